"""Prefix trie of conversations by a sparse table over sorted common prefixes.

A conversation becomes a path: ``ITEM`` bytes for each turn, the MD5 of its role and text and the number of its words. Equal paths are
one row with a weight and its least id before they are sorted, so a group of copies costs one row. Paths are sorted over the cluster
by ranges. In a block of sorted paths the lengths of common prefixes of neighbours go into a sparse table of range minima; each prefix of each path
then finds by binary search, on its own, how far to the left and to the right paths share it. That interval holds the members of a node, and all
of the node's numbers are sums over it.

Common prefixes at the edges of blocks are known, so sums of a block count every path, node and leaf once over all blocks. Only nodes that reach over an
edge, at most the turns of two paths an edge, are summed up by key.

Turns are ordered by turn (null first); turns of equal numbers by the MD5 of role and text. A null role or text is empty. Rows without a conv_id belong
to no conversation and are left out. An empty table has no nodes, not even a root. Other columns are not read. The
turns of one conversation must fit a task, at about 100 bytes a turn; texts do not travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelgrid.llm.common import checkpointed, small_batches, through_table

FAMILY, HEADS = 20, 4
ITEM, DIGEST = 20, 16
TURNS = 1 << 18
ID_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").digest()
NODES = (
    "key binary, parent_key binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends binary"
)


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, item (hex) of every row with a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    item = F.concat(F.upper(digest), F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("bigint")), 8, "0"))
    return conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), item.alias("item")).where("conv_id is not null")


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path of every conversation as it stands."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("turn", "item"))), lambda t: t["item"])
    return _turns(conversations).groupBy("conv_id").agg(F.unhex(F.array_join(items, "")).alias("path"))


def rebuilt(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """conv_id, path of every conversation c after its first turns, crc32(c) modulo ``heads`` of them, gave way to those of c - c % ``family``.

    Rows of a family meet in one place, so that its turns are shuffled once.
    """
    turns = _turns(conversations).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).repartition("base")
    items = F.transform(F.sort_array(F.collect_list(F.struct("turn", "item"))), lambda t: t["item"])
    own = turns.groupBy("base", "conv_id").agg(items.alias("items"))
    first = own.where("conv_id = base").select("base", F.slice("items", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    rest = F.slice("items", h + 1, F.greatest(F.size("items") - h, F.lit(0)))
    return own.join(first, "base", "left").select("conv_id", F.unhex(F.array_join(F.concat(head, rest), "")).alias("path"))


def _end_digests(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """key, ends: SHA-256 of the ascending ids of each path that several conversations have.

    Ids are packed by runs of 2**``ID_BITS`` numbers; a digest reads the packs of its path one after the other, as SHA-256 must, holding one.
    """
    run = F.shiftright("conv_id", ID_BITS)
    packs = rows.join(copies, "key", "left_semi").groupBy("key", run.alias("run")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            keys, ends = [], []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    keys.append(now)
                    ends.append(state.digest())
                now, state = key, hashlib.sha256(ids.encode())
            yield _pairs(keys, ends)
        if now is not None:
            yield _pairs([now], [state.digest()])

    def _pairs(keys: list[bytes], ends: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.binary())], names=["key", "ends"])

    return packs.repartition("key").sortWithinPartitions("key", "run").select("key", "ids").mapInArrow(digest, "key binary, ends binary")


def common_turns(a: bytes | None, b: bytes | None) -> int:
    """Number of turns that two paths share at their beginning; -1 if one of them is missing."""
    if a is None or b is None:
        return -1
    most = min(len(a), len(b)) // ITEM
    x, y = (np.frombuffer(p, np.uint8, most * ITEM).reshape(-1, ITEM) for p in (a, b))
    unlike = np.flatnonzero((x != y).any(axis=1))
    return int(unlike[0]) if len(unlike) else most


def _edges(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """Of each partition with rows the turns that its first path shares with the path before it, and its last with the one behind it."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if len(batch):
                path = batch.column("path")
                first = path[0].as_py() if first is None else first
                last = path[len(path) - 1].as_py()
        if first is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], names=["part", "first", "last"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, first, last, before, after = (batch.column(c).to_pylist() for c in ("part", "first", "last", "before", "after"))
            out = [list(map(common_turns, x, y)) for x, y in ((before, first), (last, after))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (part, *out)], names=["part", "before", "after"])

    # One row for each partition, whatever the number of conversations.
    rows = ordered.select("path").mapInArrow(ends, "part int, first binary, last binary")
    line = Window.orderBy("part")
    rows = rows.select("*", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("after"))
    return {r["part"]: (r["before"], r["after"]) for r in rows.mapInArrow(shared, "part int, before int, after int").collect()}


class Minima:
    """Sparse table: minima of all runs of 2**k values, so that any range takes two look-ups."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minimum from ``left`` to ``right``, both included."""
        out = np.empty(len(left), self.levels[0].dtype)
        level = np.frexp((right - left + 1).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self.levels[k]
            out[at] = np.minimum(table[left[at]], table[right[at] - (1 << k) + 1])
        return out

    def reach_left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest l of each place so that all values behind l up to the place are ``least`` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step, table = 1 << k, self.levels[k]
            can = np.flatnonzero(at >= step)
            can = can[table[at[can] - step + 1] >= least[can]]
            at[can] -= step
        return at

    def reach_right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Largest r of each place so that all values behind the place up to r are ``least`` or more."""
        at, n = at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            step, table = 1 << k, self.levels[k]
            can = np.flatnonzero(at + step < n)
            can = can[table[at[can] + 1] >= least[can]]
            at[can] += step
        return at


def block_nodes(rows: list[bytes], weight: np.ndarray, least: np.ndarray, ends: list[bytes], before: int, after: int) -> pa.RecordBatch:
    """Nodes of a block of sorted distinct paths; ``before`` and ``after`` are the turns shared with the paths around the block."""
    n = len(rows)
    size = np.fromiter(map(len, rows), np.int64, n) // ITEM
    off = np.concatenate([[0], np.cumsum(size)])
    flat = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, ITEM)
    words = np.concatenate([[0], np.cumsum(np.ascontiguousarray(flat[:, DIGEST:]).view(">u4").reshape(-1).astype(np.int64))])

    # Common prefixes of neighbours: the first turn that differs.
    both = np.minimum(size[1:], size[:-1])
    row = np.repeat(np.arange(1, n), both)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
    unlike = np.flatnonzero((flat[off[row] + turn] != flat[off[row - 1] + turn]).any(axis=1)) if len(row) else np.zeros(0, np.int64)
    shared = np.concatenate([[before], both])
    np.minimum.at(shared, row[unlike], turn[unlike])
    inner = shared.copy()
    inner[0] = -1

    # Every prefix of every path is a candidate and finds its interval by itself.
    minima, smallest = Minima(inner), Minima(least)
    at = np.repeat(np.arange(n), size + 1)
    first = off[:-1] + np.arange(n)
    depth = np.arange(len(at)) - first[at]
    left, right = minima.reach_left(at, depth), minima.reach_right(at, depth)
    member = smallest.of(left, right)
    beyond_left = (left == 0) & (before >= depth)
    beyond = beyond_left | ((right == n - 1) & (after >= depth))

    node = np.flatnonzero(left == at)
    d, l, r = depth[node], left[node], right[node]
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    own = words[off[1:]] - words[off[:-1]]
    upto = lambda i, k: words[off[i] + k] - words[off[i]]
    members = total(weight)
    members = members[r + 1] - members[l]
    leaf = total(np.append(shared[1:], after) < size)
    fresh = total(own - upto(np.arange(n), np.maximum(shared, 0)))
    read = total(weight * own)
    read = read[r + 1] - read[l] - members * upto(l, np.maximum(d - 1, 0))
    once = fresh[r + 1] - fresh[l + 1] + own[l] - upto(l, np.maximum(np.maximum(d - 1, shared[l]), 0))
    forks = np.sort(inner[1:] * np.int64(n) + np.arange(1, n))
    forks = np.searchsorted(forks, d * n + r, "right") - np.searchsorted(forks, d * n + l, "right")
    children = forks + ((size[l] > d) & (shared[l] <= d))

    up = node - 1
    has_parent = d > 0
    known = has_parent & ~beyond[np.maximum(up, 0)]
    cache: dict[tuple[int, int], bytes] = {}

    def key(i: int, k: int, group: int) -> bytes:
        """Name of the prefix of ``k`` turns; ``group`` is the first path of the block that has it."""
        if (group, k) not in cache:
            cache[group, k] = hashlib.md5(rows[i][: k * ITEM]).digest()
        return cache[group, k]

    open_ = beyond[node]
    own_key = [key(i, k, i) if o else None for i, k, o in zip(l.tolist(), d.tolist(), open_.tolist())]
    asks = (has_parent & ~known).tolist()
    parent_key = [key(i, k - 1, g) if ask else None for i, k, g, ask in zip(l.tolist(), d.tolist(), left[np.maximum(up, 0)].tolist(), asks)]
    end = [ends[i] if e else None for i, e in zip(l.tolist(), (size[l] == d).tolist())]
    columns = [
        pa.array(own_key, pa.binary()), pa.array(parent_key, pa.binary()), pa.array(member[node]), pa.array(d), pa.array(member[np.maximum(up, 0)], mask=~known),
        pa.array(members), pa.array(children), pa.array(leaf[r + 1] - leaf[l]), pa.array(read - once), pa.array(end, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NODES.split(", ")])


def trie(sequences: DataFrame) -> DataFrame:
    """All nodes of the trie over ``sequences`` (conv_id, path); columns as ``conversation_trie``."""
    spark = sequences.sparkSession
    small_batches(sequences)
    rows = through_table(sequences.select("conv_id", "path", F.unhex(F.md5("path")).alias("key")), "conversation-paths")
    distinct = through_table(rows.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")), "distinct-paths")
    ends = _end_digests(rows.select("conv_id", "key"), distinct.where("n > 1").select("key"))
    one = F.unhex(F.sha2(F.col("least").cast("string"), 256))
    several = distinct.where("n > 1").join(ends, "key").select("path", "n", "least", "ends")
    every = distinct.where("n = 1").select("path", "n", "least", one.alias("ends")).unionByName(several)
    ordered = checkpointed(every.repartitionByRange("path").sortWithinPartitions("path"))
    around = spark.sparkContext.broadcast(_edges(ordered))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int, bytes]] = []
        before, after, turns = None, None, 0

        def made(rest: int) -> pa.RecordBatch:
            path, weight, least, ends = zip(*held)
            return block_nodes(list(path), np.array(weight, np.int64), np.array(least, np.int64), list(ends), before, rest)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "n", "least", "ends"))):
                if before is None:
                    before, after = around.value[TaskContext.get().partitionId()]
                if turns >= TURNS:
                    rest = common_turns(held[-1][0], row[0])
                    yield made(rest)
                    before, held, turns = rest, [], 0
                held.append(row)
                turns += len(row[0]) // ITEM + 1
        if held:
            yield made(after)

    found = through_table(ordered.mapInArrow(nodes, NODES), "conversation-nodes")
    names = [c.split()[0] for c in NODES.split(", ")][2:]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    over = found.where("key is not null").groupBy("key").agg(
        F.first("parent_key", True).alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.min("parent_conv_id").alias("parent_conv_id"), *sums, F.max("ends").alias("ends")
    )
    over = through_table(over, "nodes-over-edges")
    every = found.where("key is null").select("parent_key", *names).unionByName(over.select("parent_key", *names))
    tops = over.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    below = every.where("parent_key is not null").join(tops, "parent_key").withColumn("parent_conv_id", F.col("parent"))
    out = every.where("parent_key is null").select(*names).unionByName(below.select(*names))
    return out.select(*names[:-1], F.lower(F.hex(F.coalesce("ends", F.lit(bytearray(EMPTY))))).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node over the rebuilt conversations."""
    return trie(rebuilt(conversations, family, heads))
