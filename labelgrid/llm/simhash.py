"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of all documents are collapsed to distinct ones. Over all of them the bits' shares of ones and their
correlations are summed; correlated bits go into one partition. If the thresholds of the partitions add up to
``distance - partitions + 1``, two fingerprints within ``distance`` bits lie within the threshold of at least one partition (-1 leaves a partition out).
A dynamic program picks the thresholds that give the fewest expected candidates and signatures. Fingerprints meet in
the buckets of their signatures and every candidate is verified on all 64 bits.

A bucket of more than ``BUCKET`` fingerprints is split anew on the bits that its members do not share by construction, again by the
pigeonhole; at most six rounds leave none. A bucket yields the edges of a spanning forest, not its pairs, and components are found by star
contraction. Copies share one fingerprint and cost one row per document.

Null, empty and blank texts have fingerprint zero and link to each other like any other; a null doc_id is never the
smallest id unless its component has no other. Repeated rows are repeated in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.common import BLANKS, Block, id_and_text, map_texts, through_table
from labelgrid.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
BUCKET = 4096

_SPACED = bytes(0x20 if BLANKS[c] else c for c in range(256))


def fingerprints(block: Block, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprint of each document of a block."""
    block = block.lowered()
    words = block.words(BLANKS)
    counts, out = words.counts(), np.zeros(len(block), np.uint64)
    data = block.data.translate(_SPACED)
    first = np.flatnonzero(words.left(shingle))
    last = first + shingle - 1
    few = np.flatnonzero((counts > 0) & (counts < shingle))
    first, last = np.concatenate([first, words.at[few]]), np.concatenate([last, words.at[few + 1] - 1])
    order = np.argsort(first, kind="stable")
    first, last = first[order], last[order]
    if not len(first):
        return out
    start, end = words.start[first], words.end[last]
    letters = np.concatenate([[0], np.cumsum(words.end - words.start)])
    single = (end - start) == letters[last + 1] - letters[first] + (last - first)
    spans = zip(start.tolist(), end.tolist())
    digest = xxhash.xxh64_intdigest
    if single.all():
        values = [digest(data[a:b], SEED) for a, b in spans]
    else:
        values = [digest(data[a:b] if s else b" ".join(data[a:b].split()), SEED) for (a, b), s in zip(spans, single.tolist())]
    bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    doc = words.doc()[first]
    opens = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    sums = np.add.reduceat(bits, opens, axis=0, dtype=np.int32)
    number = np.diff(np.append(opens, len(doc)))
    majority = (2 * sums > number[:, None]).astype(np.uint8)
    out[doc[opens]] = np.packbits(majority, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 table of how many have two bits set; 4,096 sums reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            values = np.ascontiguousarray(batch.column("fp").to_numpy()).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        if n:
            place = np.append(np.arange(4096), 4096)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(np.append(both.reshape(-1), n).astype(np.int64))], names=["place", "n"])

    rows = prints.select("fp").mapInArrow(partial, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(4097)
    for row in rows:
        table[row["place"]] = row["n"]
    return int(table[4096]), table[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of the bits, each grown around a bit by the strongest mean correlation."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    strength = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    free, groups = set(range(64)), []
    for left in range(parts, 0, -1):
        size = -(-len(free) // left)
        group = [max(sorted(free), key=lambda b: strength[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            nearest = max(sorted(free), key=lambda b: strength[b, group].mean())
            group.append(nearest)
            free.discard(nearest)
        groups.append(sorted(group))
    return groups


def allocate(n: int, both: np.ndarray, groups: list[list[int]], distance: int) -> list[int]:
    """Threshold of each partition (-1: unused) with the least expected candidates plus signatures."""
    share = np.diag(both) / max(n, 1)
    differ = 2 * share * (1 - share)
    costs = []
    for group in groups:
        near = np.zeros(distance + 2)
        near[0] = 1.0
        for b in group:
            near[1:] = near[1:] * (1 - differ[b]) + near[:-1] * differ[b]
            near[0] *= 1 - differ[b]
        cost, chance, keys = [0.0], 0.0, 0
        for t in range(distance + 1):
            chance, keys = chance + near[t], keys + comb(len(group), t)
            cost.append(n * n / 2 * chance * keys + n * keys)
        costs.append(cost)
    # best[s]: least cost of the partitions so far with thresholds that add up to s, shifted by one per partition.
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t, c in enumerate(cost):
                if total + t <= distance + 1 and (total + t not in step or spent + c < step[total + t][0]):
                    step[total + t] = (spent + c, [*chosen, t - 1])
        best = step
    return best[distance + 1][1]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _signatures(prints: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """bucket, fixed (bits that all members share by construction), fp."""
    keys = []
    for i, (group, threshold) in enumerate(zip(groups, thresholds)):
        if threshold < 0:
            continue
        own = F.col("fp").bitwiseAND(F.lit(_mask(group)))
        flips = [[]]
        for _ in range(threshold):
            flips += [f + [b] for f in flips for b in group if not f or b > f[-1]]
        flips = [list(x) for x in dict.fromkeys(map(tuple, flips))]
        fixed = _mask(group) if threshold == 0 else 0
        keys += [F.struct(F.xxhash64(F.lit(i), own.bitwiseXOR(F.lit(_mask(f)))).alias("bucket"), F.lit(fixed).cast("bigint").alias("fixed")) for f in flips]
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.bucket", "k.fixed", "fp")


def _split(hot: DataFrame, distance: int) -> DataFrame:
    """Signatures of hot buckets on the bits still free, dealt in turn to ``distance + 1`` parts that must match exactly."""
    parts = distance + 1
    masks = []
    for j in range(parts):
        bit = [F.when(F.col("fixed").bitwiseAND(F.lit(_mask([b]))) == 0, 1).otherwise(0) for b in range(64)]
        rank, mask = F.lit(0), F.lit(0).cast("bigint")
        for b in range(64):
            mask = mask.bitwiseOR(F.when((bit[b] == 1) & (rank % parts == j), F.lit(_mask([b]))).otherwise(F.lit(0)).cast("bigint"))
            rank = rank + bit[b]
        masks.append(mask)
    keys = [
        F.struct(F.xxhash64("bucket", F.lit(j), F.col("fp").bitwiseAND(F.col("part")[j])).alias("bucket"), F.col("fixed").bitwiseOR(F.col("part")[j]).alias("fixed"))
        for j in range(parts)
    ]
    # The parts of a set of fixed bits are worked out once for each distinct set, of which there are a few for each round.
    table = hot.select("fixed").distinct().select("fixed", F.array(*masks).alias("part"))
    return hot.join(table, "fixed").select("fp", F.explode(F.array(*keys)).alias("k")).select("k.bucket", "k.fixed", "fp")


def _forest(bucket: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over verified pairs of each bucket; rows are sorted by bucket."""
    n = len(fp)
    label = np.arange(n)
    left, right = [], []
    rows, d = np.arange(n), 1
    while True:
        rows = rows[rows + d < n]
        rows = rows[bucket[rows] == bucket[rows + d]]
        if not len(rows):
            break
        near = rows[np.bitwise_count(fp[rows] ^ fp[rows + d]) <= distance]
        left.append(near)
        right.append(near + d)
        if sum(map(len, left)) > 4 * n:
            label = _hook(label, np.concatenate(left), np.concatenate(right))
            left, right = [], []
        d += 1
    if left:
        label = _hook(label, np.concatenate(left), np.concatenate(right))
    joined = np.flatnonzero(label != np.arange(n))
    return fp[joined], fp[label[joined]]


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label over links, by hooking and pointer jumping."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def links(prints: DataFrame, distance: int = DISTANCE, bucket_size: int = BUCKET) -> DataFrame:
    """a, b: links whose components are those of all pairs of distinct fingerprints within ``distance`` bits."""
    n, both = bit_statistics(prints)
    groups = group_bits(n, both, distance + 1)
    rows = _signatures(prints, groups, allocate(n, both, groups, distance))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int64), np.zeros(0, np.uint64))

        def out(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _forest(bucket, fp, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            bucket = np.concatenate([kept[0], batch.column("bucket").to_numpy()])
            fp = np.concatenate([kept[1], batch.column("fp").to_numpy().view(np.uint64)])
            # The last bucket may go on in the next batch.
            whole = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            if whole:
                yield out(bucket[:whole], fp[:whole])
            kept = (bucket[whole:], fp[whole:])
        if len(kept[0]):
            yield out(*kept)

    found = None
    while True:
        rows = through_table(rows, "signatures")
        sizes = through_table(rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "bucket-sizes")
        cold = rows.join(sizes.where(F.col("members") <= bucket_size), "bucket").select("bucket", "fp").distinct()
        made = cold.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(verify, "a bigint, b bigint")
        found = made if found is None else found.unionByName(made)
        hot = sizes.where(F.col("members") > bucket_size)
        if hot.isEmpty():
            return found
        rows = _split(rows.join(hot, "bucket").select("bucket", "fixed", "fp"), distance)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, bucket_size: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""

    def run(block: Block, rows: pa.RecordBatch) -> dict:
        return {"doc_id": rows.column("doc_id"), "fp": pa.array(fingerprints(block, shingle).view(np.int64))}

    docs = through_table(map_texts(id_and_text(docs), run, "doc_id bigint, fp bigint"), "fingerprints")
    prints = through_table(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(prints, distance, bucket_size)).withColumnRenamed("node", "fp")
    known = prints.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of = known.join(ids, "root").select("fp", "component_id")
    return docs.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
