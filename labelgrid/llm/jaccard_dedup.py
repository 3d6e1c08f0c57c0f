"""Near-duplicates by Jaccard similarity of word shingles: SimHash candidates first, then every pair that they leave open.

Two texts are linked if their sets of five-word shingles (ASCII letters lowered, blanks as in op8) have a Jaccard similarity of at least
``SIMILARITY``, a fraction in whole numbers; components of links are near-duplicates. A text of fewer words has one shingle of all its words;
texts without words are equal to each other.

1. Equal sets become one node. Nodes have a SimHash of their shingles; the generalised pigeonhole (see ``simhash``) finds a forest of links between
   near fingerprints, which joins most groups of near copies by as many pairs as they have members.
2. No fixed distance of fingerprints has all pairs of that similarity, so an exact search follows. With all shingles in one order, two such sets share one of the
   first ``n - ceil(t * n) + 1`` of either side, whatever the order. Shingles common in a sample of ``SAMPLE`` texts come last. Only shingles that two sets have in
   their prefixes leave a task: a bit map tells them from the others, which are the most and are only counted.
3. Nodes that share such a shingle and are not in one component yet are candidates. For ``ROUNDS`` rounds each node meets the member with most shared shingles, then others, one a round;
   what is then still open meets pair by pair. A pair is dropped early only by exact bounds: sizes, places in the order, and parity sketches of ``SKETCH`` bits,
   which differ in no more places than the sets differ in members. A round that finds less than a tenth of all links so far is the last one.
4. Every candidate is verified on whole sets, in as many passes as keep the sets of a pass, each counted for every pair it is in, below one ``HELD``-th of those of all texts.

Texts are read where they lie, by the places of their rows in their files; only texts of candidates and of rows that may go are shuffled. Shingles are compared by 64-bit
hashes. Work tables go once nothing reads them; sketches do not travel before it is known which prefix places two sets share.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.common import BLANKS, Block, discard, grams, located, map_texts, mix, through_table
from labelgrid.llm.components import components
from labelgrid.llm.simhash import links as simhash_links
from labelgrid.llm.superstrings import _bitmap, admits

SHINGLE, SIMILARITY, DISTANCE = 5, (4, 5), 3
SAMPLE, COMMON, LISTED = 20_000, 4, 65_536
ROUNDS, FEW = 4, 10
HELD, HELD_LEAST = 2, 1 << 24  # a pass of verification reads sets of half of all shingles at most, or of so many; a set counts for each of its pairs
SKETCH, LANES = 512, 8
TEXT_BLOCK = 1 << 19  # bytes of text that a task takes at once
_AT = "at struct<file:bigint,place:bigint>"
_SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(block: Block, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """doc, hash of the distinct shingles of each document of a block, in this order."""
    words = block.lowered().words(BLANKS)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes, counts = words.hashes(), words.counts()
    values = grams(hashes, shingle)
    first = np.flatnonzero(words.left(shingle)[: len(values)])
    doc, value = [words.doc()[first]], [values[first]]
    for size in range(1, shingle):
        few = np.flatnonzero(counts == size)
        if len(few):
            doc.append(few)
            value.append(mix(grams(hashes, size)[words.at[few]] + np.uint64(size)))
    doc, value = np.concatenate(doc), np.concatenate(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[fresh], value[fresh]


def _bounds(doc: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(n + 1))


def _digests(value: np.ndarray, at: np.ndarray) -> list[bytes]:
    return [hashlib.md5(value[a:b].tobytes()).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def set_fingerprints(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHash of each set of a block: the majority of its members' bits; zero for an empty one."""
    out, size = np.zeros(len(at) - 1, np.uint64), np.diff(at)
    some = np.flatnonzero(size)
    for part in np.array_split(some, max(1, len(value) >> 17)):
        if len(part):
            own = value[at[part[0]] : at[part[-1] + 1]]
            bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, at[part] - at[part[0]], axis=0, dtype=np.int32)
            out[part] = np.packbits(2 * sums > size[part][:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def parity_sketches(value: np.ndarray, at: np.ndarray, some: np.ndarray) -> np.ndarray:
    """``SKETCH`` parities of each set that ``some`` names, as rows of ``LANES`` words of 64 bits."""
    out = np.zeros((len(some), LANES), np.int64)
    bit = (mix(value ^ _SCRAMBLE) >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    for first in range(0, len(some), 1024):
        part = some[first : first + 1024]
        size = at[part + 1] - at[part]
        row = np.repeat(np.arange(len(part)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[part], size)
        odd = (np.bincount(row * SKETCH + bit[place], minlength=len(part) * SKETCH) & 1).astype(np.uint8)
        out[first : first + len(part)] = np.packbits(odd.reshape(len(part), SKETCH), axis=1, bitorder="little").view("<i8")
    return out


def _place_hash() -> Column:
    return F.xxhash64("at.file", "at.place")


def _among(rows: DataFrame, wanted: DataFrame) -> Column:
    """Whether a row may be at one of the wanted places: never false for one of them. The map that tells is of fixed size."""
    held = rows.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(_place_hash().alias("m"))))

    def may(place: pd.Series) -> pd.Series:
        return pd.Series(admits(held.value, place.to_numpy(np.int64).view(np.uint64)))

    return F.pandas_udf(may, "boolean")(_place_hash())


def _row_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """at, doc_id, digest and size of its set, fingerprint of it."""

    def run(block: Block, batch: pa.RecordBatch) -> dict:
        doc, value = shingle_sets(block, shingle)
        at = _bounds(doc, len(block))
        return {
            "at": batch.column("at"), "doc_id": batch.column("doc_id"), "digest": pa.array(_digests(value, at), pa.binary()),
            "n": pa.array(np.diff(at), pa.int32()), "fp": pa.array(set_fingerprints(value, at).view(np.int64)),
        }

    return map_texts(rows, run, f"{_AT}, doc_id bigint, digest binary, n int, fp bigint", limit=TEXT_BLOCK)


def _common(rows: DataFrame, n_rows: int, shingle: int) -> np.ndarray:
    """Shingles common in a sample of the texts, chosen by hash, rarest first; at most ``LISTED`` reach the driver."""
    every = max(1, n_rows // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)

    def run(block: Block, batch: pa.RecordBatch) -> dict:
        value, n = np.unique(shingle_sets(block, shingle)[1], return_counts=True)
        return {"g": pa.array(value.view(np.int64)), "n": pa.array(n, pa.int64())}

    counts = map_texts(sample, run, "g bigint, n bigint", limit=TEXT_BLOCK).groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "g").limit(LISTED).collect()
    return np.array([r["g"] for r in reversed(found)], np.int64).view(np.uint64)


def _prefixes(rows: DataFrame, common: np.ndarray, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """digest, n, sketch (s0 to s7), g and pos (arrays) of each row with a prefix shingle that another set has in its prefix."""
    num, den = similarity
    by_value = np.argsort(common)
    context = rows.sparkSession.sparkContext
    held = context.broadcast((common[by_value], by_value + 1))

    def prefixes(block: Block):
        """Bounds, members of the block's distinct sets and their digests; then doc, place and scrambled shingle of each prefix place."""
        doc, value = shingle_sets(block, shingle)
        at = _bounds(doc, len(block))
        names, first = _digests(value, at), {}
        lead = np.zeros(len(block), bool)
        for i, name in enumerate(names):
            lead[i] = first.setdefault(name, i) == i
        known, place = held.value
        rank = np.zeros(len(value), np.int64)
        if len(known):
            near = np.minimum(np.searchsorted(known, value), len(known) - 1)
            rank = np.where(known[near] == value, place[near], 0)
        order = np.lexsort((value, rank, doc))
        size = np.diff(at)
        pos, n = np.arange(len(doc)) - at[doc], size[doc]
        kept = np.flatnonzero((pos < n - -(-num * n // den) + 1) & lead[doc])
        return at, value, names, doc[kept], pos[kept], mix(value[order[kept]] + _SCRAMBLE)

    def count(block: Block, batch: pa.RecordBatch) -> dict:
        _, _, names, doc, _, g = prefixes(block)
        short = np.frombuffer(b"".join(n[:8] for n in names), np.int64)
        return {"m": pa.array(g.view(np.int64)), "s": pa.array(short[doc])}

    # A shingle is shared if sets of two digests have it in their prefixes; equal sets are one.
    seen = map_texts(rows.select("text"), count, "m bigint, s bigint", limit=TEXT_BLOCK).groupBy("m").agg(F.min("s").alias("least"), F.max("s").alias("most"))
    table = context.broadcast(_bitmap(seen.where("least <> most").select("m")))

    def emit(block: Block, batch: pa.RecordBatch) -> dict | None:
        at, value, names, doc, pos, g = prefixes(block)
        yes = admits(table.value, g)
        doc, pos, g = doc[yes], pos[yes], g[yes]
        some, start = np.unique(doc, return_index=True)
        if not len(some):
            return None
        ends = pa.array(np.append(start, len(doc)), pa.int32())
        sketch = parity_sketches(value, at, some)
        return {
            "digest": pa.array([names[i] for i in some.tolist()], pa.binary()), "n": pa.array(np.diff(at)[some], pa.int32()),
            **{f"s{j}": pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(LANES)},
            "g": pa.ListArray.from_arrays(ends, pa.array(g.view(np.int64))), "pos": pa.ListArray.from_arrays(ends, pa.array(pos, pa.int32())),
        }

    lanes = ", ".join(f"s{j} bigint" for j in range(LANES))
    return map_texts(rows.select("text"), emit, f"digest binary, n int, {lanes}, g array<bigint>, pos array<int>", limit=TEXT_BLOCK)


def _near(similarity: tuple[int, int], a: str = "_a", b: str = "_b") -> Column:
    """Whether sizes and sketches allow that similarity: sets of it differ in (den - num) / (den + num) of their members at most."""
    num, den = similarity
    both = F.col(f"n{a}") + F.col(f"n{b}")
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"s{j}{a}").bitwiseXOR(F.col(f"s{j}{b}"))) for j in range(LANES)])
    return (bits * (num + den) <= both * (den - num)) & (F.least(f"n{a}", f"n{b}") * den >= F.greatest(f"n{a}", f"n{b}") * num)


def _side(members: DataFrame, suffix: str, *columns: str) -> DataFrame:
    return members.select(*[F.col(c).alias(f"{c}{suffix}") for c in ("node", "n", *[f"s{j}" for j in range(LANES)], *columns)])


def _verified(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """a, b, similar: every pair, judged on whole sets."""
    pairs = through_table(pairs.select("a", "b").distinct(), "candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("times"))
    load = nodes.join(asked, "node", "left").agg(F.sum(F.col("n").cast("long") * F.coalesce("times", F.lit(0))), F.sum("n")).first()
    passes = max(1, -(-(load[0] or 0) // max(HELD_LEAST, (load[1] or 0) // HELD)))
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(passes))
    judged = [_judged(rows, nodes, pairs if passes == 1 else pairs.where(turn == i), shingle, similarity) for i in range(passes)]
    discard(pairs)
    return reduce(DataFrame.unionByName, judged)


def _judged(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """``_verified`` in one pass over the texts."""
    num, den = similarity

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    places = through_table(nodes.join(asked, "node").select("node", "at"), "candidate-places")
    held = rows.sparkSession.sparkContext.broadcast(_bitmap(places.select(_place_hash().alias("m"))))

    def run(block: Block, batch: pa.RecordBatch) -> dict | None:
        """Sets of the texts that may be at one of the places; the join with the places tells for sure."""
        some = np.flatnonzero(admits(held.value, batch.column("place").to_numpy().view(np.uint64)))
        if not len(some):
            return None
        chosen = [block.text(i) for i in some.tolist()]
        doc, value = shingle_sets(Block(b"".join(chosen), np.concatenate([[0], np.cumsum([len(t) for t in chosen])])), shingle)
        return {
            "at": batch.column("at").take(pa.array(some)),
            "items": pa.ListArray.from_arrays(pa.array(_bounds(doc, len(some)), pa.int32()), pa.array(value.view(np.int64))),
        }

    sets = map_texts(rows.select("at", _place_hash().alias("place"), "text"), run, f"{_AT}, items array<bigint>", limit=TEXT_BLOCK)
    sets = through_table(sets.join(places, "at").select("node", "items"), "candidate-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    enough = F.size(F.array_intersect("x", "y")) * (num + den) >= num * (F.size("x") + F.size("y"))
    judged = through_table(both.select("a", "b", enough.alias("similar")), "judged-pairs")
    discard(places, sets)
    return judged


def similar(rows: DataFrame, nodes: DataFrame, n_rows: int, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """a, b: links whose components are those of all pairs of nodes of that similarity.

    ``rows`` (at, text) holds the texts, ``nodes`` (node, digest, n, fp, at) one place for each distinct set.
    """
    num, den = similarity
    found = _prefixes(rows, _common(rows, n_rows, shingle), shingle, similarity)
    lanes = [f"s{j}" for j in range(LANES)]
    # Equal sets of several blocks are one node.
    emitted = through_table(found, "prefixes")
    found = emitted.dropDuplicates(["digest"]).join(nodes.select("digest", "node"), "digest")
    found = through_table(found.select("node", "n", *lanes, F.arrays_zip("g", "pos").alias("own")), "prefix-nodes")
    discard(emitted)
    each = found.select("node", F.explode("own").alias("own")).select("node", "own.g", "own.pos")
    shared = each.groupBy("g").agg(F.count("*").alias("members")).where("members > 1")
    places = through_table(each.join(shared.select("g"), "g"), "shared-prefixes")

    # Forest links of near fingerprints; nodes of one fingerprint are linked to the least of them.
    prints = through_table(nodes.groupBy("fp").agg(F.min("node").alias("least")), "set-fingerprints")
    joined = simhash_links(prints, DISTANCE)
    pairs = joined.join(prints.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select("x", "y")
    pairs = pairs.unionByName(nodes.join(prints, "fp").where("node <> least").select(F.col("least").alias("x"), F.col("node").alias("y")))
    pairs = pairs.join(_side(found, "_a").withColumnRenamed("node_a", "x"), "x").join(_side(found, "_b").withColumnRenamed("node_b", "y"), "y").where(_near(similarity))
    judged = _verified(rows, nodes, pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), shingle, similarity)

    votes = places.groupBy("node").agg(F.count("*").alias("votes"))
    members = through_table(places.join(found.select("node", "n", *lanes).join(votes, "node"), "node"), "voting-prefixes")
    discard(places, found, prints)
    linked = judged.where("similar").count()
    for turn in range(ROUNDS + 1):
        roots = through_table(components(judged.where("similar").select("a", "b")), "similar-roots")
        known = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        lead = F.min(F.struct((F.lit(0) - F.col("votes") if turn == 0 else F.xxhash64("node", F.lit(turn))).alias("by"), *[F.col(c) for c in ("node", "n", *lanes, "root")])).alias("lead")
        buckets = through_table(known.groupBy("g").agg(lead, (F.min("root") != F.max("root")).alias("open")).where("open").drop("open"), "open-buckets")
        if turn == ROUNDS or (turn and fresh * FEW < linked):
            break
        met = _side(known, "_a", "g", "root").join(buckets.select(F.col("g").alias("g_a"), *[F.col(f"lead.{c}").alias(f"{c}_b") for c in ("by", "node", "n", *lanes, "root")]), "g_a")
        met = met.where((F.col("root_a") != F.col("root_b")) & _near(similarity)).groupBy("node_a").agg(F.min(F.struct("by_b", "node_b")).alias("lead"))
        pairs = met.select(F.least("node_a", "lead.node_b").alias("a"), F.greatest("node_a", "lead.node_b").alias("b"))
        made = _verified(rows, nodes, pairs.join(judged.select("a", "b"), ["a", "b"], "left_anti"), shingle, similarity)
        fresh = made.where("similar").count()
        judged, linked = judged.unionByName(made), linked + fresh
        discard(buckets, roots)

    left = known.join(buckets.select("g"), "g", "left_semi")
    a, b = (_side(left, s, "g", "pos", "root") for s in ("_a", "_b"))
    # Places and sizes bound what a pair can share if this is the first shingle that it shares.
    most = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    fits = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & (most * (num + den) >= num * (F.col("n_a") + F.col("n_b"))) & _near(similarity)
    pairs = a.join(b, (F.col("g_a") == F.col("g_b")) & fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    judged = judged.unionByName(_verified(rows, nodes, pairs.join(judged.select("a", "b"), ["a", "b"], "left_anti"), shingle, similarity))
    discard(members, buckets, roots)
    return judged.where("similar").select("a", "b")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each component the row with the smallest doc_id stays, of equal ids the first row.

    Rows are told apart by their places in the stage's input, not by doc_id. A null doc_id comes after all others. A null text is empty.
    """
    table = located(docs)
    rows = table.select("at", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    sets = through_table(_row_sets(rows, shingle), "row-sets")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at")
    nodes = sets.groupBy("digest").agg(F.min(rank).alias("first"), F.max("n").alias("n"), F.max("fp").alias("fp"))
    nodes = through_table(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "n", "first", "fp", F.col("first.at").alias("at")), "distinct-sets")
    found = similar(rows, nodes, sets.count(), shingle, similarity)
    roots = nodes.select("node", "first").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = through_table(roots.groupBy("root").agg(F.min("first").alias("first")).select("first.at"), "kept-rows")
    drop = through_table(sets.select("at").join(kept, "at", "left_anti"), "later-copies")
    # Only rows that may be among those to drop are shuffled.
    marked = table.withColumn("may_go", _among(table, drop))
    discard(sets, nodes, kept)
    return marked.where("not may_go").unionByName(marked.where("may_go").join(drop, "at", "left_anti")).select("row.*")
