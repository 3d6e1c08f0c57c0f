"""Repeated windows of whole texts: super-strings around minimisers, dealt to buckets.

A window is a run of ``size`` items (bytes or words) of one text. Its minimiser is the ``gram`` in it with the least hash, the last one of
equal ones; equal windows have equal minimisers. Consecutive windows that share a minimiser travel as one packed string to the
minimiser's bucket, so all places where a window starts meet there, each once.

* Minimisers are counted over all texts first. Those that occur twice set a bit in a map of fixed size, and only runs
  that it admits are packed; on a corpus that fills the map more runs travel, none is lost.
* Equal texts and equal strings of a block of texts are one row with a weight before they are shuffled.
* Minimisers with a very large count, and buckets that outgrow ``BUCKET`` bytes, go another way: their windows are dealt one by one by
  content, so no task holds them together.
* Found windows go back to the texts by content keys; texts are joined once, at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.common import BLANKS, BLOCK, Block, grams, id_and_text, map_texts, merge_spans, mix, shuffles_released, sliding, small_batches, through_table

MAP_BITS, SLICE_BITS = 25, 20
HOT_LEAST, HOT_KEYS = 1000, 1 << 16
BUCKET = 8 << 20
_SPACED = bytes(0x20 if BLANKS[c] else c for c in range(256))


class Runs(NamedTuple):
    """Windows in a row with one minimiser: text number, first item, number of windows, hash, and the packed items."""

    doc: np.ndarray
    first: np.ndarray
    wins: np.ndarray
    hash: np.ndarray
    pack: Callable[[int], bytes]


def _cut(values: np.ndarray, whole: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser place of each run; ``whole`` tells which windows are inside a text."""
    place = np.arange(len(values), dtype=np.uint64)
    order = (values & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - place)
    least = np.uint64(0xFFFFFFFF) - (sliding(order, reach) & np.uint64(0xFFFFFFFF))
    windows = np.flatnonzero(whole[: len(least)])
    own = least[windows]
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(fresh)
    return windows[at], np.diff(np.append(at, len(windows))), own[at].astype(np.int64)


def _spread(least: np.ndarray) -> np.ndarray:
    """Least hashes lie at the low end; scrambled once more they fill the bit map evenly."""
    return mix(least + np.uint64(0x9E3779B97F4A7C15))


def byte_runs(block: Block, size: int, gram: int) -> Runs:
    total, inverse = block.prefix_hash()
    n = max(0, len(block.view) - gram + 1)
    values = mix((total[gram : gram + n] - total[:n]) * inverse[:n])
    ends = np.repeat(block.at[1:], np.diff(block.at))
    first, wins, place = _cut(values, np.arange(len(ends)) + size <= ends, size - gram + 1)
    doc = np.searchsorted(block.at, first, "right") - 1
    end = (first + wins + size - 1).tolist()
    start, data = first.tolist(), block.data
    return Runs(doc, first - block.at[doc], wins, _spread(values[place]), lambda i: data[start[i] : end[i]])


def word_runs(block: Block, size: int, gram: int) -> Runs:
    words = block.words(BLANKS)
    values = grams(words.hashes(), gram)
    first, wins, place = _cut(values, words.left(size), size - gram + 1)
    doc = words.doc()[first]
    last = first + wins + size - 2
    start, end = words.start[first], words.end[last]
    letters = np.concatenate([[0], np.cumsum(words.end - words.start)])
    single = ((end - start) == letters[last + 1] - letters[first] + (last - first)).tolist()
    start, end, data = start.tolist(), end.tolist(), block.data.translate(_SPACED)

    def pack(i: int) -> bytes:
        return data[start[i] : end[i]] if single[i] else b" ".join(data[start[i] : end[i]].split())

    return Runs(doc, first - words.at[doc], wins, _spread(values[place]), pack)


def byte_windows(packed: bytes, size: int) -> list[bytes]:
    return [packed[i : i + size] for i in range(len(packed) - size + 1)]


def word_windows(packed: bytes, size: int) -> list[bytes]:
    blank = np.flatnonzero(np.frombuffer(packed, np.uint8) == 0x20)
    start = [0, *(blank + 1).tolist()]
    end = [*blank.tolist(), len(packed)]
    return [packed[a:b] for a, b in zip(start, end[size - 1 :])]


def _distinct(block: Block) -> tuple[list[bytes], np.ndarray]:
    """Content key of each text, and how many texts of the block each stands for: 0 for a repeat."""
    names, seen, weight = [], {}, np.zeros(len(block), np.int64)
    for i in range(len(block)):
        name = hashlib.md5(block.text(i)).digest()
        names.append(name)
        weight[seen.setdefault(name, i)] += 1
    return names, weight


def _bitmap(counts: DataFrame) -> np.ndarray:
    """Map of the hashes in ``counts``: each task fills slices of its own, equal slices are united, 32 of 128 kB are fetched."""
    width = 1 << (SLICE_BITS - 3)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column("m").to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)
            for number in np.unique(slot >> np.uint64(SLICE_BITS)).tolist():
                bit = slot[slot >> np.uint64(SLICE_BITS) == number] & np.uint64((1 << SLICE_BITS) - 1)
                own = slices.setdefault(number, np.zeros(width, np.uint8))
                np.bitwise_or.at(own, (bit >> np.uint64(3)).astype(np.int64), np.left_shift(1, bit & np.uint64(7)).astype(np.uint8))
        if slices:
            yield pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int32()), pa.array([s.tobytes() for s in slices.values()], pa.binary())], names=["slice", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, bits in zip(batch.column("slice").to_pylist(), batch.column("bits")):
                own = np.frombuffer(bits.as_buffer(), np.uint8)
                slices[number] = slices[number] | own if number in slices else own.copy()
        if slices:
            yield pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int32()), pa.array([s.tobytes() for s in slices.values()], pa.binary())], names=["slice", "bits"])

    with shuffles_released(counts.sparkSession):
        rows = counts.select("m").mapInArrow(fill, "slice int, bits binary").repartition("slice").mapInArrow(unite, "slice int, bits binary").collect()
    table = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for row in rows:
        table[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return table


def admits(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in a map that ``_bitmap`` made."""
    slot = hashes >> np.uint64(64 - MAP_BITS)
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


Kernel = Callable[[list[list[tuple[bytes, int]]]], list[list[np.ndarray]]]


def repeated(
    docs: DataFrame, size: int, gram: int, cut: Callable[[Block, int, int], Runs], windows: Callable[[bytes, int], list[bytes]], mark: Kernel,
    batch_bytes: int, hot_least: int = HOT_LEAST, bucket: int = BUCKET, block: int = BLOCK,
) -> DataFrame:
    """name (MD5 of a text), parts (first, ranges): repeated windows of every text that has one.

    ``ranges`` holds pairs from, to (exclusive) of windows counted from item ``first``. ``mark`` gets buckets of distinct strings with
    weights, together of about ``batch_bytes``, and returns for each string which of its windows occur twice or more.
    """
    small_batches(docs)
    texts = docs.select("text")

    def count(b: Block, rows: pa.RecordBatch) -> dict:
        _, weight = _distinct(b)
        runs = cut(b, size, gram)
        values, place = np.unique(runs.hash, return_inverse=True)
        number = np.bincount(place, weight[runs.doc], len(values)).astype(np.int64)
        return {"m": pa.array(values[number > 0].view(np.int64)), "n": pa.array(number[number > 0])}

    counts = map_texts(texts, count, "m bigint, n bigint", limit=block).groupBy("m").agg(F.sum("n").alias("n")).where("n > 1")
    counts = through_table(counts, "minimisers")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot_at = max(hot_least, -(-total // HOT_KEYS))
    # At most HOT_KEYS rows by the choice of hot_at.
    hot_rows = [r["m"] for r in counts.where(F.col("n") >= hot_at).select("m").collect()]
    shared = docs.sparkSession.sparkContext.broadcast((_bitmap(counts), np.array(sorted(hot_rows), np.int64)))

    def emit(b: Block, rows: pa.RecordBatch) -> dict | None:
        table, hot = shared.value
        names, weight = _distinct(b)
        runs = cut(b, size, gram)
        slot = runs.hash >> np.uint64(64 - MAP_BITS)
        admitted = (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        made: dict[bytes, list] = {}
        chosen = np.flatnonzero(admitted & (weight[runs.doc] > 0))
        for i, doc, first in zip(chosen.tolist(), runs.doc[chosen].tolist(), runs.first[chosen].tolist()):
            packed = runs.pack(i)
            key = hashlib.md5(packed).digest()
            row = made.setdefault(key, [i, packed, 0, [], []])
            row[2] += int(weight[doc])
            row[3].append(names[doc])
            row[4].append(first)
        if not made:
            return None
        at = np.fromiter((r[0] for r in made.values()), np.int64, len(made))
        m = runs.hash[at].view(np.int64)
        return {
            "m": pa.array(m), "key": pa.array(list(made), pa.binary()), "packed": pa.array([r[1] for r in made.values()], pa.binary()),
            "weight": pa.array([r[2] for r in made.values()], pa.int64()), "hot": pa.array(np.isin(m, hot)),
            "names": pa.array([r[3] for r in made.values()], pa.list_(pa.binary())), "firsts": pa.array([r[4] for r in made.values()], pa.list_(pa.int32())),
        }

    schema = "m bigint, key binary, packed binary, weight bigint, hot boolean, names array<binary>, firsts array<int>"
    strings = through_table(map_texts(texts, emit, schema, limit=block), "super-strings")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[list[bytes], list[tuple[bytes, int]]]] = []
        held = 0

        def rows(keys: list[bytes], ranges: list, packed: list, weights: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(ranges, pa.list_(pa.int32())), pa.array(packed, pa.binary()), pa.array(weights, pa.int64())],
                names=["key", "ranges", "packed", "weight"],
            )

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ready, held
            keys, ranges = [], []
            for (own, _), flags in zip(ready, mark([b for _, b in ready])):
                for key, flag in zip(own, flags):
                    if flag.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]])))
                        keys.append(key)
                        ranges.append(edge.tolist())
            ready, held = [], 0
            if keys:
                yield rows(keys, ranges, [None] * len(keys), [None] * len(keys))

        now, keys, own, own_bytes, over = None, [], [], 0, False
        for batch in batches:
            for m, key, packed, weight in zip(*(batch.column(c).to_pylist() for c in ("m", "key", "packed", "weight"))):
                if m != now:
                    if own:
                        ready.append((keys, own))
                        held += own_bytes
                        if held >= batch_bytes:
                            yield from flush()
                    now, keys, own, own_bytes, over = m, [], [], 0, False
                if over:
                    yield rows([key], [None], [packed], [weight])
                elif keys and keys[-1] == key:
                    own[-1] = (packed, own[-1][1] + weight)
                else:
                    keys.append(key)
                    own.append((packed, weight))
                    own_bytes += len(packed)
                    if own_bytes > bucket:
                        yield rows(keys, [None] * len(keys), [p for p, _ in own], [w for _, w in own])
                        keys, own, own_bytes, over = [], [], 0, True
        if own:
            ready.append((keys, own))
        if ready:
            yield from flush()

    cold = strings.where("not hot").select("m", "key", "packed", "weight").repartition("m").sortWithinPartitions("m", "key")
    judged = through_table(cold.mapInArrow(judge, "key binary, ranges array<int>, packed binary, weight bigint"), "judged")
    found = judged.where("packed is null").select("key", "ranges")
    rest = judged.where("packed is not null").select("key", "packed", "weight")
    if hot_rows or not rest.isEmpty():
        rest = rest.unionByName(strings.where("hot").select("key", "packed", "weight"))
        found = found.unionByName(_by_window(rest, windows, size))
    places = strings.select("key", F.explode(F.arrays_zip("names", "firsts")).alias("p")).select("key", F.col("p.names").alias("name"), F.col("p.firsts").alias("first"))
    return places.join(found, "key").groupBy("name").agg(F.collect_set(F.struct("first", "ranges")).alias("parts"))


def _by_window(strings: DataFrame, windows: Callable[[bytes, int], list[bytes]], size: int) -> DataFrame:
    """key, ranges of strings whose bucket is too large for a task: each window is dealt by its own content."""
    whole = strings.groupBy("key").agg(F.first("packed").alias("packed"), F.sum("weight").alias("weight"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, packed, weight in zip(*(batch.column(c).to_pylist() for c in ("key", "packed", "weight"))):
                own = [hashlib.md5(w).digest() for w in windows(packed, size)]
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.binary()), pa.array([key] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([weight] * n, pa.int64())],
                    names=["window", "key", "at", "weight"],
                )

    rows = through_table(whole.mapInArrow(explode, "window binary, key binary, at int, weight bigint"), "windows")
    often = rows.groupBy("window").agg(F.sum("weight").alias("n")).where("n > 1").select("window")
    hits = rows.join(often, "window").groupBy("key").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return hits.select("key", F.flatten(F.transform("at", lambda x: F.array(x, x + 1))).alias("ranges"))


def spans_of(parts: list[dict] | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans of items that the repeated windows of a text cover."""
    starts, ends = [], []
    for part in parts or []:
        pairs = np.array(part["ranges"], np.int64).reshape(-1, 2) + part["first"]
        starts.append(pairs[:, 0])
        ends.append(pairs[:, 1] + size - 1)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return merge_spans(np.concatenate(starts), np.concatenate(ends))


def with_parts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text and the parts found in the text."""
    named = id_and_text(docs).withColumn("name", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    return named.join(through_table(found, "repeats"), "name", "left").select("doc_id", "text", "parts")
