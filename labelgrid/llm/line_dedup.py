"""Line dedup by a sharded minimal perfect hash over distinct line keys.

A line's key is the line without blanks at both ends and with A-Z lowered; keys shorter than ``min_chars``
never count. Keys are hashed to 128 bits and counted by document. The distinct hashes are dealt into shards of about ``SHARD``
keys; each shard is a minimal perfect hash (levels of bit arrays; a key sits at the first level where it is alone) with an
array of fingerprints and one of counts behind it. Documents send their key hashes to the shard, which streams them past its arrays and
answers only frequent ones; lines themselves are never joined.

Keys that make up at least 1/65536 of all pairs of document and key are in a shard of their own, which therefore has
at most 65,536 keys and is held by every task: a line of a third of all documents does not travel.

A null or empty text is one empty line. Each row counts as a document, repeats included; rows with equal texts lose equal
lines. A line that repeats inside a document counts once for it and goes everywhere. Other columns are not read; ``drop_lines`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from labelgrid.llm.common import LOWER, Block, give_back, map_texts, mix, quoted, small_batches, through_table

MIN_DOCS, MIN_CHARS = 10, 1
SHARD = 1 << 17
HOT_KEYS = 1 << 16
GAMMA, LEVELS = 2.0, 24
EDGES = bytes([0x20, *range(0x09, 0x0E)])


class PerfectHash:
    """Minimal perfect hash of 128-bit keys with fingerprint and count arrays; packs into bytes."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.levels, self.rest, self.prints, self.counts = levels, rest, prints, counts
        self.before, seen, self.ranks = [], 0, []
        for bits in levels:
            ones = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.ranks.append(np.concatenate([[0], ones]) + seen)
            seen += int(ones[-1]) if len(ones) else 0
        self.alone = seen

    @staticmethod
    def _slot(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(low + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)) ^ (high >> np.uint64(7))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, wide: bool = False) -> "PerfectHash":
        """``high`` and ``low`` are the halves of distinct keys; ``wide`` where others than members will ask."""
        left, levels = np.arange(len(high)), []
        while len(left) and len(levels) < LEVELS:
            size = -(-max(64, int(GAMMA * len(left))) // 64) * 64
            slot = cls._slot(high[left], low[left], len(levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            levels.append(words)
            left = left[~alone[slot]]
        rest = np.stack([high[left], low[left]], 1)
        made = cls(levels, rest, np.zeros(len(high), np.uint64 if wide else np.uint32), np.zeros(len(high), np.uint32))
        place = made.index(high, low)
        made.prints[place] = made.fingerprint(high)
        made.counts[place] = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)
        return made

    def fingerprint(self, high: np.ndarray) -> np.ndarray:
        return high if self.prints.dtype == np.uint64 else (high >> np.uint64(32)).astype(np.uint32)

    def index(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Place of each key, 0 to n - 1; -1 or any place for a key that is not a member."""
        place, left = np.full(len(high), -1, np.int64), np.arange(len(high))
        for level, bits in enumerate(self.levels):
            if not len(left):
                return place
            slot = self._slot(high[left], low[left], level, len(bits) * 64)
            word, bit = bits[slot >> 6], (slot & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            under = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            place[left[here]] = self.ranks[level][slot[here] >> 6] + under[here]
            left = left[~here]
        for i, (a, b) in enumerate(self.rest):
            place[left[(high[left] == a) & (low[left] == b)]] = self.alone + i
        return place

    def lookup(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Count of each key; 0 where the fingerprint differs."""
        if not len(self.counts):
            return np.zeros(len(high), np.uint32)
        place = self.index(high, low)
        known = (place >= 0) & (self.prints[place] == self.fingerprint(high))
        return np.where(known, self.counts[place], 0)

    def pack(self) -> bytes:
        head = np.array([len(self.counts), len(self.rest), self.prints.itemsize, len(self.levels), *map(len, self.levels)], np.int64)
        return b"".join(x.tobytes() for x in (head, *self.levels, self.rest, self.prints, self.counts))

    @classmethod
    def unpack(cls, data: bytes) -> "PerfectHash":
        n, rest, width, count = np.frombuffer(data, np.int64, 4).tolist()
        at, levels = 32 + 8 * count, []
        for size in np.frombuffer(data, np.int64, count, 32).tolist():
            levels.append(np.frombuffer(data, np.uint64, size, at))
            at += 8 * size
        left = np.frombuffer(data, np.uint64, 2 * rest, at).reshape(rest, 2)
        at += 16 * rest
        return cls(levels, left, np.frombuffer(data, f"u{width}", n, at), np.frombuffer(data, np.uint32, n, at + width * n))


def _key(line: bytes) -> bytes:
    return line.strip(EDGES).translate(LOWER)


def _long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (chars <= 1 or len(key.decode("utf-8", "replace")) >= chars)


def line_keys(block: Block, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number and the two key halves of each distinct key of each document."""
    doc, keys = [], []
    for i in range(len(block)):
        own = {hashlib.md5(k).digest() for line in block.text(i).split(b"\n") if _long_enough(k := _key(line), min_chars)}
        doc.extend([i] * len(own))
        keys.extend(own)
    halves = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    return np.array(doc, np.int64), halves[:, 0], halves[:, 1]


def _shards(pairs: DataFrame, parts: int) -> DataFrame:
    """shard, block: the packed perfect hash of each shard of about ``SHARD`` keys."""

    def build(table: pa.Table) -> pa.Table:
        half = [table.column(c).to_numpy().view(np.uint64) for c in ("high", "low")]
        packed = PerfectHash.build(*half, table.column("n").to_numpy()).pack()
        return pa.table({"shard": pa.array(table.column("shard").to_pylist()[:1], pa.int64()), "block": pa.array([packed], pa.binary())})

    return pairs.withColumn("shard", F.pmod(F.xxhash64("high"), F.lit(parts))).groupBy("shard").applyInArrow(build, "shard bigint, block binary")


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` cut to its kept lines, plus line_count and line_dropped (bigint).

    The two added columns replace columns of these names, if there are any.
    """
    docs = docs.drop("line_count", "line_dropped")
    spark = docs.sparkSession
    small_batches(docs)
    texts = docs.select(F.col("text").cast("string").alias("text"))

    def keys(block: Block, rows: pa.RecordBatch) -> dict:
        _, high, low = line_keys(block, min_chars)
        both, count = np.unique(np.stack([high, low], 1), axis=0, return_counts=True) if len(high) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
        return {"high": pa.array(both[:, 0].copy().view(np.int64)), "low": pa.array(both[:, 1].copy().view(np.int64)), "n": pa.array(count, pa.int64())}

    counts = map_texts(texts, keys, "high bigint, low bigint, n bigint").groupBy("high", "low").agg(F.sum("n").alias("n"))
    counts = through_table(counts, "line-counts")
    size = counts.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")).first()
    hot_at = max(min_docs, -(-size["pairs"] // HOT_KEYS))
    parts = max(1, -(-size["keys"] // SHARD))
    index = through_table(_shards(counts.where(F.col("n") < hot_at), parts), "line-index")
    # At most HOT_KEYS rows by the choice of hot_at.
    hot = counts.where(F.col("n") >= hot_at).toPandas()
    shared = spark.sparkContext.broadcast(PerfectHash.build(hot["high"].to_numpy(np.int64).view(np.uint64), hot["low"].to_numpy(np.int64).view(np.uint64), hot["n"].to_numpy(np.int64), wide=True).pack())
    opened: list[PerfectHash] = []

    def common(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        if not opened:
            opened.append(PerfectHash.unpack(shared.value))
        return opened[0].lookup(high, low)

    def ask(block: Block, rows: pa.RecordBatch) -> dict:
        doc, high, low = line_keys(block, min_chars)
        rare = common(high, low) == 0
        name = [hashlib.md5(block.text(i)).digest() for i in range(len(block))]
        return {
            "name": pa.array([name[i] for i in doc[rare].tolist()], pa.binary()),
            "high": pa.array(high[rare].view(np.int64)), "low": pa.array(low[rare].view(np.int64)),
        }

    asked = map_texts(texts, ask, "name binary, high bigint, low bigint").withColumn("shard", F.pmod(F.xxhash64("high"), F.lit(parts)))
    stream = index.select("shard", F.lit(None).cast("binary").alias("name"), F.lit(None).cast("bigint").alias("high"), F.lit(None).cast("bigint").alias("low"), "block").unionByName(
        asked.withColumn("block", F.lit(None).cast("binary"))
    )
    stream = stream.repartition(F.col("shard")).sortWithinPartitions("shard", F.col("name").asc_nulls_first())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays: PerfectHash | None = None
        for batch in batches:
            blocks = batch.column("block")
            opens = np.flatnonzero(blocks.is_valid().to_numpy(zero_copy_only=False)).tolist()
            for first, last in zip([0, *opens], [*opens, len(batch)]):
                if first in opens and first < last:
                    arrays = PerfectHash.unpack(blocks[first].as_py())
                    first += 1
                if first < last:
                    high, low = (batch.column(c)[first:last].to_numpy().view(np.uint64) for c in ("high", "low"))
                    often = np.flatnonzero(arrays.lookup(high, low) >= min_docs) + first
                    if len(often):
                        yield batch.select(["name", "high", "low"]).take(pa.array(often))

    answers = stream.mapInArrow(answer, "name binary, high bigint, low bigint")
    answers = answers.groupBy("name").agg(F.collect_set(F.struct("high", "low")).alias("line_often"))
    # Read from a table, so that the join deals both sides itself and may split a text of very many copies.
    answers = through_table(answers, "line-answers")

    others = [c for c in docs.columns if c != "text"]
    if not others:
        raise ValueError("docs needs a column besides text")
    # The user's columns lie in one struct before others join them, so that no name can clash.
    packed = docs.select(F.struct(*[F.col(quoted(c)) for c in others]).alias("line_row"), F.col("text").cast("string").alias("line_text"))
    named = packed.withColumn("line_name", F.unhex(F.md5(F.coalesce("line_text", F.lit("")))))
    joined = named.join(answers.withColumnRenamed("name", "line_name"), "line_name", "left").select("line_row", "line_text", "line_often")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, dropped = [], [], []
            lists = batch.column("line_often")
            for text, often in zip(batch.column("line_text"), lists):
                lines = (text.as_py() or "").encode().split(b"\n")
                keys = [_key(line) for line in lines]
                names = [hashlib.md5(k).digest() for k in keys]
                halves = np.frombuffer(b"".join(names), np.uint64).reshape(-1, 2)
                gone = common(halves[:, 0], halves[:, 1]) > 0
                if often.is_valid:
                    own = {(x["high"], x["low"]) for x in often.as_py()}
                    signed = halves.view(np.int64).tolist()
                    gone |= np.fromiter(((a, b) in own for a, b in signed), bool, len(signed))
                gone &= np.fromiter((_long_enough(k, min_chars) for k in keys), bool, len(keys))
                counts.append(len(lines))
                dropped.append(int(gone.sum()))
                texts.append(b"\n".join(line for line, g in zip(lines, gone.tolist()) if not g).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("line_row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
                names=["line_row", "text", "line_count", "line_dropped"],
            )
            give_back()

    schema = StructType([packed.schema["line_row"], *[StructField(n, k) for n, k in (("text", StringType()), ("line_count", LongType()), ("line_dropped", LongType()))]])
    out = joined.mapInArrow(cut, schema)
    return out.select(*[F.col("text") if c == "text" else F.col("line_row").getField(c).alias(c) for c in docs.columns], "line_count", "line_dropped")
