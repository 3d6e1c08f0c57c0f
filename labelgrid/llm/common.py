"""Text blocks: whole texts of an Arrow batch as one byte array, cut into words and hashed without a loop over words.

A block holds at most ``BLOCK`` bytes of text, or one document when that is longer, so the memory of a task
follows the longest document and never the number of rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelgrid.session import discard, shared_folder, ship_package, shuffles_released, through_table

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

BLOCK = 2 << 20
BATCH = 8 << 20

# Blank characters of the contracts: the space and \x09-\x0D.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
# What parts alphanumeric words: the ASCII characters other than digits and letters.
MARKS = np.zeros(256, bool)
MARKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, kept up to block size."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table, filled = np.empty(n, np.uint64), 1
        table[0] = 1
        while filled < n:
            more = min(filled, n - filled)
            table[filled : filled + more] = table[:more] * np.uint64(pow(base, filled, 1 << 64))
            filled += more
        made.append(table)
    if n <= BLOCK + 1:
        _powers[:] = made
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Some documents as one byte array; ``at`` holds the offset of each document and the total."""

    def __init__(self, data: bytes, at: np.ndarray):
        self.data, self.at = data, at
        self.view = np.frombuffer(data, np.uint8)

    def __len__(self) -> int:
        return len(self.at) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]]

    def lowered(self) -> "Block":
        """ASCII letters lowered, all other bytes as they are."""
        return Block(self.data.translate(LOWER), self.at)

    def prefix_hash(self) -> tuple[np.ndarray, np.ndarray]:
        """Polynomial prefix hash with the inverse powers that shift any span back to offset 0."""
        power, inverse = _power_tables(len(self.view) + 1)
        total = np.zeros(len(self.view) + 1, np.uint64)
        np.cumsum((self.view.astype(np.uint64) + np.uint64(1)) * power[: len(self.view)], out=total[1:])
        return total, inverse

    def words(self, marks: np.ndarray = BLANKS) -> "Words":
        """Maximal runs of bytes that ``marks`` does not name, never across documents."""
        inside = np.zeros(len(self.view) + 2, bool)
        inside[1:-1] = ~marks[self.view]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        cut = self.at[1:-1]
        cut = cut[(cut > 0) & (cut < len(self.view))]
        begins[cut] |= inside[1:-1][cut]
        ends[cut - 1] |= inside[1:-1][cut - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return Words(self, start, end, np.searchsorted(start, self.at))


class Words:
    """Words of a block: byte spans, and ``at`` with the number of the first word of each document."""

    def __init__(self, block: Block, start: np.ndarray, end: np.ndarray, at: np.ndarray):
        self.block, self.start, self.end, self.at = block, start, end, at

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        total, inverse = self.block.prefix_hash()
        return mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def left(self, n: int) -> np.ndarray:
        """For each word whether ``n`` words of its document start there."""
        return np.arange(len(self)) + n <= np.repeat(self.at[1:], self.counts())

    def list(self, first: int, last: int) -> list[bytes]:
        data = self.block.data
        return [data[a:b] for a, b in zip(self.start[first:last].tolist(), self.end[first:last].tolist())]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` items; the result is ``k - 1`` shorter."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), 1
    for j in range(k):
        out += hashes[j : j + n] * np.uint64(factor)
        factor = factor * _STEP % (1 << 64)
    return mix(out)


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each window of ``width`` values by doubling."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out, span = pick(out[:-span], out[span:]), span * 2
    if span < width:
        out = pick(out[: len(out) - (width - span)], out[width - span :])
    return out


def blocks_of(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK) -> Iterator[tuple[slice, Block]]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text; a null is an empty text."""
    array = batch.column(batch.schema.get_field_index(column))
    if not len(array):
        return
    _, where, data = array.buffers()
    at = np.frombuffer(where, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = memoryview(data) if data is not None else memoryview(b"")
    first = 0
    while first < len(array):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield slice(first, last), Block(bytes(raw[at[first] : at[last]]), at[first : last + 1] - at[first])
        first = last


def small_batches(df: DataFrame) -> None:
    """Ship the package, and let no batch of rows to a worker exceed ``BATCH`` bytes, whatever the length of the texts."""
    spark = df.sparkSession
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "67108864b"):
        spark.conf.set(name, str(BATCH))


def give_back() -> None:
    """Return freed memory to the system, so that a worker does not keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def map_texts(df: DataFrame, fn: Callable[[Block, pa.RecordBatch], dict | None], schema: str | StructType, column: str = "text", limit: int = BLOCK) -> DataFrame:
    """Run ``fn`` over blocks of texts; it gets the block and its rows and returns arrays by column name."""
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in blocks_of(batch, column, limit):
                made = fn(block, batch.slice(rows.start, rows.stop - rows.start))
                if made is not None:
                    yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))
            give_back()

    return df.mapInArrow(run, schema)


class Memo(dict):
    """Bounded memory of worked-out pieces: two generations, so what is used goes on and the rest is let go."""

    def __init__(self, bound: int):
        super().__init__()
        self.bound, self.old = bound, {}

    def missing(self, lists: list[list[str]]) -> set[str]:
        """Pieces of the lists that are in neither generation; used ones of the older move to the younger."""
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()
        lacking = set(filterfalse(self.__contains__, chain.from_iterable(lists)))
        known = lacking & self.old.keys()
        self.update(zip(known, map(self.old.__getitem__, known)))
        return lacking - known


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators read, whatever else the table carries."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def quoted(column: str) -> str:
    """A name as it stands, whatever signs it has."""
    return f"`{column.replace('`', '``')}`"


def _from_files(docs: DataFrame) -> bool:
    """Whether each row stands for one row of a file: a file scan under nothing but projections and filters."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation"


def located(docs: DataFrame) -> DataFrame:
    """row (all columns as one struct) and at (file, place): a key of each row where ids are null or stand for several texts.

    The key is the row's place in its Parquet file, which every later read finds again; what does not come straight from files is written first.
    All columns of the user lie in ``row``, so their names cannot clash with others.
    """
    table = docs if _from_files(docs) else through_table(docs, "located")
    where = table.metadataColumn("_metadata")
    at = F.struct(F.xxhash64(where["file_path"]).alias("file"), where["row_index"].alias("place"))
    return table.select(F.struct(*[F.col(quoted(c)) for c in table.columns]).alias("row"), at.alias("at"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Written below the shared checkpoint folder, with its partitions and their order as they are."""
    context = df.sparkSession.sparkContext
    shared_folder(df.sparkSession, "checkpoint")
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as disjoint, ascending spans; touching spans become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = starts[1:] > ends[:-1]
    return starts[fresh], ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(ends) - 1)]


__all__ = [
    "BLANKS", "BLOCK", "Block", "MARKS", "Memo", "Words", "blocks_of", "checkpointed", "discard", "give_back", "grams", "id_and_text", "located", "map_texts",
    "merge_spans", "mix", "quoted", "shuffles_released", "sliding", "small_batches", "through_table",
]
