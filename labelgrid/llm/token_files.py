"""Token files: concatenated ids with Elias-Fano coded document boundaries.

Rows are dealt by range of doc_id (nulls first, repeats of an id by their texts) and written as blocks of about ``BLOCK_IDS`` ids. A block is one
self-describing byte string::

    header   7 x int64: documents, of which without id, ids, bytes per id, least doc_id, bytes of the two codes
    bounds   Elias-Fano code of the ids before each document, and of the total
    docs     Elias-Fano code of doc_id - least doc_id
    ids      unsigned, two bytes each where all fit, else four

The code of a sequence stores low bits plainly and high bits in unary, with the place of every 256th one; ``select``
finds any entry from the nearest such place. Blocks lie in Parquet files, so Spark commits them as a whole and a lost executor
leaves nothing behind. The ids before a part of the files come from one number per written part.

A null or empty text has the end id alone. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.common import BLANKS, Block, Memo, Words, blocks_of, id_and_text, small_batches
from labelgrid.session import shared_folder, ship_package

BLOCK_IDS = 2 << 20
SAMPLE = 256
MOST_FOUND = 65_536
CACHE = 300_000
# Signs to set between pieces; the first that the tokenizer turns into one id is taken.
MARKS = "~^\\`}{"


class EliasFano:
    """Code of an ascending sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << b
        return out

    def all(self) -> np.ndarray:
        """Every value."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        i = np.arange(self.n)
        return ((ones - i) << self.low_bits) | self._low(i)

    def select(self, i: int) -> int:
        """Value ``i`` alone, read from the nearest sampled one."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, first = at >> 3, True
        while True:
            bits = int(self.high[byte])
            if first:
                bits &= 0xFF << (at & 7) & 0xFF
                first = False
            ones = bits.bit_count()
            if left < ones:
                break
            left, byte = left - ones, byte + 1
        for _ in range(left):
            bits &= bits - 1
        one = byte * 8 + (bits & -bits).bit_length() - 1
        return ((one - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def pack(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)], "<i8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> "EliasFano":
        n, bits, low, high, samples = np.frombuffer(data, "<i8", 5).tolist()
        at = 40
        return cls(n, bits, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low), np.frombuffer(data, "<u4", samples, at + low + high))


class TokenBlock:
    """One block of documents."""

    def __init__(self, doc_ids: list[int | None], bounds: EliasFano, ids: np.ndarray):
        self.doc_ids, self.bounds, self.ids = doc_ids, bounds, ids

    @staticmethod
    def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
        """``doc_ids`` ascend, nulls first; ``ids`` are those of all documents."""
        known = np.array([d for d in doc_ids if d is not None], np.int64)
        least = int(known[0]) if len(known) else 0
        bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(counts)])).pack()
        names = EliasFano.encode(known.astype(np.uint64) - np.uint64(least % (1 << 64))).pack()
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        head = np.array([len(doc_ids), len(doc_ids) - len(known), len(ids), width, least, len(bounds), len(names)], "<i8")
        return head.tobytes() + bounds + names + ids.astype(f"<u{width}").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> "TokenBlock":
        docs, nulls, n, width, least, bounds, names = np.frombuffer(data, "<i8", 7).tolist()
        at = 56
        known = EliasFano.unpack(data[at + bounds : at + bounds + names]).all() + least
        ids = np.frombuffer(data, f"<u{width}", n, at + bounds + names)
        return cls([None] * nulls + known.tolist(), EliasFano.unpack(data[at : at + bounds]), ids)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


class Encoder:
    """Encodes texts with the tokenizers library, distinct pieces once where the file parts pieces at blanks anyway."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = spec.get("pre_tokenizer") or {}
        first = (steps.get("pretokenizers") or [steps])[0]
        classes = re.sub(r"\[[^\]]*\]|\\[pP]\{\w+\}", "", (first.get("pattern") or {}).get("Regex", " "))
        # Kept matches hold no blank, nothing looks around, and no special token takes blanks along: pieces are independent.
        self.parted = (
            first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and not re.search(r"\s|\\s|\(\?|\.", classes)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        )
        steps = spec.get("normalizer") or {}
        lowers = any(x.get("type") == "Lowercase" for x in steps.get("normalizers") or [steps])
        # Letters are lowered, and a run of letters is a pretoken of its own: "Word," has the ids of "word" and of ",".
        self.plain = self.parted and lowers and r"[\p{L}]+|" in (first.get("pattern") or {}).get("Regex", "")
        self.plain = self.plain and not any(t["content"][-1:] in ",." for t in spec["added_tokens"])
        self.special = [t["content"].lower().encode() for t in spec["added_tokens"]]
        self.pieces = Memo(CACHE)
        # Parts pieces in one text: a mark that is a pretoken of one id.
        self.mark = next((m for m in MARKS if len(self._ids([m])[0]) == 4), None) if self.parted else None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _split_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, all encoded as one text with marks between them; no piece holds the mark."""
        packed = self._ids([f" {self.mark} ".join(pieces)])[0]
        mark = np.flatnonzero(np.frombuffer(packed, "<u4") == np.frombuffer(self._ids([self.mark])[0], "<u4")) * 4
        return [packed[a:b] for a, b in zip([0, *(mark + 4).tolist()], [*mark.tolist(), len(packed)])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed unsigned 32-bit integers."""
        raw = [t.encode() for t in texts]
        ids, counts = self.encode_block(Block(b"".join(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])))
        return [x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(texts) else []

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block in a row, and the number of each text."""
        if not self.parted:
            made = self._ids([block.text(i).decode() for i in range(len(block))])
            return np.frombuffer(b"".join(made), "<u4"), np.array([len(m) // 4 for m in made], np.int64)
        # Lowered letters may not make a special token of what is none.
        low = block.lowered() if self.plain else block
        if low is not block and any(s in low.data for s in self.special):
            low = block
        words = low.words(BLANKS)
        start, end = words.start, words.end
        stop = np.zeros(len(start), np.int64)
        if self.plain and len(start):
            last = low.view[end - 1]
            cut = (end - start > 1) & ((last == 0x2C) | (last == 0x2E)) & _LETTER[low.view[end - 2]]
            stop = np.where(cut, np.where(last == 0x2C, 1, 2), 0)
            end = end - cut
        order, fresh = _groups(Words(low, start, end, words.at).hashes())
        number = np.empty(len(start), np.int64)
        number[order] = np.cumsum(fresh) - 1
        chosen = order[fresh]
        data = low.data
        pieces = [data[a:b] for a, b in zip(start[chosen].tolist(), end[chosen].tolist())]
        self._learn(self.pieces.missing([pieces, [b",", b"."]]))
        made = [*map(self.pieces.__getitem__, pieces), self.pieces[b","], self.pieces[b"."]]
        flat, sizes = np.frombuffer(b"".join(made), "<u4"), np.fromiter(map(len, made), np.int64, len(made)) // 4
        # The sign behind a word is a unit of its own.
        tails = np.cumsum(stop > 0)
        units = np.empty(len(start) + (int(tails[-1]) if len(tails) else 0), np.int64)
        place = np.arange(len(start)) + tails
        units[place - (stop > 0)] = number
        units[place[stop > 0]] = len(pieces) + stop[stop > 0] - 1
        lengths = sizes[units]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.arange(int(ends[-1])) + np.repeat((np.cumsum(sizes) - sizes)[units] - ends[:-1], lengths)]
        bounds = words.at + np.concatenate([[0], tails])[words.at]
        return ids, np.diff(ends[bounds])

    def _learn(self, lacking: set[bytes]) -> None:
        """Encode pieces and keep their ids."""
        texts = {piece: piece.decode() for piece in lacking}
        apart = [p for p, t in texts.items() if self.mark is None or self.mark in t]
        whole = [p for p in texts if self.mark is not None and self.mark not in texts[p]]
        for some, encode in ((apart, self._ids), (whole, self._split_ids)):
            for i in range(0, len(some), 8192):
                part = some[i : i + 8192]
                self.pieces.update(zip(part, encode([texts[p] for p in part])))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal values together, and where each group begins in it."""
    order = np.argsort(values)
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[order[1:]] != values[order[:-1]]
    return order, fresh


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1) -> None:
    """Write the ids of every text, closed by ``end_id``, in ascending doc_id order below ``folder``."""
    small_batches(docs)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    rows = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            counts = np.fromiter((len(h) // 4 for h in held), np.int64, len(held))
            packed = TokenBlock.pack(names, counts, ids)
            values = [pa.array([v], pa.int64()) for v in (part, number, before, len(ids))]
            return pa.RecordBatch.from_arrays([*values, pa.array([packed], pa.binary())], names=["part", "number", "before", "n_ids", "block"])

        for batch in batches:
            for at, block in blocks_of(batch):
                ids, counts = _encoder(tokenizer_path).encode_block(block)
                raw, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
                for name, a, b in zip(batch.column("doc_id")[at].to_pylist(), [0, *ends], ends):
                    names.append(name)
                    held.append(raw[a:b] + end)
                    size += (b - a) // 4 + 1
                    if size >= BLOCK_IDS:
                        yield flush()
                        before, number, names, held, size = before + size, number + 1, [], [], 0
        if held:
            yield flush()

    blocks = rows.mapInArrow(write, "part bigint, number bigint, before bigint, n_ids bigint, block binary")
    blocks.write.mode("overwrite").option("compression", "zstd").parquet(folder)


def read_tokens(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (packed unsigned 32-bit integers) of every document in the files below ``folder``."""
    return _read(spark, folder, "ids binary", lambda ids: pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()))


def find_tokens(spark, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids (packed unsigned 32-bit integers) of the documents that ``wanted`` (doc_id) names, each found in its block by two select
    look-ups; no other boundary is decoded. At most ``MOST_FOUND`` ids, which go to every task; for more, join ``read_tokens``.
    """
    ship_package(spark)
    rows = wanted.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct().limit(MOST_FOUND + 1).collect()
    if len(rows) > MOST_FOUND:
        raise ValueError(f"more than {MOST_FOUND} documents to find")
    shared = spark.sparkContext.broadcast(np.array(sorted(r["doc_id"] for r in rows), np.int64))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("block"):
                block = TokenBlock.unpack(packed.as_buffer())
                names = np.array([d for d in block.doc_ids if d is not None], np.int64)
                nulls = len(block.doc_ids) - len(names)
                first, last = np.searchsorted(names, shared.value, "left"), np.searchsorted(names, shared.value, "right")
                found = [i for a, b in zip(first.tolist(), last.tolist()) for i in range(a, b)]
                ids = [block.document(i + nulls) for i in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[found], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "n_tokens", "ids"],
                )

    return spark.read.parquet(folder).select("block").mapInArrow(find, "doc_id bigint, n_tokens bigint, ids binary")


def read_checksums(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files below ``folder``."""
    return _read(spark, folder, "ids_crc32 bigint", lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))


def _read(spark, folder: str, column: str, made) -> DataFrame:
    ship_package(spark)
    files = spark.read.parquet(folder)
    # One number for each written part, as many as the write had tasks.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    bases = dict(zip((r["part"] for r in totals), np.concatenate([[0], np.cumsum([r["n"] for r in totals])]).astype(int).tolist()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, packed in zip(*(batch.column(c) for c in ("part", "before", "block"))):
                block = TokenBlock.unpack(packed.as_buffer())
                at = block.bounds.all()
                ids = [block.ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.doc_ids, pa.int64()), pa.array(at[:-1] + bases[part.as_py()] + before.as_py(), pa.int64()),
                        pa.array(np.diff(at), pa.int64()), made(ids),
                    ],
                    names=["doc_id", "start", "n_tokens", column.split()[0]],
                )

    return files.select("part", "before", "block").mapInArrow(read, f"doc_id bigint, start bigint, n_tokens bigint, {column}")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the files into the shared folder and read back what ``read_checksums`` gives."""
    folder = shared_folder(docs.sparkSession, "token-files")
    write_tokens(docs, tokenizer_path, folder, end_id)
    return read_checksums(docs.sparkSession, folder)
