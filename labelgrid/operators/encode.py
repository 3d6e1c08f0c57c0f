"""Running a caller's model over a text column: one load per task, batches, retries."""

from __future__ import annotations

import hashlib
import time
import unicodedata
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelgrid.session import give_back, small_batches

DENSE = T.ArrayType(T.FloatType(), False)
KNOWN_TERMS = 500_000
# Letters in lower case and digits stay, every other ASCII character becomes a space.
TERM_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))
INDICES = T.ArrayType(T.IntegerType(), False)
VECTORS = [T.StructField("dense", DENSE), T.StructField("sparse_idx", INDICES), T.StructField("sparse_w", DENSE)]


def count_terms(token_lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row number, term number and count of every (row, term), in that order, and the terms."""
    sizes = np.fromiter((len(t) for t in token_lists), dtype=np.int64, count=len(token_lists))
    flat = np.array([t for tokens in token_lists for t in tokens], dtype=object)
    codes, terms = pd.factorize(flat)
    keys, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(terms)) + codes, return_counts=True)
    return keys // max(1, len(terms)), keys % max(1, len(terms)), counts, terms


class HashingEncoder:
    """Default encoder: term counts, hashed to a short dense and a wide sparse vector, unit length.

    A term's index is the number in the first seven hex digits of its MD5; the
    eighth digit gives the sign of its part in the dense vector.
    """

    batch = 1024

    def __init__(self, dims: int = 64):
        self.dims = dims
        self.known: dict[str, int] = {}

    def numbers(self, terms: list[str]) -> np.ndarray:
        """First eight hex digits of the MD5 of each term, remembered for common terms."""
        found = list(map(self.known.get, terms))
        if None in found:
            fresh = {t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in {t for t, n in zip(terms, found) if n is None}}
            found = [fresh[t] if n is None else n for t, n in zip(terms, found)]
            self.known.update(islice(fresh.items(), max(0, KNOWN_TERMS - len(self.known))))
        return np.array(found, dtype=np.int64)

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        dense, sizes, places, weights = self.flat(texts)
        cuts = np.cumsum(sizes)[:-1]
        return list(zip(dense, np.split(places, cuts), np.split(weights, cuts)))

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Dense matrix, entries per text, and the sparse indices and weights of all texts in a row."""
        tokens, sizes = [], []
        for text in texts:
            text = text or ""
            if not text.isascii():
                text = unicodedata.normalize("NFKD", text)
            words = text.encode("ascii", "ignore").translate(TERM_BYTES).decode().split()
            tokens += words
            sizes.append(len(words))
        # Terms with one number have the same place and sign, so numbers are counted, not terms.
        keys, count = np.unique(np.repeat(np.arange(len(texts)) << 32, sizes) | self.numbers(tokens), return_counts=True)
        row, number, count = keys >> 32, keys & 0xFFFFFFFF, count.astype(np.float64)
        place, sign = number >> 4, 1 - 2 * (number & 1)
        dense = np.bincount(row * self.dims + place % self.dims, weights=count * sign, minlength=len(texts) * self.dims).astype(np.float64).reshape(len(texts), self.dims)
        dense = self._unit(dense, np.sqrt((dense**2).sum(axis=1)))
        # Terms that share an index are one entry of the sparse vector.
        keys = (row << 28) + place
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, weights = keys[first], np.add.reduceat(count, first) if len(first) else count
        rows, places = keys >> 28, (keys & ((1 << 28) - 1)).astype(np.int32)
        sizes = np.sqrt(np.bincount(rows, weights=weights**2, minlength=len(texts)))
        weights = (weights / sizes[rows]).astype(np.float32)
        return dense, np.bincount(rows, minlength=len(texts)), places, weights

    @staticmethod
    def _unit(matrix: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.divide(matrix, length[:, None], out=matrix.copy(), where=length[:, None] > 0).astype(np.float32)


def with_retry(call: Callable, attempts: int = 3, wait_s: float = 0.0) -> Callable:
    """Repeat a batch call a bounded number of times; the last error is passed on."""

    def run(batch):
        for attempt in range(attempts):
            try:
                return call(batch)
            except Exception:
                if attempt + 1 == attempts:
                    raise
                time.sleep(wait_s)

    return run


def encode_column(
    df: DataFrame,
    column: str,
    load_encoder: Callable[[], Callable] = HashingEncoder,
    batch: int | None = None,
    attempts: int = 3,
) -> DataFrame:
    """Add ``dense``, ``sparse_idx`` and ``sparse_w``; the encoder is loaded once per task.

    Without ``batch`` the encoder's own batch size is taken, or 16 texts. An
    encoder with a ``flat`` method fills the Arrow columns without a list per text;
    it gets at most ``batch`` texts (1024 if unset) and about ``FLAT_BYTES`` at once.
    """
    if hasattr(load_encoder, "flat"):
        return _encode_flat(df, column, load_encoder, attempts, batch or FLAT_ROWS)
    schema = T.StructType(df.schema.fields + VECTORS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_encoder()
        encode, size = with_retry(model, attempts), batch or getattr(model, "batch", 16)
        for frame in frames:
            texts = frame[column].tolist()
            vectors = [v for at in range(0, len(texts), size) for v in encode(texts[at : at + size])]
            yield frame.assign(
                dense=[v[0] for v in vectors], sparse_idx=[v[1] for v in vectors], sparse_w=[v[2] for v in vectors]
            )

    return df.mapInPandas(run, schema)


FLAT_ROWS, FLAT_BYTES = 1024, 4 << 20


def _parts(batch: pa.RecordBatch, column: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows whose texts are about ``FLAT_BYTES`` together, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = min(first + rows, max(first + 1, int(np.searchsorted(ends, before + FLAT_BYTES, "right"))))
        yield batch.slice(first, last - first)
        first = last


def _encode_flat(df: DataFrame, column: str, load_encoder: Callable, attempts: int, size: int) -> DataFrame:
    schema = T.StructType(df.schema.fields + VECTORS)
    small_batches(df.sparkSession)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            yield from _parts(whole, column, size)
            give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = with_retry(load_encoder().flat, attempts)
        for batch in parts(batches):
            dense, sizes, places, weights = encode(batch.column(column).to_pylist())
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            rows = np.arange(batch.num_rows + 1, dtype=np.int32) * dense.shape[1]
            lists = [
                pa.ListArray.from_arrays(rows, pa.array(dense.ravel(), pa.float32())),
                pa.ListArray.from_arrays(starts, pa.array(places, pa.int32())),
                pa.ListArray.from_arrays(starts, pa.array(weights, pa.float32())),
            ]
            yield pa.RecordBatch.from_arrays(batch.columns + lists, names=schema.names)

    return df.mapInArrow(run, schema)


def generate_column(
    df: DataFrame, column: str, generate: Callable[[str], str], failed: Callable[[str], bool] | None = None
) -> DataFrame:
    """Add ``text``, ``latency_s`` and ``failed``; an error becomes the text ``ERROR: ...``.

    ``failed`` judges a reply that raised nothing, e.g. one that is too short.
    """
    schema = T.StructType(
        df.schema.fields
        + [T.StructField("text", T.StringType()), T.StructField("latency_s", T.DoubleType()), T.StructField("failed", T.IntegerType())]
    )

    def one(value):
        start = time.perf_counter()
        try:
            text, bad = generate(value), False
        except Exception as error:
            text, bad = f"ERROR: {error}", True
        bad = bad or bool(failed and failed(text))
        return text, round(time.perf_counter() - start, 2), int(bad)

    def run(frames):
        for frame in frames:
            done = [one(v) for v in frame[column]]
            yield frame.assign(
                text=[d[0] for d in done], latency_s=[d[1] for d in done], failed=[d[2] for d in done]
            )

    return df.mapInPandas(run, schema)


def compute_missing(items: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache plus ``compute`` run over only those items whose key it lacks."""
    missing = items.join(cache.select(key), key, "left_anti")
    return cache.unionByName(compute(missing).select(*cache.columns))
