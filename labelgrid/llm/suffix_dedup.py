"""Suffix-array dedup over bytes by threshold-bounded interval expansion.

A byte is removed if a string of ``size`` bytes that also starts elsewhere covers it. Runs of such strings meet in buckets (see
``superstrings``). Of the distinct strings of some buckets a Burrows-Wheeler transform is made, each string closed by a sign of its own. Starting
with the intervals of all 7-byte prefixes, every interval is extended backward by each byte that stands before its suffixes; the
right end of a new interval that has no value yet gets the current length as its common prefix, and only such intervals go on.
So common prefixes come out by increasing value, breadth first, and the expansion stops at ``size``: ends without a value by then divide suffixes
that share ``size`` bytes or more.

Null and empty texts have no bytes; texts shorter than ``size`` lose none; matches never cross texts. Repeated rows repeat all their strings.
Other columns are not read. What is kept is bytes, as a cut may fall inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelgrid.llm.common import BLOCK, blocks_of, id_and_text, small_batches
from labelgrid.llm.superstrings import BUCKET, byte_runs, byte_windows, repeated, spans_of, with_parts

SIZE, GRAM = 400, 64
SEED = 7
# Dealing a string of bytes by window costs a row for each byte, so only very large buckets are dealt so.
HOT_LEAST = 5000


def bounded_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order by ``depth`` symbols or more, the first ranks (by ``SEED`` symbols) and which suffixes they leave alone.

    A symbol of 0 ends a string: a prefix that holds one equals no other, and of prefixes equal up to there the earlier comes
    first, so that putting one symbol before two suffixes never changes their order.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(SEED, symbols.dtype)]).astype(np.int64)
    key, closed = np.zeros(n, np.int64), np.zeros(n, bool)
    for j in range(SEED):
        closed |= padded[j : j + n] == 0
        key = key << 9 | np.where(closed, 0, padded[j : j + n])
    order = np.argsort(key, kind="stable")
    key, shut = key[order], closed[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (key[1:] != key[:-1]) | shut[1:] | shut[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    seeds, span = rank, SEED
    open_ = order[~(fresh & np.append(fresh[1:], True))]
    while len(open_) and span < depth:
        follow = rank[np.minimum(open_ + span, n - 1)]
        group = rank[open_]
        sort = np.argsort(group * np.int64(n) + follow, kind="stable")
        open_, follow, group = open_[sort], follow[sort], group[sort]
        first = np.ones(len(open_), bool)
        first[1:] = group[1:] != group[:-1]
        fresh = first.copy()
        fresh[1:] |= follow[1:] != follow[:-1]
        here = np.arange(len(open_))
        rank = rank.copy()
        rank[open_] = group + np.maximum.accumulate(np.where(fresh, here, 0)) - np.maximum.accumulate(np.where(first, here, 0))
        open_, span = open_[~(fresh & np.append(fresh[1:], True))], span * 2
    return np.argsort(rank, kind="stable"), seeds, rank


def expand(symbols: np.ndarray, size: int) -> np.ndarray:
    """For each place of the text whether ``size`` symbols from there start elsewhere too."""
    n = len(symbols)
    order, seeds, _ = bounded_order(symbols, size)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = order - 1
    sign = symbols[np.maximum(before, 0)].astype(np.int64)
    sign[before < 0] = 0
    # A step back in the transform: where the suffix that is one symbol longer stands.
    back = place[np.maximum(before, 0)]
    ranks = seeds[order]
    open_ = np.ones(n + 1, bool)
    start = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
    open_[start] = open_[n] = False
    low, high = start, np.append(start[1:], n)
    for length in range(SEED, size):
        if not len(low):
            break
        width = high - low
        ends = np.cumsum(width)
        at = np.arange(int(ends[-1])) + np.repeat(low - (ends - width), width)
        owner = np.repeat(np.arange(len(low)), width)
        keep = sign[at] > 0
        at, owner = at[keep], owner[keep]
        to = back[at]
        sort = np.argsort(to)
        to, owner, letter = to[sort], owner[sort], sign[at[sort]]
        if not len(to):
            break
        fresh = np.ones(len(to), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (letter[1:] != letter[:-1])
        first = np.flatnonzero(fresh)
        low, high = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        unset = open_[high]
        low, high = low[unset], high[unset]
        open_[high] = False
    shared = open_[:-1] | open_[1:]
    out = np.empty(n, bool)
    out[order] = shared
    return out


def mark_repeats(buckets: list[list[tuple[bytes, int]]], size: int) -> list[list[np.ndarray]]:
    """For each string of each bucket, which of its windows occur twice or more in the buckets."""
    parts, wanted = [], []
    for bucket in buckets:
        if len(bucket) > 1:
            for packed, _ in bucket:
                parts.append(np.frombuffer(packed, np.uint8).astype(np.uint16) + 1)
                parts.append(np.zeros(1, np.uint16))
                wanted.append(len(packed) + 1)
    found = expand(np.concatenate(parts), size) if parts else np.zeros(0, bool)
    starts, i, out = np.concatenate([[0], np.cumsum(wanted, dtype=np.int64)]), 0, []
    for bucket in buckets:
        flags = []
        for packed, weight in bucket:
            own = np.full(len(packed) - size + 1, weight > 1)
            if len(bucket) > 1:
                own |= found[starts[i] : starts[i] + len(own)]
                i += 1
            flags.append(own)
        out.append(flags)
    return out


def drop_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot_least: int = HOT_LEAST, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of every row."""
    if gram > size or size < SEED:
        raise ValueError(f"size must be at least {SEED} and not below gram")
    found = repeated(id_and_text(docs), size, gram, byte_runs, byte_windows, lambda b: mark_repeats(b, size), 1 << 20, hot_least, bucket, BLOCK // 2)
    small_batches(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, block in blocks_of(batch):
                kept, removed, spans = [], [], []
                for i, parts in enumerate(batch.column("parts")[rows]):
                    data, last, out = block.text(i), 0, []
                    start, end = spans_of(parts.as_py(), size)
                    for a, b in zip(start.tolist(), end.tolist()):
                        out.append(data[last:a])
                        last = b
                    kept.append(b"".join([*out, data[last:]]))
                    removed.append(int((end - start).sum()))
                    spans.append(len(start))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[rows], pa.array(np.diff(block.at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return with_parts(docs, found).mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
