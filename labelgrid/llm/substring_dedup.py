"""Substring dedup over words by super-k-mers.

A window is ``size`` consecutive words of one text. Consecutive windows with the same minimiser travel as one packed string of words to its bucket
(see ``superstrings``); there all windows of the bucket's distinct strings are sorted and equal neighbours counted, with the strings'
weights. Each word covered by a window that starts at two places or more is removed; windows are judged on the input.

Null, empty and blank texts have no words; texts of fewer words than a window lose none. Repeated rows repeat all their windows
and are each returned. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelgrid.llm.common import Block, blocks_of, id_and_text, small_batches
from labelgrid.llm.superstrings import BUCKET, HOT_LEAST, repeated, spans_of, with_parts, word_runs, word_windows

SIZE, GRAM = 35, 10


def count_sorted(buckets: list[list[tuple[bytes, int]]], size: int) -> list[list[np.ndarray]]:
    """For each string of each bucket, which of its windows occur twice or more in the bucket."""
    out = []
    for strings in buckets:
        if len(strings) == 1:
            packed, weight = strings[0]
            out.append([np.full(packed.count(b" ") + 2 - size, weight > 1)])
            continue
        cut = [word_windows(packed, size) for packed, _ in strings]
        flags = [np.full(len(w), weight > 1) for w, (_, weight) in zip(cut, strings)]
        rows = sorted((w, s, i) for s, own in enumerate(cut) for i, w in enumerate(own))
        for (w, s, i), (v, t, j) in zip(rows, rows[1:]):
            if w == v:
                flags[s][i] = flags[t][j] = True
        out.append(flags)
    return out


def drop_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot_least: int = HOT_LEAST, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_words, n_removed and text (the kept words joined by one space) of every row."""
    found = repeated(id_and_text(docs), size, gram, word_runs, word_windows, lambda b: count_sorted(b, size), 1 << 20, hot_least, bucket)
    small_batches(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks_of(batch):
                yield _kept(block, batch.slice(at.start, at.stop - at.start), size)

    return with_parts(docs, found).mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, text string")


def _kept(block: Block, rows: pa.RecordBatch, size: int) -> pa.RecordBatch:
    words = block.words()
    removed, texts = [], []
    for i, parts in enumerate(rows.column("parts")):
        own = words.list(int(words.at[i]), int(words.at[i + 1]))
        start, end = spans_of(parts.as_py(), size)
        removed.append(int((end - start).sum()))
        kept, last = [], 0
        for a, b in zip(start.tolist(), end.tolist()):
            kept += own[last:a]
            last = b
        texts.append(b" ".join(kept + own[last:]).decode())
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id"), pa.array(words.counts(), pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
        names=["doc_id", "n_words", "n_removed", "text"],
    )
