"""Quality rules on repetition, from a suffix array over the words of each document.

The suffixes of all documents of a block are sorted by prefix doubling; words of different documents never rank equal, and a
suffix that is alone in its group is not sorted again. The ranks kept from each doubling give the longest common
prefix of neighbours. Intervals of neighbours that share at least ``MIN_REPEAT`` words are repeated substrings, maximal
because each suffix takes the longer prefix of its two neighbours; the union of their spans is the covered part.

A document is kept if it has at least ``MIN_WORDS`` words, no more than half of them in repeated three-word
windows, no more than ``MAX_COVERED`` of them in repeated substrings of ``MIN_REPEAT`` words or more, and no repeated substring longer than
``MAX_REPEAT`` words. A null, empty or blank text has no words and is not kept; rows are judged one by one and
only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelgrid.llm.common import BLANKS, Block, id_and_text, map_texts, mix

MIN_WORDS, MAX_SHORT_REPEAT = 50, 50
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 10, 30, 150

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def suffix_array(classes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of ``classes`` and, for each doubling, ranks that are equal just for equal prefixes.

    A prefix that leaves the sequence equals no other; a caller gives parts of their own classes to keep them apart.
    """
    n = len(classes)
    order = np.argsort(classes, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = classes[order][1:] != classes[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, span = [rank], 1
    grouped = ~(fresh & np.append(fresh[1:], True))
    open_ = order[grouped]
    while len(open_):
        rank = rank.copy()
        ahead = open_ + span
        key = np.where(ahead < n, levels[-1][np.minimum(ahead, n - 1)], -1)
        group = levels[-1][open_]
        # By group, then by what follows; groups are whole runs, so a stable sort keeps their places.
        sort = np.argsort(group * np.int64(n + 1) + key + 1, kind="stable")
        open_, key, group = open_[sort], key[sort], group[sort]
        first = np.ones(len(open_), bool)
        first[1:] = group[1:] != group[:-1]
        fresh = first.copy()
        fresh[1:] |= key[1:] != key[:-1]
        fresh |= key < 0
        start = np.maximum.accumulate(np.where(first, np.arange(len(open_)), 0))
        rank[open_] = group + np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0)) - start
        levels.append(rank)
        open_, span = open_[~(fresh & np.append(fresh[1:], True))], span * 2
    return np.argsort(rank, kind="stable"), levels


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """For each suffix the longer of its common prefixes with the neighbours in suffix order."""
    n = len(order)
    if n < 2:
        return np.zeros(n, np.int64)
    near = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
    a, b = order[:-1][near].copy(), order[1:][near].copy()
    shared = np.zeros(len(near), np.int64)
    for power in range(len(levels) - 1, -1, -1):
        rank = np.append(levels[power], -1)
        same = rank[np.minimum(a, n)] == rank[np.minimum(b, n)]
        step = np.where(same, 1 << power, 0)
        shared, a, b = shared + step, a + step, b + step
    lcp = np.zeros(n + 1, np.int64)
    lcp[near + 1] = shared
    out = np.empty(n, np.int64)
    out[order] = np.maximum(lcp[:-1], lcp[1:])
    return out


def covered(lengths: np.ndarray) -> np.ndarray:
    """Which items lie in a span of ``lengths[i]`` items from ``i``; spans end inside the sequence."""
    if not len(lengths):
        return np.zeros(0, bool)
    return np.maximum.accumulate(np.arange(len(lengths)) + lengths) > np.arange(len(lengths))


def measure(block: Block, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Counts of each document of a block."""
    words = block.words(BLANKS)
    at, doc = words.at, words.doc()
    order, levels = suffix_array(mix(words.hashes() + mix(doc.astype(np.uint64) + np.uint64(1))))
    shared = neighbour_prefixes(order, levels)

    def per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])

    longest = np.zeros(len(block), np.int64)
    np.maximum.at(longest, doc, shared)
    lead = (block.view & 0xC0) != 0x80
    blank = BLANKS[block.view]
    return {
        "n_words": words.counts(),
        "word_chars": per_doc(lead & ~blank, block.at),
        "n_symbols": per_doc(SYMBOLS[block.view], block.at),
        "n_dup_lines": _repeated_lines(block, blank),
        "n_repeat_words": per_doc(covered(np.where(shared >= 3, 3, 0)), at),
        "n_covered": per_doc(covered(np.where(shared >= min_repeat, shared, 0)), at),
        "longest_repeat": longest,
    }


def _repeated_lines(block: Block, blank: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the document."""
    lines = Block(block.data, block.at).words(_NEWLINE)
    total, inverse = block.prefix_hash()
    filled = np.concatenate([[0], np.cumsum(~blank, dtype=np.int64)])
    has = filled[lines.end] > filled[lines.start]
    doc = lines.doc()
    start, end, doc = lines.start[has], lines.end[has], doc[has]
    value = mix(mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)) + doc.astype(np.uint64))
    _, first = np.unique(value, return_index=True)
    again = np.ones(len(value), bool)
    again[first] = False
    return np.bincount(doc[again], minlength=len(block))


_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def judge(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: int = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, the counts of ``measure``, base_failed and kept of every row; ``max_covered`` is in percent."""

    def run(block: Block, rows: pa.RecordBatch) -> dict:
        m = measure(block, min_repeat)
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_SHORT_REPEAT * m["n_words"])
        bad = (100 * m["n_covered"] > max_covered * m["n_words"]) | (m["longest_repeat"] > max_repeat)
        return {"doc_id": rows.column("doc_id")} | {k: pa.array(v, pa.int64()) for k, v in m.items()} | {"base_failed": pa.array(failed), "kept": pa.array(~failed & ~bad)}

    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_covered longest_repeat".split()
    return map_texts(id_and_text(docs), run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, kept boolean")
