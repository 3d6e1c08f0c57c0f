"""Licence scan: Dice coefficient over word bigrams against licence templates.

A text is normalised to lower-case alphanumeric words. Spans are its lines, its paragraphs (parts between blank lines), the whole text, and for each template
all windows of as many words as the template has, whose bigram counts are kept up to date as they slide. A span
matches a template if ``2 * common / (span + template)`` distinct word bigrams is at least ``THRESHOLD``. That needs the sizes to be within
``t / (2 - t)`` of each other, so a span meets only templates of a size in these bounds, and a text only those templates of which at least that
share of bigrams occurs in it.

Where matches overlap, the one of the highest coefficient stays: of equal ones the licence first in the alphabet, then the earliest and the shortest.

Templates are a dictionary or a table (license, text) of at most ``MOST_BYTES`` of text. Null and empty texts, and spans of fewer than two words, match nothing.
Repeated rows are judged one by one; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.common import MARKS, Block, grams, id_and_text, map_texts
from labelgrid.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
MOST_BYTES = 16 << 20
Match = tuple[float, str, int, int]  # coefficient with its sign turned, licence, first word, word behind the last


def _pairs(text: str) -> np.ndarray:
    raw = text.encode()
    return grams(Block(raw, np.array([0, len(raw)])).lowered().words(MARKS).hashes(), 2)


class Index:
    """Bigrams of the templates, sorted by size."""

    def __init__(self, templates: dict[str, list[str]]):
        rows = [(name, _pairs(text)) for name, texts in sorted(templates.items()) for text in texts]
        # name, distinct bigrams, words
        self.rows = sorted(((n, np.unique(p), len(p) + 1) for n, p in rows if len(p)), key=lambda r: (len(r[1]), r[0]))
        self.sizes = np.array([len(b) for _, b, _ in self.rows])
        self.all = np.unique(np.concatenate([b for _, b, _ in self.rows])) if self.rows else np.zeros(0, np.uint64)

    def matches(self, bigrams: np.ndarray, threshold: float) -> list[tuple[str, float]]:
        """Templates that a span of these distinct, sorted bigrams matches."""
        n, bound = len(bigrams), threshold / (2 - threshold)
        first, last = np.searchsorted(self.sizes, n * bound - 1e-9), np.searchsorted(self.sizes, n / bound + 1e-9, "right")
        found = [(name, 2 * int(_in(bigrams, of).sum()) / (n + len(of))) for name, of, _ in self.rows[first:last]]
        return [(name, dice) for name, dice in found if dice >= threshold]


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _units(block: Block) -> list[np.ndarray]:
    """Offsets where lines, paragraphs and texts begin, each list closed by the end."""
    lines = np.unique(np.concatenate([block.at, np.flatnonzero(block.view == 10) + 1]))
    blank = np.array([m.end() for m in re.finditer(rb"\n[ \t\x0b\x0c\r]*(?=\n)", block.data)], np.int64)
    return [lines, np.unique(np.concatenate([block.at, blank])), np.unique(block.at)]


def sliding_dice(pairs: np.ndarray, of: np.ndarray, width: int) -> np.ndarray:
    """Dice of the distinct bigrams of each window of ``width`` bigrams with those of a template.

    A bigram counts in the windows that begin behind its occurrence before, so each is counted once however often a window holds it.
    """
    n = len(pairs) - width + 1
    if n <= 0:
        return np.zeros(0)
    order = np.argsort(pairs, kind="stable")
    again = np.flatnonzero(pairs[order[1:]] == pairs[order[:-1]])
    before = np.full(len(pairs), -1, np.int64)
    before[order[again + 1]] = order[again]
    place = np.arange(len(pairs))
    first, last = np.maximum(before, place - width) + 1, np.minimum(place, n - 1)
    hit = _in(pairs, of)

    def counts(chosen: np.ndarray) -> np.ndarray:
        a, b = first[chosen], last[chosen]
        fits = a <= b
        steps = np.bincount(a[fits], minlength=n + 1) - np.bincount(b[fits] + 1, minlength=n + 1)
        return np.cumsum(steps)[:n]

    return 2 * counts(hit) / (counts(np.ones(len(pairs), bool)) + len(of))


def best_of_overlapping(found: list[Match]) -> list[Match]:
    kept: list[Match] = []
    for match in sorted(set(found)):
        if all(match[3] <= k[2] or k[3] <= match[2] for k in kept):
            kept.append(match)
    return kept


def find(block: Block, index: Index, threshold: float = THRESHOLD) -> list[list[Match]]:
    """The matches of each text that no better one overlaps; words are counted from the text's first."""
    out: list[list[Match]] = [[] for _ in range(len(block))]
    words = block.lowered().words(MARKS)
    if len(words) < 2 or not index.rows:
        return out
    pairs = grams(words.hashes(), 2)
    known, doc = _in(pairs, index.all), words.doc()
    bound = threshold / (2 - threshold)

    for bounds in _units(block):
        unit = np.searchsorted(bounds, words.start, "right") - 1
        whole = unit[:-1] == unit[1:]
        of, value, hit = unit[:-1][whole], pairs[whole], known[whole]
        # Units in which a template's bigram occurs at all; the others cannot match.
        touched = np.isin(of, np.unique(of[hit]))
        of, value, hit = of[touched], value[touched], hit[touched]
        order = np.lexsort((value, of))
        of, value, hit = of[order], value[order], hit[order]
        fresh = np.ones(len(of), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
        of, value, hit = of[fresh], value[fresh], hit[fresh]
        if not len(of):
            continue
        opens = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        size, common = np.diff(np.append(opens, len(of))), np.add.reduceat(hit.astype(np.int64), opens)
        for i in np.flatnonzero(common * (2 - threshold) >= threshold * size - 1e-9).tolist():
            a, b = np.searchsorted(unit, of[opens[i]]), np.searchsorted(unit, of[opens[i]], "right")
            d = int(doc[a])
            for name, dice in index.matches(value[opens[i] : opens[i] + size[i]], threshold):
                out[d].append((-dice, name, int(a - words.at[d]), int(b - words.at[d])))

    inside = doc[:-1] == doc[1:]
    for d in np.unique(doc[:-1][known & inside]).tolist():
        own = pairs[words.at[d] : words.at[d + 1] - 1]
        held = np.unique(own[known[words.at[d] : words.at[d + 1] - 1]])
        for name, of, size in index.rows:
            # No window has more of a template than the text.
            if len(held) < bound * len(of) - 1e-9 or np.count_nonzero(_in(of, held)) < bound * len(of) - 1e-9:
                continue
            dice = sliding_dice(own, of, size - 1)
            for at in np.flatnonzero(dice >= threshold).tolist():
                out[d].append((-float(dice[at]), name, at, at + size))
    return [best_of_overlapping(found) for found in out]


def _given(templates: dict[str, list[str]] | DataFrame | None) -> dict[str, list[str]]:
    if not isinstance(templates, DataFrame):
        return TEMPLATES if templates is None else templates
    rows = templates.select(F.col("license").cast("string").alias("license"), F.col("text").cast("string").alias("text")).where("license is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of templates; at most {MOST_BYTES} fit a task beside its texts")
    made: dict[str, list[str]] = {}
    for row in rows.collect():
        made.setdefault(row["license"], []).append(row["text"])
    return made


def scan(docs: DataFrame, templates: dict[str, list[str]] | DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (best, or null), dice, n_licenses and licenses (sorted, comma-joined), n_matches of every row."""
    texts = _given(templates)
    held: list[Index] = []

    def run(block: Block, rows: pa.RecordBatch) -> dict:
        if not held:
            held.append(Index(texts))
        found = find(block, held[0], threshold)
        best = [min(f, default=(0.0, None, 0, 0)) for f in found]
        names = [sorted({m[1] for m in f}) for f in found]
        return {
            "doc_id": rows.column("doc_id"), "license": pa.array([b[1] for b in best], pa.string()), "dice": pa.array([-b[0] + 0.0 for b in best], pa.float64()),
            "n_licenses": pa.array([len(n) for n in names], pa.int64()), "licenses": pa.array([",".join(n) for n in names], pa.string()),
            "n_matches": pa.array([len(f) for f in found], pa.int64()),
        }

    return map_texts(id_and_text(docs), run, "doc_id bigint, license string, dice double, n_licenses bigint, licenses string, n_matches bigint")
