"""Quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade <= k) = sigmoid(threshold_k - w.x)`` with one weight vector for all grades and ordered thresholds. Features are the distinct lower-cased
words of a text hashed into ``BUCKETS`` and a few shares of its characters and words. The model is fitted on at most ``sample``
rated documents, those with the least hash of their doc_id, by proximal gradient steps with an L1 penalty on word weights. The
driver receives hashed features of the sample alone. Every text is then scored where it lies.

A document is kept if the probability of the highest grade is at least ``keep``. A null, empty or wordless text has expected grade and
tail probability 0 and is not kept. Without ratings of at least two grades there is no evidence: every text with words is kept, with null
scores. A document rated more than once counts with its least grade; null ratings and ratings of unknown documents count
not at all. Repeated rows are scored one by one; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.common import BLANKS, MARKS, Block, id_and_text, map_texts

BUCKETS = 1 << 17
SAMPLE, KEEP = 8000, 0.5
STEPS, PENALTY = 600, 4e-4
SHARES = 17

_SIGN = np.zeros(256, bool)
_SIGN[[b for b in range(0x21, 0x7F) if MARKS[b] and b not in b".,"]] = True
_UPPER, _LOWERED, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B] = _LOWERED[0x61:0x7B] = _DIGIT[0x30:0x3A] = True


class Features(NamedTuple):
    """Distinct word buckets of all texts in a row, their number by text, and the shares of each text."""

    bucket: np.ndarray
    number: np.ndarray
    share: np.ndarray


class Model(NamedTuple):
    word: np.ndarray
    share: np.ndarray
    thresholds: np.ndarray


def features(block: Block) -> Features:
    n = len(block)
    words = block.lowered().words(MARKS)
    bucket = (words.hashes() & np.uint64(BUCKETS - 1)).astype(np.int64)
    pair = np.unique(words.doc() * BUCKETS + bucket)
    doc, bucket = pair // BUCKETS, pair % BUCKETS
    number = np.bincount(doc, minlength=n)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[block.at])

    view, parts = block.view, block.words(BLANKS)
    size, count = np.maximum(np.diff(block.at), 1), np.maximum(words.counts(), 1)
    sign, upper, lower = per_text(_SIGN[view]), per_text(_UPPER[view]), per_text(_LOWERED[view])
    # Words that end with a sign other than a point or comma.
    odd = np.bincount(parts.doc(), _SIGN[view[parts.end - 1]] if len(parts) else None, n)
    share = np.stack([
        np.minimum(1, 5 * sign / size), odd / np.maximum(parts.counts(), 1), upper / np.maximum(upper + lower, 1), np.minimum(1, 5 * per_text(_DIGIT[view]) / size),
        1 - number / count, (1 - number / count) ** 4, np.minimum(1, 20 * per_text(view == 0x7C) / size), np.minimum(1, np.log1p(words.counts()) / 10), (words.counts() < 20) * 1.0,
    ], axis=1)
    # Steps of the shares: a long text of many words shall not outweigh what holds for nearly all of it.
    steps = [share[:, 1] > 0.2, share[:, 1] > 0.5, share[:, 2] > 0.3, share[:, 2] > 0.6, share[:, 4] > 0.7, share[:, 4] > 0.9, share[:, 6] > 0.3, share[:, 6] > 0.7]
    return Features(bucket, number, np.concatenate([share, np.stack(steps, axis=1)], axis=1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(f: Features, grade: np.ndarray, grades: int, steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """Fit weights and thresholds; a word must be in five texts or more to have a weight."""
    n = len(grade)
    row = np.repeat(np.arange(n), f.number)
    often = np.bincount(f.bucket, minlength=BUCKETS) >= 5
    row, bucket = row[often[f.bucket]], f.bucket[often[f.bucket]]
    word, share = np.zeros(BUCKETS), np.zeros(SHARES)
    below = np.clip(np.array([(grade <= k).mean() for k in range(grades - 1)]), 1 / (n + 2), 1 - 1 / (n + 2))
    first = np.log(below / (1 - below))
    # Thresholds as a start and positive gaps, so that they stay in order.
    gaps = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    sums = [np.full(BUCKETS, 1e-8), np.full(SHARES, 1e-8), np.full(grades - 1, 1e-8)]
    for step in range(steps):
        threshold = gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))])
        score = np.bincount(row, word[bucket], n) + f.share @ share
        high = _sigmoid(np.append(threshold, np.inf)[grade] - score)
        low = _sigmoid(np.append(-np.inf, threshold)[grade] - score)
        chance = np.maximum(high - low, 1e-12)
        slope = (1 - high - low) / n
        by_word = np.bincount(bucket, slope[row], BUCKETS)
        by_share = f.share.T @ slope
        up, down = -high * (1 - high) / chance / n, low * (1 - low) / chance / n
        by_threshold = np.bincount(grade, up, grades)[: grades - 1] + np.bincount(grade, down, grades)[1:]
        by_gap = np.concatenate([[by_threshold.sum()], np.cumsum(by_threshold[::-1])[::-1][1:] * np.exp(gaps[1:])])
        for total, slope_of in zip(sums, (by_word, by_share, by_gap)):
            total += slope_of**2
        rate = 0.5
        scale = rate / np.sqrt(sums[0])
        word -= scale * by_word
        word = np.sign(word) * np.maximum(np.abs(word) - scale * penalty, 0)
        share -= rate / np.sqrt(sums[1]) * by_share
        gaps -= rate / np.sqrt(sums[2]) * by_gap
    return Model(word, share, gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))]))


def score(f: Features, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, expected grade and probability of the highest grade of each text."""
    n = len(f.number)
    value = np.bincount(np.repeat(np.arange(n), f.number), model.word[f.bucket], n) + f.share @ model.share
    above = 1 - _sigmoid(model.thresholds[None, :] - value[:, None])
    return value, above.sum(axis=1), above[:, -1]


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model from ``ratings`` (doc_id, grade 0, 1, ...) on at most ``sample`` documents; None without two grades."""
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = id_and_text(docs).join(F.broadcast(rated), "doc_id").select("grade", "text")

    def run(block: Block, rows: pa.RecordBatch) -> dict:
        f = features(block)
        ends = np.cumsum(f.number)
        return {
            "grade": rows.column("grade"),
            "bucket": pa.array([x.astype("<i4").tobytes() for x in np.split(f.bucket, ends[:-1])], pa.binary()),
            "share": pa.array([x.astype("<f8").tobytes() for x in f.share], pa.binary()),
        }

    # At most ``sample`` rows; sorted, so that sums of floating-point numbers do not depend on the order of tasks.
    rows = sorted(map_texts(texts, run, "grade int, bucket binary, share binary").collect(), key=lambda r: (r["grade"], r["bucket"], r["share"]))
    grade = np.array([r["grade"] for r in rows], np.int64)
    if len(np.unique(grade)) < 2:
        return None
    bucket = [np.frombuffer(bytes(r["bucket"]), "<i4").astype(np.int64) for r in rows]
    share = np.stack([np.frombuffer(bytes(r["share"]), "<f8") for r in rows])
    return fit(Features(np.concatenate(bucket), np.array([len(b) for b in bucket]), share), grade, int(grade.max()) + 1)


def classify(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """doc_id, score, expected_grade, tail_probability and kept of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, ratings, sample))
    schema = "doc_id bigint, score double, expected_grade double, tail_probability double, kept boolean"
    return map_texts(id_and_text(docs), lambda block, rows: {"doc_id": rows.column("doc_id")} | _verdict(block, shared.value, keep), schema)


def keep_good(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """Rows of ``docs`` that ``classify`` keeps, with all their columns, filtered where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, ratings, sample))

    def run(block: Block, rows: pa.RecordBatch) -> dict:
        good = rows.filter(_verdict(block, shared.value, keep)["kept"])
        return dict(zip(good.schema.names, good.columns))

    return map_texts(docs, run, docs.schema)


def _verdict(block: Block, model: Model | None, keep: float) -> dict:
    f = features(block)
    some = f.number > 0
    if model is None:
        none = pa.nulls(len(some), pa.float64())
        return {"score": none, "expected_grade": none, "tail_probability": none, "kept": pa.array(some)}
    value, expected, tail = score(f, model)
    return {
        "score": pa.array(np.where(some, value, 0.0)), "expected_grade": pa.array(np.where(some, expected, 0.0)),
        "tail_probability": pa.array(np.where(some, tail, 0.0)), "kept": pa.array(some & (tail >= keep)),
    }


def ratings(labels: DataFrame) -> DataFrame:
    """Grades from the labels table: 0 toxic, 1 of low quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2)
    return labels.select("doc_id", grade.alias("grade"))


