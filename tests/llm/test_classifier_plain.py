"""The ordinal classifier against a plain version: likelihood, fit and score written out row by row."""

import math
import random
import re

import numpy as np
import pytest

from labelgrid.llm import classifier
from labelgrid.llm.common import Block

from . import brute

DATA = "/root/testdata/sf0.001"
# Capitals count as signs, too.
SIGNS = {chr(b) for b in range(0x21, 0x7F)} - set("0123456789abcdefghijklmnopqrstuvwxyz.,")


def bucket_of(word):
    raw = word.encode()
    hashed = Block(raw, np.array([0, len(raw)])).words(np.zeros(256, bool)).hashes()
    return int(hashed[0]) & (classifier.BUCKETS - 1)


def plain_features(text):
    text = text or ""
    words, parts = brute.marked(text), brute.words(text)
    buckets = sorted({bucket_of(w) for w in words})
    size = max(1, len(text.encode()))
    part = lambda test: sum(map(test, text))
    upper, lower = part(lambda c: "A" <= c <= "Z"), part(lambda c: "a" <= c <= "z")
    odd, plainness = sum(p[-1] in SIGNS for p in parts) / max(1, len(parts)), 1 - len(buckets) / max(1, len(words))
    share = [
        min(1, 5 * part(SIGNS.__contains__) / size), odd, upper / max(1, upper + lower), min(1, 5 * part(lambda c: "0" <= c <= "9") / size), plainness, plainness**4,
        min(1, 20 * text.count("|") / size), min(1, math.log1p(len(words)) / 10), float(len(words) < 20),
    ]
    steps = [odd > 0.2, odd > 0.5, share[2] > 0.3, share[2] > 0.6, plainness > 0.7, plainness > 0.9, share[6] > 0.3, share[6] > 0.7]
    return buckets, share + [float(s) for s in steps]


def sigmoid(x):
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def log_chance(score, thresholds, grade):
    """Cumulative links: the chance of a grade lies between two thresholds."""
    high = sigmoid(thresholds[grade] - score) if grade < len(thresholds) else 1.0
    low = sigmoid(thresholds[grade - 1] - score) if grade else 0.0
    return math.log(high - low)


def plain_fit(rows, grades, steps, penalty):
    """Ascent of the mean log-likelihood, with slopes by differences of each row's likelihood."""
    n, e = len(rows), 1e-5
    often = {b for b in {b for bs, _ in [f for f, _ in rows] for b in bs} if sum(b in f[0] for f, _ in rows) >= 5}
    word, share = dict.fromkeys(often, 0.0), [0.0] * classifier.SHARES
    below = [min(max(sum(g <= k for _, g in rows) / n, 1 / (n + 2)), 1 - 1 / (n + 2)) for k in range(grades - 1)]
    first = [math.log(b / (1 - b)) for b in below]
    gaps = first[:1] + [math.log(max(b - a, 1e-3)) for a, b in zip(first, first[1:])]
    sums = [dict.fromkeys(often, 1e-8), [1e-8] * classifier.SHARES, [1e-8] * (grades - 1)]
    spaced = lambda g: [g[0] + sum(math.exp(x) for x in g[1:k]) for k in range(1, grades)]
    for _ in range(steps):
        thresholds = spaced(gaps)
        by_word, by_share, by_gap = dict.fromkeys(often, 0.0), [0.0] * classifier.SHARES, [0.0] * (grades - 1)
        for (buckets, shares), grade in rows:
            score = sum(word[b] for b in buckets if b in often) + sum(a * b for a, b in zip(shares, share))
            slope = -(log_chance(score + e, thresholds, grade) - log_chance(score - e, thresholds, grade)) / (2 * e) / n
            for b in buckets:
                if b in often:
                    by_word[b] += slope
            by_share = [a + slope * b for a, b in zip(by_share, shares)]
            for k in range(grades - 1):
                up, down = list(gaps), list(gaps)
                up[k], down[k] = up[k] + e, down[k] - e
                by_gap[k] -= (log_chance(score, spaced(up), grade) - log_chance(score, spaced(down), grade)) / (2 * e) / n
        for b in often:
            sums[0][b] += by_word[b] ** 2
            scale = 0.5 / math.sqrt(sums[0][b])
            moved = word[b] - scale * by_word[b]
            word[b] = math.copysign(max(abs(moved) - scale * penalty, 0), moved)
        for values, slopes, total in ((share, by_share, sums[1]), (gaps, by_gap, sums[2])):
            for k, slope in enumerate(slopes):
                total[k] += slope**2
                values[k] -= 0.5 / math.sqrt(total[k]) * slope
    return word, share, spaced(gaps)


@pytest.mark.parametrize("grades", [2, 3, 4])
def test_fit_against_plain_ascent(grades):
    rnd, texts, labels = random.Random(grades), [], []
    for _ in range(60):
        grade = rnd.randrange(grades)
        texts.append(" ".join(rnd.choice([f"g{grade}", f"g{max(0, grade - 1)}", "and", "The", "#!", "x|", "7"]) for _ in range(rnd.randint(3, 30))))
        labels.append(grade)
    plain = [plain_features(t) for t in texts]
    raw = [t.encode() for t in texts]
    found = classifier.features(Block(b"".join(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])])))
    ends = np.cumsum(found.number)
    for (buckets, share), a, b, row in zip(plain, np.concatenate([[0], ends]), ends, found.share):
        assert buckets == found.bucket[a:b].tolist() and np.allclose(share, row)
    model = classifier.fit(found, np.array(labels), grades, steps=25, penalty=1e-3)
    word, share, thresholds = plain_fit(list(zip(plain, labels)), grades, 25, 1e-3)
    assert np.allclose(model.share, share, atol=1e-4) and np.allclose(model.thresholds, thresholds, atol=1e-4)
    assert all(abs(model.word[b] - w) < 1e-4 for b, w in word.items()) and np.count_nonzero(model.word) <= len(word)


def test_every_row_scored_again(spark):
    """All documents of the smallest table, scored row by row from the fitted model."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rated = classifier.ratings(labels)
    model = classifier.train(docs, rated)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = classifier.classify(docs, rated).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if not (texts[r["doc_id"]] or "").strip():
            continue
        buckets, share = plain_features(texts[r["doc_id"]])
        score = sum(model.word[b] for b in buckets) + sum(a * b for a, b in zip(share, model.share))
        above = [1 - sigmoid(t - score) for t in model.thresholds]
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["expected_grade"] == pytest.approx(sum(above), abs=1e-9)
        assert r["tail_probability"] == pytest.approx(above[-1], abs=1e-9) and r["kept"] == (r["tail_probability"] >= classifier.KEEP)
