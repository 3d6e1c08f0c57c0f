"""Both ways of every search against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelgrid.operators import scan
from labelgrid.operators import search as se
from labelgrid.operators.encode import HashingEncoder, compute_missing, encode_column, generate_column, with_retry

rng = np.random.default_rng(3)
CENTRES = rng.normal(size=(5, 8))
POINTS = np.vstack([CENTRES[rng.integers(5, size=300)] + rng.normal(scale=0.15, size=(300, 8)), np.repeat(CENTRES[:1], 150, axis=0)])


def frame(spark, name, rows=POINTS):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{name} long, vector array<float>").repartition(3)


def brute(k=None, floor=None, skip_self=False, earlier=False):
    unit = POINTS.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    out = set()
    for q in range(len(unit)):
        ids = [d for d in range(len(unit)) if (floor is None or scores[q, d] >= floor) and not (skip_self and d == q) and not (earlier and d >= q)]
        ids.sort(key=lambda d: (-scores[q, d], d))
        out |= {(q, d) for d in (ids if k is None else ids[:k])}
    return out


@pytest.mark.parametrize("ship_rows", [None, 10])
@pytest.mark.parametrize("kwargs", [
    dict(k=7, skip_self=True), dict(k=3), dict(min_score=0.97), dict(k=1, min_score=0.9, earlier_only=True),
])
def test_dense_search_shipped_and_tiled(spark, ship_rows, kwargs):
    got = scan.dense_search(frame(spark, "query_id"), frame(spark, "id"), ship_rows=ship_rows, **kwargs).collect()
    want = brute(kwargs.get("k"), kwargs.get("min_score"), kwargs.get("skip_self", False), kwargs.get("earlier_only", False))
    assert {(r["query_id"], r["id"]) for r in got} == want
    assert len(got) == len(want)


def test_tiles_split_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(scan, "INDEX_TILE", 20)
    monkeypatch.setattr(scan, "QUERY_TILE", 15)
    got = scan.dense_search(frame(spark, "query_id"), frame(spark, "id"), k=4, ship_rows=10).collect()
    assert {(r["query_id"], r["id"]) for r in got} == brute(4)


def test_thresholds_from_a_first_pass_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(scan, "SEED_PARTITIONS", 0)
    monkeypatch.setattr(scan, "SEED_SHARE", 4)
    got = scan.dense_search(frame(spark, "query_id"), frame(spark, "id"), k=5).collect()
    assert {(r["query_id"], r["id"]) for r in got} == brute(5)


def test_a_limit_is_required(spark):
    with pytest.raises(ValueError):
        scan.dense_search(frame(spark, "query_id"), frame(spark, "id"))


def sparse_rows(spark, name, n, seed):
    r = random.Random(seed)
    rows = [(i, sorted(r.sample(range(40), r.randint(0, 8))), []) for i in range(n)]
    rows = [(i, idx, [round(r.uniform(0.1, 1), 3) for _ in idx]) for i, idx, _ in rows]
    return rows, spark.createDataFrame(rows, f"{name} long, idx array<int>, w array<double>")


@pytest.mark.parametrize("ship_cells", [None, 0])
@pytest.mark.parametrize("all_rows", [False, True])
def test_sparse_search_shipped_and_joined(spark, ship_cells, all_rows):
    queries, q = sparse_rows(spark, "query_id", 25, 1)
    index, d = sparse_rows(spark, "id", 120, 2)
    got = scan.sparse_search(q, d, 6, all_rows=all_rows, ship_cells=ship_cells).collect()
    want = set()
    for qi, idx, w in queries:
        weights = dict(zip(idx, w))
        scored = [(round(sum(weights[t] * x for t, x in zip(di, dw) if t in weights), 9), i) for i, di, dw in index]
        scored = [s for s in scored if all_rows or s[0] > 0]
        want |= {(qi, i, s) for s, i in sorted(scored, key=lambda s: (-s[0], s[1]))[:6]}
    assert {(r["query_id"], r["id"], r["score"]) for r in got} == want


TEXTS = ["el toro rojo y el sol", "un sol de oro", "la dama y el toro", "", "oro oro oro", "nada que ver", "dama de oro"]


@pytest.mark.parametrize("ship_cells", [None, 0])
def test_bm25_against_the_formula(spark, ship_cells):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    asked = ["toro rojo", "oro", "el el dama", "zzz"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    split = [t.split() for t in TEXTS]
    n, avg = len(split), sum(map(len, split)) / len(split)
    df = {t: sum(t in d for d in split) for d in split for t in d}
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    want = set()
    for q, text in enumerate(asked):
        scores = [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in text.split()) for d in split]
        want |= {(q, i) for i in sorted(range(n), key=lambda i: (-round(scores[i], 6), i))[:4]}
    got = se.bm25(queries, docs, 4, ship_cells=ship_cells).collect()
    assert {(r["query_id"], r["id"]) for r in got} == want


@pytest.mark.parametrize("block, reach", [(se.NEEDLE_BYTES, se.TEXT_BYTES), (60, 1)])
def test_lexical_hits_by_blocks(spark, monkeypatch, block, reach):
    """Needles of any length, copies of them, letters of several bytes, empty and missing texts; blocks of needles and texts of any size."""
    monkeypatch.setattr(se, "TEXT_BYTES", reach)
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abÉñ中 ") for _ in range(rnd.randint(1, 12)))
    texts = [(i, " ".join(word() for _ in range(rnd.randint(0, 30)))) for i in range(40)] + [(40, None), (41, ""), (42, "aaaaaaaaab"), (43, "aaaaaaaab")]
    needles = [(q, word()) for q in range(30)] + [(100, "  "), (101, None), (102, "AAAAAAAAAB"), (103, "a"), (104, "a"), (105, "É"), (106, texts[3][1])]
    got = se.lexical_hits(spark.createDataFrame(needles, "query_id long, text string"), spark.createDataFrame(texts, "item_id long, text string").repartition(3), block)
    expected = sorted((q, i) for q, n in needles for i, t in texts if (n or "").strip() and (n.strip().lower() in (t or "").lower()))
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 50


@pytest.mark.parametrize("ship_rows", [None, 3])
def test_near_duplicates_with_a_large_group_of_copies(spark, ship_rows):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0])] + [(i, [1.0, 0.01]) for i in range(2, 40)] + [(40, [0.0, 2.0]), (41, [0.0, 0.0]), (42, [0.0, 0.0])]
    got = {r["id"]: r["match_id"] for r in se.near_duplicates(spark.createDataFrame(rows, "id long, vector array<float>"), 0.95, ship_rows).collect()}
    assert got == {2: 0, **{i: 2 for i in range(3, 40)}, 40: 1}


def test_gate_verdicts(spark):
    rows = [(0, "a b c d", [1.0, 0.0]), (1, "a b c d", [1.0, 0.0]), (2, "x y", [1.0, 0.0]), (3, "a b c d", [0.0, 1.0])]
    items = spark.createDataFrame(rows, "id long, text string, vector array<float>")
    assert {r["id"]: r["status"] for r in se.duplicate_gate(items).collect()} == {0: "new", 1: "duplicate", 2: "new", 3: "new"}
    assert {r["status"] for r in se.duplicate_gate(items, force=True).collect()} == {"new"}


def test_encoder_hook(spark):
    df = spark.createDataFrame([(0, "uno dos dos"), (1, ""), (2, None)], "id int, text string")
    rows = {r["id"]: r for r in encode_column(df, "text", HashingEncoder, batch=2).collect()}
    assert sum(x * x for x in rows[0]["dense"]) == pytest.approx(1.0, abs=1e-6)
    assert sorted(rows[0]["sparse_w"]) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert rows[1]["sparse_idx"] == [] and set(rows[2]["dense"]) == {0.0}


def test_flat_calls_are_bounded_and_repeated(spark, tmp_path):
    seen = str(tmp_path)

    class Flaky(HashingEncoder):
        """Fails at the first call for each batch of texts and notes the size of each call."""

        def flat(self, texts):
            import os
            import uuid

            open(f"{seen}/{len(texts)}-{uuid.uuid4().hex}", "w").close()
            if not os.path.exists(mark := f"{seen}/mark-{hash(tuple(texts))}"):
                open(mark, "w").close()
                raise RuntimeError("down")
            return super().flat(texts)

    df = spark.createDataFrame([(i, f"toro rojo {i}") for i in range(11)], "id long, text string").coalesce(1)
    got = {r["id"]: r["sparse_idx"] for r in encode_column(df, "text", Flaky, batch=3).collect()}
    assert got == {r["id"]: r["sparse_idx"] for r in encode_column(df, "text", HashingEncoder).collect()}
    sizes = [int(p.name.split("-")[0]) for p in tmp_path.iterdir() if not p.name.startswith("mark")]
    assert max(sizes) == 3 and len(sizes) >= 8


def test_retry_is_bounded():
    calls = []

    def flaky(batch):
        calls.append(batch)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return batch

    assert with_retry(flaky, 3)([1]) == [1] and len(calls) == 3
    with pytest.raises(RuntimeError):
        with_retry(lambda b: 1 / 0 if b is None else (_ for _ in ()).throw(RuntimeError("down")), 2)([1])


def test_generator_errors_become_text(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, v string")

    def generate(v):
        if v == "bad":
            raise ValueError("no")
        return v * 2

    rows = {r["id"]: r for r in generate_column(df, "v", generate, lambda t: len(t) < 3).collect()}
    assert rows[1]["text"] == "okok" and rows[1]["failed"] == 0 and rows[1]["latency_s"] >= 0
    assert rows[2]["text"] == "ERROR: no" and rows[2]["failed"] == 1


def test_only_missing_items_are_computed(spark):
    items = spark.range(5).withColumnRenamed("id", "k")
    cache = spark.createDataFrame([(1, "old"), (3, "old")], "k long, v string")
    out = compute_missing(items, cache, "k", lambda m: m.withColumn("v", F.lit("new")))
    assert {r["k"]: r["v"] for r in out.collect()} == {0: "new", 1: "old", 2: "new", 3: "old", 4: "new"}


@pytest.mark.parametrize("limits", [scan.Limits(3), scan.Limits(3, skip_self=True), scan.Limits(None, 0.9), scan.Limits(None, 0.9, earlier_only=True), scan.Limits(2, 0.5, earlier_only=True)])
def test_tiles_with_pivots_in_two_levels(spark, monkeypatch, limits):
    monkeypatch.setattr(scan, "CELL_ROWS", 4)
    monkeypatch.setattr(scan, "INDEX_TILE", 3)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 5))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=5) * 0.2]) for i in range(300)]
    frame = lambda name: spark.createDataFrame(rows, f"{name} long, vector array<double>").repartition(3)
    found = scan.dense_search(frame("query_id"), frame("id"), limits.k, limits.min_score, limits.skip_self, limits.earlier_only, ship_rows=0)
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    scores, expected = np.round(u @ u.T, 9), set()
    for q in range(len(rows)):
        hits = [(-scores[q, d], d) for d in range(len(rows)) if not (limits.skip_self and d == q) and not (limits.earlier_only and d >= q) and (limits.min_score is None or scores[q, d] >= limits.min_score)]
        expected |= {(q, d) for _, d in sorted(hits)[: limits.k]}
    assert {(r["query_id"], r["id"]) for r in found.collect()} == expected


def test_share_of_visited_cells_falls_with_the_rows(spark, monkeypatch):
    """Cells keep their size, so more rows make smaller cells, of which a query visits a smaller share; earlier rows only halve it again."""
    monkeypatch.setattr(scan, "CELL_ROWS", 10)
    rng = np.random.default_rng(7)
    shares = []
    for n in (500, 8000):
        u = rng.normal(size=(n, 3))
        rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(u)], "id long, vector array<float>")
        _, cells = scan._dealt(rows)
        unit = u[:400] / np.linalg.norm(u[:400], axis=1, keepdims=True)
        share = lambda ids, limits: len(cells.visits(unit, ids, limits)[0]) / (400 * len(cells))
        shares.append((share(np.arange(400), scan.Limits(None, 0.99)), share(np.arange(400), scan.Limits(None, 0.99, earlier_only=True))))
        assert len(cells) == n // 10 and len(cells.tops) == int(len(cells) ** 0.5)
    assert shares[1][0] < shares[0][0] / 2 and all(earlier < whole for whole, earlier in shares), shares


@pytest.mark.parametrize("k, least, span", [(4, None, None), (1, None, None), (4, 2.5, None), (None, 3.0, None), (3, None, 10), (10**6, None, None)])
def test_sparse_search_by_bounds(spark, monkeypatch, k, least, span):
    """Beyond the shipped block: equal to the full join, with far fewer rows joined when common terms weigh little."""
    monkeypatch.setattr(scan, "SEED_ROWS", 100)
    rng = np.random.default_rng(4)
    index = []
    for i in range(900):
        terms = sorted({0, 1, *rng.integers(2, 40, rng.integers(0, 3)).tolist()} if i % 9 else set())
        index.append((i, terms, [float(0.1 * rng.integers(1, 4)) if t < 2 else float(rng.integers(1, 4)) for t in terms]))
    queries = [(q, terms, [1.0] * len(terms)) for q, terms in enumerate([[0, 1, 5, 9], [0, 7], [0, 1], [], [99], [2, 3, 4, 5, 6]])]
    q = spark.createDataFrame(queries, "query_id long, idx array<int>, w array<double>")
    d = spark.createDataFrame(index, "id long, idx array<int>, w array<double>").repartition(3)
    found = scan.sparse_search(q, d, k, least, ship_cells=0, span=span)
    expected = set()
    for name, terms, weights in queries:
        own, best = dict(zip(terms, weights)), {}
        for i, has, w in index:
            shared = [(own[t], x) for t, x in zip(has, w) if t in own]
            score = round(sum(a * b for a, b in shared), 9)
            if shared and (least is None or score >= least):
                best[i if span is None else i // span] = min(best.get(i if span is None else i // span, (0.0, 0)), (-score, i))
        expected |= {(name, i, -s, r) for r, (s, i) in enumerate(sorted(best.values())[:k], 1)}
    assert {(r["query_id"], r["id"], round(r["score"], 9), r["rank"]) for r in found.collect()} == {(a, b, round(c, 9), e) for a, b, c, e in expected}
    if k == 4 and least is None:
        floors = scan._floors(q, d, scan.Limits(k))
        needed = scan.term_bounds(q, scan._postings(d), floors).where("needed")
        joined = scan._postings(d).join(needed.select("query_id", "term"), "term").count()
        assert joined * 2 < scan._postings(d).join(scan._query_terms(q), "term").count()


def test_packs_ship_each_vector_once(spark, monkeypatch):
    """Beyond the shipped block rows go into one pack of their cell each, however many cells the queries visit, and hits are those of all pairs."""
    monkeypatch.setattr(scan, "CELL_ROWS", 4)
    monkeypatch.setattr(scan, "INDEX_TILE", 10)
    monkeypatch.setattr(scan, "QUERY_TILE", 7)
    monkeypatch.setattr(scan, "PACK_BYTES", 2000)
    monkeypatch.setattr(scan, "BLOCK_CELLS", 30)
    monkeypatch.setattr(scan, "EXACT_ROWS", 5)
    limits = scan.Limits(3, 0.2, skip_self=True)
    rows, cells = scan._dealt(frame(spark, "id"))
    packs, asked = scan._index_packs(rows, cells), scan._query_packs(frame(spark, "query_id"), cells, limits)
    for df in (packs, asked):
        assert sorted(i for r in df.collect() for i in np.frombuffer(r["ids"], np.int64).tolist()) == list(range(len(POINTS)))
    hits = scan._dense_tiles(frame(spark, "query_id"), frame(spark, "id"), limits)
    assert "CartesianProduct" in hits._jdf.queryExecution().executedPlan().toString()
    assert {(r["query_id"], r["id"]) for r in scan._finish(hits, limits).collect()} == brute(3, 0.2, True)


def test_single_precision_loses_no_hit():
    """Scores that differ only beyond single precision are told apart, and of many that tie the smaller ids come first."""
    names = np.arange(50)
    angles = np.append(1e-3 + 1e-8 * np.arange(40), np.full(10, 0.5))
    rows = np.stack([np.cos(angles), np.sin(angles)], 1)
    search = scan.PackSearch(np.array([99]), np.array([[1.0, 0.0]]), np.array([-1.0]), scan.Limits(5))
    out = [f for at in range(0, 50, 9) for f in search.meet(names[::-1][at : at + 9], rows[::-1][at : at + 9])] + list(search.flush())
    scores = np.round(rows[:, 0], 9)
    assert [i for f in out for i in f["id"]] == sorted(names.tolist(), key=lambda i: (-scores[i], i))[:5]


def test_encoder_as_a_plain_version_has_it(monkeypatch):
    import hashlib
    import re
    import unicodedata
    from collections import Counter

    from labelgrid.operators import encode as en

    monkeypatch.setattr(en, "KNOWN_TERMS", 3)  # most terms are not remembered
    texts = ["Uno dos, UNO-3_4!", "", None, "ñandú ² ａＢ İK\x1fß a1b2", "!!", "uno " * 50 + "tres"]
    dense, sizes, places, weights = (encoder := HashingEncoder()).flat(texts)
    assert len(encoder.known) == 3
    at = 0
    for row, text in enumerate(texts):
        plain = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
        vector, sparse = np.zeros(64), Counter()
        for term, n in Counter(re.findall("[a-z0-9]+", plain)).items():
            number = int(hashlib.md5(term.encode()).hexdigest()[:8], 16)
            vector[(number >> 4) % 64] += -n if number & 1 else n
            sparse[number >> 4] += n
        length = np.sqrt(sum(n * n for n in sparse.values()))
        assert np.allclose(dense[row], vector / (np.sqrt((vector**2).sum()) or 1))
        assert places[at : at + sizes[row]].tolist() == sorted(sparse)
        assert np.allclose(weights[at : at + sizes[row]], [sparse[p] / length for p in sorted(sparse)])
        at += sizes[row]
    assert at == len(places)


def test_blocks_too_far_on_few_axes_are_passed_over(monkeypatch):
    """Hits and links of packs in blocks of neighbours equal those of all pairs, and most pairs are never scored."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 24)) * np.linspace(3, 0.3, 24)
    rows = centres[rnd.integers(0, 40, 1500)] + rnd.normal(size=(1500, 24)) * 0.15
    rows[7] = 0
    rows = scan._unit(rows)
    ids = rnd.permutation(1500).astype(np.int64)
    axes = scan.main_axes(rows[:200])
    monkeypatch.setattr(scan, "AXES", 6)
    few = scan.main_axes(rows[:200])
    exact = np.round(np.einsum("ij,kj->ik", rows, rows), 9)
    made, real = [], scan.PackSearch._score
    monkeypatch.setattr(scan.PackSearch, "_score", lambda self, own, some, *rest: made.append((own.stop - own.start) * len(some)) or real(self, own, some, *rest))
    for basis in (axes, few):
        order = scan.neighbours_first(scan.along_axes(rows, basis), 32)
        assert sorted(order.tolist()) == list(range(1500))
        monkeypatch.setattr(scan, "QUERY_BLOCK", 32)
        monkeypatch.setattr(scan, "INDEX_BLOCK", 32)
        for limits in (scan.Limits(None, 0.95, earlier_only=True), scan.Limits(1, 0.95, earlier_only=True), scan.Limits(5, skip_self=True), scan.Limits(None, 0.95, earlier_only=True, links=True)):
            least = -1.0 if limits.min_score is None else limits.min_score
            search = scan.PackSearch(ids[order], rows[order], np.full(1500, least), limits, basis)
            made.clear()
            frames = [f for cut in np.array_split(order, 3) for f in search.meet(ids[cut], rows[cut])] + list(search.flush())
            got = pd.concat(frames)
            allowed = exact >= least
            allowed &= (ids[None, :] < ids[:, None]) if limits.earlier_only else (ids[None, :] != ids[:, None])
            want = {(int(ids[q]), int(ids[d])): exact[q, d] for q, d in np.argwhere(allowed)}
            if limits.links:
                counts = got[got["score"] > 0]
                assert dict(zip(counts["id"], counts["score"])) == {i: n for i, n in zip(ids.tolist(), allowed.sum(axis=1)) if n}
                assert (got["score"] < 0).sum() < 1500
                continue
            found = {(q, i): v for q, i, v in got.itertuples(index=False)}
            assert len(found) == len(got) and all(abs(want[x] - v) < 2e-9 for x, v in found.items())
            if limits.k is None:
                assert set(found) == set(want)
            else:
                first = {}
                for (q, i), v in want.items():
                    first.setdefault(q, []).append((-v, i))
                assert all((q, i) in found for q, hits in first.items() for _, i in sorted(hits)[: limits.k])
            if limits.min_score is not None:
                assert sum(made) < 0.5 * 1500 * 1500
