"""Search that counts items: every path gives the best segment of each item, as a full listing does."""

import numpy as np
import pytest

from labelgrid.operators import scan

SPAN = 1000


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    # Two decimals, so scores tie; items have 1 to 12 segments, out of order.
    index = [(item * SPAN + s, [float(x) for x in rng.integers(-2, 3, 4)]) for item in range(40) for s in range(1 + item % 12)]
    rng.shuffle(index)
    queries = [(q, [float(x) for x in rng.integers(-2, 3, 4)]) for q in range(9)]
    return queries, [(int(i), v) for i, v in index]


def expected(queries, index, k):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    out = []
    for q, v in queries:
        best = {}
        for i, w in index:
            hit = (-round(float(unit(v) @ unit(w)), 9) + 0.0, i)
            best[i // SPAN] = min(best.get(i // SPAN, hit), hit)
        out += [(q, i, -s + 0.0, r) for r, (s, i) in enumerate(sorted(best.values())[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k, ship", [(1, None), (7, None), (100, None), (7, 0), (100, 0)])
def test_dense_items(spark, sides, k, ship):
    queries, index = sides
    q = spark.createDataFrame(queries, "query_id long, vector array<double>")
    d = spark.createDataFrame(index, "id long, vector array<float>").repartition(5)
    found = scan.dense_search(q, d, k, span=SPAN, ship_rows=ship).select("query_id", "id", "score", "rank").collect()
    assert sorted((a, b, round(c, 9) + 0.0, r) for a, b, c, r in found) == expected(queries, index, k)


@pytest.mark.parametrize("ship", [None, 0])
def test_sparse_items(spark, sides, ship):
    queries, index = sides
    terms = lambda v: ([i for i, x in enumerate(v) if x], [abs(x) for x in v if x])
    q = spark.createDataFrame([(i, *terms(v)) for i, v in queries], "query_id long, idx array<int>, w array<double>")
    d = spark.createDataFrame([(i, *terms(v)) for i, v in index], "id long, idx array<int>, w array<double>").repartition(5)
    every = scan.sparse_search(q, d, 10**6, ship_cells=10**9).collect()
    best = {}
    for r in every:
        key, hit = (r["query_id"], r["id"] // SPAN), (-r["score"], r["id"])
        best[key] = min(best.get(key, hit), hit)
    wanted = []
    for query in {key[0] for key in best}:
        rows = sorted(hit for key, hit in best.items() if key[0] == query)[:6]
        wanted += [(query, i, -s, r) for r, (s, i) in enumerate(rows, 1)]
    found = scan.sparse_search(q, d, 6, span=SPAN, ship_cells=ship).select("query_id", "id", "score", "rank").collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_floors_of_items(spark, sides, monkeypatch):
    monkeypatch.setattr(scan, "SEED_PARTITIONS", 2)
    monkeypatch.setattr(scan, "SEED_SHARE", 2)
    queries, index = sides
    q = spark.createDataFrame(queries, "query_id long, vector array<double>")
    d = spark.createDataFrame(index, "id long, vector array<float>").repartition(5)
    found = scan.dense_search(q, d, 7, span=SPAN).select("query_id", "id", "score", "rank").collect()
    assert sorted((a, b, round(c, 9) + 0.0, r) for a, b, c, r in found) == expected(queries, index, 7)
