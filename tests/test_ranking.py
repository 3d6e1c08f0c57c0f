import pytest
from pyspark.sql import functions as F

from labelgrid.operators import metrics as me
from labelgrid.operators import ranking as rk

HITS = "query_id string, item_id string, rank int, score double"
RANKED = "query_id string, system string, item_id string, rank int, complete boolean"
QRELS = "query_id string, item_id string, gain int"


def test_best_segment_keeps_best_rank_once(spark):
    hits = spark.createDataFrame([("q", "1_01", 3, 0.7), ("q", "1_02", 1, 0.9), ("q", "1_01", 2, 0.8), ("q", "1_03", 4, 0.1)], HITS)
    rows = rk.best_segment(hits, ["query_id"]).orderBy("rank").collect()
    assert [(r["item_id"], r["rank"], r["segment_rank"]) for r in rows] == [("1_02", 1, 1), ("1_01", 2, 2), ("1_03", 3, 4)]


def branch(spark, ids):
    return spark.createDataFrame([("q", i, n + 1) for n, i in enumerate(ids)], "query_id string, item_id string, rank int")


def test_fusion_scores_and_ties(spark):
    out = rk.rrf({"a": branch(spark, ["x", "y"]), "b": branch(spark, ["y", "x", "z"])}).orderBy("rank").collect()
    assert [r["item_id"] for r in out] == ["x", "y", "z"]
    assert out[0]["score"] == pytest.approx(1 / 61 + 1 / 62)
    assert out[2]["score"] == pytest.approx(1 / 63)


def test_fusion_with_an_empty_branch(spark):
    out = rk.rrf({"dense": branch(spark, ["x"]), "sparse": branch(spark, ["x"]).limit(0)}).collect()
    assert [(r["item_id"], r["score"]) for r in out] == [("x", pytest.approx(1 / 61))]


def test_fusion_rejects_repeats_and_bad_k(spark):
    with pytest.raises(Exception, match="twice in one branch"):
        rk.rrf({"a": branch(spark, ["x", "x"]), "b": branch(spark, ["x"])}).collect()
    with pytest.raises(ValueError):
        rk.rrf({"a": branch(spark, ["x"])}, k=0)


def test_fusion_bounds_and_fifty(spark):
    a, b = [f"i{n:03d}" for n in range(80)], [f"i{n:03d}" for n in reversed(range(80))]
    out = rk.rrf({"a": branch(spark, a), "b": branch(spark, b)}).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 51)) and len({r["item_id"] for r in out}) == 50
    assert all(0 < r["score"] <= 2 / 61 for r in out)


def test_incomplete_ranking_fails(spark):
    good = branch(spark, ["x", "y"])
    assert rk.require_complete(good, 2, ["query_id"]).collect()[0]["complete"]
    for bad in (branch(spark, ["x"]), branch(spark, ["x", "x"])):
        with pytest.raises(Exception, match="incomplete ranking"):
            rk.require_complete(bad, 2, ["query_id"]).collect()


def test_pages(spark):
    df = spark.range(10)
    rows = rk.page(df, ["id"], 1, 4).collect()
    assert sorted(r["id"] for r in rows) == [4, 5, 6, 7] and rows[0]["total"] == 10 and rows[0]["has_more"]
    assert not rk.page(df, ["id"], 2, 4).collect()[0]["has_more"]


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a = [r["id"] for r in rk.hash_sample(df.repartition(3), "id", 20, 7).collect()]
    b = [r["id"] for r in rk.hash_sample(df.repartition(11), "id", 20, 7).collect()]
    assert sorted(a) == sorted(b) and len(set(a)) == 20


def run(spark, ids, gains, complete=True):
    rankings = spark.createDataFrame([("q", "s", i, n + 1, complete) for n, i in enumerate(ids)], RANKED)
    return rankings, spark.createDataFrame([("q", i, g) for i, g in gains.items()], QRELS)


def test_metric_constants(spark):
    rankings, qrels = run(spark, ["a", "b", "c"], {"a": 1, "c": 1})
    row = me.metrics_for_rankings(rankings, qrels).first()
    assert row["ndcg_at_10"] == pytest.approx(0.9197207891, abs=1e-9)
    assert row["map"] == pytest.approx((1 + 2 / 3) / 2)
    assert row["p_at_10"] == pytest.approx(0.2) and row["mrr"] == 1.0 and row["recall_at_10"] == 1.0


def test_full_depth_against_cut_off(spark):
    ids = [f"x{n}" for n in range(10)] + ["hit"]
    row = me.metrics_for_rankings(*run(spark, ids, {"hit": 1})).first()
    assert row["map"] == pytest.approx(1 / 11) and row["map_at_10"] == 0.0
    assert row["mrr"] == pytest.approx(1 / 11) and row["mrr_at_10"] == 0.0


def test_cut_rankings_have_no_full_depth_metrics(spark):
    row = me.metrics_for_rankings(*run(spark, ["a"], {"a": 1}, complete=False)).first()
    assert row["map"] is None and row["mrr"] is None and row["map_at_10"] == 1.0


def test_graded_gain_and_nothing_relevant(spark):
    rankings, qrels = run(spark, ["a", "b"], {"a": 1, "b": 3})
    expected = (1 + 7 / 1.584962500721156) / (7 + 1 / 1.584962500721156)
    assert me.ndcg_at_k(rankings, qrels, 10).first()["ndcg"] == pytest.approx(expected)
    rankings, qrels = run(spark, ["a"], {"z": 0})
    row = me.metrics_for_rankings(rankings, qrels).first()
    assert row["ndcg_at_10"] == row["map"] == row["recall_at_10"] == row["mrr"] == 0.0


def test_one_missing_value_makes_the_mean_missing(spark):
    rows = [("t", "s", 1.0, None), ("t", "s", 0.5, 0.5)]
    df = spark.createDataFrame(rows, "query_type string, system string, p double, m double")
    rest = {c: F.lit(0.0) for c in me.METRICS if c not in ("p_at_5", "map")}
    out = me.metrics_by_type(df.withColumnRenamed("p", "p_at_5").withColumnRenamed("m", "map").withColumns(rest)).collect()
    assert {r["query_type"] for r in out} == {"t", "aggregate"}
    assert all(r["map"] is None and r["p_at_5"] == 0.75 for r in out)


def test_overlap_of_stored_lists(spark):
    lists = {("q", "a"): "1 2 3".split(), ("q", "b"): "2 3 4".split()}
    rows = [(q, s, i, n + 1, False) for (q, s), ids in lists.items() for n, i in enumerate(ids)]
    out = me.ranking_overlap(spark.createDataFrame(rows, RANKED), [("a", "b")]).first()
    assert out["pair"] == "a_vs_b" and out["jaccard"] == pytest.approx(0.5)


def test_pool_marks(spark):
    pool = spark.createDataFrame([("q", str(i), m) for i, m in enumerate(["1", " 2 ", "3", "0", "", None, "x"])], "query_id string, item_id string, mark string")
    assert sorted(r["gain"] for r in me.pool_to_qrels(pool).collect()) == [1, 2, 3]


def test_metrics_equal_a_plain_version(spark):
    import math
    import random

    rng = random.Random(5)
    ranked, gains = [], {}
    for q in range(6):
        items = [f"i{n}" for n in range(25)]
        gains[f"q{q}"] = {i: rng.choice([0, 0, 1, 2, 3]) for i in rng.sample(items, [0, 1, 8, 20, 5, 25][q])}
        for system in ("a", "b"):
            rng.shuffle(items)
            ranked += [(f"q{q}", system, i, n + 1, system == "a") for n, i in enumerate(items[: rng.choice([1, 12, 25])])]
    qrels = spark.createDataFrame([(q, i, g) for q, items in gains.items() for i, g in items.items()], QRELS)
    found = {(r["query_id"], r["system"]): r for r in me.metrics_for_rankings(spark.createDataFrame(ranked, RANKED), qrels).collect()}
    runs = {}
    for q, system, item, rank, complete in ranked:
        runs.setdefault((q, system), []).append(gains[q].get(item, 0))
    assert set(found) == set(runs)
    for (q, system), got in runs.items():
        row, n_rel = found[q, system], sum(g > 0 for g in gains[q].values())

        def dcg(values):
            return sum((2**g - 1) / math.log2(n + 2) for n, g in enumerate(values[:10]))

        best = dcg(sorted(gains[q].values(), reverse=True))
        hits = [n + 1 for n, g in enumerate(got) if g > 0]
        ap = sum((n + 1) / rank for n, rank in enumerate(hits)) / n_rel if n_rel else 0
        assert (row["depth"], row["complete"]) == (len(got), system == "a")
        assert row["ndcg_at_10"] == pytest.approx(dcg(got) / best if best else 0)
        assert row["map"] == (pytest.approx(ap) if system == "a" else None)
        assert row["p_at_5"] == pytest.approx(sum(r <= 5 for r in hits) / 5)
        assert row["recall_at_10"] == pytest.approx(sum(r <= 10 for r in hits) / n_rel if n_rel else 0)
        assert row["mrr_at_10"] == pytest.approx(1 / hits[0] if hits and hits[0] <= 10 else 0)
