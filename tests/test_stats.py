import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgrid.operators import stats as st


@pytest.mark.parametrize("bound", [200_000, 8])
def test_order_statistics_with_and_without_narrowing(spark, bound, monkeypatch):
    monkeypatch.setattr(st, "FINE", 4)
    r = random.Random(4)
    data = {"a": [r.expovariate(1) for _ in range(900)], "b": [float(r.randint(0, 3)) for _ in range(500)], "c": [7.5]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    n = F.col("n")
    out = st.order_statistics(df, ["g"], "v", {"lo": F.lit(1), "mid": F.floor((n + 1) / 2), "hi": n}, bound)
    for row in out.collect():
        values = sorted(data[row["g"]])
        assert (row["lo"], row["mid"], row["hi"]) == (values[0], values[(len(values) + 1) // 2 - 1], values[-1])


def test_three_p95_rules(spark):
    values = [float(v) for v in range(1, 301)]
    df = spark.createDataFrame([("x", v, 0) for v in values], "p string, v double, f int")
    row = st.latency_summary(df, ["p"], "v").first()
    assert (row["count"], row["median"], row["p95"]) == (300, 150.5, 285.0)
    assert row["std"] == pytest.approx(statistics.pstdev(values))
    got = st.stage_percentiles(df, ["p"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (got["p50"], got["p95"]) == (pytest.approx(np.percentile(values, 50)), pytest.approx(np.percentile(values, 95)))
    assert st.model_compare(df, "p", "v", "f").first()["p95"] == values[int(300 * 0.95) - 1]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_error_rates_against_plain_edit_distance(spark):
    r = random.Random(8)
    words = ["año", "niño", "sol", "toro", "flor", "luz"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 12))), " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ref string, hyp string")
    got = {x["id"]: x for x in df.select("id", st.cer(F.col("ref"), F.col("hyp")).alias("c"), st.wer(F.col("ref"), F.col("hyp")).alias("w")).collect()}
    for i, ref, hyp in rows:
        assert got[i]["c"] == pytest.approx(distance(ref, hyp) / len(ref))
        assert got[i]["w"] == pytest.approx(distance(ref.split(), hyp.split()) / len(ref.split()))
    assert df.select(st.cer(F.lit(""), F.col("hyp"))).first()[0] is None


def test_words_become_different_characters_past_the_surrogates():
    many = [f"w{i}" for i in range(60_000)]
    ref, hyp = st.words_as_characters(" ".join(many), "w59999 w0 other")
    assert len(set(ref)) == 60_000 and hyp[0] == ref[-1] and hyp[1] == ref[0] and hyp[2] not in ref
    ref.encode("utf-8")


def test_token_prf(spark):
    df = spark.createDataFrame([(1, "a a b", "a b b c"), (2, "x", "")], "id long, ref string, hyp string")
    rows = {r["id"]: r for r in st.token_prf(df).collect()}
    assert (rows[1]["precision"], rows[1]["recall"]) == (0.5, pytest.approx(2 / 3))
    assert rows[2]["f1"] == 0.0


def test_kappa_uses_label_positions(spark):
    pairs = [("x", a, b) for a, b in [(1, 1), (1, 3), (3, 3), (5, 3), (5, 5), (1, 1)]]
    got = st.weighted_kappa(spark.createDataFrame(pairs, "axis string, a int, b int"), ["axis"]).first()["kappa"]
    place = {1: 0, 3: 1, 5: 2}
    a, b = [place[p[1]] for p in pairs], [place[p[2]] for p in pairs]
    off = sum((x - y) ** 2 for x, y in zip(a, b))
    expected = sum((x - y) ** 2 for x in a for y in b) / len(a)
    assert got == pytest.approx(1 - off / expected)


def test_bootstrap_is_repeatable_and_covers_the_mean(spark):
    df = spark.createDataFrame([("m", float(i % 6)) for i in range(300)], "g string, v double")
    a, b = (st.bootstrap_ci(df.repartition(n), ["g"], "v", 400, 7).first() for n in (2, 5))
    assert a == b and a["low"] < a["mean"] < a["high"] and a["mean"] == pytest.approx(2.5)


def test_sweep_counts_and_recall_falls(spark):
    r = random.Random(2)
    pairs = [(round(r.uniform(0.7, 1.0), 4), r.random() < 0.4) for _ in range(400)]
    rows = st.threshold_sweep(spark.createDataFrame(pairs, "score double, duplicate boolean")).orderBy("threshold").collect()
    assert len(rows) == 20
    for row in rows:
        t = row["threshold"]
        assert row["tp"] == sum(s >= t and d for s, d in pairs) and row["fp"] == sum(s >= t and not d for s, d in pairs)
    assert [x["recall"] for x in rows] == sorted((x["recall"] for x in rows), reverse=True)


def test_quality_summary_of_valid_rows_only(spark):
    rows = [("m", "g", 5, 4, 0), ("m", "g", 4, 4, 1), ("m", "h", 0, 0, 2), ("m", "h", None, 3, 1)]
    out = {r["group"]: r for r in st.quality_summary(spark.createDataFrame(rows, "model string, `group` string, a int, b int, hal int"), ["a", "b"], "hal").collect()}
    assert out["g"]["a_mean"] == 4.5 and out["g"]["a_std"] == 0.71 and out["g"]["errors"] == 0
    assert out["h"]["a_mean"] is None and out["h"]["errors"] == 2
    assert out["Overall"]["total"] == 4 and out["Overall"]["hal_mean"] == 0.5


def test_blind_sheet_and_back(spark):
    df = spark.createDataFrame([(str(i), m) for i in range(5) for m in ("x", "y")], "item_id string, model string")
    sheet, key = st.blind_sheet(df, 7)
    assert "model" not in sheet.columns and key.distinct().count() == 10
    assert st.unblind(sheet, key).where("model in ('x', 'y')").count() == 10
    assert {r["model"] for r in st.unblind(sheet, key.limit(0)).collect()} == {r["code"] for r in key.collect()}


def test_blanks_are_filled_once(spark):
    target = spark.createDataFrame([("1", " "), ("2", "kept"), ("3", "")], "id string, text string")
    source = spark.createDataFrame([("1", "new"), ("2", "other"), ("3", "")], "id string, text string")
    assert {r["id"]: r["text"] for r in st.fill_blank(target, source, "id", "text").collect()} == {"1": "new", "2": "kept", "3": ""}


def test_order_statistics_of_any_spread(spark, monkeypatch):
    """Values over 300 decades, a NaN, infinities, ties and a null; large groups are cut once and give exact ranks."""
    monkeypatch.setattr(st, "COARSE", 4)
    monkeypatch.setattr(st, "FINE", 3)
    rnd = random.Random(2)
    values = {"wide": [10.0 ** rnd.uniform(-150, 150) * rnd.choice([1, -1]) for _ in range(900)], "odd": [float("nan"), float("inf"), float("-inf"), 0.0] + [5e-324] * 40 + [float(i) for i in range(300)],
              "one": [7.0] * 50, "few": [1.0, 2.0]}
    rows = [(g, v) for g, own in values.items() for v in own] + [("few", None), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    n = F.col("n")
    ranks = {"first": F.lit(1), "third": F.least(F.lit(3), n), "mid": F.floor((n + 1) / 2), "last": n}
    jobs = []
    real = st.through_table
    monkeypatch.setattr(st, "through_table", lambda df, purpose: jobs.append(purpose) or real(df, purpose))
    found = {r["g"]: r for r in st.order_statistics(frame, ["g"], "v", ranks, sort_bound=20).collect()}
    assert jobs == ["value-counts", "group-sizes", "placed-values"]
    assert set(found) == {"wide", "odd", "one", "few"}
    for g, own in values.items():
        ordered = sorted(own, key=lambda v: (v != v, v))
        for name, at in (("first", 1), ("third", min(3, len(own))), ("mid", (len(own) + 1) // 2), ("last", len(own))):
            assert repr(found[g][name]) == repr(ordered[at - 1]), (g, name)


def test_poisson_weights(spark):
    """Mean and variance of small and large means, and the share of zeros."""
    for mean in (1, 6, 31, 32, 400):
        draws = spark.range(4000).select(st.poisson_weight(F.lit(mean), F.lit("seed"), F.col("id").cast("string")).alias("w"))
        out = draws.agg(F.avg("w").alias("m"), F.var_samp("w").alias("v"), F.avg((F.col("w") == 0).cast("int")).alias("none"), F.avg((F.col("w") % 1).cast("double")).alias("part")).first()
        assert abs(out["m"] - mean) < 4 * math.sqrt(mean / 4000) and abs(out["v"] / mean - 1) < 0.12
        assert abs(out["none"] - math.exp(-mean)) < 0.03 and out["part"] == 0


def test_bootstrap_interval_of_a_known_spread(spark):
    rnd = random.Random(1)
    rows = [("g", float(rnd.choice([1, 2, 3, 4, 5]))) for _ in range(2000)]
    out = st.bootstrap_ci(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").first()
    mean = sum(v for _, v in rows) / len(rows)
    width = 1.96 * math.sqrt(sum((v - mean) ** 2 for _, v in rows)) / len(rows)
    assert abs(out["mean"] - mean) < 1e-12 and abs(out["low"] - (mean - width)) < 0.012 and abs(out["high"] - (mean + width)) < 0.012


def test_tokens_of_texts_are_not_shuffled(spark):
    """Tokens are counted where the texts are, so memory does not grow with the number of tokens; many copies of a token count once each."""
    rows = [(1, "a a b  c", "a c c d"), (2, "x " * 5000, "x " * 3000), (3, "a", ""), (4, "a", None)]
    pairs = spark.createDataFrame(rows, "id long, ref string, hyp string")
    got = st.token_prf(pairs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert sorted((r["id"], r["precision"], r["recall"]) for r in got.collect()) == [(1, 0.5, 0.5), (2, 1.0, 0.6), (3, 0.0, 0.0), (4, 0.0, 0.0)]
    scores = st.ocr_scores(pairs.select("id", F.col("ref").alias("text")), pairs.select("id", F.col("hyp").alias("text")))
    assert {r["id"]: r["f1"] for r in scores.collect()}[1] == 0.5 and scores.columns == ["id", "cer", "wer", "precision", "recall", "f1"]


def test_recognised_text_is_scored_whole(spark):
    """Accents written as marks of their own are composed first, and the summary has the word error rate beside the others."""
    side = lambda rows: spark.createDataFrame(rows, "id long, text string")
    scores = st.ocr_scores(side([(1, "El nin\u0303o LEO\u0301N"), (2, "uno dos tres"), (3, None)]), side([(1, "el niño león"), (2, "uno tres"), (3, "x")]))
    found = {r["id"]: (r["cer"], r["wer"], r["f1"]) for r in scores.collect()}
    assert found == {1: (0.0, 0.0, 1.0), 2: (4 / 12, 1 / 3, 0.8)}


def test_summary_has_word_error_rate(spark, tmp_path):
    """Means of all three measures over all pairs of neighbouring turns; the second text of a pair keeps one word of two."""
    from __spark_entry__ import queries

    rows = [(1, 0, "user", "uno dos"), (1, 1, "assistant", "uno tres"), (1, 2, "user", "uno tres")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = queries()["ocr_summary"](spark, str(tmp_path))
    assert out.columns == ["grouping", "value", "n", "cer", "wer", "f1"]
    assert {(r["grouping"], r["value"]): (r["n"], r["wer"], r["f1"]) for r in out.where("grouping <> 'spot'").collect()} == {
        ("all", None): (2, 0.25, 0.75), ("role", "user"): (1, 0.5, 0.5), ("role", "assistant"): (1, 0.0, 1.0)}


def test_values_of_a_hot_group_stay_in_their_tasks(spark, monkeypatch):
    """Splitters of few large groups go to the values; a group's values are not sent to one task to meet them."""
    plans, real = {}, st.through_table
    monkeypatch.setattr(st, "through_table", lambda df, purpose: plans.update({purpose: df._jdf.queryExecution().analyzed().toString()}) or real(df, purpose))
    rows = spark.range(3000).selectExpr("'a' AS part", "cast(pmod(id * 7919, 3000) as double) AS v")
    found = st.order_statistics(rows, ["part"], "v", {"p": st.F.lit(1234)}, sort_bound=100).collect()
    assert [(r["part"], r["p"]) for r in found] == [("a", 1233.0)]
    assert "strategy=broadcast" in plans["placed-values"]
