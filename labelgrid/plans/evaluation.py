"""Ranking quality, latency, agreement and text error rates over the given tables.

Rankings: for each nation, all brands its suppliers sold, ranked by quantity, by
number of lines and by value (complete), and the first ten by value (cut).
Judgements: how often customers of that nation ordered the brand (gain 0..3).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelgrid.functions import text as tx
from labelgrid.operators import metrics as me
from labelgrid.operators import ranking as rk
from labelgrid.operators import stats as st
from labelgrid.operators.scan import dense_search
from labelgrid.plans import sqltext as s
from labelgrid.plans.registry import query
from labelgrid.session import spread, through_table


def rankings(t):
    sold = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("s_nationkey").alias("query_id"), F.col("p_brand").alias("item_id"))
        .agg(F.sum("l_quantity").alias("by_quantity"), F.count(F.lit(1)).cast("double").alias("by_lines"),
             F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double").alias("by_value"))
    )
    long = sold.unpivot(["query_id", "item_id"], ["by_quantity", "by_lines", "by_value"], "system", "score")
    ranked = rk.rank_hits(long, ["query_id", "system"], "item_id").withColumn("complete", F.lit(True))
    cut = ranked.where("system = 'by_value' AND rank <= 10").withColumns({"system": F.lit("by_value_top10"), "complete": F.lit(False)})
    return ranked.unionByName(cut)


def qrels(t):
    bought = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("c_nationkey").alias("query_id"), F.col("p_brand").alias("item_id")).agg(F.count(F.lit(1)).alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "item_id"))
    gain = F.when(F.col("place") <= 3, 3).when(F.col("place") <= 6, 2).when(F.col("place") <= 10, 1).otherwise(0)
    return bought.withColumn("place", place).select("query_id", "item_id", gain.alias("gain"))


def types(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("query_id"), F.col("r_name").alias("query_type"))


RANKS = """
sold AS (SELECT s_nationkey AS query_id, p_brand AS item_id, sum(l_quantity) AS q, count(*)::DOUBLE AS c,
                sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE AS v
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
lng AS (SELECT query_id, item_id, 'by_quantity' AS system, q AS score FROM sold UNION ALL
        SELECT query_id, item_id, 'by_lines', c FROM sold UNION ALL SELECT query_id, item_id, 'by_value', v FROM sold),
rnk AS (SELECT *, row_number() OVER (PARTITION BY query_id, system ORDER BY score DESC, item_id) AS rank FROM lng),
ranks AS (SELECT query_id, item_id, system, rank, true AS complete FROM rnk UNION ALL
          SELECT query_id, item_id, 'by_value_top10', rank, false FROM rnk WHERE system = 'by_value' AND rank <= 10),
bought AS (SELECT c_nationkey AS query_id, p_brand AS item_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
qrels AS (SELECT query_id, item_id, CASE WHEN p <= 3 THEN 3 WHEN p <= 6 THEN 2 WHEN p <= 10 THEN 1 ELSE 0 END AS gain
          FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, item_id) AS p FROM bought)),
types AS (SELECT n_nationkey AS query_id, r_name AS query_type FROM nation JOIN region ON n_regionkey = r_regionkey)"""

JUDGED = """
ideal AS (SELECT query_id, sum(CASE WHEN i <= 10 THEN (pow(2.0::DOUBLE, gain) - 1) / log2(i + 1) END) AS ideal, count(*) FILTER (gain >= 1) AS n_rel
          FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, item_id) AS i FROM qrels) GROUP BY query_id),
jr AS (SELECT r.*, coalesce(gain, 0) AS gain, coalesce(ideal, 0.0) AS ideal, coalesce(n_rel, 0) AS n_rel, CASE WHEN coalesce(gain, 0) >= 1 THEN 1 ELSE 0 END AS rel
       FROM ranks r LEFT JOIN qrels USING (query_id, item_id) LEFT JOIN ideal USING (query_id)),
j AS (SELECT *, sum(rel) OVER (PARTITION BY query_id, system ORDER BY rank) AS hits FROM jr),
bq AS (SELECT query_id, system, count(*) AS depth, bool_and(complete) AS complete,
    CASE WHEN max(ideal) > 0 THEN sum(CASE WHEN rank <= 10 THEN (pow(2.0::DOUBLE, gain) - 1) / log2(rank + 1) ELSE 0 END) / max(ideal) ELSE 0 END AS ndcg_at_10,
    CASE WHEN max(n_rel) > 0 THEN sum(CASE WHEN rel = 1 THEN hits::DOUBLE / rank ELSE 0 END) / max(n_rel) ELSE 0 END AS map_all,
    CASE WHEN max(n_rel) > 0 THEN sum(CASE WHEN rel = 1 AND rank <= 10 THEN hits::DOUBLE / rank ELSE 0 END) / max(n_rel) ELSE 0 END AS map_at_10,
    sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END)::DOUBLE / 5 AS p_at_5, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END)::DOUBLE / 10 AS p_at_10,
    CASE WHEN max(n_rel) > 0 THEN sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END)::DOUBLE / max(n_rel) ELSE 0 END AS recall_at_10,
    coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0) AS mrr_all,
    coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 AND rank <= 10 THEN rank END), 0) AS mrr_at_10
    FROM j GROUP BY query_id, system)"""
BASE = f"WITH {RANKS}, {JUDGED}"
EIGHT = ["ndcg_at_10", "map", "map_at_10", "p_at_5", "p_at_10", "recall_at_10", "mrr", "mrr_at_10"]
FULL = {"map": "CASE WHEN complete THEN map_all END", "mrr": "CASE WHEN complete THEN mrr_all END"}


def shown(column: str) -> str:
    return f"round({FULL.get(column, column)}, 9) AS {column}"


def nine(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


for _name, _column, _build in [
    ("ndcg_at_10", "ndcg_at_10 AS ndcg", lambda r, q: me.ndcg_at_k(r, q, 10)),
    ("average_precision", "map_all AS ap", lambda r, q: me.average_precision(r, q)),
    ("average_precision_at_10", "map_at_10 AS ap", lambda r, q: me.average_precision(r, q, 10)),
    ("precision_at_5", "p_at_5 AS precision", lambda r, q: me.precision_at_k(r, q, 5)),
    ("recall_at_10", "recall_at_10 AS recall", lambda r, q: me.recall_at_k(r, q, 10)),
    ("reciprocal_rank", "mrr_all AS rr", lambda r, q: me.reciprocal_rank(r, q)),
]:
    def _metric(t, build=_build):
        out = build(rankings(t), qrels(t))
        return nine(out, out.columns[-1])

    _source, _alias = _column.split(" AS ")
    query(_name, f"{BASE} SELECT query_id, system, round({_source}, 9) AS {_alias} FROM bq")(_metric)


@query("metrics_by_query", f"{BASE} SELECT query_id, system, depth, complete, {', '.join(shown(m) for m in EIGHT)} FROM bq")
def metrics_by_query(t):
    return nine(me.metrics_for_rankings(rankings(t), qrels(t)), *EIGHT)


def _means(keys: str, kind: str) -> str:
    cells = []
    for m in EIGHT:
        source = FULL.get(m, m)
        cells.append(f"round(CASE WHEN count({source}) = count(*) THEN avg({source}) END, 9) AS {m}")
    return f"SELECT {kind} AS query_type, system, count(*) AS queries, {', '.join(cells)} FROM bq JOIN types USING (query_id) GROUP BY {keys}"


BY_TYPE = f"{_means('query_type, system', 'query_type')} UNION ALL {_means('system', chr(39) + 'aggregate' + chr(39))}"


def by_type(t):
    return me.metrics_by_type(me.metrics_for_rankings(rankings(t), qrels(t)).join(types(t), "query_id"))


@query("metrics_by_type", f"{BASE} {BY_TYPE}")
def metrics_by_type(t):
    return nine(by_type(t), *EIGHT)


ORDER = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "aggregate"]


@query("metric_table", f"""{BASE}, bt AS ({BY_TYPE}),
l AS (SELECT *, list_position({ORDER}, query_type) AS position, max(CASE WHEN map IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY system) AS cut FROM bt)
SELECT system || CASE WHEN cut = 1 THEN ' (legacy top-10)' ELSE '' END AS display, system, query_type, position,
       {', '.join(f"coalesce(printf('%.3f', {m}), '---') AS {m}" for m in EIGHT)} FROM l WHERE position > 0""")
def metric_table(t):
    return me.metric_table(nine(by_type(t), *EIGHT), ORDER)


LEGACY_SQL = {"ndcg": "ndcg_at_10", "map": "map_all", "p5": "p_at_5", "p10": "p_at_10", "mrr": "mrr_all"}


def _legacy(keys: str, kind: str) -> str:
    cells = ", ".join(f"round(coalesce(avg({c}), 0), 9) AS {m}" for m, c in LEGACY_SQL.items())
    return f"SELECT {kind} AS query_type, system, {cells} FROM bq JOIN types USING (query_id) GROUP BY {keys}"


LEGACY = f"{_legacy('query_type, system', 'query_type')} UNION ALL {_legacy('system', chr(39) + 'aggregate' + chr(39))}"


@query("metrics_legacy_means", f"{BASE} {LEGACY}")
def metrics_legacy(t):
    return nine(me.metrics_legacy(rankings(t), qrels(t), types(t)), *me.LEGACY)


@query("compare_to_stored", f"""{BASE}, now AS ({LEGACY}),
st AS (SELECT query_type, system, ndcg, map, p5, p10, CASE WHEN system = 'by_lines' THEN mrr + 1 ELSE mrr END AS mrr FROM now),
a AS (UNPIVOT now ON ndcg, map, p5, p10, mrr INTO NAME metric VALUE value), b AS (UNPIVOT st ON ndcg, map, p5, p10, mrr INTO NAME metric VALUE stored)
SELECT query_type, system, metric, value, stored, abs(value - stored) < 1e-9 AS equal FROM a JOIN b USING (query_type, system, metric)""")
def compare_to_stored(t):
    """Means written to a table and compared with a fresh run; one metric of one system was altered."""
    means = nine(me.metrics_legacy(rankings(t), qrels(t), types(t)), *me.LEGACY)
    stored = through_table(means.withColumn("mrr", F.when(F.col("system") == "by_lines", F.col("mrr") + 1).otherwise(F.col("mrr"))), "stored-means")
    return me.compare_to_stored(means, stored)


PAIRS = [("by_quantity", "by_lines"), ("by_quantity", "by_value"), ("by_lines", "by_value")]
OVERLAP = f"""WITH {RANKS}, tops AS (SELECT query_id, system, list(item_id) AS items FROM ranks WHERE rank <= 10 GROUP BY ALL),
o AS (SELECT a.query_id, a.system || '_vs_' || b.system AS pair, len(list_intersect(a.items, b.items))::DOUBLE / len(list_distinct(list_concat(a.items, b.items))) AS jac
      FROM tops a JOIN tops b USING (query_id) WHERE (a.system, b.system) IN {tuple(PAIRS)})"""


@query("ranking_overlap", OVERLAP + " SELECT query_id, pair, round_even(jac, 4) AS jaccard FROM o")
def ranking_overlap(t):
    return me.ranking_overlap(rankings(t), PAIRS).withColumn("jaccard", F.bround("jaccard", 4))


@query("ranking_overlap_means", OVERLAP + " SELECT pair, round_even(avg(jac), 4) AS mean_jaccard FROM o GROUP BY pair")
def ranking_overlap_means(t):
    return me.overlap_means(me.ranking_overlap(rankings(t), PAIRS))


@query("judgement_pool", f"WITH {RANKS} SELECT DISTINCT query_id, item_id, '' AS mark FROM ranks WHERE rank <= 20")
def judgement_pool(t):
    return me.build_pool(rankings(t), 20)


@query("pool_to_qrels", f"""WITH {RANKS}, p AS (SELECT DISTINCT query_id, item_id FROM ranks WHERE rank <= 20)
SELECT query_id, item_id, gain FROM p JOIN qrels USING (query_id, item_id) WHERE gain IN (1, 2, 3)""")
def pool_to_qrels(t):
    """A pool marked with the judgements; blank, zero and padded marks included."""
    marks = qrels(t).select("query_id", "item_id", F.concat(F.lit(" "), F.col("gain").cast("string")).alias("mark"))
    return me.pool_to_qrels(me.build_pool(rankings(t)).drop("mark").join(marks, ["query_id", "item_id"], "left"))


@query("require_complete", f"WITH {RANKS} SELECT query_id, system, count(*) AS depth, count(DISTINCT item_id) AS items, true AS complete FROM ranks WHERE complete GROUP BY ALL")
def require_complete(t):
    brands = t.part.select(F.countDistinct("p_brand")).first()[0]
    return rk.require_complete(rankings(t).where("complete"), brands, ["query_id", "system"])


@query("image_search_quality", f"""
WITH sc AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {s.cosine('a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
ranks AS (SELECT * FROM (SELECT query_id, item_id, 'image' AS system, false AS complete, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sc) WHERE rank <= 50),
same AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
good AS (SELECT r.*, a.label = b.label AS rel, n - 1 AS n_rel FROM ranks r JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = item_id JOIN same ON same.label = a.label),
h AS (SELECT *, sum(rel::INT) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM good)
SELECT query_id, system, count(*) AS depth,
  round(sum(CASE WHEN rel AND rank <= 10 THEN hits::DOUBLE / rank ELSE 0 END) / max(n_rel), 9) AS map_at_10,
  round(sum(CASE WHEN rel AND rank <= 10 THEN 1 ELSE 0 END) / 10.0::DOUBLE, 9) AS p_at_10,
  round(coalesce(1.0::DOUBLE / min(CASE WHEN rel AND rank <= 10 THEN rank END), 0), 9) AS mrr_at_10
FROM h GROUP BY query_id, system""")
def image_search_quality(t):
    """Nearest images of every image; relevant are those of the same label, without forming label pairs.

    The relevant ones are matched per ranked row, their number comes from a
    count per label, so no pair list of a large label is ever made.
    """
    e = t.embeddings
    side = lambda name: e.select(F.col("vec_id").alias(name), F.col("embedding").alias("vector"))
    hits = dense_search(side("query_id"), side("id"), 50, skip_self=True).withColumnRenamed("id", "item_id")
    label = lambda name: e.select(F.col("vec_id").alias(name), F.col("label").alias(f"{name}_label"))
    sizes = e.groupBy(F.col("label").alias("query_id_label")).agg((F.count(F.lit(1)) - 1).alias("n_rel"))
    rows = hits.join(label("query_id"), "query_id").join(label("item_id"), "item_id").join(sizes, "query_id_label")
    rows = rows.withColumns({"system": F.lit("image"), "rel": (F.col("query_id_label") == F.col("item_id_label")).cast("int")})
    so_far = Window.partitionBy("query_id", "system").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("hits", F.sum("rel").over(so_far)).groupBy("query_id", "system").agg(
        F.count(F.lit(1)).alias("depth"), me.ap(10).alias("map_at_10"), me.precision(10).alias("p_at_10"), me.rr(10).alias("mrr_at_10"))
    return nine(out, "map_at_10", "p_at_10", "mrr_at_10")


# ---------------------------------------------------------------- latency

@query("latency_summary", """
SELECT event_type AS phase, count(value) AS count, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std,
       quantile_disc(value, 0.95) AS p95, min(value) AS min, max(value) AS max FROM events GROUP BY event_type""")
def latency_summary(t):
    out = st.latency_summary(t.events.select(F.col("event_type").alias("phase"), "value"), ["phase"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")})


@query("benchmark_phases", """
WITH w AS (UNPIVOT (SELECT l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) ON quantity, discount, tax INTO NAME phase VALUE ms)
SELECT phase, count(ms) AS count, round(avg(ms), 6) AS mean, round(median(ms), 6) AS median, round(stddev_pop(ms), 6) AS std,
       quantile_disc(ms, 0.95) AS p95, min(ms) AS min, max(ms) AS max FROM w GROUP BY phase""")
def benchmark_phases(t):
    wide = t.lineitem.select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    out = st.benchmark_phases(wide, ["quantity", "discount", "tax"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")})


@query("stage_percentiles", """
SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def stage_percentiles(t):
    out = st.stage_percentiles(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


@query("model_compare", """
WITH r AS (SELECT l_shipdate, l_returnflag AS model, l_extendedprice AS latency, CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS failed FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY latency) AS i, count(*) OVER (PARTITION BY model) AS n FROM r)
SELECT model, round(avg(latency), 4) AS mean_latency, sum(failed)::BIGINT AS failures, count(*) AS n,
       max(CASE WHEN i = greatest(1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) THEN latency END) AS p95 FROM o GROUP BY model""")
def model_compare(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("model"), F.col("l_extendedprice").alias("latency"), (F.col("l_discount") > 0.08).cast("int").alias("failed"))
    return st.model_compare(rows, "model", "latency", "failed").withColumn("mean_latency", F.round("mean_latency", 4))


CALIBRATED = """
WITH m AS (SELECT event_type AS phase, round_even(avg(value), 2) AS ratio FROM events GROUP BY event_type),
w AS (SELECT phase, ratio, round_even(ratio / sum(ratio) OVER (), 3) AS weight FROM m)
"""


@query("phase_calibration", CALIBRATED + "SELECT phase, ratio, weight FROM w")
def phase_calibration(t):
    return st.phase_calibration(t.events.select(F.col("event_type").alias("phase"), "value"), "phase", "value")


@query("phase_progress", CALIBRATED + """,
o AS (SELECT phase, weight, ratio, coalesce(sum(weight) OVER (ORDER BY list_position(['signup', 'view', 'click', 'purchase', 'error'], phase) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM w)
SELECT event_id, round(base + CASE WHEN ratio * (length(props) / 8.0::DOUBLE) > 0 THEN least(1.0, value / (ratio * (length(props) / 8.0::DOUBLE))) ELSE 1.0 END * weight, 6) AS progress
FROM events JOIN o ON event_type = phase""")
def phase_progress(t):
    """Progress of every event within its phase, from the calibrated ratios and weights."""
    calibrated = through_table(st.phase_calibration(t.events.select(F.col("event_type").alias("phase"), "value"), "phase", "value"), "calibration")
    bases = st.phase_bases(calibrated, ["signup", "view", "click", "purchase", "error"]).join(calibrated.select("phase", "ratio"), "phase")
    rows = t.events.join(F.broadcast(bases), F.col("event_type") == F.col("phase"))  # one row per phase
    value = tx.progress(F.col("base"), F.col("weight"), F.col("value"), F.col("ratio"), F.length("props") / 8.0)
    return rows.select("event_id", F.round(value, 6).alias("progress"))


# ---------------------------------------------------------------- quality and agreement

def scored(t):
    return t.labels.join(t.documents, "doc_id").select(
        F.col("source").alias("model"), F.col("lang").alias("group"), "quality", "toxic", (F.col("n_chars") % 5).alias("extra"))


def _quality(keys: str, group: str) -> str:
    ok = "quality IS NOT NULL AND toxic IS NOT NULL AND greatest(quality, toxic) > 0"
    cells = "".join(f"round_even(avg({a}) FILTER ({ok}), 2) AS {a}_mean, round_even(stddev_samp({a}) FILTER ({ok}), 2) AS {a}_std, " for a in ("quality", "toxic"))
    return f"""SELECT source AS model, {group} AS "group", {cells} round_even(avg(n_chars % 5) FILTER ({ok}), 2) AS extra_mean,
    count(*) FILTER (NOT ({ok})) AS errors, count(*) AS total FROM labels JOIN documents USING (doc_id) GROUP BY {keys}"""


@query("quality_summary", f"{_quality('source, lang', 'lang')} UNION ALL {_quality('source', chr(39) + 'Overall' + chr(39))}")
def quality_summary(t):
    return st.quality_summary(scored(t), ["quality", "toxic"], "extra")


@query("valid_scores", "SELECT doc_id FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL AND greatest(quality, toxic) > 0")
def valid_scores(t):
    return t.labels.where(st.has_scores(["quality", "toxic"])).select("doc_id")


@query("success_rate", """SELECT lang, count(*) FILTER (quality = 1) AS succeeded, count(*) AS attempts,
round(avg(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 9) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def success_rate(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    return nine(st.success_rate(rows, ["lang"], F.coalesce(F.col("quality") == 1, F.lit(False))), "rate")


@query("group_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def group_counts(t):
    return st.group_counts(t.documents, ["lang", "source"])


@query("unblind_models", """
SELECT doc_id, 'M' || source AS code, CASE WHEN lang IN ('en', 'es') THEN 'real-' || source ELSE 'M' || source END AS model
FROM documents JOIN labels USING (doc_id)""".replace("CASE WHEN lang IN ('en', 'es') THEN 'real-' || source ELSE 'M' || source END", "coalesce(k.real_model, 'M' || source)").replace(
    "FROM documents JOIN labels USING (doc_id)", "FROM documents LEFT JOIN (SELECT DISTINCT 'M' || source AS code, 'real-' || source AS real_model FROM documents WHERE lang = 'en') k ON k.code = 'M' || source"))
def unblind_models(t):
    """Sources without an English document are missing in the key and keep their code."""
    code = F.concat(F.lit("M"), F.col("source"))
    key = t.documents.where("lang = 'en'").select(code.alias("code"), F.concat(F.lit("real-"), "source").alias("real_model")).distinct()
    return st.unblind(t.documents.select("doc_id", code.alias("code")), key)


@query("blind_sheet", "SELECT 'M' || md5(doc_id || '|' || source || '|7') AS code, doc_id AS item_id, lang, source AS real_model FROM documents")
def blind_sheet(t):
    sheet, key = st.blind_sheet(t.documents.select(F.col("doc_id").alias("item_id"), F.col("source").alias("model"), "lang"), 7)
    return sheet.join(key, "code")


PAIRED = """
WITH e AS (SELECT c_custkey AS id, c_mktsegment AS grp, c_nationkey % 6 AS fidelity, (c_nationkey + c_custkey) % 5 AS detail FROM customer),
f AS (SELECT c_custkey AS id, least(5, c_nationkey % 6 + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS fidelity, CASE WHEN c_acctbal > 9000 THEN NULL ELSE c_nationkey % 5 END AS detail FROM customer),
p AS (SELECT id, grp, 'fidelity' AS axis, e.fidelity AS a, f.fidelity AS b FROM e JOIN f USING (id) UNION ALL SELECT id, grp, 'detail', e.detail, f.detail FROM e JOIN f USING (id)),
q AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
"""


def annotated(t):
    """Two readings of each customer record on two axes; the second lacks some values."""
    c = t.customer
    nation, key = F.col("c_nationkey").cast("long"), F.col("c_custkey")
    a = c.select(key.alias("id"), F.col("c_mktsegment").alias("grp"), (nation % 6).alias("fidelity"), ((nation + key) % 5).alias("detail"))
    b = c.select(key.alias("id"), F.col("c_mktsegment").alias("grp"),
                 F.least(F.lit(5), nation % 6 + F.when(F.col("c_acctbal") < 0, 1).otherwise(0)).cast("long").alias("fidelity"),
                 F.when(F.col("c_acctbal") <= 9000, nation % 5).alias("detail"))
    return a, b


@query("pair_annotators", PAIRED + "SELECT id, grp, axis, a, b FROM q")
def pair_annotators(t):
    return st.pair_annotators(*annotated(t), ["id", "grp"], ["fidelity", "detail"])


@query("weighted_kappa", PAIRED + """,
lab AS (SELECT axis, l, row_number() OVER (PARTITION BY axis ORDER BY l) AS i FROM (SELECT axis, a AS l FROM q UNION SELECT axis, b FROM q)),
x AS (SELECT q.axis, la.i::DOUBLE AS x, lb.i::DOUBLE AS y FROM q JOIN lab la ON la.axis = q.axis AND la.l = q.a JOIN lab lb ON lb.axis = q.axis AND lb.l = q.b)
SELECT axis, count(*) AS n, round(1 - sum((x - y) * (x - y)) / (sum(x * x) + sum(y * y) - 2 * sum(x) * sum(y) / count(*)), 9) AS kappa FROM x GROUP BY axis""")
def weighted_kappa(t):
    return nine(st.weighted_kappa(st.pair_annotators(*annotated(t), ["id", "grp"], ["fidelity", "detail"]), ["axis"]), "kappa")


@query("consensus_bootstrap", PAIRED + f""",
c AS (SELECT grp, axis, (a + b) / 2.0 AS v, count(*) AS c FROM q GROUP BY ALL),
h AS (SELECT *, md5(concat_ws('|', '7', rep, grp, axis, CAST(round(v * 1000000) AS BIGINT))) AS x FROM c, range(1000) AS r(rep)),
u AS (SELECT *, (CAST('0x' || substr(x, 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS u, (CAST('0x' || substr(x, 13, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS w FROM h),
z AS (SELECT *, sqrt(-2 * ln(u)) * cos(2 * pi() * w) AS z FROM u),
small AS (SELECT c, sum(exp(-c + j * ln(c) - lgamma(j + 1))) OVER (PARTITION BY c ORDER BY j) AS upto FROM (SELECT DISTINCT c FROM c WHERE c < {st.EXACT_POISSON}), range({5 * st.EXACT_POISSON}) AS r(j)),
d AS (SELECT grp, axis, v, z.c, rep, CASE WHEN z.c < {st.EXACT_POISSON} THEN (SELECT count(*) FROM small s WHERE s.c = z.c AND s.upto < z.u) ELSE greatest(0, floor(z.c + sqrt(z.c) * z + (z * z - 1) / 6 + 0.5)) END AS w FROM z),
m AS (SELECT grp, axis, sum(w * v) / nullif(sum(w), 0) AS m FROM d GROUP BY grp, axis, rep),
b AS (SELECT grp, axis, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY ALL)
SELECT grp, axis, round(sum(v * c) / sum(c), 6) AS mean, CAST(sum(c) AS BIGINT) AS n, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM c JOIN b USING (grp, axis) GROUP BY grp, axis""")
def consensus_bootstrap(t):
    """Mean of the two readings per group and axis with a bootstrap interval."""
    pairs = st.pair_annotators(*annotated(t), ["id", "grp"], ["fidelity", "detail"])
    out = st.bootstrap_ci(pairs.withColumn("both", (F.col("a") + F.col("b")) / 2), ["grp", "axis"], "both")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


# ---------------------------------------------------------------- text error rates

def turns(t, shift):
    """Conversation turns; with shift 1 each turn carries the id of the one before it."""
    key = F.concat_ws("-", "conv_id", (F.col("turn") - shift))
    return spread(t.conversations).select(key.alias("id"), F.col("role"), F.col("text"))


# The distance of this engine counts bytes, so each letter beyond ASCII stands as one sign that normal forms do not hold.
FREE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+-./:;<=>?@[]^{}|~"
OCR = r"""
WITH nrm AS (SELECT conv_id || '-' || turn AS id, role, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM conversations),
let AS (SELECT coalesce(string_agg(ch, '' ORDER BY ch), '') AS beyond FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM nrm) WHERE ord(ch) > 127),
h AS (SELECT conv_id || '-' || (turn - 1) AS id, (conv_id || '-' || turn) AS own FROM conversations),
p AS (SELECT nrm.id, nrm.role, nrm.text AS ref, o.text AS hyp FROM nrm JOIN h USING (id) JOIN nrm o ON o.id = h.own WHERE nrm.text <> ''),
rt AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(string_split(ref, ' ')) AS w FROM p) WHERE w <> '' GROUP BY ALL),
ht AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(string_split(hyp, ' ')) AS w FROM p) WHERE w <> '' GROUP BY ALL),
tp AS (SELECT id, sum(least(rt.c, ht.c)) AS tp FROM rt JOIN ht USING (id, w) GROUP BY id),
sz AS (SELECT id, coalesce(tp, 0) AS tp, (SELECT sum(c) FROM rt WHERE rt.id = p.id) AS nr, coalesce((SELECT sum(c) FROM ht WHERE ht.id = p.id), 0) AS nh FROM p LEFT JOIN tp USING (id)),
f AS (SELECT id, CASE WHEN nh > 0 THEN tp::DOUBLE / nh ELSE 0 END AS pr, tp::DOUBLE / nr AS rc FROM sz),
sc AS (SELECT id, role, levenshtein(translate(ref, beyond, '@FREE@'), translate(hyp, beyond, '@FREE@'))::DOUBLE / length(ref) AS cer, pr, rc, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM p JOIN f USING (id), let)
""".replace("@FREE@", FREE)


@query("text_pairs", OCR + "SELECT id, ref, hyp FROM p")
def text_pairs(t):
    return st.pair_texts(turns(t, 0), turns(t, 1))


@query("character_error_rate", OCR + "SELECT id, round(cer, 9) AS cer FROM sc")
def character_error_rate(t):
    pairs = st.pair_texts(turns(t, 0), turns(t, 1))
    return pairs.select("id", F.round(st.cer(F.col("ref"), F.col("hyp")), 9).alias("cer"))


@query("word_error_rate", OCR + """, w AS (SELECT id, list_filter(string_split(ref, ' '), lambda x: x <> '') AS r, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS h FROM p)
SELECT id, round(list_reduce(range(1, len(r) + 1), lambda prev, i: list_reduce(range(1, len(h) + 1), lambda new, j:
  list_append(new, least(new[j] + 1, prev[j + 1] + 1, prev[j] + CASE WHEN r[i] = h[j] THEN 0 ELSE 1 END)), [i]), range(0, len(h) + 1))[len(h) + 1]::DOUBLE / len(r), 9) AS wer FROM w""")
def word_error_rate(t):
    pairs = st.pair_texts(turns(t, 0), turns(t, 1))
    return pairs.select("id", F.round(st.wer(F.col("ref"), F.col("hyp")), 9).alias("wer"))


@query("token_prf", OCR + "SELECT id, round(pr, 9) AS precision, round(rc, 9) AS recall, round(f1, 9) AS f1 FROM sc")
def token_prf(t):
    return nine(st.token_prf(st.pair_texts(turns(t, 0), turns(t, 1))), "precision", "recall", "f1")


def _ocr_means(keys: str, grouping: str, value: str) -> str:
    by = f" GROUP BY {keys}" if keys else ""
    return f"SELECT '{grouping}' AS grouping, {value} AS value, count(*) AS n, round_even(avg(cer), 3) AS cer, round_even(avg(wer), 3) AS wer, round_even(avg(f1), 3) AS f1 FROM m{by}"


# Of composed texts, with the texts beside their rates.
OCR_WHOLE = OCR.replace("lower(text)", "nfc_normalize(lower(text))").replace("SELECT id, role, levenshtein(", "SELECT id, role, ref, hyp, levenshtein(")


@query("ocr_summary", OCR_WHOLE + f""",
w AS (SELECT *, list_filter(string_split(ref, ' '), lambda x: x <> '') AS r, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS h FROM sc),
m AS (SELECT *, CASE WHEN role = 'system' THEN ' ' ELSE 'turn ' || split_part(id, '-', 2) END AS spot,
  list_reduce(range(1, len(r) + 1), lambda prev, i: list_reduce(range(1, len(h) + 1), lambda new, j:
    list_append(new, least(new[j] + 1, prev[j + 1] + 1, prev[j] + CASE WHEN r[i] = h[j] THEN 0 ELSE 1 END)), [i]), range(0, len(h) + 1))[len(h) + 1]::DOUBLE / len(r) AS wer FROM w)
{_ocr_means('', 'all', 'NULL')} UNION ALL {_ocr_means('role', 'role', 'role')} UNION ALL
SELECT * FROM ({_ocr_means('spot', 'spot', 'spot')}) WHERE trim(value) <> ''""")
def ocr_summary(t):
    scores = st.ocr_scores(turns(t, 0), turns(t, 1)).join(turns(t, 0).select("id", "role"), "id")
    spot = F.when(F.col("role") == "system", " ").otherwise(F.concat(F.lit("turn "), F.split_part("id", F.lit("-"), F.lit(2))))
    return st.ocr_summary(scores.withColumn("spot", spot), ["role", "spot"], ["cer", "wer", "f1"])


@query("fill_blank_values", """
WITH t AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN '  ' ELSE text END AS text FROM documents)
SELECT t.doc_id, CASE WHEN trim(t.text) = '' AND d.quality = 1 THEN 'taken ' || d.doc_id ELSE t.text END AS text FROM t LEFT JOIN labels d USING (doc_id)""")
def fill_blank_values(t):
    target = t.documents.select("doc_id", F.when(F.col("lang") == "fr", "  ").otherwise(F.col("text")).alias("text"))
    source = t.labels.select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("taken "), "doc_id")).otherwise("").alias("text"))
    return st.fill_blank(target, source, "doc_id", "text")


# ---------------------------------------------------------------- threshold sweep

@query("threshold_sweep", f"""
WITH {s.encoded('d', 'documents', 'doc_id', 'text')},
nb AS (SELECT a.key AS query_id, b.key AS id, {s.cosine('a.v', 'b.v')} AS score FROM d_dense a, d_dense b WHERE a.key <> b.key),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM nb),
p AS (SELECT score, x.text = y.text AS dup FROM k JOIN documents x ON x.doc_id = query_id JOIN documents y ON y.doc_id = id WHERE rank <= 5),
c AS (SELECT t / 100.0::DOUBLE AS threshold, count(*) FILTER (score >= t / 100.0::DOUBLE AND dup) AS tp, count(*) FILTER (score >= t / 100.0::DOUBLE AND NOT dup) AS fp,
             count(*) FILTER (score < t / 100.0::DOUBLE AND dup) AS fn FROM p, range(80, 100) r(t) GROUP BY t),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM c)
SELECT threshold, tp, fp, fn, round(pr, 9) AS precision, round(rc, 9) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 9) AS f1 FROM m""")
def threshold_sweep(t):
    """Each document with its five nearest; duplicates are those with the very same text."""
    from labelgrid.plans.search import arrivals

    docs = arrivals(t)
    near = dense_search(docs.select(F.col("id").alias("query_id"), "vector"), docs.select("id", "vector"), 5, skip_self=True)
    digest = lambda name: t.documents.select(F.col("doc_id").alias(name), F.sha2("text", 256).alias(f"{name}_text"))
    pairs = near.join(digest("query_id"), "query_id").join(digest("id"), "id").select("score", (F.col("query_id_text") == F.col("id_text")).alias("duplicate"))
    return nine(st.threshold_sweep(pairs), "precision", "recall", "f1")
