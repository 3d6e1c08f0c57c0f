"""Ranking quality: nDCG, average precision, precision, recall, reciprocal rank and reports on them.

``rankings``: ``query_id, system, item_id, rank`` (and ``complete`` where full-depth
metrics are wanted); ``qrels``: ``query_id, item_id, gain``. An item is relevant when
its gain is at least the threshold (1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ["query_id", "system"]
METRICS = ["ndcg_at_10", "map", "map_at_10", "p_at_5", "p_at_10", "recall_at_10", "mrr", "mrr_at_10"]


def judged(rankings: DataFrame, qrels: DataFrame, k: int = 10, threshold: int = 1) -> DataFrame:
    """Ranked rows with gain, relevance, running hit count, and the query's ideal DCG and relevant count."""
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "item_id"))
    ideal = qrels.withColumn("i", ideal_rank).groupBy("query_id").agg(
        F.sum(F.when(F.col("i") <= k, (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col("i") + 1))).alias("ideal"),
        F.count_if(F.col("gain") >= threshold).alias("n_rel"),
    )
    rows = rankings.join(qrels.select("query_id", "item_id", "gain"), ["query_id", "item_id"], "left")
    rows = rows.join(ideal, "query_id", "left").withColumns({
        "gain": F.coalesce("gain", F.lit(0)), "ideal": F.coalesce("ideal", F.lit(0.0)), "n_rel": F.coalesce("n_rel", F.lit(0)),
    })
    rows = rows.withColumn("rel", (F.col("gain") >= threshold).cast("int"))
    so_far = Window.partitionBy(*RUN).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("hits", F.sum("rel").over(so_far))


def _within(k: int | None) -> Column:
    return F.lit(True) if k is None else F.col("rank") <= k


def ndcg(k: int) -> Column:
    dcg = F.sum(F.when(_within(k), (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col("rank") + 1)).otherwise(0.0))
    return F.when(F.max("ideal") > 0, dcg / F.max("ideal")).otherwise(0.0)


def ap(k: int | None) -> Column:
    total = F.sum(F.when(_within(k) & (F.col("rel") == 1), F.col("hits") / F.col("rank")).otherwise(0.0))
    return F.when(F.max("n_rel") > 0, total / F.max("n_rel")).otherwise(0.0)


def precision(k: int) -> Column:
    if k <= 0:
        raise ValueError("k must be positive")
    return F.sum(F.when(_within(k), F.col("rel")).otherwise(0)) / F.lit(k)


def recall(k: int) -> Column:
    found = F.sum(F.when(_within(k), F.col("rel")).otherwise(0))
    return F.when(F.max("n_rel") > 0, found / F.max("n_rel")).otherwise(0.0)


def rr(k: int | None) -> Column:
    return F.coalesce(1.0 / F.min(F.when(_within(k) & (F.col("rel") == 1), F.col("rank"))), F.lit(0.0))


def ndcg_at_k(rankings, qrels, k=10):
    return judged(rankings, qrels, k).groupBy(*RUN).agg(ndcg(k).alias("ndcg"))


def average_precision(rankings, qrels, k=None):
    return judged(rankings, qrels).groupBy(*RUN).agg(ap(k).alias("ap"))


def precision_at_k(rankings, qrels, k):
    return judged(rankings, qrels).groupBy(*RUN).agg(precision(k).alias("precision"))


def recall_at_k(rankings, qrels, k):
    return judged(rankings, qrels).groupBy(*RUN).agg(recall(k).alias("recall"))


def reciprocal_rank(rankings, qrels, k=None):
    return judged(rankings, qrels).groupBy(*RUN).agg(rr(k).alias("rr"))


def metrics_for_rankings(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row per query and system in one aggregation; full-depth metrics are null for cut rankings."""
    whole = F.bool_and("complete")
    return judged(rankings, qrels).groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("depth"),
        whole.alias("complete"),
        ndcg(10).alias("ndcg_at_10"),
        F.when(whole, ap(None)).alias("map"),
        ap(10).alias("map_at_10"),
        precision(5).alias("p_at_5"),
        precision(10).alias("p_at_10"),
        recall(10).alias("recall_at_10"),
        F.when(whole, rr(None)).alias("mrr"),
        rr(10).alias("mrr_at_10"),
    )


def mean_unless_missing(c: str) -> Column:
    """The mean, or null as soon as one value is missing."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def metrics_by_type(by_query: DataFrame) -> DataFrame:
    """Means per query type and over all types, from rows with ``query_type``."""
    grouped = by_query.groupingSets([["query_type", "system"], ["system"]], "query_type", "system").agg(
        F.grouping("query_type").alias("over_all"),
        F.count(F.lit(1)).alias("queries"),
        *[mean_unless_missing(m).alias(m) for m in METRICS],
    )
    kind = F.when(F.col("over_all") == 1, F.lit("aggregate")).otherwise(F.col("query_type"))
    return grouped.select(kind.alias("query_type"), "system", "queries", *METRICS)


LEGACY = ["ndcg", "map", "p5", "p10", "mrr"]


def metrics_legacy(rankings: DataFrame, qrels: DataFrame, types: DataFrame) -> DataFrame:
    """Means over whatever depth the lists have; queries without judgements are left out."""
    rows = judged(rankings.join(qrels.select("query_id").distinct(), "query_id", "left_semi"), qrels)
    per_query = rows.groupBy(*RUN).agg(
        ndcg(10).alias("ndcg"), ap(None).alias("map"), precision(5).alias("p5"), precision(10).alias("p10"), rr(None).alias("mrr")
    )
    means = per_query.join(types, "query_id").groupingSets([["query_type", "system"], ["system"]], "query_type", "system").agg(
        F.grouping("query_type").alias("over_all"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in LEGACY]
    )
    kind = F.when(F.col("over_all") == 1, F.lit("aggregate")).otherwise(F.col("query_type"))
    return means.select(kind.alias("query_type"), "system", *LEGACY)


def compare_to_stored(means: DataFrame, stored: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Recomputed against stored means, one row per system, type and metric, with a verdict."""
    ids = ["query_type", "system"]
    now = means.unpivot(ids, LEGACY, "metric", "value")
    then = stored.unpivot(ids, LEGACY, "metric", "stored")
    joined = now.join(then, [*ids, "metric"], "full_outer")
    return joined.withColumn("equal", F.coalesce(F.abs(F.col("value") - F.col("stored")) < eps, F.lit(False)))


def ranking_overlap(rankings: DataFrame, pairs: list[tuple[str, str]], k: int = 10) -> DataFrame:
    """Jaccard overlap of two systems' first ``k`` items for each query."""
    tops = rankings.where(F.col("rank") <= k).groupBy(*RUN).agg(F.collect_set("item_id").alias("items"))  # <= k each
    wanted = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    left = tops.select("query_id", F.col("system").alias("a"), F.col("items").alias("left"))
    right = tops.select("query_id", F.col("system").alias("b"), F.col("items").alias("right"))
    both = left.join(right, "query_id").where(F.array_contains(wanted, F.struct("a", "b")))
    either = F.size(F.array_union("left", "right"))
    value = F.when(either > 0, F.size(F.array_intersect("left", "right")) / either).otherwise(0.0)
    return both.select("query_id", F.concat("a", F.lit("_vs_"), "b").alias("pair"), value.alias("jaccard"))


def overlap_means(overlaps: DataFrame) -> DataFrame:
    return overlaps.groupBy("pair").agg(F.bround(F.avg("jaccard"), 4).alias("mean_jaccard"))


def build_pool(rankings: DataFrame, depth: int = 20) -> DataFrame:
    """Union of each system's first ``depth`` items, to be judged."""
    return rankings.where(F.col("rank") <= depth).select("query_id", "item_id").distinct().withColumn("mark", F.lit(""))


def pool_to_qrels(pool: DataFrame) -> DataFrame:
    """Judged rows of a pool; only the marks 1, 2 and 3 count."""
    mark = F.trim(F.coalesce("mark", F.lit("")))
    return pool.where(mark.isin("1", "2", "3")).select("query_id", "item_id", mark.cast("int").alias("gain"))


def metric_table(by_type: DataFrame, type_order: list[str]) -> DataFrame:
    """Report cells with three decimals and ``---`` for missing, in system and type order."""
    order = F.array_position(F.array(*[F.lit(x) for x in type_order]), F.col("query_type"))
    cells = [F.when(F.col(m).isNotNull(), F.format_string("%.3f", m)).otherwise("---").alias(m) for m in METRICS]
    listed = by_type.where(order > 0)
    cut = F.max(F.col("map").isNull()).over(Window.partitionBy("system"))
    name = F.when(cut, F.concat("system", F.lit(" (legacy top-10)"))).otherwise(F.col("system"))
    table = listed.select(name.alias("display"), "system", "query_type", order.cast("int").alias("position"), *cells)
    return table.orderBy("system", "position")
