"""Ranking rows within a query: top-k, best segment per item, rank fusion, paging.

Every rank is deterministic: the score is rounded to nine places, ties go to
the smaller id. ``row_number`` over a (query, branch) window with a rank filter
is planned by Spark as a partial and a final group limit, so at most k rows
per query and partition are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 9


def rounded(score: Column, digits: int = SCORE_DIGITS) -> Column:
    return F.round(score, digits)


def rank_hits(df: DataFrame, by: list[str], id_col: str = "id", rank_col: str = "rank") -> DataFrame:
    """Rank 1..n within ``by``, best score first."""
    window = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(id_col))
    return df.withColumn(rank_col, F.row_number().over(window))


def topk(df: DataFrame, k: int, by: list[str], id_col: str = "id") -> DataFrame:
    return rank_hits(df, by, id_col).where(F.col("rank") <= k)


def min_score(df: DataFrame, threshold: float | None) -> DataFrame:
    return df if threshold is None else df.where(F.col("score") >= threshold)


def best_segment(hits: DataFrame, by: list[str], item: str = "item_id") -> DataFrame:
    """One row per item and branch, from its best-ranked segment, then ranked again without gaps."""
    best = hits.groupBy(*by, item).agg(F.min(F.struct(F.col("rank").alias("r"), (-F.col("score")).alias("s"))).alias("b"))
    window = Window.partitionBy(*by).orderBy(F.col("b.r"), F.col("b.s"), F.col(item))
    return best.select(
        *by, item, (-F.col("b.s")).alias("score"), F.col("b.r").alias("segment_rank"), F.row_number().over(window).alias("rank")
    )


def best_score(hits: DataFrame, by: list[str], k: int | None = None, item: str = "item_id") -> DataFrame:
    """One row per item with its highest score, ranked, optionally cut at ``k``."""
    best = hits.groupBy(*by, item).agg(F.max("score").alias("score"))
    ranked = rank_hits(best, by, item)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def rrf(branches: dict[str, DataFrame], k: int = 60, n: int | None = 50, by: tuple[str, ...] = ("query_id",), item: str = "item_id") -> DataFrame:
    """Reciprocal Rank Fusion: each branch adds ``1 / (k + rank)`` for an item, once.

    A union and one aggregation instead of a full outer join. Two rows of one
    branch for the same item fail the job. Ties go to the id in string order.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    tagged = [df.select(*by, item, "rank", F.lit(name).alias("branch")) for name, df in sorted(branches.items())]
    votes = reduce(DataFrame.unionByName, tagged)
    per_branch = [F.count(F.when(F.col("branch") == name, 1)) for name in sorted(branches)]
    fused = votes.groupBy(*by, item).agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.greatest(F.lit(0), *per_branch).alias("most")
    )
    checked = F.when(F.col("most") > 1, F.raise_error(F.lit("an item occurs twice in one branch")).cast("double")).otherwise(
        F.round("score", 12)
    )
    ranked = fused.select(*by, item, checked.alias("score"))
    window = Window.partitionBy(*by).orderBy(F.desc("score"), F.col(item).cast("string"))
    ranked = ranked.withColumn("rank", F.row_number().over(window))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def branch_depth(index: DataFrame, final: int, depth: int) -> DataFrame:
    """How many candidates each branch reads: the larger wish, at most the index size."""
    return index.agg(F.least(F.greatest(F.lit(final), F.lit(depth)).cast("long"), F.count(F.lit(1))).alias("depth"))


def require_complete(ranked: DataFrame, n: int, by: list[str], item: str = "item_id") -> DataFrame:
    """One row per ranking; a ranking without exactly ``n`` different items fails the job."""
    sizes = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("depth"), F.countDistinct(item).alias("items"))
    whole = (F.col("depth") == n) & (F.col("items") == n)
    return sizes.withColumn(
        "complete", F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("incomplete ranking of depth "), F.col("depth"))).cast("boolean"))
    )


def page(df: DataFrame, order: list, page_no: int, limit: int) -> DataFrame:
    """One page in a stated order, with the total and whether more follow.

    The page is a global sort with offset and limit (a top-k, not a full sort,
    for early pages); the total is one count joined as a single row.
    """
    rows = df.orderBy(*order).offset(page_no * limit).limit(limit)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    more = F.col("total") > (page_no + 1) * limit
    return rows.join(F.broadcast(total)).withColumn("has_more", more)


def cut(df: DataFrame, order: list, limit: int) -> DataFrame:
    """First ``limit`` results with recomputed total and has_more."""
    return page(df, order, 0, limit)


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in an order that depends on key and seed only, not on partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def random_row(df: DataFrame, key: str, seed: int) -> DataFrame:
    return hash_sample(df, key, 1, seed)


def blank_template(groups: DataFrame, n: int) -> DataFrame:
    """``n`` empty rows for each row of ``groups(group)``."""
    return groups.select(F.lit("").alias("item_id"), "group", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("position"), F.lit("").alias("legibility"))
