"""Data-quality checks: one row ``name, status, critical, detail`` each.

Details carry counts; the ids behind a failed check come from ``only_in``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, name: str | Column, condition: Column, detail: Column, critical: bool = True) -> DataFrame:
    name = F.lit(name) if isinstance(name, str) else name
    status = F.when(F.coalesce(condition, F.lit(False)), "pass").otherwise("fail")
    return df.select(name.alias("name"), status.alias("status"), F.lit(critical).alias("critical"), detail.alias("detail"))


def skipped(spark, name: str, detail: str, critical: bool = False) -> DataFrame:
    return spark.range(1).select(F.lit(name).alias("name"), F.lit("skip").alias("status"), F.lit(critical).alias("critical"), F.lit(detail).alias("detail"))


def _say(**parts) -> Column:
    cells = []
    for label, value in parts.items():
        cells += [F.lit(f"{' ' if cells else ''}{label}="), (value if isinstance(value, Column) else F.lit(value)).cast("string")]
    return F.concat(*cells)


def union(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids of the left side that the right side lacks."""
    return left.select(key).subtract(right.select(key))


def same_ids(name: str, found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Set equality: both sides in one full outer join, missing and unknown counted."""
    a = found.select(key).distinct().withColumn("_f", F.lit(1))
    b = expected.select(key).distinct().withColumn("_e", F.lit(1))
    n = a.join(b, key, "full_outer").agg(F.count_if(F.col("_f").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unknown"))
    return _row(n, name, (F.col("missing") == 0) & (F.col("unknown") == 0), _say(missing=F.col("missing"), unknown=F.col("unknown")))


def count_is(name: str, df: DataFrame, expected: int) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return _row(n, name, F.col("n") == expected, _say(found=F.col("n"), expected=expected))


def all_known(name: str, df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    n = df.select(key).distinct().join(known.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return _row(n, name, F.col("n") == 0, _say(unknown=F.col("n")))


def audit_inputs(queries: DataFrame, cache: DataFrame, expected: DataFrame, files: DataFrame, qrels: DataFrame, n_queries: int, n_items: int, fields: list[str], graded: bool) -> DataFrame:
    """Checks of the evaluation inputs; ``cache`` has rows ``field, item_id, text``."""
    checks = [count_is("query_count", queries, n_queries)]
    for field in fields:
        rows = cache.where(F.col("field") == field)
        n = rows.agg(F.countDistinct("item_id").alias("n"), F.count_if(F.trim("text") == "").alias("empty"))
        checks += [
            _row(n, f"{field}_count", F.col("n") == n_items, _say(found=F.col("n"), expected=n_items)),
            same_ids(f"{field}_canonical_ids", rows, expected, "item_id"),
            _row(n, f"{field}_nonempty", F.col("empty") == 0, _say(empty=F.col("empty"))),
        ]
    spread = cache.where(F.col("field").isin(fields)).groupBy("item_id").agg(F.countDistinct("field").alias("n")).agg(
        F.count_if(F.col("n") != len(fields)).alias("uneven"))
    judged = qrels.select("query_id").distinct()
    n_unjudged = queries.select("query_id").join(judged, "query_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    checks += [
        _row(spread, "representation_id_sets_identical", F.col("uneven") == 0, _say(uneven=F.col("uneven"))),
        same_ids("image_count", files, expected, "item_id"),
        same_ids("qrels_query_coverage", judged, queries, "query_id"),
        all_known("qrels_ids_known", qrels, expected, "item_id"),
        _row(n_unjudged, "queries_have_qrels", F.col("n") == 0, _say(missing=F.col("n"))),
        _row(queries.sparkSession.range(1), "qrels_format", F.lit(not graded), F.lit(f"binary={not graded}")),
    ]
    return union(checks)


REQUIRED = ["eval_id", "image_path", "group", "filename", "segment_id", "segment_type", "segment_text"]


def audit_index(name: str, payloads: DataFrame, expected: DataFrame, item: str = "item_id", required: list[str] | None = None) -> DataFrame:
    """Checks of an index: ids, required fields, exactly one ``full`` segment per item."""
    fields = required or REQUIRED
    missing_field = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in fields])
    n = payloads.agg(F.count(F.lit(1)).alias("points"), F.countDistinct(item).alias("items"), F.coalesce(F.count_if(missing_field), F.lit(0)).alias("bad"))
    fulls = payloads.where("segment_type = 'full'").groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    per_item = expected.select(item).distinct().join(fulls, item, "left").agg(F.count_if(F.coalesce("n", F.lit(0)) != 1).alias("invalid"))
    return union([
        same_ids(f"collection_{name}_eval_ids", payloads, expected, item),
        _row(n, f"collection_{name}_payload", F.col("bad") == 0, _say(points=F.col("points"), items=F.col("items"), bad=F.col("bad"))),
        all_known(f"collection_{name}_no_external_docs", payloads, expected, item),
        _row(per_item, f"collection_{name}_one_full_per_label", F.col("invalid") == 0, _say(invalid=F.col("invalid"))),
    ])


def audit_rankings(rankings: DataFrame, queries: DataFrame, expected: DataFrame, final: int) -> DataFrame:
    """Per ranking: unique, known, complete where it claims to be; and the same systems for every query."""
    known = expected.select("item_id", F.lit(1).alias("_known")).distinct()
    per = rankings.join(known, "item_id", "left").groupBy("query_id", "system").agg(
        F.count(F.lit(1)).alias("depth"), F.countDistinct("item_id").alias("unique"),
        F.count_if(F.col("_known").isNull()).alias("unknown"), F.bool_or("complete").alias("complete"))
    label = lambda what: F.concat(F.lit("ranking_"), F.col("query_id").cast("string"), F.lit("_"), F.col("system"), F.lit(f"_{what}"))
    whole = (F.col("depth") == final) & (F.col("unique") == final) & (F.col("unknown") == 0)
    systems = rankings.select("query_id", "system").distinct().groupBy("system").agg(F.count(F.lit(1)).alias("n"))
    total = rankings.agg(F.countDistinct("query_id").alias("q"))
    uneven = systems.join(F.broadcast(total)).agg(F.count_if(F.col("n") != F.col("q")).alias("uneven"))
    return union([
        same_ids("ranking_query_set", rankings, queries, "query_id"),
        _row(per, label("unique"), F.col("depth") == F.col("unique"), _say(depth=F.col("depth"), unique=F.col("unique"))),
        _row(per, label("known"), F.col("unknown") == 0, _say(unknown=F.col("unknown"))),
        _row(per.where("complete"), label("complete"), whole, _say(depth=F.col("depth"))),
        _row(uneven, "all_systems_use_same_queries", F.col("uneven") == 0, _say(uneven=F.col("uneven"))),
    ])


def audit_status(checks: DataFrame, strict: bool) -> DataFrame:
    """One row: fail when a critical check failed; in strict mode a skipped check counts as failed too."""
    bad = (F.col("status") == "fail") & F.col("critical")
    if strict:
        bad = bad | (F.col("status") == "skip")
    return checks.agg(
        F.when(F.coalesce(F.bool_or(bad), F.lit(False)), "fail").otherwise("pass").alias("status"), F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "skip").alias("skipped"))


def audit_keys(tables: dict[str, DataFrame], keys: dict[str, list[list[str]]], references: list[tuple[str, str, str, str]]) -> DataFrame:
    """Duplicate keys and dangling references of the catalogue tables."""
    checks = []
    for table, columns in ((t, c) for t, sets in keys.items() if t in tables for c in sets):
        twice = tables[table].groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n"))
        checks.append(_row(twice, f"key_{table}_{'_'.join(columns)}", F.col("n") == 0, _say(duplicates=F.col("n"))))
    for table, column, other, target in references:
        if table in tables and other in tables:
            left = tables[table].where(F.col(column).isNotNull()).select(F.col(column).alias("_k"))
            lost = left.join(tables[other].select(F.col(target).alias("_k")), "_k", "left_anti").agg(F.count(F.lit(1)).alias("n"))
            checks.append(_row(lost, f"reference_{table}_{column}", F.col("n") == 0, _say(dangling=F.col("n"))))
    return union(checks)
