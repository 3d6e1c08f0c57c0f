"""Consecutive numbers without a one-task window.

Rows are range-partitioned by (group, order) and written once, so even one
group holding most rows is spread over many tasks; each task numbers its own
slice and a table of slice sizes supplies the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelgrid.session import through_table


def number_in_group(df: DataFrame, group: list[str], order: list[str], name: str = "number") -> DataFrame:
    """1..n within each group, in the given order (which must be free of ties)."""
    keys = [*group, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = through_table(ranged.withColumn("_slice", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy("_slice", *group).agg(F.count(F.lit(1)).alias("_size"))
    # One row per slice a group touches, so this window is short even for a hot group.
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    within = F.row_number().over(Window.partitionBy("_slice", *group).orderBy(*order))
    condition = F.col("p._slice") == F.col("o._slice")
    for g in group:
        condition &= F.col(f"p.{g}").eqNullSafe(F.col(f"o.{g}"))
    joined = placed.withColumn("_within", within).alias("p").join(offsets.alias("o"), condition)
    return joined.select(*[F.col(f"p.{c}") for c in df.columns], (F.col("_before") + F.col("_within")).alias(name))


def number_rows(df: DataFrame, order: list[str], name: str = "number", start: Column | int = 0) -> DataFrame:
    """start+1, start+2, ... over all rows in the given order."""
    first = start if isinstance(start, Column) else F.lit(start)
    return number_in_group(df, [], order, name).withColumn(name, F.col(name) + first)


def last_id(df: DataFrame, column: str = "id") -> DataFrame:
    """The largest id, zero for an empty table."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("last_id"))


def _taken(existing: DataFrame) -> DataFrame:
    """Numbers already used for each base: the bare slug is 1, ``base-n`` is n."""
    bare = existing.select(F.col("slug").alias("base"), F.lit(1).cast("long").alias("t"))
    suffix = F.regexp_extract("slug", r"-([1-9]\d{0,17})\z", 1)
    numbered = existing.where(suffix != "").select(F.regexp_replace("slug", r"-[1-9]\d{0,17}\z", "").alias("base"), suffix.cast("long").alias("t"))
    return bare.unionByName(numbered.where("t >= 2")).distinct()


def unique_slugs(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``id, base`` to ``id, slug``: base, base-2, base-3, ... skipping slugs in use.

    The i-th row of a base takes the i-th free number. A clash between the
    numbered slug of one base and the bare slug of another goes to the smaller
    id; the other row is numbered again against what has been given out. Each
    round settles at least one row of every clash, so the rounds come to an end.
    """
    pending, used, done = new.select("id", "base"), existing.select("slug").distinct(), []
    while True:
        wanted = number_in_group(pending, ["base"], ["id"], "key").select("base", "key", F.lit(0).alias("kind"), "id")
        taken = number_in_group(_taken(used).join(pending.select("base").distinct(), "base", "left_semi"), ["base"], ["t"], "j")
        marks = taken.select("base", (F.col("t") - F.col("j")).alias("key"), F.lit(1).alias("kind"), F.col("t").alias("id"))
        placed = number_in_group(wanted.unionByName(marks), ["base"], ["key", "kind", "id"], "free").where("kind = 0")
        slug = F.when(F.col("free") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("free").cast("string")))
        given = through_table(placed.select("id", "base", slug.alias("slug")), "slugs")
        winners = given.groupBy("slug").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        done.append(given.join(winners.select("id", "slug"), ["id", "slug"], "left_semi").select("id", "slug"))
        if not winners.where("n > 1").limit(1).count():
            break
        pending = through_table(given.join(winners.select("id", "slug"), ["id", "slug"], "left_anti").select("id", "base"), "slugs-pending")
        used = used.unionByName(done[-1].select("slug"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
