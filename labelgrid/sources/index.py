"""The item and segment tables of a search index: build, append, replace, delete, rebuild.

Parquet has no row updates: each change returns the new state of a table for
the caller to write beside the old one and switch. Appends go to a directory
per batch, so a repeated batch overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrid.functions import text as tx
from labelgrid.operators.numbering import last_id, number_rows
from labelgrid.operators.search import SEGMENT_SPAN
from labelgrid.sources.files import _exists


def point_key(name: str, segment_id: str):
    """The same key for the same segment in every rebuild."""
    return F.sha1(F.concat_ws(":", F.lit(name), F.col(segment_id).cast("string")))


def build_index(spark: SparkSession, documents: DataFrame, name: str, folder: str, encode, reset: bool = False) -> DataFrame:
    """Encode and write keyed segments, unless the index is there already; the index as a table."""
    path = f"{folder}/{name}"
    if reset or not _exists(spark, f"{path}/_SUCCESS"):
        keyed = encode(documents).withColumn("point_id", point_key(name, "segment_id"))
        keyed.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def joined_units(index: DataFrame) -> DataFrame:
    """Of an index of joined texts and lines (``segments_of``, mode ``both``) the joined texts with their vectors, without keys."""
    return index.where(F.col("segment_id") == F.col("item_id") * SEGMENT_SPAN).drop("point_id")


def index_report(indexes: dict[str, DataFrame], item: str = "item_id") -> DataFrame:
    """Points and distinct items of each index."""
    from labelgrid.sources.files import union_all

    return union_all([
        df.agg(F.count(F.lit(1)).alias("points"), F.countDistinct(item).alias("items")).select(F.lit(name).alias("system"), "points", "items")
        for name, df in indexes.items()
    ])


def number_segments(units: DataFrame, start) -> DataFrame:
    """``item_id, pos, segment_text`` to consecutive segment ids after ``start``."""
    return number_rows(units, ["item_id", "pos"], "segment_id", start).select("item_id", "segment_id", "segment_text")


def units_of(items: DataFrame) -> DataFrame:
    return items.select("item_id", F.posexplode(tx.line_units(F.col("text"))).alias("pos", "segment_text"))


def append_items(items: DataFrame, segments: DataFrame, new: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """New items and their segments with ids that continue after the largest ones; only the new rows."""
    numbered = number_rows(new, [order], "item_id", last_id(items, "item_id").first()[0])
    return numbered, number_segments(units_of(numbered), last_id(segments, "segment_id").first()[0])


def replace_segments(items: DataFrame, segments: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New texts for known items: text replaced, old segments gone, new ones numbered on; an unknown id fails."""
    new = updates.select("item_id", F.col("text").alias("_new"))
    joined = items.withColumn("_known", F.lit(True)).join(new, "item_id", "full_outer")
    text = F.when(F.col("_known"), F.coalesce("_new", "text")).otherwise(
        F.raise_error(F.concat(F.lit("unknown item: "), F.col("item_id").cast("string"))).cast("string"))
    after = joined.withColumn("text", text).select(*items.columns)
    kept = segments.join(updates.select("item_id"), "item_id", "left_anti").select("item_id", "segment_id", "segment_text")
    made = number_segments(units_of(updates), last_id(segments, "segment_id").first()[0])
    return after, kept.unionByName(made)


def delete_items(items: DataFrame, segments: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return items.join(ids, "item_id", "left_anti"), segments.join(ids, "item_id", "left_anti")


def rebuild_segments(items: DataFrame) -> DataFrame:
    """All segments from the item texts, ids from 1 in item and line order."""
    return number_segments(units_of(items), 0)


def evaluation_segments(items: DataFrame, mode: str) -> DataFrame:
    """Text units with readable segment ids: ``item:full`` and ``item:segment:001``."""
    rows = items.select("item_id", F.posexplode(tx.text_units(F.col("text"), mode)).alias("pos", "u"))
    key = F.when(F.col("u.segment_type") == "full", F.concat(F.col("item_id").cast("string"), F.lit(":full"))).otherwise(
        F.format_string("%s:segment:%03d", F.col("item_id").cast("string"), F.col("pos")))
    return rows.select("item_id", key.alias("segment_id"), "u.segment_type", "u.segment_text")


