"""Quoted CSV and one large nested JSON object, read in byte ranges by Spark's text source.

A separator inside quotes or brackets does not end a record, and whether a place lies inside them depends on all before it. So files are cut
at every separator (the text source does that in byte ranges of any size), and each piece tells what it does to the state: how many quotes it has, and by how
much it changes the depth of brackets, begun outside or inside a string. Running sums within a range, and over the ranges of a file, give the state at each piece. Records are
then put together again: most are one piece and stay where they are; only the others are grouped. No task holds more than a range, and
no row more than a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelgrid.session import through_table

RANGE = ["file", "block"]


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))


def _signs(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _depth_change(text: Column) -> Column:
    """Brackets opened less brackets closed outside strings; a string that does not end goes on to the end of the piece."""
    plain = F.regexp_replace(text, r'"[^"]*+("|\z)', "")
    return _signs(plain, r"[\[{]") - _signs(plain, r"[\]}]")


def _records(pieces: DataFrame, separator: str, level: int) -> DataFrame:
    """file, record (a number), text, depth, end, opener, leading, from pieces with ``quotes``, ``outside`` and ``inside``.

    A record begins with a piece that starts outside strings at a depth of ``level`` at most. ``depth`` and ``end`` are the depths at its start and end, ``opener``
    the number of the last record up to it that began above that level, and ``leading`` marks the first record of a file.
    """
    in_order = Window.partitionBy(*RANGE).orderBy("id")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def summed(c: Column | str, over) -> Column:
        return F.coalesce(F.sum(c).over(over), F.lit(0))

    # State at the start of each range; text does not take part.
    marks = pieces.select(*RANGE, "id", "quotes", "outside", "inside").withColumn("odd", summed("quotes", before) % 2)
    ranges = marks.groupBy(*RANGE).agg(
        F.sum("quotes").alias("quotes"),
        F.sum(F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside"))).alias("outside"),
        F.sum(F.when(F.col("odd") == 0, F.col("inside")).otherwise(F.col("outside"))).alias("inside"),
    )
    ranges = ranges.withColumn("first_odd", summed("quotes", earlier) % 2)
    ranges = ranges.withColumn("first_depth", summed(F.when(F.col("first_odd") == 0, F.col("outside")).otherwise(F.col("inside")), earlier))

    placed = pieces.join(ranges.select(*RANGE, "first_odd", "first_depth"), RANGE)
    placed = placed.withColumn("odd", (F.col("first_odd") + summed("quotes", before)) % 2)
    placed = placed.withColumn("change", F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside")))
    placed = placed.withColumn("depth", F.col("first_depth") + summed("change", before))
    begins = (F.col("odd") == 0) & (F.col("depth") <= level)
    placed = placed.withColumn("begins", (F.col("odd") == 0) & (F.col("depth") <= level))
    placed = placed.withColumns({
        "record": F.last(F.when(F.col("begins"), F.col("id")), True).over(so_far),
        "opener": F.last(F.when(F.col("begins") & (F.col("depth") < level), F.col("id")), True).over(so_far),
        # Whether the record is this piece alone; after the last piece of a range that is not known.
        "alone": F.col("begins") & F.coalesce(F.lead("begins").over(in_order), F.lit(False)),
    })
    placed = placed.select(*RANGE, "id", "value", "depth", (F.col("depth") + F.col("change")).alias("end"), "record", "opener", "alone")
    placed = through_table(placed, "pieces")

    # Pieces at the head of a range may go on with a record of an earlier one.
    ends = placed.groupBy(*RANGE).agg(F.max("record").alias("record"), F.max("opener").alias("opener"), F.min("id").alias("least"))
    ends = ends.select(*RANGE, "least", F.last("record", True).over(earlier).alias("old_record"), F.last("opener", True).over(earlier).alias("old_opener"))
    placed = placed.join(ends, RANGE).withColumns({"record": F.coalesce("record", "old_record"), "opener": F.coalesce("opener", "old_opener")})
    placed = placed.withColumn("leading", (F.col("block") == 0) & (F.col("id") == F.col("least")))

    alone = placed.where("alone").select("file", "record", F.col("value").alias("text"), "depth", "end", "opener", "leading")
    # Numbers ascend within a range only.
    place = F.struct("block", "id")
    parts = F.array_sort(F.collect_list(F.struct("block", "id", "value")))
    several = placed.where("not alone").groupBy("file", "record").agg(
        F.array_join(F.transform(parts, lambda x: x["value"]), separator).alias("text"), F.min_by("depth", place).alias("depth"),
        F.max_by("end", place).alias("end"), F.min_by("opener", place).alias("opener"), F.max("leading").alias("leading"),
    )
    return alone.unionByName(several)


def csv_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``text``: the records of CSV files whose first line names ``columns``, without that line; blank records are left out.

    Fields may be quoted, with quotes doubled inside and line breaks as they are; a quote inside a field that is not quoted is not allowed. Another header fails the job.
    """
    rows = _pieces(spark, path, "\n").withColumns({"quotes": _signs(F.col("value"), '"'), "outside": F.lit(0), "inside": F.lit(0)})
    text = F.regexp_replace("text", r"\r\z", "")
    found = F.from_csv(F.regexp_replace(text, r"\A\x{FEFF}", ""), ", ".join(f"c{i} string" for i in range(len(columns))), {"quote": '"', "escape": '"'})
    names = F.array(*[F.trim(found[f"c{i}"]) for i in range(len(columns))])
    error = F.raise_error(F.concat(F.lit("unexpected header: "), text)).cast("boolean")
    kept = F.when(~F.col("leading"), F.trim(text) != "").when(names == F.array(*[F.lit(c) for c in columns]), F.lit(False)).otherwise(error)
    return _records(rows, "\n", 0).where(kept).select(text.alias("text"))


def nested_entries(spark: SparkSession, path: str, value: T.DataType) -> DataFrame:
    """``outer, inner, value``: the entries of files that hold one object ``{outer: {inner: value}}`` each, of any size and in any layout."""
    rows = _pieces(spark, path, ",").withColumn("plain", F.regexp_replace("value", r"(?s)\\.", ""))
    rows = rows.withColumns({
        "quotes": _signs(F.col("plain"), '"'), "outside": _depth_change(F.col("plain")), "inside": _depth_change(F.concat(F.lit('"'), "plain")),
    }).drop("plain")
    records = _records(rows, ",", 2).where(F.trim(F.regexp_replace("text", r"\s", "")) != "")
    # Each record becomes an object by itself; the place of the outer key stays empty where another record has it.
    whole = F.concat(F.when(F.col("depth") == 2, '{"": {').when(F.col("depth") == 1, "{").otherwise(""), "text", F.repeat(F.lit("}"), F.col("end").cast("int")))
    schema = T.MapType(T.StringType(), T.MapType(T.StringType(), value))
    outer = records.select("file", "record", "depth", "opener", F.explode(F.from_json(whole, schema, {"mode": "FAILFAST"})).alias("outer", "items"))
    entries = outer.select("file", "record", "depth", "opener", "outer", F.explode("items").alias("inner", "value"))
    names = outer.where("depth < 2").select("file", F.col("record").alias("opener"), F.col("outer").alias("name"))
    under = entries.where("depth = 2").drop("outer").join(names, ["file", "opener"]).select(F.col("name").alias("outer"), "inner", "value")
    return entries.where("depth < 2").select("outer", "inner", "value").unionByName(under)
