"""Reading and writing the evaluation and catalogue files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelgrid.functions import text as tx
from labelgrid.operators.numbering import number_in_group
from labelgrid.sources import schemas
from labelgrid.sources.pieces import csv_records, nested_entries


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV with quoted multi-line fields, read in byte ranges; every field stripped; a malformed row fails the job."""
    fields = spark.createDataFrame([], schema).schema
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true"}
    df = csv_records(spark, path, fields.names).select(F.from_csv("text", schema, options).alias("row")).select("row.*")
    return df.select(*[tx.strip(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.QUERIES).select("query_id", F.col("query").alias("text"), F.col("type").alias("query_type"))


def _entries(spark: SparkSession, path: str, value: T.DataType, whole_file: bool) -> DataFrame:
    """``outer, inner, value`` of one nested object per file (``whole_file``, read in byte ranges) or per line."""
    if whole_file:
        return nested_entries(spark, path, value)
    schema = T.MapType(T.StringType(), T.MapType(T.StringType(), value))
    text = spark.read.text(path).where(F.trim("value") != "")
    outer = text.select(F.explode(F.from_json("value", schema, {"mode": "FAILFAST"})).alias("outer", "items"))
    return outer.select("outer", F.explode("items").alias("inner", "value"))


def read_text_cache(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """``{field: {id: text}}`` as rows ``field, item_id, text``."""
    return _entries(spark, path, T.StringType(), whole_file).toDF("field", "item_id", "text")


def read_qrels(spark: SparkSession, binary: str, graded: str | None = None, threshold: int = 1, whole_file: bool = True, pattern: str | None = tx.ITEM_ID) -> DataFrame:
    """``{query: {item: gain}}`` as rows with ``gain`` and ``relevant``.

    The graded file is taken when there is one. A gain outside 0..3 (graded) or
    0..1 (binary), or an id outside the pattern, fails the job.
    """
    use_graded = graded is not None and _exists(spark, graded)
    top, limit = (3, threshold) if use_graded else (1, 1)
    rows = _entries(spark, graded if use_graded else binary, T.IntegerType(), whole_file).toDF("query_id", "item_id", "gain")
    gain = F.when(F.col("gain").between(0, top), F.col("gain")).otherwise(
        F.raise_error(F.concat(F.lit("gain out of range for "), "query_id", F.lit("/"), "item_id")).cast("int"))
    item = F.col("item_id") if pattern is None else tx.canonical_id(F.col("item_id"), pattern)
    return rows.select("query_id", item.alias("item_id"), gain.alias("gain")).withColumn("relevant", F.col("gain") >= limit)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_rankings(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """``{query: {system: [ids]}}`` as ranked rows."""
    return explode_rankings(_entries(spark, path, T.ArrayType(T.StringType()), whole_file).toDF("query_id", "system", "items"))


def explode_rankings(df: DataFrame, items: str = "items") -> DataFrame:
    """Ordered id lists as rows with a rank from 1; the other columns stay."""
    rest = [c for c in df.columns if c != items]
    return df.select(*rest, F.posexplode(items).alias("_pos", "item_id")).select(*rest, "item_id", (F.col("_pos") + 1).alias("rank"))


# Extensions that count as images; fixed by the input folder format.
IMAGE_FILES = r"(?i)\.(?:jpg|jpeg|png|webp)\z"


def scan_files(spark: SparkSession, glob: str) -> DataFrame:
    """Image files with an id from folder and stem: ``item_id, path, group, filename``.

    Only listing data is read, never file contents. A name that gives no valid
    id, or two files with the same id, fail the job.
    """
    files = spark.read.format("binaryFile").load(glob).select("path").where(F.col("path").rlike(IMAGE_FILES))
    name = F.substring_index("path", "/", -1)
    folder = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    stem = F.try_to_number(F.regexp_extract(name, r"^(\d+)\.[^.]*\z", 1), F.lit("999999999")).cast("int")
    raw = F.concat(folder, F.lit("_"), F.coalesce(F.format_string("%02d", stem), F.lit("?")))
    rows = files.select(tx.canonical_id(raw).alias("item_id"), "path", folder.cast("int").alias("group"), name.alias("filename"))
    copies = F.count(F.lit(1)).over(Window.partitionBy("item_id"))
    checked = F.when(copies == 1, F.col("item_id")).otherwise(F.raise_error(F.concat(F.lit("two files for id "), "item_id")).cast("string"))
    return rows.select(checked.alias("item_id"), "path", "group", "filename")


def numbered_folder(spark: SparkSession, glob: str) -> DataFrame:
    """Files of each folder in natural order, numbered ``folder_01``, ``folder_02``, ..."""
    files = spark.read.format("binaryFile").load(glob).select("path").where(F.col("path").rlike(IMAGE_FILES))
    rows = files.select(F.substring_index(F.substring_index("path", "/", -2), "/", 1).alias("folder"), F.substring_index("path", "/", -1).alias("filename"), "path")
    keyed = rows.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(tx.natural_key(F.col("filename")))])
    placed = number_in_group(keyed, ["folder"], ["_k0", "_k1", "_k2"], "_place")
    return placed.select(F.format_string("%s_%02d", "folder", "_place").alias("item_id"), "folder", "filename", "path")


def build_corpus(expected: DataFrame, texts: DataFrame, files: DataFrame) -> DataFrame:
    """Every expected id with its text (empty when missing) and its file; a missing file fails the job."""
    rows = expected.join(texts.select("item_id", "text"), "item_id", "left").join(files.select("item_id", "path"), "item_id", "left")
    path = F.when(F.col("path").isNotNull(), F.col("path")).otherwise(
        F.raise_error(F.concat(F.lit("no file for item "), F.col("item_id").cast("string"))).cast("string"))
    return rows.select("item_id", F.coalesce("text", F.lit("")).alias("text"), path.alias("path"), F.substring_index("path", "/", -1).alias("filename"))


def expected_ids(spark: SparkSession, groups: int = 5, per_group: int = 10) -> DataFrame:
    """All canonical ids: groups times positions."""
    group = spark.range(1, groups + 1).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(1), F.lit(per_group))).alias("i"))
    return group.select(F.format_string("%d_%02d", "g", "i").alias("item_id"))


def read_catalog(spark: SparkSession, table: str, parquet_folder: str | None = None, jdbc: dict | None = None, split_column: str = "id",
                 bounds: tuple[int, int] | None = None, partitions: int = 32) -> DataFrame:
    """A catalogue table from Parquet, or from a database in parallel ranges of ``split_column``."""
    if parquet_folder is not None:
        return spark.read.schema(schemas.CATALOG[table]).parquet(f"{parquet_folder}/{table}")
    reader = spark.read.format("jdbc").options(**jdbc).option("dbtable", table)
    if bounds is not None:
        reader = reader.options(partitionColumn=split_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def scan_payload(df: DataFrame) -> DataFrame:
    """All columns but the vectors, so a columnar source never reads them."""
    vectors = (T.FloatType, T.DoubleType)
    keep = [f.name for f in df.schema if not (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, vectors))]
    return df.select(*keep)


def filter_media(df: DataFrame) -> DataFrame:
    """Uploads that are images by content type."""
    return df.where(F.coalesce(F.col("content_type").startswith("image/"), F.lit(False)))


def write_report(df: DataFrame, path: str, fmt: str, columns: list[str] | None = None, split_by: list[str] | None = None) -> None:
    """Report as ``json`` or ``csv`` (with header) in a fixed column order."""
    out = df.select(*(columns or df.columns))
    writer = out.write.mode("overwrite")
    if split_by:
        writer = writer.partitionBy(*split_by)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown report format: {fmt}")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
