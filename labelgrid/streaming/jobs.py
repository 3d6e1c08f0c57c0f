"""Ingest and activity streams.

No stream keeps state: a batch is summed up by itself and written to a directory
of its own, so a repeated batch replaces itself, and a view adds the batches up.
Rows that arrive late or out of order count like any other, and the result does
not depend on how files are split into batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrid.functions import text as tx
from labelgrid.operators import search as se
from labelgrid.operators.encode import HashingEncoder, encode_column
from labelgrid.operators.numbering import last_id, number_rows
from labelgrid.session import shared_folder, through_table
from labelgrid.sources.files import _exists


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Parquet files arriving in a folder; a single file is read as the only one of its name in its folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())
    return reader.parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work off everything that is there, batch by batch, then stop."""
    query = stream.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def to_table(stream: DataFrame, folder: str, shape: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """Every batch, shaped, in a directory of its own, with the batch number as a column."""

    def write(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{folder}/rows/batch={number:09d}")

    run_batches(stream, write, f"{folder}/checkpoint")
    spark = stream.sparkSession
    if not _exists(spark, f"{folder}/rows"):
        return shape(spark.createDataFrame([], stream.schema)).withColumn("batch", F.lit(0))
    return spark.read.parquet(f"{folder}/rows")


# ---------------------------------------------------------------- sessions and progress

def session_state(batch: DataFrame) -> DataFrame:
    """Latest phase and text of each (session, item) of a batch; later sequence numbers win."""
    live = batch.where("phase <> 'end'")
    return live.groupBy("session", "item").agg(F.max(F.struct("seq", "phase", "text")).alias("last"))


def session_view(updates: DataFrame) -> DataFrame:
    """Current state from the table of batches: the largest sequence number wins."""
    best = updates.groupBy("session", "item").agg(F.max("last").alias("last"))
    return best.select("session", "item", "last.seq", "last.phase", "last.text")


def end_sessions(view: DataFrame, ended: DataFrame) -> DataFrame:
    """State without the sessions that were closed."""
    return view.join(ended.select("session"), "session", "left_anti")


def progress_counts(batch: DataFrame) -> DataFrame:
    """Processed, succeeded and failed items per session and phase of a batch."""
    return batch.groupBy("session", "phase").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("errors"))


def progress_view(updates: DataFrame) -> DataFrame:
    """Counts per session and phase over all batches."""
    return updates.groupBy("session", "phase").agg(*[F.sum(c).alias(c) for c in ("processed", "success", "errors")])


# ---------------------------------------------------------------- activity log

REPEAT_KEYS = ["request", "_user", "method", "path"]


def activity_rows(batch: DataFrame) -> DataFrame:
    """Log rows of a batch with action name and cut fields; repeats of (request, user, method, path) dropped."""
    rows = batch.withColumn("action", tx.action_for(F.col("method"), F.col("path")))
    email = F.nullif(F.col("user_email"), F.lit(""))
    rows = tx.truncate_fields(rows.withColumn("user_email", email))
    rows = rows.withColumn("user_id", F.when(F.col("user_id") > 0, F.col("user_id"))).withColumn("_user", F.coalesce("user_id", F.lit(0)))
    return _first_of_each(rows, ["ts"])


def activity_view(rows: DataFrame) -> DataFrame:
    """The log over all batches: of repeats the row of the earliest time stays."""
    return _first_of_each(rows, ["ts", "batch"]).drop("_user", "batch")


def _first_of_each(rows: DataFrame, order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in REPEAT_KEYS]
    first = rows.groupBy(*REPEAT_KEYS).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*[F.col(c) if c in REPEAT_KEYS else F.col(f"_first.{c}").alias(c) for c in rows.columns])


# ---------------------------------------------------------------- ingest

def gate_batch(batch: DataFrame, index: DataFrame | None, threshold: float = 0.95, verify_above: float = 0.9) -> DataFrame:
    """``id, status`` of each new item, judged against the index and against accepted earlier items of the batch; both carry ``id, text, vector``.

    ``batch`` is a table already, which the gate reads several times.
    """
    return se.duplicate_gate(batch, threshold, verify_above, index=index, written=True).select("id", "status")


def ingest_stream(stream: DataFrame, folder: str, load_encoder=HashingEncoder, force: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Run new documents (``doc_id, text, content_type``) through the phases into an index.

    Phases: media filter, description present, encode, duplicate gate, append
    with continued ids. Returns the events and the index.
    """
    spark = stream.sparkSession
    ready = stream.where(F.coalesce(F.col("content_type").startswith("image/"), F.lit(False)))

    def step(batch: DataFrame, number: int) -> None:
        lacking = batch.where(tx.is_blank(F.col("text"))).select(F.col("doc_id"), F.lit("error").alias("status"))
        described = batch.where(~tx.is_blank(F.col("text"))).select("doc_id", "text")
        encoded = encode_column(described, "text", load_encoder).select(F.col("doc_id").alias("id"), "text", F.col("dense").alias("vector"))
        arrived = through_table(encoded, "arrived")
        parts = f"{folder}/index"
        done = spark.read.parquet(parts).where(F.col("batch") < number) if _exists(spark, parts) else None
        old = None if done is None else done.select(F.col("item_id").alias("id"), "text", "vector")
        judged = arrived.select("id", F.lit("new").alias("status")) if force else gate_batch(arrived, old)
        judged = through_table(judged, "judged")
        top = 0 if done is None else last_id(done, "item_id").first()[0]
        # Ids are numbered alone; texts and vectors meet their numbers once.
        numbers = number_rows(judged.where("status = 'new'").select("id"), ["id"], "item_id", top)
        added = arrived.join(numbers, "id").select(F.col("id").alias("doc_id"), "text", "vector", "item_id")
        added.write.mode("overwrite").parquet(f"{parts}/batch={number}")
        events = judged.select(F.col("id").alias("doc_id"), F.when(F.col("status") == "new", "indexed").otherwise("duplicate").alias("status"))
        events.unionByName(lacking).write.mode("overwrite").parquet(f"{folder}/events/batch={number}")

    run_batches(ready, step, f"{folder}/checkpoint")
    if not _exists(spark, f"{folder}/events"):
        return spark.createDataFrame([], "doc_id long, status string, batch int"), None
    return spark.read.parquet(f"{folder}/events"), spark.read.parquet(f"{folder}/index")
