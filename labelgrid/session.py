"""Session settings, the shared work folder and size probes."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# A side with at most this many rows may be shipped to every task. The probe
# below reads one row more than the bound, so the driver never holds more.
SHIP_ROWS = 8192
BATCH_BYTES = 8 << 20  # most bytes of the rows that a Python worker gets at once, whatever the length of the texts
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("labelgrid")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
    )
    if shuffle_partitions:
        # One partition per core as asked: ranked hits are few bytes but much work, so AQE shall not merge them.
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder every executor can reach.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only
    where that is unset (tests, a laptop) a temporary one is made and recorded.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="labelgrid-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/labelgrid/{purpose}-{uuid.uuid4().hex}"


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is planned and run inside go as it ends, not when the driver next collects garbage; for what runs only once."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)


def through_table(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives executor loss."""
    path = shared_folder(df.sparkSession, purpose)
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.work_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete results of ``through_table`` that nothing reads any more, not even what was made of them and has not run."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.work_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def frame_if_small(df: DataFrame, bound: int):
    """As ``rows_if_small``, fetched as Arrow batches into a pandas frame."""
    frame = df.limit(bound + 1).toPandas()
    return frame if len(frame) <= bound else None


def rows_if_small(df: DataFrame, bound: int = SHIP_ROWS) -> list | None:
    """All rows when there are at most ``bound`` of them, otherwise ``None``."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work on a scan all cores when the files alone would not.

    A large table has more splits than cores and passes unchanged, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


ROWS_OF_A_TASK = 500_000


def parts_for(scan: DataFrame) -> int | None:
    """Partitions of half a million rows for the rows of a file scan; none where the session's tasks hold no more than that.

    Left to itself a shuffle is merged to about one partition a core, so that what a task holds grows with the input.
    """
    parts = -(-scan.count() // ROWS_OF_A_TASK)
    return parts if parts > scan.sparkSession.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt by keys that few rows share to as many partitions; grouping by the keys needs no other shuffle."""
    return df if parts is None else df.repartition(parts, *keys)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows sent to a Python worker at once in bytes, where the session has the default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "67108864b"):
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system, so that a worker does not keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in every Python worker of the session."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="labelgrid-code-"), "labelgrid"), "zip", os.path.dirname(here), os.path.basename(here)
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
