"""Fused rankings from the first items of each branch and counted ranks, against whole branches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgrid.operators import fused, scan
from labelgrid.operators import ranking as rk

SPAN = 1000


@pytest.fixture(scope="module")
def sides(spark):
    """Few different values, so scores tie; items of 1 to 4 segments in consecutive rows; some share no term with a query."""
    rng = np.random.default_rng(12)

    def row(i):
        terms = sorted(set(rng.integers(0, 12, rng.integers(0, 4)).tolist()))
        return (i, [float(x) for x in rng.integers(-2, 3, 5)], terms, [float(x) for x in rng.integers(1, 3, len(terms))])

    index = [row(item * SPAN + s) for item in rng.permutation(600).tolist() for s in range(1 + item % 4)]
    queries = [row(q) for q in range(7)]
    columns = "long, dense array<double>, sparse_idx array<int>, sparse_w array<double>"
    q = spark.createDataFrame(queries, f"query_id {columns}")
    # Few rows a partition: items reach over the ends of tasks.
    d = spark.createDataFrame(spark.sparkContext.parallelize(index, 23), f"segment_id {columns}")
    return q, d


def branches(q, d, depth):
    cut = lambda df, key, name: (df.select(F.col(key).alias(name), F.col("dense").alias("vector")), df.select(F.col(key).alias(name), F.col("sparse_idx").alias("idx"), F.col("sparse_w").alias("w")))
    (qv, qt), (dv, dt) = cut(q, "query_id", "query_id"), cut(d, "segment_id", "id")
    item = F.expr(f"id div {SPAN}").alias("item_id")
    return scan.dense_search(qv, dv, depth, span=SPAN).select("query_id", item, "rank"), scan.sparse_search(qt, dt, depth, span=SPAN).select("query_id", item, "rank")


def listed(frame):
    return sorted((r["query_id"], r["rank"], r["item_id"], round(r["score"], 12)) for r in frame.collect())


@pytest.mark.parametrize("n, k", [(1, 1), (5, 3), (10, 60), (400, 60)])
def test_fused_items(spark, sides, monkeypatch, n, k):
    monkeypatch.setattr(fused, "BLOCK_QUERIES", 3)
    q, d = sides
    whole = dict(zip(("dense", "sparse"), branches(q, d, 10**6)))
    first = branches(q, d, fused.reach_of(n, k))
    assert listed(fused.fused_items(q, d, *first, SPAN, n, k)) == listed(rk.rrf(whole, k, n))


def test_ranks_of_every_item(spark, sides):
    """Counting alone gives the ranks of whole branches."""
    q, d = sides
    dense, sparse = branches(q, d, 10**6)
    every = q.select("query_id").crossJoin(d.select(F.expr(f"segment_id div {SPAN}").alias("item_id")).distinct()).where("(query_id + item_id) % 3 = 0")
    side = d.select(F.col("segment_id").alias("id"), F.col("dense").alias("vector"))
    found = fused.branch_ranks(q.select("query_id", F.col("dense").alias("vector")), side, every, scan.dense_scorer, SPAN)
    expected = dense.join(every, ["query_id", "item_id"], "left_semi")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.select("query_id", "item_id", "rank").collect()))


def test_scattered_segments_are_refused(spark, sides):
    q, d = sides
    scattered = d.orderBy(F.xxhash64("segment_id")).repartition(3)
    first = branches(q, d, 4)
    with pytest.raises(ValueError, match="consecutive"):
        fused.fused_items(q, scattered, *first, SPAN, 1, 2).collect()


def test_a_task_may_read_pieces_of_several_files(spark, sides, tmp_path):
    """An item that begins in the piece of one task and goes on in the middle of another task counts once."""
    import os

    long = lambda df: df.withColumn("dense", F.transform(F.flatten(F.array_repeat("dense", 8)), lambda x: x + F.round(F.rand(3), 9)))
    q, d = long(sides[0]), long(sides[1])
    q.write.parquet(str(tmp_path / "queries"))
    q, path = spark.read.schema(q.schema).parquet(str(tmp_path / "queries")), str(tmp_path / "index")
    d.coalesce(4).write.option("parquet.block.size", 1024).option("parquet.block.size.row.check.min", 50).option("parquet.page.size.row.check.min", 50).parquet(path)
    size = max(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))
    names = {"spark.sql.files.maxPartitionBytes": str(int(size * 0.7)), "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        stored = spark.read.schema(d.schema).parquet(path)
        pieces = stored.select(F.spark_partition_id().alias("task"), F.concat(F.input_file_name(), F.input_file_block_start()).alias("piece")).distinct().groupBy("task").count()
        assert pieces.agg(F.max("count")).first()[0] > 1
        first = branches(q, stored, fused.reach_of(5, 3))
        whole = dict(zip(("dense", "sparse"), branches(q, stored, 10**6)))
        assert listed(fused.fused_items(q, stored, *first, SPAN, 5, 3)) == listed(rk.rrf(whole, 3, 5))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
