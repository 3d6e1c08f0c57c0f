"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.session import through_table


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of ``links`` (a, b); the root is the least node that it reaches.

    Each round takes minima by node, which combine before the shuffle, and joins them back; no node's neighbours are
    gathered. Rounds are written to the shared folder and grow with the logarithm of the longest chain. A link of a node with itself,
    a repeated or a null one changes nothing; nodes without links are not in the result.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct()
    edges, before = through_table(edges, "links"), None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        small = small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        edges = through_table(small, "links")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()
