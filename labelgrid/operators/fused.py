"""The first fused items of two branches without deep lists, by a threshold and exact rank counting.

With reciprocal ranks an item outside the first ``k + 2 n`` of both branches scores at most ``2 / (2 k + 2 n + 1)``, less than the ``1 / (k + n)`` that each of the first ``n`` items of a
branch has. So only items among these firsts of one branch can be among the first ``n`` fused ones. Where such a candidate is not
among the firsts of the other branch, its rank there is counted: one pass over the index tells, for each candidate, how many items precede it.

Items are counted, not segments. A task counts what lies whole in it; the first and the last item of each piece of a file that it reads may go on in others and are
merged first (a task may read pieces of several files). For this the segments of an item must be consecutive rows, as ``segment_index`` writes them; a count of all items proves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelgrid.operators import ranking as rk
from labelgrid.operators.scan import HITS, TERM_CELLS, dense_scorer, sparse_scorer, terms_of
from labelgrid.session import through_table

BLOCK_QUERIES = 1000  # queries of a block: its candidates and its counts are at most this times the reach
TALLY = "query_id long, slot long, n long, item_id long, score double"


def reach_of(n: int, k: int) -> int:
    """Items of each branch among which all of the first ``n`` fused ones are."""
    return k + 2 * n


class Marks:
    """The candidates of each query whose ranks are wanted: scores from the best down, ties by item."""

    def __init__(self, query_ids: np.ndarray, own: pd.DataFrame):
        own = own.sort_values(["query_id", "slot"])
        query = own["query_id"].to_numpy(np.int64)
        self.at = np.concatenate([np.searchsorted(query, query_ids, "left"), [len(query)]]) if len(query) else np.zeros(len(query_ids) + 1, np.int64)
        self.end = np.searchsorted(query, query_ids, "right")
        self.score, self.item = -own["score"].to_numpy(np.float64), own["item_id"].to_numpy(np.int64)

    def place(self, q: int, items: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """For items of one query the number of the first mark that each precedes; marked items and those behind all marks have none."""
        cut = slice(self.at[q], self.end[q])
        marks, names = self.score[cut], self.item[cut]
        if not len(marks):
            return np.zeros(0, np.int64)
        left, right = np.searchsorted(marks, -scores, "left"), np.searchsorted(marks, -scores, "right")
        for i in np.flatnonzero(left < right):
            left[i] += np.searchsorted(names[left[i] : right[i]], items[i], "left")
        known = np.sort(names)
        near = np.minimum(np.searchsorted(known, items), len(known) - 1)
        return left[(known[near] != items) & (scores > -np.inf) & (left < len(marks))]


def _tallied(query_ids: np.ndarray, marks: Marks, counts: np.ndarray) -> pd.DataFrame:
    """Rows of the counts, which lie mark by mark in the order of ``marks``."""
    some = np.flatnonzero(counts)
    q = np.searchsorted(marks.end, some, "right")
    return pd.DataFrame({"query_id": query_ids[q], "slot": some - marks.at[q] + 1, "n": counts[some], "item_id": pd.array([pd.NA] * len(some), "Int64"), "score": np.nan})


def branch_ranks(queries: DataFrame, index: DataFrame, wanted: DataFrame, build: Callable, span: int, digits: int = rk.SCORE_DIGITS) -> DataFrame:
    """query_id, item_id, rank of the ``wanted`` pairs that are hits of a branch.

    ``build`` makes a scorer of a block of queries, ``index`` has ``id`` and what that scorer reads.
    """
    spark, found = index.sparkSession, None
    item = F.call_function("div", F.col("id") - F.pmod("id", F.lit(span)), F.lit(span))
    every = index.select(item.alias("item_id")).distinct().count()
    parts = max(1, -(-queries.count() // BLOCK_QUERIES))
    for part in range(parts):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toPandas()
        for some in _bounded(block):
            ranks = _block_ranks(spark, some, index, wanted, build, span, digits, item, every)
            found = ranks if found is None else found.unionByName(ranks)
    return found if found is not None else spark.createDataFrame([], "query_id long, item_id long, rank long")


def _bounded(block: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A block, halved until its matrix of terms is within the bound."""
    if len(block) > 1 and "idx" in block and len(block) * len(terms_of(block)) > TERM_CELLS:
        half = len(block) // 2
        yield from _bounded(block.iloc[:half])
        yield from _bounded(block.iloc[half:])
    elif len(block):
        yield block


def by_piece(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, pd.DataFrame]]:
    """Frames cut where the next piece of a file begins."""
    for frame in frames:
        piece = frame["piece"].to_numpy()
        starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))[: len(piece)]
        for first, last in zip(starts, np.append(starts[1:], len(piece))):
            yield piece[first], frame.iloc[first:last].reset_index(drop=True)


def _block_ranks(spark, block, index, wanted, build, span, digits, item, every) -> DataFrame:
    query_ids, scorer = build(spark, block)
    low, high = int(query_ids.min()), int(query_ids.max())
    mine = wanted.where(F.col("query_id").between(low, high)).toPandas()  # at most the reach for each query
    mine = mine[mine["query_id"].isin(query_ids)].sort_values("item_id")
    pairs = spark.sparkContext.broadcast((mine["item_id"].to_numpy(np.int64), np.searchsorted(query_ids, mine["query_id"].to_numpy(np.int64))))

    def score(frames):
        names, asking = pairs.value
        for frame in frames:
            for scores, ids, allowed in scorer(frame):
                scores = np.round(scores, digits) + 0.0
                first, last = np.searchsorted(names, ids // span, "left"), np.searchsorted(names, ids // span, "right")
                row = np.repeat(np.arange(len(ids)), last - first)
                q = asking[np.arange(len(row)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)]
                yes = np.ones(len(row), bool) if allowed is None else allowed[q, row]
                yield pd.DataFrame({"query_id": query_ids[q[yes]], "id": ids[row[yes]], "score": scores[q[yes], row[yes]]})

    asked = wanted.select(F.col("item_id").alias("asked")).distinct()
    own = index.join(asked, item == F.col("asked"), "left_semi").mapInPandas(score, HITS).groupBy("query_id", item.alias("item_id")).agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    own = through_table(own.withColumn("slot", F.row_number().over(order).cast("long")), "marked-items")
    marks = spark.sparkContext.broadcast(Marks(query_ids, own.toPandas()))

    def tally(frames):
        held = marks.value
        counts, whole = np.zeros(int(held.end[-1]), np.int64), 0
        open_item, open_best, edges, edged = None, None, [], False

        def close(names, best):
            nonlocal whole, edged
            if len(names) and not edged:
                edges.append((int(names[0]), best[:, 0]))
                names, best, edged = names[1:], best[:, 1:], True
            whole += len(names)
            for q in range(len(query_ids)):
                place = held.place(q, names, best[q])
                counts[held.at[q] : held.end[q]] += np.bincount(place, minlength=held.end[q] - held.at[q])

        def end():
            nonlocal open_item, edged
            if open_item is not None:
                edges.append((open_item, open_best))
            open_item, edged = None, False

        now = None
        for piece, frame in by_piece(frames):
            if piece != now:
                end()
                now = piece
            for scores, ids, allowed in scorer(frame):
                if not len(ids):
                    continue
                scores = np.round(scores, digits) + 0.0
                scores = scores if allowed is None else np.where(allowed, scores, -np.inf)
                names = ids // span
                starts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
                names, best = names[starts], np.maximum.reduceat(scores, starts, axis=1)
                if open_item is not None:
                    if names[0] == open_item:
                        best[:, 0] = np.maximum(best[:, 0], open_best)
                    else:
                        close(np.array([open_item]), open_best[:, None])
                close(names[:-1], best[:, :-1])
                open_item, open_best = int(names[-1]), best[:, -1]
        end()
        yield _tallied(query_ids, held, counts)
        for name, best in edges:
            yield pd.DataFrame({"query_id": query_ids, "slot": -1, "n": 0, "item_id": name, "score": best})
        yield pd.DataFrame({"query_id": [-1], "slot": [-2], "n": [whole], "item_id": pd.array([pd.NA], "Int64"), "score": [np.nan]})

    piece = F.concat_ws(":", F.input_file_name(), F.input_file_block_start()).alias("piece")
    seen = through_table(index.select("*", piece).mapInPandas(tally, TALLY), "rank-counts")
    edges = seen.where("slot = -1").groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    whole = seen.where("slot = -2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + seen.where("slot = -1").select("item_id").distinct().count()
    if whole != every:
        raise ValueError(f"the index does not hold the segments of an item in consecutive rows: {every} items, {whole} runs")

    def merge(frames):
        held = marks.value
        counts = np.zeros(int(held.end[-1]), np.int64)
        for frame in frames:
            for query, rows in frame.groupby("query_id"):
                q = int(np.searchsorted(query_ids, query))
                place = held.place(q, rows["item_id"].to_numpy(np.int64), rows["score"].to_numpy(np.float64))
                counts[held.at[q] : held.end[q]] += np.bincount(place, minlength=held.end[q] - held.at[q])
        yield _tallied(query_ids, held, counts)

    counts = seen.where("slot > 0").select("query_id", "slot", "n").unionByName(edges.mapInPandas(merge, TALLY).select("query_id", "slot", "n"))
    counts = counts.groupBy("query_id", "slot").agg(F.sum("n").alias("n"))
    # What precedes a mark: counted items, and marked ones before it.
    before = Window.partitionBy("query_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    ranked = own.join(counts, ["query_id", "slot"], "left").withColumn("rank", F.sum(F.coalesce("n", F.lit(0))).over(before) + F.col("slot"))
    return ranked.select("query_id", "item_id", "rank")


def fused_items(queries: DataFrame, index: DataFrame, dense: DataFrame, sparse: DataFrame, span: int, n: int = 50, k: int = 60) -> DataFrame:
    """The first ``n`` items of both branches fused, as a fusion of the whole branches gives them.

    ``queries`` and ``index`` (query_id or segment_id, dense, sparse_idx, sparse_w) are encoded; ``dense`` and ``sparse`` are the first ``reach_of(n, k)`` items of each branch, or all.
    """
    sides = {
        "dense": (dense, dense_scorer, lambda df, key, name: df.select(F.col(key).alias(name), F.col("dense").alias("vector"))),
        "sparse": (sparse, sparse_scorer, lambda df, key, name: df.select(F.col(key).alias(name), F.col("sparse_idx").alias("idx"), F.col("sparse_w").alias("w"))),
    }
    pairs = dense.select("query_id", "item_id").unionByName(sparse.select("query_id", "item_id")).distinct()
    branches = {}
    for name, (first, build, cut) in sides.items():
        wanted = through_table(pairs.join(first.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti"), "wanted-ranks")
        ranks = first.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"))
        if not wanted.isEmpty():
            ranks = ranks.unionByName(branch_ranks(cut(queries, "query_id", "query_id"), cut(index, "segment_id", "id"), wanted, build, span))
        branches[name] = ranks
    return rk.rrf(branches, k, n)
