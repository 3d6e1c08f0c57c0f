"""Exact top-k and threshold search of many queries over many vectors.

Few queries (a probe proves the size of the block): the query block goes to every
task, each task streams its part of the index through a matrix product and
keeps a running top-k, so the index is read once, never shuffled, and at most
k rows per query leave a task. When the index has many partitions, thresholds
from a first pass over one percent of it (a true lower bound of the final
k-th score) keep the tasks from emitting k rows each.

Many queries: both sides are cut into packs, one row with the ids and vectors of a
few thousand rows of one cell. Index rows are grouped by nearest pivot, found in two
levels, so that cells stay small on a large index; a cell is skipped for a pack of
queries when even its best possible score (from the cell radius) cannot pass for any
of them, or when only earlier rows count and it has none. Packs of both sides meet in
a Cartesian product, so vectors are shuffled once and no pair of rows is written out
before it passed the test. Within packs, rows lie in blocks of neighbours along a few axes;
rows too far from a block of queries on these axes alone are passed over, which is exact for any axes. Scores are made in single precision; those within its error
of the floor or above are made again in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelgrid.operators.ranking import SCORE_DIGITS, topk
from labelgrid.session import frame_if_small, through_table

BLOCK_CELLS = 4_000_000  # scores held at once by a task
TERM_CELLS = 16_000_000  # entries of a shipped query-by-term matrix
SHIP_ROWS = 65_536  # most queries of a shipped block of terms
DENSE_ROWS = 8_192  # most queries of a shipped block of vectors
SHIP_CELLS = 16_000_000  # bound on queries times (vector length plus k)
INDEX_TILE, QUERY_TILE = 4_096, 2_048  # most rows of a pack, of few rows
TILE, TILE_BYTES = 16_384, 8 << 20  # most rows of a pack of many, and bytes of its vectors in single precision
AXES, AXES_ROWS = 16, 4_096  # axes along which blocks are bounded, and the least sample they are taken from
QUERY_BLOCK, INDEX_BLOCK, INDEX_CUT = 256, 128, 2_048  # rows of a block of either side; rows of the index that a block of queries meets at once
GAP_SLACK = 1e-8
PACK_BYTES = 64 << 20  # packs of the index that a task holds
PRODUCT_TASKS = 4  # parts of the queries for each core
EXACT_ROWS = 100_000  # pairs scored at once in double precision
CELL_ROWS = 4_000
PIVOT_CELLS = 16_000_000  # bound on pivots times vector length
SEED_PARTITIONS = 64
SEED_SHARE = 100
SEED_ROWS = 10_000  # least sample of the index from which floors are taken
BOUND_SLACK = 1e-6
ANGLE_SLACK = 1e-6
ROUNDING_SLACK = 2 * 10.0**-SCORE_DIGITS
SINGLE_EPS = 2.0**-24


@dataclass
class Limits:
    """What a hit must satisfy."""

    k: int | None = None
    min_score: float | None = None
    skip_self: bool = False
    earlier_only: bool = False
    digits: int = SCORE_DIGITS
    span: int | None = None  # ids of one item share ``id // span``; then k counts items, each with its best row
    links: bool = False  # instead of hits, a forest over them and how many each query has


class TopBuffer:
    """Running best hits of every query of a block; without a k all passing hits, to be taken out block by block."""

    def __init__(self, query_ids: np.ndarray, limits: Limits, floors: np.ndarray | None):
        self.query_ids, self.limits, self.floors = query_ids, limits, floors
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """``scores``: one row per query, one column per index row."""
        scores = np.round(scores, self.limits.digits) + 0.0
        keep = np.ones(scores.shape, dtype=bool) if allowed is None else allowed
        if self.limits.min_score is not None:
            keep &= scores >= self.limits.min_score
        if self.floors is not None:
            keep &= scores >= self.floors[:, None]
        if self.limits.skip_self:
            keep &= ids[None, :] != self.query_ids[:, None]
        if self.limits.earlier_only:
            keep &= ids[None, :] < self.query_ids[:, None]
        k = self.limits.k
        ids = np.broadcast_to(ids[None, :], scores.shape)
        if self.limits.span is not None and scores.shape[1]:
            scores, ids = self.best_rows(np.where(keep, scores, -np.inf), ids[0])
            keep = scores > -np.inf
        if k is not None and k < scores.shape[1]:
            masked = np.where(keep, scores, -np.inf)
            kth = -np.partition(-masked, k - 1, axis=1)[:, k - 1]
            keep &= scores >= kth[:, None]
        q, d = np.nonzero(keep)
        self.parts.append((q, ids[q, d], scores[q, d]))
        self.held += len(q)
        if k is not None and self.held > 4 * k * max(1, len(self.query_ids)) + 100_000:
            self.shrink()

    def best_rows(self, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score of each item and query, and the least id that has it."""
        order = np.argsort(ids, kind="stable")
        scores, ids = scores[:, order], ids[order]
        item = ids // self.limits.span
        starts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        best = np.maximum.reduceat(scores, starts, axis=1)
        level = np.repeat(best, np.diff(np.append(starts, len(ids))), axis=1)
        return best, np.minimum.reduceat(np.where(scores == level, ids[None, :], np.iinfo(np.int64).max), starts, axis=1)

    def shrink(self) -> None:
        if not self.parts:
            return
        q, ids, scores = (np.concatenate(p) for p in zip(*self.parts))
        if self.limits.span is not None:
            item = ids // self.limits.span
            order = np.lexsort((ids, -scores, item, q))
            q, ids, scores, item = q[order], ids[order], scores[order], item[order]
            first = np.append(True, (q[1:] != q[:-1]) | (item[1:] != item[:-1]))[: len(q)]
            q, ids, scores = q[first], ids[first], scores[first]
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        if self.limits.k is not None:
            starts = np.searchsorted(q, q, side="left")
            best = np.arange(len(q)) - starts < self.limits.k
            q, ids, scores = q[best], ids[best], scores[best]
        self.parts, self.held = [(q, ids, scores)], len(q)

    def frames(self) -> Iterator[pd.DataFrame]:
        self.shrink()
        for q, ids, scores in self.parts:
            for at in range(0, len(q), 100_000):
                cut = slice(at, at + 100_000)
                yield pd.DataFrame({"query_id": self.query_ids[q[cut]], "id": ids[cut], "score": scores[cut]})


class LinkBuffer:
    """Hits of a block as a forest: of any number of pairs no more links stay than there are rows, and the number of hits of each query."""

    def __init__(self, query_ids: np.ndarray, limits: Limits):
        self.query_ids, self.limits = query_ids, limits
        self.counts = np.zeros(len(query_ids), np.int64)
        self.pairs: list[np.ndarray] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None) -> None:
        keep = np.round(scores, self.limits.digits) >= self.limits.min_score
        if allowed is not None:
            keep &= allowed
        self.take(keep, ids)

    def take(self, keep: np.ndarray, ids: np.ndarray) -> None:
        """``keep``: one row per query, one column per index row, true where the score passes."""
        if self.limits.earlier_only:
            keep &= ids[None, :] < self.query_ids[:, None]
        q, d = np.divmod(np.flatnonzero(keep), keep.shape[1])
        self.counts += np.bincount(q, minlength=len(self.query_ids))
        self.pairs.append(np.stack([self.query_ids[q], ids[d]], 1))
        self.held += len(q)
        if self.held > 1_000_000:
            self.shrink()

    def shrink(self) -> None:
        pairs = np.concatenate(self.pairs) if self.pairs else np.zeros((0, 2), np.int64)
        nodes, place = np.unique(pairs, return_inverse=True)
        place, label = place.reshape(-1, 2), np.arange(len(nodes))
        a, b = place[:, 0], place[:, 1]
        while True:
            x, y = label[a], label[b]
            far = x != y
            if not far.any():
                break
            a, b, x, y = a[far], b[far], x[far], y[far]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
        joined = np.flatnonzero(label != np.arange(len(nodes)))
        self.pairs = [np.stack([nodes[joined], nodes[label[joined]]], 1)]
        self.held = len(joined)

    def put(self, q: np.ndarray, ids: np.ndarray) -> None:
        """Pairs of a query's place in the block and a hit."""
        if not len(q):
            return
        self.counts += np.bincount(q, minlength=len(self.query_ids))
        self.pairs.append(np.stack([self.query_ids[q], ids], 1))
        self.held += len(q)
        if self.held > 1_000_000:
            self.shrink()

    def frames(self) -> Iterator[pd.DataFrame]:
        self.shrink()
        some = np.flatnonzero(self.counts)
        own = self.query_ids[some]
        for a, b, n in ((self.pairs[0][:, 0], self.pairs[0][:, 1], np.full(len(self.pairs[0]), -1.0)), (own, own, self.counts[some].astype(np.float64))):
            for at in range(0, len(a), 100_000):
                cut = slice(at, at + 100_000)
                yield pd.DataFrame({"query_id": a[cut], "id": b[cut], "score": n[cut]})
        self.pairs, self.held, self.counts = [], 0, np.zeros(len(self.query_ids), np.int64)


HITS = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())
])
ARROW_HITS = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def _stream(index: DataFrame, query_ids: np.ndarray, limits: Limits, scorer: Callable, floors=None) -> DataFrame:
    """One pass over the index; ``scorer(frame)`` yields (scores, ids, allowed) blocks."""

    def run(frames):
        buffer = LinkBuffer(query_ids, limits) if limits.links else TopBuffer(query_ids, limits, floors)
        for frame in frames:
            for scores, ids, allowed in scorer(frame):
                buffer.add(scores, ids, allowed)
                if limits.k is None and not limits.links:
                    yield from buffer.frames()
                    buffer.parts, buffer.held = [], 0
        yield from buffer.frames()

    return index.mapInPandas(run, HITS)


def _seed_floors(index: DataFrame, query_ids: np.ndarray, limits: Limits, scorer: Callable) -> np.ndarray | None:
    """Lower bound of each query's k-th score from one percent of a large index.

    The bound only spares output: every row at or above it is still kept.
    """
    if limits.k is None or limits.earlier_only or index.rdd.getNumPartitions() <= SEED_PARTITIONS:
        return None
    part = index.where(F.pmod(F.xxhash64("id"), F.lit(SEED_SHARE)) == 0)
    kth = _finish(_stream(part, query_ids, limits, scorer), limits).where(F.col("rank") == limits.k)
    found = {r["query_id"]: r["score"] for r in kth.select("query_id", "score").collect()}
    return np.array([found.get(q, -np.inf) for q in query_ids.tolist()])


def _finish(hits: DataFrame, limits: Limits) -> DataFrame:
    if limits.span is not None:
        # The rows of an item may lie in several tasks.
        item = F.call_function("div", F.col("id") - F.pmod("id", F.lit(limits.span)), F.lit(limits.span))
        best = hits.groupBy("query_id", item.alias("item")).agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
        hits = best.select("query_id", F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))
    if limits.k is not None:
        return topk(hits, limits.k, ["query_id"])
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(window))


def _unit(rows) -> np.ndarray:
    whole = isinstance(rows, np.ndarray) and rows.ndim == 2
    matrix = rows.astype(np.float64) if whole else np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    length = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return np.divide(matrix, length, out=matrix.copy(), where=length > 0)


# ---------------------------------------------------------------- dense vectors

def dense_search(queries: DataFrame, index: DataFrame, k: int | None = None, min_score: float | None = None,
                 skip_self: bool = False, earlier_only: bool = False, ship_rows: int | None = None, span: int | None = None) -> DataFrame:
    """Cosine hits ``(query_id, id, score, rank)``; with ``span`` the best row of each item, and ``k`` counts items.

    ``queries``: ``query_id, vector``; ``index``: ``id, vector``; ids are whole numbers.
    """
    if k is None and min_score is None:
        raise ValueError("give k or min_score, otherwise every pair would be a hit")
    limits = Limits(k, min_score, skip_self, earlier_only, span=span)
    return _finish(_dense_hits(queries, index, limits, ship_rows), limits)


def dense_links(rows: DataFrame, min_score: float, ship_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) whose components are those of all pairs of ``rows`` (id, vector) of at least that score, and how many earlier partners each id has (id, n).

    A group of n near copies puts out about n links a task, not its pairs.
    """
    limits = Limits(None, min_score, earlier_only=True, links=True)
    rows = rows.select("id", "vector")
    found = through_table(_dense_hits(rows.withColumnRenamed("id", "query_id"), rows, limits, ship_rows), "vector-links")
    links = found.where("score < 0").select(F.col("query_id").alias("a"), F.col("id").alias("b"))
    return links, found.where("score > 0").groupBy("id").agg(F.sum("score").cast("long").alias("n"))


def _dense_hits(queries: DataFrame, index: DataFrame, limits: Limits, ship_rows: int | None) -> DataFrame:
    k = limits.k
    queries, index = queries.select("query_id", "vector"), index.select("id", "vector")
    block = frame_if_small(queries, DENSE_ROWS if ship_rows is None else ship_rows)
    if block is not None and len(block) * (len(block["vector"].iloc[0]) + (k or 1) if len(block) else 1) > SHIP_CELLS:
        block = None
    if block is None:
        return _dense_tiles(queries, index, limits)
    if not len(block):
        return index.sparkSession.createDataFrame([], HITS)
    query_ids, scorer = dense_scorer(index.sparkSession, block)
    floors = _seed_floors(index, query_ids, limits, scorer)
    matrix = index.sparkSession.sparkContext.broadcast(_unit(block.sort_values("query_id")["vector"]))
    least = np.full(len(query_ids), -1.0 if limits.min_score is None else limits.min_score)
    floors = least if floors is None else np.maximum(floors, least)

    def run(frames):
        search = PackSearch(query_ids, matrix.value, floors.copy(), limits)
        for frame in frames:
            if len(frame):
                yield from search.meet(frame["id"].to_numpy(np.int64), _unit(frame["vector"]))
        yield from search.flush()

    return index.mapInPandas(run, HITS)


def dense_scorer(spark, block: pd.DataFrame) -> tuple[np.ndarray, Callable]:
    """Query ids of a block in ascending order, and what yields (scores, ids, None) of all of them for the rows of a frame (id, vector)."""
    block = block.sort_values("query_id")
    query_ids = block["query_id"].to_numpy(np.int64)
    matrix = spark.sparkContext.broadcast(_unit(block["vector"]))
    step = max(1, BLOCK_CELLS // len(query_ids))

    def scorer(frame):
        ids = frame["id"].to_numpy(np.int64)
        for at in range(0, len(frame), step):
            part = _unit(frame["vector"].iloc[at : at + step])
            yield matrix.value @ part.T, ids[at : at + step], None

    return query_ids, scorer


class Cells:
    """Pivots in two levels: a row goes to its nearest top pivot, then to the nearest pivot under that, so either step looks at about the root of their number."""

    def __init__(self, pivots: np.ndarray, pivot_ids: np.ndarray, axes: np.ndarray | None = None, index_tile: int = INDEX_TILE, query_tile: int = QUERY_TILE):
        self.axes, self.index_tile, self.query_tile = axes, index_tile, query_tile
        n_tops = max(1, math.isqrt(len(pivots)))
        top = (pivots @ pivots[:n_tops].T).argmax(axis=1)
        order = np.argsort(top, kind="stable")
        self.tops, self.top_ids = pivots[:n_tops], pivot_ids[:n_tops]
        self.pivots, self.ids, self.top = pivots[order], pivot_ids[order], top[order]
        self.start = np.searchsorted(self.top, np.arange(n_tops + 1))
        # Known once the rows are dealt: how far a cell reaches, its smallest id, and among how many tiles its rows are split.
        self.radius, self.top_radius = np.full(len(pivots), -np.inf), np.full(n_tops, -np.inf)
        self.least, self.slices = np.full(len(pivots), np.iinfo(np.int64).max), np.zeros(len(pivots), np.int64)

    def __len__(self) -> int:
        return len(self.pivots)

    def under(self, top: int) -> slice:
        return slice(self.start[top], self.start[top + 1])

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each row, and its cosine to the cell's pivot and to the top pivot."""
        far = rows @ self.tops.T
        top = far.argmax(axis=1)
        cell, near = np.zeros(len(rows), np.int32), np.zeros(len(rows))
        for t in np.unique(top).tolist():
            at = np.flatnonzero(top == t)
            own = rows[at] @ self.pivots[self.under(t)].T
            best = own.argmax(axis=1)
            cell[at], near[at] = best + self.start[t], own[np.arange(len(at)), best]
        return cell, near, far[np.arange(len(rows)), top]

    def learn(self, shape: list) -> None:
        for r in shape:
            c = r["cell"]
            self.radius[c] = math.acos(min(1.0, max(-1.0, r["edge"]))) + ANGLE_SLACK
            self.top_radius[self.top[c]] = max(self.top_radius[self.top[c]], math.acos(min(1.0, max(-1.0, r["far"]))) + ANGLE_SLACK)
            self.least[c], self.slices[c] = r["least"], math.ceil(r["n"] / self.index_tile)

    def visits(self, rows: np.ndarray, query_ids: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
        """Which query has to visit which cell; all others cannot hold a hit."""
        near = np.clip(rows @ self.tops.T, -1.0, 1.0)
        floors = self.floors(rows, near, limits)
        # Scores are compared after rounding, so a hit may lie a little below its floor.
        reach = np.arccos(np.clip(floors - ROUNDING_SLACK, -1.0, 1.0)) + ANGLE_SLACK
        open_ = np.arccos(near) - reach[:, None] <= self.top_radius[None, :]
        found = []
        for t in np.flatnonzero(open_.any(axis=0)).tolist():
            q, cut = np.flatnonzero(open_[:, t]), self.under(t)
            own = np.arccos(np.clip(rows[q] @ self.pivots[cut].T, -1.0, 1.0))
            meets = (own - reach[q][:, None] <= self.radius[cut][None, :]) & (self.slices[cut] > 0)[None, :]
            if limits.earlier_only:
                meets &= self.least[cut][None, :] < query_ids[q][:, None]
            x, c = np.nonzero(meets)
            found.append((q[x], c + self.start[t]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([q for q, _ in found]), np.concatenate([c for _, c in found])

    def floors(self, rows: np.ndarray, near: np.ndarray, limits: Limits) -> np.ndarray:
        """What a hit of each query scores at least."""
        floors = np.full(len(rows), -1.0 if limits.min_score is None else limits.min_score)
        # Pivots may be rows of one item, so they bound no k-th item.
        if limits.k is not None and limits.span is None and not limits.earlier_only:
            self._raise_floors(rows, near, floors, limits.k + (1 if limits.skip_self else 0))
        return floors

    def _raise_floors(self, rows: np.ndarray, near: np.ndarray, floors: np.ndarray, k: int) -> None:
        """``k`` pivots already score this much: of the top ones and of those under the nearest."""
        top = near.argmax(axis=1)
        for t in np.unique(top).tolist():
            at, cut = np.flatnonzero(top == t), self.under(t)
            # The top pivots stand once more under themselves.
            rest = self.pivots[cut][~np.isin(self.ids[cut], self.top_ids)]
            known = np.hstack([near[at], rows[at] @ rest.T])
            if known.shape[1] >= k:
                floors[at] = np.maximum(floors[at], -np.partition(-known, k - 1, axis=1)[:, k - 1])


def _dealt(index: DataFrame) -> tuple[DataFrame, Cells] | None:
    """The index with the cell of each row (id, vector, cell, near, far), and what is known of the cells; nothing for an empty index."""
    index = through_table(index, "tiles")
    first = index.first()
    if first is None:
        return None
    n, dims = index.count(), max(1, len(first["vector"]))
    # Fewer and larger packs of a large index, so that the pairs of packs to be handed to Python grow less than those of rows.
    tile = min(TILE, n // (PRODUCT_TASKS * index.sparkSession.sparkContext.defaultParallelism), TILE_BYTES // (4 * dims))
    index_tile = max(INDEX_TILE, tile)
    wanted = min(PIVOT_CELLS // dims, max(16, n // (CELL_ROWS if tile <= INDEX_TILE else tile)))
    picked = index.orderBy(F.xxhash64("id"), "id").limit(max(wanted, min(AXES_ROWS, PIVOT_CELLS // dims))).collect()
    sample, names = _unit(r["vector"] for r in picked), np.array([r["id"] for r in picked], np.int64)
    cells = Cells(sample[:wanted], names[:wanted], main_axes(sample), index_tile, max(QUERY_TILE, tile))
    held = index.sparkSession.sparkContext.broadcast(cells)

    def to_cells(frames):
        for frame in frames:
            if len(frame):
                cell, near, far = held.value.assign(_unit(frame["vector"]))
                yield frame.assign(cell=cell, near=near, far=far)

    kind = index.schema["vector"].dataType.simpleString()
    rows = through_table(index.mapInPandas(to_cells, f"id long, vector {kind}, cell int, near double, far double"), "cells")
    # One row for each pivot.
    cells.learn(rows.groupBy("cell").agg(F.min("near").alias("edge"), F.min("far").alias("far"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).collect())
    return rows, cells


def main_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns along which the rows of a sample reach most."""
    sample = sample[np.isfinite(sample).all(axis=1)]
    return np.ascontiguousarray(np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :AXES])


def along_axes(rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The parts of each row along the axes, and the length of what is left of it: two rows are never nearer to each other than these."""
    parts = rows @ axes
    rest = np.sqrt(np.maximum(0.0, (rows**2).sum(axis=1) - (parts**2).sum(axis=1)))
    return np.hstack([parts, rest[:, None]])


def neighbours_first(places: np.ndarray, size: int) -> np.ndarray:
    """An order of rows in which each block of ``size`` holds neighbours: halves along the widest axis, cut at multiples of the size."""
    done, open_ = [], [np.arange(len(places))]
    while open_:
        at = open_.pop()
        if len(at) <= size:
            done.append(at)
            continue
        half = -(-len(at) // size) // 2 * size
        order = np.argpartition(places[at, np.argmax(places[at].var(axis=0))], half)
        open_ += [at[order[half:]], at[order[:half]]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


PACK = "ids binary, vectors binary"


def _as_bytes(rows: pd.DataFrame, name: str, single: bool) -> dict:
    vectors = np.stack([np.asarray(v, dtype=np.float32 if single else np.float64) for v in rows["vector"]])
    return {"ids": rows[name].to_numpy(np.int64).tobytes(), "vectors": vectors.tobytes()}


def _from_bytes(ids: bytes, vectors: bytes, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a pack and their unit vectors."""
    names = np.frombuffer(ids, np.int64)
    return names, _unit(np.frombuffer(vectors, np.float32 if single else np.float64).reshape(len(names), -1))


def _single(df: DataFrame) -> bool:
    return isinstance(df.schema["vector"].dataType.elementType, T.FloatType)


def _in_slices(rows: DataFrame, sizes: list[tuple[int, int]], name: str, tile: int) -> DataFrame:
    """Rows with the slice of their cell, none of more than about ``tile`` rows; ``sizes``: a row for each pivot."""
    slices = [(c, -(-n // tile)) for c, n in sizes]
    slices = rows.sparkSession.createDataFrame(slices, "cell int, slices long")
    return rows.join(F.broadcast(slices), "cell").withColumn("slice", F.pmod(F.xxhash64(name), F.col("slices")).cast("int"))


def _index_packs(rows: DataFrame, cells: Cells) -> DataFrame:
    """cell, least, ids, vectors: a row for each pack of the index; ``least`` is its smallest id."""
    single = _single(rows)

    axes = cells.axes

    def pack(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.iloc[neighbours_first(along_axes(_unit(part["vector"]), axes), INDEX_BLOCK)]
        return pd.DataFrame([{"cell": key[0], "least": part["id"].min(), **_as_bytes(part, "id", single)}])

    sizes = [(c, int(n) * cells.index_tile) for c, n in enumerate(cells.slices.tolist()) if n]
    parts = _in_slices(rows.select("id", "vector", "cell"), sizes, "id", cells.index_tile)
    return through_table(parts.groupBy("cell", "slice").applyInPandas(pack, f"cell int, least long, {PACK}"), "index-packs")


def _query_packs(queries: DataFrame, cells: Cells, limits: Limits) -> DataFrame:
    """last, visits, floors, ids, vectors: a row for each pack of queries; ``last`` is its largest id, ``visits`` are the cells that any of them has to visit."""
    single, kind = _single(queries), queries.schema["vector"].dataType.simpleString()
    held = queries.sparkSession.sparkContext.broadcast(cells)

    def to_cells(frames):
        for frame in frames:
            if len(frame):
                yield frame.assign(cell=held.value.assign(_unit(frame["vector"]))[0])

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.iloc[neighbours_first(along_axes(_unit(part["vector"]), held.value.axes), QUERY_BLOCK)]
        rows, ids = _unit(part["vector"]), part["query_id"].to_numpy(np.int64)
        floors = held.value.floors(rows, np.clip(rows @ held.value.tops.T, -1.0, 1.0), limits)
        visits = np.unique(held.value.visits(rows, ids, limits)[1]).astype(np.int32)
        return pd.DataFrame([{"last": ids.max(), "visits": visits, "floors": floors.tobytes(), **_as_bytes(part, "query_id", single)}])

    rows = through_table(queries.mapInPandas(to_cells, f"query_id long, vector {kind}, cell int"), "query-cells")
    sizes = [(r["cell"], r["count"]) for r in rows.groupBy("cell").count().collect()]  # one row for each pivot
    parts = _in_slices(rows, sizes, "query_id", cells.query_tile)
    return through_table(parts.groupBy("cell", "slice").applyInPandas(pack, f"last long, visits array<int>, floors binary, {PACK}"), "query-packs")


class PackSearch:
    """One pack of queries that meets packs of the index one after the other; with axes both have their rows in blocks of neighbours."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, floors: np.ndarray, limits: Limits, axes: np.ndarray | None = None):
        self.ids, self.rows, self.limits, self.floors = ids, rows, limits, floors
        self.axes = None if limits.span is not None else axes  # floors of items need all their rows
        self.single = rows.astype(np.float32)
        # Rounding of both sides, of the products and of their sum.
        self.slack = (rows.shape[1] + 4) * SINGLE_EPS + 10.0**-limits.digits
        self.buffer = LinkBuffer(ids, limits) if limits.links else TopBuffer(ids, limits, floors if limits.span is not None else None)
        self.fresh = 0
        if self.axes is not None:
            self.places = along_axes(rows, self.axes)

    def meet(self, names: np.ndarray, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        if self.limits.span is not None:
            step = max(1, BLOCK_CELLS // len(self.ids))
            for at in range(0, len(names), step):
                self.buffer.add(self.rows @ rows[at : at + step].T, names[at : at + step])
            return
        single = rows.astype(np.float32)
        if self.axes is None:
            whole, step = slice(0, len(self.ids)), max(1, BLOCK_CELLS // len(self.ids))
            for at in range(0, len(names), step):
                yield from self._score(whole, slice(at, at + step), names, rows, single)
            return
        places = along_axes(rows, self.axes)
        starts = np.arange(0, len(names), INDEX_BLOCK)
        low, high = np.minimum.reduceat(places, starts, axis=0), np.maximum.reduceat(places, starts, axis=0)
        for first in range(0, len(self.ids), QUERY_BLOCK):
            own = slice(first, min(first + QUERY_BLOCK, len(self.ids)))
            near = self._within(own, low, high, places)
            for at in range(0, len(near), INDEX_CUT):
                yield from self._score(own, near[at : at + INDEX_CUT], names, rows, single)

    def _within(self, own: slice, low: np.ndarray, high: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Rows of a pack that are near enough to a block of queries, as far as the axes tell: first of whole blocks, then one by one."""
        least, most = self.places[own].min(axis=0), self.places[own].max(axis=0)
        # Unit vectors of cosine c are apart by the root of 2 - 2c; a vector of length zero scores zero and is that near to all.
        reach = 2 - 2 * self.floors[own].min() + GAP_SLACK
        far = (np.maximum(0.0, np.maximum(least - high, low - most)) ** 2).sum(axis=1) > reach
        near = np.flatnonzero(~np.repeat(far, INDEX_BLOCK)[: len(places)])
        apart = (np.maximum(0.0, np.maximum(least - places[near], places[near] - most)) ** 2).sum(axis=1) > reach
        return near[~apart]

    def _score(self, own: slice, some: slice | np.ndarray, names: np.ndarray, rows: np.ndarray, single: np.ndarray) -> Iterator[pd.DataFrame]:
        """Hits of some rows of a pack of the index among some of the queries."""
        scores = self.single[own] @ single[some].T
        q, d = self._passing(scores) if self.limits.links else self._near(scores, own, names[some])
        d = d + some.start if isinstance(some, slice) else some[d]
        q = q + own.start
        if self.limits.links:
            self._link(q, d, names, rows)
            return
        for cut in range(0, len(q), EXACT_ROWS):
            self._take(q[cut : cut + EXACT_ROWS], d[cut : cut + EXACT_ROWS], names, rows)
            if self.limits.k is None:
                yield from self.flush()
        self._raise()

    def flush(self) -> Iterator[pd.DataFrame]:
        yield from self.buffer.frames()
        if not self.limits.links:
            self.buffer.parts, self.buffer.held = [], 0

    def _near(self, scores: np.ndarray, own: slice, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose single score may pass; of many, those that may be among the first k of their query."""
        floors = (self.floors[own] - self.slack).astype(np.float32)
        # Most blocks have no hit, and a maximum is found faster than all places.
        if not scores.size or scores.max() < floors.min():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keep = scores >= floors[:, None]
        k = self.limits.k
        if k is not None and k < scores.shape[1] and np.count_nonzero(keep) > 4 * k * len(scores):
            masked = np.where(keep & self._allowed(own, names), scores, np.float32(-np.inf))
            kth = np.partition(masked, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            keep &= masked >= (kth - 2 * self.slack)[:, None]
            keep &= masked > -np.inf
        return np.divmod(np.flatnonzero(keep), keep.shape[1])  # faster than places in two dimensions

    def _allowed(self, own: slice, names: np.ndarray) -> np.ndarray:
        if self.limits.earlier_only:
            return names[None, :] < self.ids[own][:, None]
        if self.limits.skip_self:
            return names[None, :] != self.ids[own][:, None]
        return np.ones((1, 1), bool)

    def _exact(self, q: np.ndarray, d: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.round(np.einsum("ij,ij->i", self.rows[q], rows[d]), self.limits.digits) + 0.0

    def _take(self, q: np.ndarray, d: np.ndarray, names: np.ndarray, rows: np.ndarray) -> None:
        if self.limits.skip_self:
            q, d = (x[names[d] != self.ids[q]] for x in (q, d))
        if self.limits.earlier_only:
            q, d = (x[names[d] < self.ids[q]] for x in (q, d))
        scores = self._exact(q, d, rows)
        keep = scores >= self.floors[q] - ROUNDING_SLACK
        if self.limits.min_score is not None:
            keep &= scores >= self.limits.min_score
        self.buffer.parts.append((q[keep], names[d[keep]], scores[keep]))
        self.buffer.held += int(keep.sum())
        self.fresh += int(keep.sum())

    def _raise(self) -> None:
        """Once enough new hits are there: only the first k of each query stay, and the k-th is the floor."""
        k = self.limits.k
        if k is None or self.fresh < k * len(self.ids):
            return
        self.buffer.shrink()
        self.fresh = 0
        q, _, scores = self.buffer.parts[0]
        first, n = np.searchsorted(q, np.arange(len(self.ids))), np.bincount(q, minlength=len(self.ids))
        full = np.flatnonzero(n >= k)
        self.floors[full] = np.maximum(self.floors[full], scores[first[full] + k - 1])

    def _passing(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose single score may pass the least one."""
        least = np.float32(self.limits.min_score - 2 * self.slack)
        if not scores.size or scores.max() < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.divmod(np.flatnonzero(scores >= least), scores.shape[1])

    def _link(self, q: np.ndarray, d: np.ndarray, names: np.ndarray, rows: np.ndarray) -> None:
        if self.limits.earlier_only:
            q, d = (x[names[d] < self.ids[q]] for x in (q, d))
        for cut in range(0, len(q), EXACT_ROWS):
            own, some = q[cut : cut + EXACT_ROWS], d[cut : cut + EXACT_ROWS]
            near = self._exact(own, some, rows) >= self.limits.min_score
            self.buffer.put(own[near], names[some[near]])


def _dense_tiles(queries: DataFrame, index: DataFrame, limits: Limits) -> DataFrame:
    """Product of packs for a query side too large to ship."""
    dealt = _dealt(index)
    if dealt is None:
        return index.sparkSession.createDataFrame([], HITS)
    rows, cells = dealt
    spark = index.sparkSession
    packs = _index_packs(rows, cells)
    asked = _query_packs(queries, cells, limits)
    size = packs.agg(F.sum(F.octet_length("vectors") + F.octet_length("ids"))).first()[0]
    asked_packs = asked.count()
    left = asked.repartition(max(1, min(asked_packs, PRODUCT_TASKS * spark.sparkContext.defaultParallelism)))
    left = left.select("last", "visits", "floors", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    right = packs.repartition(max(1, -(-size // PACK_BYTES)))
    meets = F.array_contains("visits", F.col("cell"))
    if limits.earlier_only:
        meets &= F.col("least") < F.col("last")
    # Vectors of a pack of queries stay the same over the packs of a part of the index that it meets.
    pairs = left.join(right.hint("shuffle_replicate_nl"), meets).select("query_ids", "query_vectors", "floors", "ids", "vectors")
    single, single_index, axes = _single(queries), _single(index), cells.axes

    def run(batches):
        now, search = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch["query_ids"][row].as_py()
                if own != now:
                    if search is not None:
                        yield from search.flush()
                    floors = np.frombuffer(batch["floors"][row].as_py(), np.float64).copy()
                    now, search = own, PackSearch(*_from_bytes(own, batch["query_vectors"][row].as_py(), single), floors, limits, axes)
                yield from search.meet(*_from_bytes(batch["ids"][row].as_py(), batch["vectors"][row].as_py(), single_index))
        if search is not None:
            yield from search.flush()

    def to_arrow(batches):
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=ARROW_HITS, preserve_index=False)

    return pairs.mapInArrow(to_arrow, HITS)


# ---------------------------------------------------------------- sparse vectors

def sparse_search(queries: DataFrame, index: DataFrame, k: int | None = None, min_score: float | None = None,
                  all_rows: bool = False, ship_cells: int | None = None, digits: int = SCORE_DIGITS, span: int | None = None) -> DataFrame:
    """Hits by dot product over shared terms: ``(query_id, id, score, rank)``; ``span`` as in ``dense_search``.

    Both sides carry ``idx`` (terms or their numbers, each once per row) and
    ``w``. Rows that share no term are no hits, unless ``all_rows`` lets them in
    with score zero (and weights may then be of either sign).
    """
    limits = Limits(k, min_score, digits=digits, span=span)
    queries, index = queries.select("query_id", "idx", "w"), index.select("id", "idx", "w")
    block = frame_if_small(queries, SHIP_ROWS)
    if block is not None and len(block) * max(1, len(terms_of(block)) + (k or 1)) > (TERM_CELLS if ship_cells is None else ship_cells):
        block = None
    if block is None:
        return _finish(_sparse_join(queries, index, limits, all_rows), limits)
    if not len(block) or (not len(terms_of(block)) and not all_rows):
        return index.sparkSession.createDataFrame([], HITS).withColumn("rank", F.lit(1))
    query_ids, scorer = sparse_scorer(index.sparkSession, block, all_rows)
    return _finish(_stream(index, query_ids, limits, scorer, _seed_floors(index, query_ids, limits, scorer)), limits)


def terms_of(block: pd.DataFrame) -> pd.Index:
    return pd.Index(sorted({t for terms in block["idx"] for t in terms}))


def sparse_scorer(spark, block: pd.DataFrame, all_rows: bool = False) -> tuple[np.ndarray, Callable]:
    """As ``dense_scorer`` for frames (id, idx, w); without ``all_rows`` only rows that share a term are allowed."""
    block, vocabulary = block.sort_values("query_id"), terms_of(block)
    query_ids = block["query_id"].to_numpy(np.int64)
    lists = [(at, vocabulary.get_indexer(terms), weights) for at, (terms, weights) in enumerate(zip(block["idx"], block["w"])) if len(terms)]
    asked = np.concatenate([np.full(len(places), at) for at, places, _ in lists]) if lists else np.zeros(0, np.int64)
    term = np.concatenate([places for _, places, _ in lists]) if lists else np.zeros(0, np.int64)
    own = np.concatenate([np.asarray(weights, np.float64) for _, _, weights in lists]) if lists else np.zeros(0)
    order = np.argsort(term, kind="stable")
    # Of each term the queries that ask for it, one term after the other.
    per_term = spark.sparkContext.broadcast((np.searchsorted(term[order], np.arange(len(vocabulary) + 1)), asked[order], own[order]))
    held = max(1, BLOCK_CELLS // len(query_ids))

    def summed(row: np.ndarray, place: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """Scores of all queries for ``rows`` rows from their entries; only pairs of an entry and a query that asks for its term are made."""
        start, of, factor = per_term.value
        times = start[place + 1] - start[place]
        ends, scores, first = np.cumsum(times), np.zeros(rows * len(query_ids)), 0
        while first < len(place):
            made = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, made + BLOCK_CELLS, "right")))
            cut = slice(first, last)
            entry = np.repeat(np.arange(first, last), times[cut])
            at = np.arange(len(entry)) + np.repeat(start[place[cut]] - (ends[cut] - times[cut] - made), times[cut])
            scores += np.bincount(row[entry] * len(query_ids) + of[at], weights=weight[entry] * factor[at], minlength=len(scores))
            first = last
        return scores.reshape(rows, len(query_ids))

    def scorer(frame):
        ids = frame["id"].to_numpy(np.int64)
        sizes = frame["idx"].map(len).to_numpy()
        row = np.repeat(np.arange(len(frame)), sizes)
        if len(vocabulary) and len(row):
            place = vocabulary.get_indexer(np.concatenate(frame["idx"].to_numpy()))
            weight = np.concatenate(frame["w"].to_numpy()).astype(np.float64)
            row, place, weight = row[place >= 0], place[place >= 0], weight[place >= 0]
        else:
            row, place, weight = row[:0], row[:0].astype(np.int64), np.zeros(0)
        for at in range(0, len(frame), held):
            upto = min(at + held, len(frame))
            some = slice(*np.searchsorted(row, (at, upto)))
            scores = summed(row[some] - at, place[some], weight[some], upto - at)
            # Weights are positive without all_rows, so a shared term shows as a score above zero.
            yield scores.T, ids[at:upto], None if all_rows else scores.T > 0

    return query_ids, scorer


def _query_terms(queries: DataFrame) -> DataFrame:
    terms = queries.select("query_id", F.explode(F.arrays_zip("idx", "w")).alias("t"))
    return terms.select("query_id", F.col("t.idx").alias("term"), F.col("t.w").cast("double").alias("qw"))


def _postings(index: DataFrame) -> DataFrame:
    terms = index.select("id", F.explode(F.arrays_zip("idx", "w")).alias("t"))
    return terms.select("id", F.col("t.idx").alias("term"), F.col("t.w").cast("double").alias("dw"))


def sparse_scores(queries: DataFrame, index: DataFrame, digits: int = SCORE_DIGITS) -> DataFrame:
    """Every (query, row) that shares a term, with its score; an inverted-index join.

    Row terms are spread by row id before they meet the query terms, so the sum
    per (query, row) needs no second shuffle and hot terms do not pile up in one
    task: the term join ships the query side when it fits and is otherwise
    re-planned by AQE's skew join.
    """
    return _postings(index.repartition("id")).join(_query_terms(queries), "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("qw") * F.col("dw")), digits).alias("score"))


def term_bounds(queries: DataFrame, postings: DataFrame, floors: DataFrame) -> DataFrame:
    """query_id, term, qw, rest, needed: which terms of a query a row must share to reach its floor.

    A term adds at most its query weight times its largest weight in any row. The terms that add least, together less than the floor (``rest``), cannot reach it
    without one of the others, so rows that share only them are no hits. Stop words are mostly among them.
    """
    most = postings.groupBy("term").agg(F.max("dw").alias("most"))
    bounds = _query_terms(queries).join(most, "term").withColumn("adds", F.col("qw") * F.col("most")).join(floors, "query_id", "left")
    upto = Window.partitionBy("query_id").orderBy("adds", "term").rowsBetween(Window.unboundedPreceding, 0)
    bounds = bounds.withColumn("upto", F.sum("adds").over(upto))
    needed = F.col("floor").isNull() | (F.col("upto") >= F.col("floor") - BOUND_SLACK)
    spared = F.max(F.when(~needed, F.col("upto"))).over(Window.partitionBy("query_id"))
    return bounds.select("query_id", "term", "qw", "floor", F.coalesce(spared, F.lit(0.0)).alias("rest"), needed.alias("needed"))


def _floors(queries: DataFrame, index: DataFrame, limits: Limits) -> DataFrame:
    """query_id, floor: a score that the k-th hit of a query has at least, from a sample of the index, or the smallest score allowed."""
    floor = queries.select("query_id", F.lit(limits.min_score).cast("double").alias("floor"))
    if limits.k is not None:
        every = max(1, index.count() // max(SEED_ROWS, 100 * limits.k))
        part = index.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
        kth = _finish(sparse_scores(queries, part, limits.digits), limits).where(F.col("rank") == limits.k).select("query_id", F.col("score").alias("kth"))
        floor = floor.join(kth, "query_id", "left").select("query_id", F.greatest("floor", "kth").alias("floor"))
    return floor.where("floor is not null")


def _bounded_sparse_join(queries: DataFrame, index: DataFrame, limits: Limits) -> DataFrame:
    """Scores of all rows that may be hits: those that share a needed term, and whose sum over needed terms can still reach the floor."""
    floors = through_table(_floors(queries, index, limits), "sparse-floors")
    bounds = through_table(term_bounds(queries, _postings(index), floors), "term-bounds")
    # Rows are dealt by id before they meet the terms, so sums per (query, row) need no second shuffle.
    lists = _postings(index.repartition("id"))
    found = lists.join(bounds.where("needed").select("query_id", "term", "qw", "floor", "rest"), "term")
    part = found.groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("dw")).alias("part"), F.first("floor").alias("floor"), F.first("rest").alias("rest"))
    alive = through_table(part.where(F.col("floor").isNull() | (F.col("part") + F.col("rest") >= F.col("floor") - BOUND_SLACK)), "sparse-candidates")
    spared = alive.select("query_id", "id").join(bounds.where("not needed").select("query_id", "term", "qw"), "query_id").join(_postings(index), ["id", "term"])
    sums = alive.select("query_id", "id", "part").unionByName(spared.select("query_id", "id", (F.col("qw") * F.col("dw")).alias("part")))
    scores = sums.groupBy("query_id", "id").agg(F.round(F.sum("part"), limits.digits).alias("score"))
    return scores if limits.min_score is None else scores.where(F.col("score") >= limits.min_score)


def _sparse_join(queries: DataFrame, index: DataFrame, limits: Limits, all_rows: bool) -> DataFrame:
    if not all_rows:
        return _bounded_sparse_join(queries, index, limits)
    scores = sparse_scores(queries, index, limits.digits)
    if all_rows and limits.k is not None:
        # A query with m < k hits is filled with zero rows; those are among the first k ids plus its hits.
        first = index.select("id").orderBy("id").limit(limits.k)
        zero = queries.select("query_id").join(F.broadcast(first)).join(scores, ["query_id", "id"], "left_anti")
        scores = scores.unionByName(zero.withColumn("score", F.lit(0.0)))
    return scores if limits.min_score is None else scores.where(F.col("score") >= limits.min_score)
