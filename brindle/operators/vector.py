"""Exact nearest neighbours by cosine: a stated query set against all points, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import stage

from .ranking import top_by

#: Queries that go to the executors at a time.
BLOCK = 4_096
#: Queries and points whose scores are held at a time.
ROWS, COLUMNS = 256, 4_096
#: Scores are rounded to nine places; what is further below a rounded one than this stays below.
SLACK = 2e-9


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the vectors that are whole and have size values, and which those are."""
    if not size:
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    which = np.flatnonzero(length == size)
    values = column.take(pa.array(which)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(which), size)
    whole = np.isfinite(values).all(axis=1)  # nulls are read as nan
    return values[whole], which[whole]


class _Best:
    """The k best points of each of n queries so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.count, self.floor = k, np.zeros(n, np.int64), np.full(n, -np.inf)
        self.score, self.id = np.zeros((n, k)), np.zeros((n, k), np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores of the queries numbered at (each once) with the points ids."""
        hit = scores >= self.floor[at, None] - SLACK
        if hit.shape[1] > self.k and np.count_nonzero(hit) > 4 * self.k * len(at):
            hit &= scores >= np.partition(scores, -self.k, axis=1)[:, [-self.k]] - SLACK
        row, col = np.nonzero(hit)
        if not len(row):
            return
        rows = np.unique(row)
        slot = np.arange(self.k) < self.count[at[rows], None]
        score = np.concatenate([self.score[at[rows]][slot], np.round(scores[row, col], 9)])
        name = np.concatenate([self.id[at[rows]][slot], ids[col]])
        row = np.concatenate([np.repeat(rows, self.count[at[rows]]), row])
        order = np.lexsort((name, -score, row))
        row, score, name = row[order], score[order], name[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < self.k
        row, place = at[row[first]], place[first]
        self.score[row, place], self.id[row, place] = score[first], name[first]
        np.maximum.at(self.count, row, place + 1)
        full = np.unique(row)
        full = full[self.count[full] == self.k]
        self.floor[full] = self.score[full, -1]

    def found(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the queries from start to end, ids and scores."""
        row, slot = np.nonzero(np.arange(self.k) < self.count[start:end, None])
        return row + start, self.id[row + start, slot], self.score[row + start, slot]


def _scored(batches: Iterator[pa.RecordBatch], names: list, matrix: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a task's points (id, vector) for each query of matrix: its name, the point and the score."""
    best = _Best(len(names), k)
    for batch in batches:
        for i in range(0, batch.num_rows, COLUMNS):
            part = batch.slice(i, COLUMNS)
            own, whole = _matrix(part.column(1), matrix.shape[1])
            if not len(whole) or not names:
                continue
            ids, own = part.column(0).take(pa.array(whole)).to_numpy(zero_copy_only=False), _unit(own)
            for j in range(0, len(names), ROWS):
                best.add(np.arange(j, min(j + ROWS, len(names))), matrix[j : j + ROWS] @ own.T, ids)
    for j in range(0, len(names), ROWS):
        row, point, score = best.found(j, j + ROWS)
        yield pa.RecordBatch.from_arrays([pa.array([names[r] for r in row], pa.int64()), pa.array(point), pa.array(score)], ["q", "p", "score"])


def nearest(queries: DataFrame, points: DataFrame, k: int, query_id: str = "query_id", point_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, point_id, score and rank of the k nearest points of each query; ties go to the smaller id.

    Each task keeps k points a query, so what is shuffled does not grow with queries times points; it holds the scores of ROWS queries
    with COLUMNS points at a time. Vectors that are null, or hold a null or a value that is not finite, take no part; a query is compared
    with the points of its own length. Queries come to the driver in blocks, one at a time.
    """
    usable = queries.select(query_id, vector, F.size(vector).alias("_size")).where(f"{query_id} IS NOT NULL AND size({vector}) > 0 AND NOT exists({vector}, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")
    sizes = [(r["_size"], r["n"]) for r in usable.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).orderBy("_size").collect()]
    out = None
    for size, block, blocks in [(s, b, -(-n // BLOCK)) for s, n in sizes or [(0, 1)] for b in range(-(-n // BLOCK))]:
        rows = usable.where((F.col("_size") == size) & (F.pmod(F.xxhash64(query_id), F.lit(blocks)) == block)).select(query_id, vector).collect()
        matrix = _unit(np.array([r[1] for r in rows], np.float64).reshape(len(rows), size))
        shared = points.sparkSession.sparkContext.broadcast(([r[0] for r in rows], matrix))
        if out is not None:  # a block's result is written before the next block comes
            out = stage(out, "nearest")

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            return _scored(batches, *shared.value, k)

        one = points.select(point_id, vector).where(F.col(point_id).isNotNull()).mapInArrow(run, "q long, p long, score double")
        out = one if out is None else out.unionByName(one)
    return top_by(out, ["q"], k, F.desc("score"), F.asc("p")).withColumnsRenamed({"q": query_id, "p": point_id})


#: Points that cells are built around, and rows of a cell that are ruled out together.
PIVOTS, CELL_ROWS = 64, 256
#: Squared distances are compared with this much room, as scores are rounded to nine places.
ROOM = 1e-8


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows of unit length."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _cells(points: DataFrame, pivots: np.ndarray, point_id: str, vector: str) -> DataFrame:
    """point, its nearest pivot, the distance to it and the unit vector, in the shared folder by pivot and distance. A zero vector has pivot -1."""
    size = pivots.shape[1]
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, whole = _matrix(batch.column(1), size)
            own = _unit(own)
            apart = _apart(own, shared.value)
            pivot = apart.argmin(axis=1)
            far = apart[np.arange(len(own)), pivot]
            zero = ~own.any(axis=1)
            pivot[zero], far[zero] = -1, 0
            values = pa.FixedSizeListArray.from_arrays(pa.array(own.ravel()), size).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whole)), pa.array(pivot), pa.array(far), values], ["p", "pivot", "far", "unit"])

    rows = points.select(point_id, vector).where(F.col(point_id).isNotNull()).mapInArrow(placed, "p long, pivot long, far double, unit array<double>")
    # a range of pivots and distances a task: a cell with very many points is cut by distance, which keeps its rings thin
    return stage(rows.repartitionByRange("pivot", "far").sortWithinPartitions("pivot", "far"), "cells")


def nearest_by_pivots(
    queries: DataFrame, points: DataFrame, k: int, query_id: str = "query_id", point_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS
) -> tuple[DataFrame, DataFrame]:
    """The rows of nearest (all vectors of one length), and for each query the points and the distances that were computed.

    Points lie in cells around some of them, sorted by their distance to the middle. A stretch of a cell is ruled out for a query when, by the
    triangle inequality, all of it is further away than the k-th best of the query's nearest cells. Queries go in blocks of BLOCK.
    """
    spark = points.sparkSession
    usable = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).where(f"{query_id} IS NOT NULL AND size({vector}) > 0 AND NOT exists({vector}, x -> x IS NULL)")
    n = usable.count()
    middle = points.where(f"size({vector}) > 0 AND NOT exists({vector}, x -> x IS NULL)").orderBy(F.xxhash64(point_id), point_id).limit(pivots).select(vector).collect()
    if not n or not middle:
        none = spark.createDataFrame([], f"`{query_id}` long, `{point_id}` long, score double, rank long")
        return none, spark.createDataFrame([], f"`{query_id}` long, points long, distances long")
    middle = _unit(np.array([r[0] for r in middle], np.float64))
    cells = _cells(points, middle, point_id, vector)
    schema = "q long, p long, score double, points long, distances long"
    done = []
    for block in range(-(-n // BLOCK)):
        rows = usable.where(F.pmod(F.xxhash64("q"), F.lit(-(-n // BLOCK))) == block).collect()
        if not rows:
            continue
        matrix = _unit(np.array([r.v for r in rows], np.float64).reshape(len(rows), -1))
        to_pivot = _apart(matrix, middle)
        closest = np.argsort(to_pivot, axis=1)[:, :2]

        def scored(limits: np.ndarray | None, rows: list = rows, matrix: np.ndarray = matrix, to_pivot: np.ndarray = to_pivot, closest: np.ndarray = closest) -> DataFrame:
            """The k best of each task: of the two closest cells without limits (squared distances), else of all that may hold a nearer point."""
            shared = spark.sparkContext.broadcast(([r.q for r in rows], matrix, to_pivot, closest, limits))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                names, matrix, to_pivot, closest, limits = shared.value
                zero = ~matrix.any(axis=1)
                for batch in batches:
                    pivot, far = (batch.column(c).to_numpy() for c in ("pivot", "far"))
                    own, _ = _matrix(batch.column("unit"), matrix.shape[1])
                    edges = np.flatnonzero(np.diff(pivot)) + 1
                    edges = np.unique(np.concatenate([[0], edges, np.arange(0, len(pivot), CELL_ROWS), [len(pivot)]]))
                    out: list[tuple] = []
                    computed = np.zeros(len(names), np.int64)
                    for i, j in zip(edges, edges[1:], strict=False):
                        p = pivot[i]
                        if limits is None:
                            asked = np.flatnonzero((closest == p).any(axis=1))
                        elif p < 0:
                            asked = np.arange(len(names))
                        else:
                            least = np.maximum(np.maximum(to_pivot[:, p] - far[j - 1], far[i] - to_pivot[:, p]), 0)
                            asked = np.flatnonzero(zero | (least**2 <= limits + ROOM))
                        if not len(asked):
                            continue
                        computed[asked] += j - i
                        ids = batch.column("p")[i:j].to_numpy()
                        order = np.argsort(ids, kind="stable")
                        scores = np.round(own[i:j][order] @ matrix[asked].T, 9)
                        kept = np.argsort(-scores, axis=0, kind="stable")[:k]
                        row, col = kept.T.ravel(), np.repeat(np.arange(len(asked)), len(kept))
                        out.append((asked[col], ids[order][row], scores[row, col]))
                    q, p, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                    every = np.array(names, np.int64)
                    blank = pa.nulls(len(every))
                    yield pa.RecordBatch.from_arrays([pa.array(every[q]), pa.array(p), pa.array(score), pa.nulls(len(q), pa.int64()), pa.nulls(len(q), pa.int64())], schema_names)
                    yield pa.RecordBatch.from_arrays([pa.array(every), blank.cast(pa.int64()), blank.cast(pa.float64()), pa.array(np.full(len(every), len(pivot))), pa.array(computed)], schema_names)

            schema_names = ["q", "p", "score", "points", "distances"]
            return stage(cells.mapInArrow(run, schema), "near")

        first = scored(None)
        bar = {r.q: r.score for r in top_by(first.where("p IS NOT NULL"), ["q"], k, F.desc("score"), F.asc("p")).where(F.col("rank") == k).select("q", "score").collect()}
        limits = np.array([2 - 2 * bar[r.q] if r.q in bar else np.inf for r in rows])
        last = scored(limits)
        best = top_by(last.where("p IS NOT NULL").select("q", "p", "score"), ["q"], k, F.desc("score"), F.asc("p")).withColumnsRenamed({"q": query_id, "p": point_id})
        spent = first.where("p IS NULL").select("q", F.lit(0).cast("long").alias("points"), "distances").unionByName(last.where("p IS NULL").select("q", "points", "distances"))
        done.append((best, spent.groupBy(F.col("q").alias(query_id)).agg(F.sum("points").alias("points"), F.sum("distances").alias("distances"))))
    return tuple(reduce(DataFrame.unionByName, some) for some in zip(*done, strict=True))
