"""Exact top-k search in three phases with a uniform threshold.

A candidate's score, its inner product with the query, is the sum of its scores in LISTS lists: the parts of the product over equal
slices of the components. Each task holds the lists of its own rows.

1. Each task gathers the first k rows of every list for each query, sums the scores of these rows, and sends the k greatest sums. No
   sum is above its row's score, as it is the score; so the k-th greatest of all that were sent is a safe cutoff of the query.
2. The cutoffs are broadcast. A row whose scores lie below cutoff / LISTS in every list is below the cutoff. All other entries are
   collected in their task: a row goes on when what its sufficient entries sum to could reach the cutoff with the rest just below.
3. Of these rows the scores in the remaining lists are computed, and those that reach the cutoff are sent with their exact scores and
   ranked. No more than the k first and those that tie with the cutoff or passed it by chance of the first phase travel.

Queries come in blocks (exact_vectors.BLOCK_BYTES), so that vectors, cutoffs and local lists stay in bounds. Products are taken in
float64 where every partial sum is a whole number below 2^53 and so exact, and otherwise in Python's integers.

Results for odd input. Vectors that are null or hold a null or a component that is not finite take no part. A null id is no query, and
comes last among ties. A repeated row is a row of its own and listed as often as it stands in the table; a query that is repeated whole is
one query, and rows with the query's id are its own and not listed. Where an id has several vectors, each is a query. With fewer than k
candidates all are listed. Vectors of different lengths are compared as if zeros followed. Other columns are not read. A score outside
64 bits ends the query with an OverflowError. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .exact_vectors import LEAST, ROWS, Best, bound, blocks, chunks, whole

#: Lists that a score is the sum of.
LISTS = 2


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of all rows, exact; OverflowError where one has more than 64 bits."""
    most = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (a, b)]
    if a.shape[1] * most[0] * most[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound(a, b) < 2**63 and a.shape[1] * most[0] * most[1] < 2**63:
        return a @ b.T
    return np.array((a.astype(object) @ b.T.astype(object)).tolist(), np.int64).reshape(len(a), len(b))


def _lists(queries: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """The scores in each list."""
    edges = np.linspace(0, queries.shape[1], LISTS + 1).astype(int)
    return [products(queries[:, i:j], rows[:, i:j]) for i, j in zip(edges, edges[1:], strict=False)]


def _gather(batches: Iterator[pa.RecordBatch], shared: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    """Phase 1: for each query the k greatest sums of the rows that lead a list of this task."""
    (ids,), vectors = shared.value
    ids, best = np.array(ids, np.int64), Best(len(ids), k)
    for _, names, nulls, rows in chunks(batches, vectors.shape[1]):
        for i in range(0, len(ids), ROWS):
            at = np.arange(i, min(i + ROWS, len(ids)))
            other = (ids[at, None] != names) | nulls
            scores, leads = _lists(vectors[at], rows), other
            if len(names) > k + 1:  # else all rows lead
                leads = np.zeros(other.shape, bool)
                for one in scores:
                    one = np.where(other, one, LEAST)
                    leads |= one >= np.partition(one, -k, axis=1)[:, [-k]]
                leads &= other
            best.add(at, sum(scores), names, nulls, leads)
    row, _, score = best.found()
    yield pa.RecordBatch.from_arrays([pa.array(row), score], ["key", "score"])


def _resolve(batches: Iterator[pa.RecordBatch], shared: Broadcast, cutoffs: Broadcast) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3: the rows that reach the cutoff, with their scores."""
    (ids,), vectors = shared.value
    ids, (cutoff, every) = np.array(ids, np.int64), cutoffs.value
    share = -(-cutoff // LISTS)  # a list's score below it, and so below cutoff / LISTS
    for _, names, nulls, rows in chunks(batches, vectors.shape[1]):
        for i in range(0, len(ids), ROWS):
            at = np.arange(i, min(i + ROWS, len(ids)))
            enough, known = [], 0
            scores = _lists(vectors[at], rows)
            for one in scores:
                enough.append(one >= share[at, None])
                known = known + np.where(enough[-1], one, share[at, None] - 1)  # of the rest no more than this
            sufficient = np.logical_or.reduce(enough) & (known >= cutoff[at, None]) | every[at, None]
            row, col = np.nonzero(sufficient & ((ids[at, None] != names) | nulls))
            total = sum(one[row, col] for one in scores)
            reach = (total >= cutoff[at[row]]) | every[at[row]]
            row, col, total = at[row[reach]], col[reach], total[reach]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids[row]), pa.array(names[col], mask=nulls[col]), pa.array(total)], ["key", "query_id", "vec_id", "score"])


def search(queries: DataFrame, rows: DataFrame, k: int, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k first rows of each query: higher inner products of floor(scale * x), then smaller ids."""
    spark = rows.sparkSession
    rows = whole(rows, scale, vector, key)
    done = []
    for shared, (ids,) in blocks(whole(queries, scale, vector, key).where(F.col(key).isNotNull())):

        def first(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            return _gather(batches, shared, k)

        place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score")))
        gathered = rows.mapInArrow(first, "key long, score long").withColumn("n", place).where(F.col("n") == k).select("key", "score").toArrow()
        cutoff, every = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)  # with fewer than k candidates, every one is sufficient
        cutoff[gathered.column("key").to_numpy()] = gathered.column("score").to_numpy()
        every[gathered.column("key").to_numpy()] = False
        cutoffs = spark.sparkContext.broadcast((cutoff, every))

        def second(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared, cutoffs: Broadcast = cutoffs) -> Iterator[pa.RecordBatch]:
            return _resolve(batches, shared, cutoffs)

        found = rows.mapInArrow(second, "key long, query_id long, vec_id long, score long")
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))).cast("int")
        done.append(stage(found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk"))  # before the next block comes
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
