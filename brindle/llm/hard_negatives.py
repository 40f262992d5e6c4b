"""Hard negatives by exact integer scores, several at a time: Kronecker-packed products.

The components of several candidates, biased to be no less than zero, lie in separated fields of one wide integer, a word for each
component of the vectors. An anchor's component is multiplied with the word of that component once, for all candidates in it; the words'
products are added and the fields of the sum are the scores. Words have 64 bits, and the sums are right modulo 2^64; the bias is taken
out again and a field is as wide as the scores of the batch can be (Cauchy and Schwarz), so three scores of vectors of length 256 fit.
Where one score alone would not fit, the words are Python's integers of any width, by the same steps.

A block of anchors at a time (exact_vectors.BLOCK_BYTES) is broadcast and passes twice over all rows: first for the positives, then for
the negatives below them. A task keeps the best few of each anchor, so that what is shuffled does not grow with anchors times rows.

Results for odd input. Rows with a null label or a vector that is null or holds a null or a component that is not finite take no part.
A null id is no anchor and comes last among ties. A repeated row is a row of its own, and is listed as often as it stands in the table;
an anchor that is repeated whole is one anchor, and rows with the anchor's id are the anchor's own and not listed. Where an id has several
vectors, each is an anchor. A positive with a negative score has no negatives. Vectors of different lengths are compared as if zeros
followed. Other columns are not read. A score outside 64 bits ends the query with an OverflowError. Empty tables give no rows.
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
from .exact_vectors import ROWS, Best, blocks, bound, chunks, whole

#: Candidates in one of Python's integers.
WIDE_FIELDS = 8


def packed_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The inner products of all rows, exact; OverflowError where one has more than 64 bits."""
    most = bound(anchors, candidates)
    bias = max(0, -int(candidates.min(initial=0)))
    width = max(2 * most + 1, bias + int(candidates.max(initial=0))).bit_length()
    fields, kind = (64 // width, np.uint64) if width <= 64 and bias < 2**62 else (WIDE_FIELDS, object)
    as_words = (lambda m: m.astype(np.uint64)) if kind is np.uint64 else (lambda m: m.astype(object))
    n, words = len(candidates), -(-len(candidates) // fields)
    packed = np.zeros((words, anchors.shape[1]), kind)
    for f in range(fields):
        part = as_words(candidates[f * words : (f + 1) * words])
        packed[: len(part)] += (part + kind(bias)) << kind(f * width) if kind is np.uint64 else (part + bias) << f * width
    sums = as_words(anchors) @ packed.T
    # a field now holds score + bias * (sum of the anchor's components); make it score + most, which is in [0, 2 * most]
    ones = sum(1 << f * width for f in range(fields))
    shift = np.array([(most - bias * int(s)) * ones for s in anchors.astype(object).sum(axis=1)], object)
    sums += (np.array([s % 2**64 for s in shift], np.uint64) if kind is np.uint64 else shift)[:, None]
    out = np.empty((len(anchors), fields * words), np.int64)
    mask = (1 << width) - 1
    for f in range(fields):
        if kind is np.uint64:
            out[:, f * words : (f + 1) * words] = ((sums >> np.uint64(f * width)) & np.uint64(mask)).astype(np.int64) - most
        else:
            out[:, f * words : (f + 1) * words] = ((sums >> f * width) & mask) - most
    return out[:, :n]


def _emitted(best: Best, of: np.ndarray | None = None) -> pa.RecordBatch:
    row, ids, scores = best.found()
    return pa.RecordBatch.from_arrays([pa.array(row if of is None else of[row]), ids, scores], ["key", "id", "score"])


def _parts(vectors: np.ndarray, labels: np.ndarray, label: object = None) -> Iterator[np.ndarray]:
    """Numbers of anchors, some at a time: those of a label, or all."""
    which = np.arange(len(vectors)) if label is None else np.flatnonzero(labels == label)
    for i in range(0, len(which), ROWS):
        yield which[i : i + ROWS]


def _positives(batches: Iterator[pa.RecordBatch], shared: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    (ids, labels), vectors = shared.value
    ids, labels, best = np.array(ids, np.int64), np.array(labels), Best(len(ids), k)
    for part, names, nulls, rows in chunks(batches, vectors.shape[1]):
        own = np.array(part.column(1).to_pylist())
        for label in np.unique(own):
            same = np.flatnonzero(own == label)
            for at in _parts(vectors, labels, label):
                best.add(at, packed_products(vectors[at], rows[same]), names[same], nulls[same], (ids[at, None] != names[same]) | nulls[same])
    yield _emitted(best)


def _negatives(batches: Iterator[pa.RecordBatch], shared: Broadcast, ranges: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    """ranges: for each anchor and positive the least and the greatest score of a negative."""
    (ids, labels), vectors = shared.value
    ids, labels, (least, most) = np.array(ids, np.int64), np.array(labels), ranges.value
    bests = [Best(len(labels), k) for _ in range(least.shape[1])]
    for part, names, nulls, rows in chunks(batches, vectors.shape[1]):
        own = np.array(part.column(1).to_pylist())
        for at in _parts(vectors, labels):
            scores = packed_products(vectors[at], rows)
            differ = (labels[at, None] != own) & ((ids[at, None] != names) | nulls)
            for j, best in enumerate(bests):
                best.add(at, scores, names, nulls, differ & (scores >= least[at, j, None]) & (scores <= most[at, j, None]))
    for j, best in enumerate(bests):
        yield _emitted(best, np.arange(len(labels)) * len(bests) + j)


def mine(
    anchors: DataFrame, rows: DataFrame, positives: int, negatives: int, least: tuple[int, int], most: tuple[int, int], scale: int,
    key: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Each anchor has the first positives of its label; each of them the first negatives of other labels whose score is at least
    least[0] / least[1] and at most most[0] / most[1] of its own (tested in whole numbers). Scores are inner products of
    floor(scale * x); higher ones come first, then smaller ids.
    """
    spark, columns = rows.sparkSession, [key, label]
    rows = whole(rows, scale, vector, *columns).where(F.col(label).isNotNull())
    anchors = whole(anchors, scale, vector, *columns).where(F.col(label).isNotNull() & F.col(key).isNotNull())
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    schema = "key long, id long, score long"
    done = []
    for shared, (ids, _) in blocks(anchors):

        def first(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            return _positives(batches, shared, positives)

        # at most `positives` of each anchor of the block
        known = rows.mapInArrow(first, schema).withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).toArrow().to_pylist()
        low, high = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        for r in known:
            if r["score"] >= 0:  # below zero, half a score is more than the score
                low[r["key"], r["n"] - 1], high[r["key"], r["n"] - 1] = -(-r["score"] * least[0] // least[1]), r["score"] * most[0] // most[1]
        ranges = spark.sparkContext.broadcast((low, high))

        def second(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared, ranges: Broadcast = ranges) -> Iterator[pa.RecordBatch]:
            return _negatives(batches, shared, ranges, negatives)

        found = rows.mapInArrow(second, schema).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= negatives)
        pairs = [pa.array([r["key"] * positives + r["n"] - 1 for r in known], pa.int64()), pa.array([ids[r["key"]] for r in known], pa.int64())]
        pairs += [pa.array([r[c] for r in known], pa.int64()) for c in ("id", "score")]
        pairs = spark.createDataFrame(pa.table(pairs, ["key", "anchor_id", "positive_id", "positive_score"]))
        one = found.join(pairs, "key").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        done.append(stage(one, "negatives"))  # before the next block comes
    if not done:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, done)
