"""Integer vectors for the exact searches: whole components, blocks of queries, matrices of a batch, running best scores.

A component x becomes floor(scale * x) with x as double, held to 64 bits. A vector that is null or holds a null or a component that is
not finite takes no part. Where vectors differ in length, the missing components count as zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of components of the queries that are broadcast at a time: 65,536 queries of 64 components.
BLOCK_BYTES = 32 << 20
#: Queries and candidates whose scores are held at a time.
ROWS, COLUMNS = 256, 4_096
LEAST = np.iinfo(np.int64).min


def whole(rows: DataFrame, scale: int, vector: str, *others: str) -> DataFrame:
    """others and the components as integers (column ints), of the vectors that take part."""
    usable = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(usable).select(*others, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("ints"))


def blocks(queries: DataFrame) -> Iterator[tuple[Broadcast, list]]:
    """Distinct rows of queries (ints last) in blocks of about BLOCK_BYTES: the broadcast columns, with the vectors as one matrix.

    A block comes to the driver when the one before is done. Rows are dealt by a hash of all their columns, so no id fills a block.
    """
    distinct = queries.distinct()
    n, longest = distinct.agg(F.count(F.lit(1)), F.max(F.size("ints"))).first()
    count = -(-n * max(1, longest or 0) * 8 // BLOCK_BYTES)
    for i in range(count):
        table = distinct.where(F.pmod(F.xxhash64(*queries.columns), F.lit(count)) == i).toArrow().combine_chunks()
        if not table.num_rows:
            continue
        held = [table.column(c).to_pylist() for c in queries.columns[:-1]]
        vectors = matrix(table.column("ints").combine_chunks(), longest)
        shared = queries.sparkSession.sparkContext.broadcast((held, vectors))
        yield shared, held
        shared.unpersist()


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of a matrix: cut at width, filled with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == width).all():
        return values.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), size)
    at = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    out[row[at < width], at[at < width]] = values[at < width]
    return out


def chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """At most COLUMNS rows at a time: the rows, ids (first column), which ids are null, vectors (last column)."""
    for batch in batches:
        for i in range(0, batch.num_rows, COLUMNS):
            part = batch.slice(i, COLUMNS)
            nulls = part.column(0).is_null().to_numpy(zero_copy_only=False)
            yield part, part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), nulls, matrix(part.column(part.num_columns - 1), width)


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """No inner product of a row of a and a row of b is further from zero (Cauchy and Schwarz, or length times greatest components)."""
    most_a, most_b = (max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (a, b))
    plain = a.shape[1] * most_a * most_b
    if a.shape[1] * max(most_a, most_b) ** 2 < 2**62:
        norms = [int((m * m).sum(axis=1).max(initial=0)) for m in (a, b)]
        root = int(np.sqrt(float(norms[0]) * float(norms[1]))) + 2  # above the root, whatever the rounding
        return min(plain, root + root // 2**40)
    return plain


class Best:
    """The k first of the scores of each of n rows, higher ones first, then smaller ids, null ids last."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.count, self.floor = k, np.zeros(n, np.int64), np.full(n, LEAST)
        self.score, self.id, self.null = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, allowed: np.ndarray) -> None:
        """scores of the rows numbered at (each once) with the candidates ids, where allowed."""
        hit = allowed & (scores >= self.floor[at, None])
        if hit.shape[1] > self.k and np.count_nonzero(hit) > 4 * self.k * len(at):
            hit &= scores >= np.partition(np.where(hit, scores, LEAST), -self.k, axis=1)[:, [-self.k]]
        row, col = np.nonzero(hit)
        if not len(row):
            return
        rows = np.unique(row)
        slot = np.arange(self.k) < self.count[at[rows], None]
        old = np.repeat(rows, self.count[at[rows]])
        row = np.concatenate([old, row])
        score = np.concatenate([self.score[at[rows]][slot], scores[hit]])
        name, null = np.concatenate([self.id[at[rows]][slot], ids[col]]), np.concatenate([self.null[at[rows]][slot], nulls[col]])
        order = np.lexsort((name, null, ~score, row))
        row, score, name, null = row[order], score[order], name[order], null[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = place < self.k
        row, place = at[row[first]], place[first]
        self.score[row, place], self.id[row, place], self.null[row, place] = score[first], name[first], null[first]
        np.maximum.at(self.count, row, place + 1)
        full = np.unique(row)
        full = full[self.count[full] == self.k]
        self.floor[full] = self.score[full, -1]

    def found(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Numbers of rows, ids and scores."""
        row, slot = np.nonzero(np.arange(self.k) < self.count[:, None])
        return row, pa.array(self.id[row, slot], mask=self.null[row, slot]), pa.array(self.score[row, slot])
