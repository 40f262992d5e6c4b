"""BM25 over documents dealt to tasks: impact-ordered postings, pruned by the greatest scores of terms (MaxScore).

Questions come in blocks of a bounded size. A task keeps of a document the asked terms only and turns a batch of documents into lists
of postings, ordered by weight, for some shards of like length (a term weighs less in a long document). What is shuffled is the k
best documents a question and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.structured import BM25_B, BM25_K1, idf
from brindle.functions.text import tokens
from brindle.session import stage

from .ranking import top_by

#: Bytes of the questions that are broadcast at a time.
BLOCK_BYTES = 8 << 20
#: Words that are looked up at a time.
WORDS = 1 << 19
#: Documents of a batch and their postings at most, and shards of it.
BATCH, POSTINGS, SHARDS = 10_000, 1 << 21, 4
#: The first postings of each list that are read to set the bar (fewer of short lists), and the documents a result whose scores set it.
SEEDS, SEED_DOCS = 8, 4
#: Scores are rounded to six places; what is further below the bar than this stays below.
SLACK = 1e-5


def tokenized(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, terms and length of every document."""
    split = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    return split.withColumn("length", F.size("terms"))


def corpus(split: DataFrame) -> DataFrame:
    """One row: the number of documents with terms and their average length."""
    return split.where("length > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))


def postings(split: DataFrame, key: str) -> DataFrame:
    """key, term, tf and length."""
    return split.select(key, "length", F.explode("terms").alias("term")).groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


class Shard:
    """Postings of some documents: lists of one term by weight and by document, and the terms of a document."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int) -> None:
        """doc numbers below size, in order; each with its distinct terms."""
        self.size, self.term, self.weight = size, term, weight
        self.first = np.searchsorted(doc, np.arange(size + 1))
        by_term = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[by_term], weight[by_term]
        by_weight = np.lexsort((-weight, term))
        self.heavy_docs, self.heavy = doc[by_weight], weight[by_weight]
        self.names, starts = np.unique(term[by_term], return_index=True)
        self.edges = np.append(starts, len(term))

    def lists(self, terms: np.ndarray, gains: np.ndarray) -> list[tuple[float, float, int, int]]:
        """Greatest gain, gain a weight, start and end of the list of each term that occurs, greatest first."""
        at = np.searchsorted(self.names, terms)
        at[at == len(self.names)] = 0
        here = self.names[at] == terms if len(self.names) else np.zeros(len(terms), bool)
        found = [(float(g * self.heavy[self.edges[i]]), float(g), int(self.edges[i]), int(self.edges[i + 1])) for i, g in zip(at[here], gains[here], strict=True)]
        return sorted(found, reverse=True)

    def seeds(self, lists: list[tuple[float, float, int, int]], gain_of: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        """Whole scores of the documents that gain most by the first postings of the lists, and the postings read for it."""
        partial, read = np.zeros(self.size), 0
        for _, gain, start, end in lists:
            end = start + min(SEEDS, 1 + (end - start) // SEEDS)
            partial[self.heavy_docs[start:end]] += gain * self.heavy[start:end]
            read += end - start
        some = np.flatnonzero(partial)
        some = some[np.argsort(-partial[some], kind="stable")[: SEED_DOCS * k]]
        scores = [float(gain_of[self.term[i:j]] @ self.weight[i:j]) for i, j in zip(self.first[some], self.first[some + 1], strict=True)]
        return np.array(scores), read + sum(int(np.count_nonzero(gain_of[self.term[i:j]])) for i, j in zip(self.first[some], self.first[some + 1], strict=True))

    def above(self, lists: list[tuple[float, float, int, int]], bar: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may have a score of bar and over, their scores, and the postings read.

        Terms whose greatest gains together stay below the bar name no candidate: they are optional. Of the other lists only the first
        postings are read, those that reach the bar with the greatest gains of all other terms. What may still pass the bar is
        looked up in the optional lists, greatest gains first.
        """
        total, optional, spare = sum(x[0] for x in lists), len(lists), 0.0
        while optional and spare + lists[optional - 1][0] < bar:
            optional -= 1
            spare += lists[optional][0]
        score, read = np.zeros(self.size), 0
        for most, gain, start, end in lists[:optional]:
            least = (bar - (total - most)) / gain
            end = start + int(np.searchsorted(-self.heavy[start:end], -least, side="right"))
            score[self.heavy_docs[start:end]] += gain * self.heavy[start:end]
            read += end - start
        some = np.flatnonzero((score > 0) & (score + spare >= bar))
        for most, gain, start, end in lists[optional:]:
            if not len(some):
                break
            at = np.searchsorted(self.docs[start:end], some)
            at[at == end - start] = 0
            held = self.docs[start:end][at] == some
            score[some[held]] += gain * self.weights[start:end][at[held]]
            read += int(np.count_nonzero(held))
            spare -= most
            some = some[score[some] + spare >= bar]
        return some, score[some], read


def _stretches(lists: pa.ListArray, values: int, rows: int) -> Iterator[tuple[int, int]]:
    """Stretches of lists, of at most so many lists, and of so many values unless it is one list."""
    ends, start = lists.offsets.to_numpy(), 0
    while start < len(lists):
        end = int(np.searchsorted(ends, int(ends[start]) + values, side="right")) - 1
        yield start, (end := max(start + 1, min(end, start + rows)))
        start = end


def _kept_terms(batches: Iterator[pa.RecordBatch], vocabulary: Broadcast) -> Iterator[pa.RecordBatch]:
    """key, length, and the asked terms (numbers) of each document with their counts."""
    known = pa.array(vocabulary.value, pa.string())
    for batch in batches:
        for start, end in _stretches(batch.column(1), WORDS, BATCH):
            part = batch.slice(start, end - start)
            terms = part.column(1)
            number = pc.index_in(terms.flatten(), value_set=known)
            doc = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
            asked = number.is_valid().to_numpy(zero_copy_only=False)
            pair, count = np.unique(doc[asked] * max(1, len(known)) + number.drop_null().to_numpy(), return_counts=True)
            doc, term = np.divmod(pair, max(1, len(known)))
            ends = pa.array(np.searchsorted(doc, np.arange(len(terms) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (term, count)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], ["key", "length", "terms", "tfs"])


def _shards(batches: Iterator[pa.RecordBatch], average: float) -> Iterator[tuple[pa.Array, Shard]]:
    """Keys and postings of documents of like length."""
    for batch in batches:
        for start, end in _stretches(batch.column("terms"), POSTINGS, BATCH):
            part = batch.slice(start, end - start)
            length = part.column("length").to_numpy()
            for rows in np.array_split(np.argsort(length, kind="stable"), SHARDS):
                some = part.take(pa.array(rows))
                doc = np.repeat(np.arange(len(rows)), np.diff(some.column("terms").offsets.to_numpy()))
                term, tf = (some.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
                weight = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length[rows][doc] / average))
                yield some.column("key"), Shard(doc, term, weight, len(rows))


def _seeded(batches: Iterator[pa.RecordBatch], asked: Broadcast, average: float, k: int) -> Iterator[pa.RecordBatch]:
    """number of the question, the best scores of some documents of each shard, postings read."""
    questions, gains = asked.value
    for _, shard in _shards(batches, average):
        numbers, scores, reads = [], [], []
        of = np.zeros(len(gains))
        for q, terms in enumerate(questions):
            of[terms] = gains[terms]
            best, read = shard.seeds(shard.lists(terms, gains[terms]), of, k)
            of[terms] = 0
            best = np.sort(best)[::-1][:k]
            numbers.append(np.full(len(best) + 1, q))
            scores += [*best.tolist(), None]
            reads += [0] * len(best) + [read]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), pa.array(scores, pa.float64()), pa.array(reads, pa.int64())], ["q", "score", "read"])


def _first(keys: pa.Array, some: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which of some documents (with their scores) may be among the k best: of those of one score the k smallest keys, by score and key."""
    place = np.empty(len(some), np.int64)
    place[pc.sort_indices(keys.take(pa.array(some))).to_numpy()] = np.arange(len(some))
    order = np.lexsort((place, -score))
    ordered = score[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[(nth < k) & (ordered >= ordered[k - 1] - SLACK)]


def _ranked(batches: Iterator[pa.RecordBatch], asked: Broadcast, bars: Broadcast, average: float, k: int) -> Iterator[pa.RecordBatch]:
    """number of the question, key and score of documents at or above the bar; a row without score has the postings read and there are."""
    (questions, gains), bar = asked.value, bars.value.copy()
    leading: list[np.ndarray] = [np.zeros(0)] * len(questions)
    for keys, shard in _shards(batches, average):
        numbers, docs, scores, reads, alls = [], [], [], [], []
        for q, terms in enumerate(questions):
            lists = shard.lists(terms, gains[terms])
            some, score, read = shard.above(lists, bar[q])
            if len(some) > k:
                first = _first(keys, some, score, k)
                some, score = some[first], score[first]
            if len(some):
                leading[q] = np.sort(np.append(leading[q], score))[::-1][:k]
                if len(leading[q]) == k:
                    bar[q] = max(bar[q], leading[q][-1] - SLACK)
            numbers.append(np.full(len(some) + 1, q))
            docs += [*some.tolist(), None]
            scores += [*score.tolist(), None]
            reads += [0] * len(some) + [read]
            alls += [0] * len(some) + [sum(x[3] - x[2] for x in lists)]
        columns = [pa.array(np.concatenate(numbers)), keys.take(pa.array(docs, pa.int64())), pa.array(scores, pa.float64()), pa.array(reads, pa.int64()), pa.array(alls, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["q", "key", "score", "read", "postings"])


def _blocks(queries: DataFrame, query_id: str, query_text: str) -> Iterator[list]:
    """(id, distinct terms) of the questions, in blocks of about BLOCK_BYTES."""
    asked = queries.select(F.col(query_id).alias("id"), F.array_distinct(tokens(F.coalesce(F.col(query_text), F.lit("")))).alias("terms")).where("size(terms) > 0")
    size = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.length(t) + 16))).first()[0]
    blocks = -(-(size or 0) // BLOCK_BYTES)
    for block in range(blocks):
        yield [(r.id, r.terms) for r in asked.where(F.pmod(F.xxhash64("id", "terms"), F.lit(blocks)) == block).collect()]


def search_counted(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """query_id, key, score and rank of the k best documents (those without a query term are not ranked); and for each query the postings
    of its terms and how many of them were read.

    Per block of questions: the documents' asked terms are written to the shared folder; some documents of each shard are scored, and
    the k-th best of all their scores is the bar of a question; then each task ranks what can reach the bar.
    """
    spark, kinds, done = docs.sparkSession, dict(docs.dtypes) | {"?": dict(queries.dtypes)[query_id]}, []
    split = tokenized(docs, key, text).where(F.col(key).isNotNull())
    for n_block, block in enumerate(_blocks(queries, query_id, query_text)):
        if n_block == 1:
            split = stage(split, "terms")  # more than one block reads them
        vocabulary = sorted({t for _, terms in block for t in terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        words = spark.sparkContext.broadcast(vocabulary)

        def narrowed(batches: Iterator[pa.RecordBatch], words: Broadcast = words) -> Iterator[pa.RecordBatch]:
            return _kept_terms(batches, words)

        held = split.select(key, "terms", "length").mapInArrow(narrowed, f"key {kinds[key]}, length int, terms array<int>, tfs array<int>")
        held = stage(held, "postings")
        size = corpus(held).first()
        counted = held.select(F.explode("terms").alias("t")).groupBy("t").agg(idf(F.lit(size.n), F.count(F.lit(1))).alias("idf")).toArrow()
        gains = np.zeros(len(vocabulary))
        gains[counted.column("t").to_numpy()] = counted.column("idf").to_numpy()
        asked = spark.sparkContext.broadcast(([np.array([number[t] for t in terms]) for _, terms in block], gains))
        average = float(size.average or 1)

        def seeded(batches: Iterator[pa.RecordBatch], asked: Broadcast = asked, average: float = average) -> Iterator[pa.RecordBatch]:
            return _seeded(batches, asked, average, k)

        seeds = stage(held.mapInArrow(seeded, "q long, score double, read long"), "seeds")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
        bar = np.full(len(block), -np.inf)
        found = seeds.where("score IS NOT NULL").withColumn("n", place).where(F.col("n") == k).toArrow()
        bar[found.column("q").to_numpy()] = found.column("score").to_numpy() - SLACK
        bars = spark.sparkContext.broadcast(bar)

        def ranked(batches: Iterator[pa.RecordBatch], asked: Broadcast = asked, bars: Broadcast = bars, average: float = average) -> Iterator[pa.RecordBatch]:
            return _ranked(batches, asked, bars, average, k)

        rows = stage(held.mapInArrow(ranked, f"q long, key {kinds[key]}, score double, read long, postings long"), "ranked")
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"q long, id {kinds['?']}")
        scored = rows.where("score > 0").select("q", "key", F.round("score", 6).alias("score")).where("score > 0")
        best = top_by(scored, ["q"], k, F.desc("score"), F.asc("key")).join(names, "q").select(F.col("id").alias(query_id), F.col("key").alias(key), "score", "rank")
        work = rows.where("score IS NULL").select("q", "read", "postings").unionByName(seeds.where("score IS NULL").select("q", "read", F.lit(0).cast("long").alias("postings")))
        work = work.groupBy("q").agg(F.sum("postings").alias("postings"), F.sum("read").alias("read")).join(names, "q").select(F.col("id").alias(query_id), "postings", "read")
        done.append((best, work))
    if not done:
        none = spark.createDataFrame([], f"`{query_id}` {kinds['?']}, `{key}` {kinds[key]}, score double, rank long")
        return none, spark.createDataFrame([], f"`{query_id}` {kinds['?']}, postings long, read long")
    return tuple(reduce(DataFrame.unionByName, some) for some in zip(*done, strict=True))


def search(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """query_id, key, score and rank of the k best documents; documents without a query term are not ranked."""
    return search_counted(docs, queries, k, key, text, query_id, query_text)[0]
