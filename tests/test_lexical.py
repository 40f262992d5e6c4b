"""Pruned BM25 against plain scores of all documents."""

from __future__ import annotations

import math
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.operators import lexical


def plain(docs, questions, k):
    terms = [(key, Counter(t.split())) for key, t in docs]
    n = sum(1 for _, c in terms if c)
    average = sum(c.total() for _, c in terms) / max(n, 1)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for q, text in questions:
        scored = []
        for key, c in terms:
            s = 0.0
            for t in set((text or "").split()):
                if c[t]:
                    s += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / average))
            if round(s, 6) > 0:
                scored.append((-round(s, 6), key))
        out += [(q, key, -s, i + 1) for i, (s, key) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_pruned_search_finds_what_a_full_one_does(spark, monkeypatch, small_blocks):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice((0, 1, 5, 30, 200))))) for i in range(800)]
    docs += [(1_000 + i, docs[7][1]) for i in range(12)]  # ties
    questions = [(i, " ".join(rng.choices(words, weights, k=12))) for i in range(20)] + [(50, ""), (51, None), (52, "unheard of"), (53, docs[7][1])]
    if small_blocks:
        monkeypatch.setattr(lexical, "BLOCK_BYTES", 1_000)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).union(spark.createDataFrame([(5_000, None)], "doc_id long, text string"))
    q = spark.createDataFrame(questions, "item_id long, text string")
    best, work = lexical.search_counted(d, q, 10)
    got = sorted((r.item_id, r.doc_id, round(r.score, 6), r["rank"]) for r in best.collect())
    want = plain([*docs, (5_000, "")], questions, 10)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, want, strict=True)) < 2e-6
    assert work.count() == 22


def test_pruned_search_reads_a_part_of_the_postings(spark):
    rng = random.Random(9)
    words, weights = [f"w{i}" for i in range(300)], [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice((5, 30, 60))))) for i in range(6_000)]
    questions = [(i, " ".join(rng.choices(words, weights, k=12))) for i in range(10)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    best, work = lexical.search_counted(d, spark.createDataFrame(questions, "item_id long, text string"), 5)
    counted = work.agg(F.sum("postings"), F.sum("read")).first()
    assert 0 < 2 * counted[1] < counted[0]
    assert sorted((r.item_id, r.doc_id) for r in best.collect()) == sorted(w[:2] for w in plain(docs, questions, 5))


def test_search_without_questions_or_documents(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(d, q.where("false"), 5).collect() == []
    assert lexical.search(d.where("false"), q, 5).collect() == []


def held_mb(work):
    """MB of numpy at most while work's batches are taken one by one, and how many there are."""
    tracemalloc.start()
    n = sum(1 for _ in work)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6, n


def test_words_and_postings_of_long_documents_are_held_in_bounded_numbers():
    rng = np.random.default_rng(2)
    docs, words = 1_500, 4_000
    ends = pa.array(np.arange(0, docs * words + 1, words, dtype=np.int32))
    vocabulary = [f"w{i}" for i in range(2 * words)]
    number = np.concatenate([rng.choice(2 * words, words, replace=False) for _ in range(docs)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(ends, pa.array(vocabulary).take(pa.array(number)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(docs)), lists, pa.array([words] * docs, pa.int32())], ["key", "terms", "length"])
    mb, _ = held_mb(lexical._kept_terms(iter([batch]), SimpleNamespace(value=vocabulary)))
    assert mb < 60  # 6 million words: some 300 MB at once
    kept = pa.Table.from_batches(list(lexical._kept_terms(iter([batch]), SimpleNamespace(value=vocabulary)))).combine_chunks().to_batches()[0]
    assert kept.column("key").to_pylist() == list(range(docs)) and set(kept.column("tfs").flatten().to_pylist()) == {1}
    assert (kept.column("terms").flatten().to_numpy().reshape(docs, words) == np.searchsorted(np.arange(2 * words), np.sort(number.reshape(docs, words), axis=1))).all()
    mb, n = held_mb(lexical._shards(iter([kept]), float(words)))
    assert mb < 250 and n == 12  # 520 documents at a time: 2 million postings
    assert sum(shard.size for _, shard in lexical._shards(iter([kept]), float(words))) == docs


def test_of_equal_documents_a_shard_gives_the_first_keys_only():
    keys = pa.array([f"k{i:04}" for i in random.Random(1).sample(range(4_000), 3_000)])
    batch = pa.RecordBatch.from_arrays(
        [keys, pa.array([2] * 3_000, pa.int32()), pa.array([[0, 1]] * 3_000, pa.list_(pa.int32())), pa.array([[1, 1]] * 3_000, pa.list_(pa.int32()))], ["key", "length", "terms", "tfs"]
    )
    asked = SimpleNamespace(value=([np.array([0, 1])], np.array([0.5, 0.25])))
    rows = [r for b in lexical._ranked(iter([batch]), asked, SimpleNamespace(value=np.array([-np.inf])), 2.0, 7) for r in b.to_pylist()]
    scored = sorted(r["key"] for r in rows if r["score"] is not None)
    assert len(scored) == 4 * 7 and scored[:7] == sorted(keys.to_pylist())[:7]
    assert sum(r["postings"] for r in rows) == 6_000


def test_search_ranks_ties_over_shards_by_key(spark):
    docs = [(i, ("a b", "a b c", "b")[i % 3]) for i in random.Random(3).sample(range(900), 900)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = lexical.search(d, spark.createDataFrame([(1, "a"), (2, "b c")], "item_id long, text string"), 9).collect()
    assert sorted((r.item_id, r.doc_id, r["rank"]) for r in got) == sorted(w[:2] + w[3:] for w in plain(docs, [(1, "a"), (2, "b c")], 9))
