"""Hard negatives, exact top-k search and source divergence against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import divergence, exact_vectors
from brindle.llm.divergence import audit, counted, radix_order
from brindle.llm.exact_vectors import Best, matrix
from brindle.llm.hard_negatives import mine, packed_products
from brindle.llm.topk_search import products, search

VECTORS = "vec_id long, embedding array<float>, label int, score string, key int, rank int, ints int"


def made(seed: int, n: int = 150) -> list[tuple]:
    """Vectors with ties, repeated rows, nulls, odd components, lengths and ids."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-0.5, -0.25, 0.0, 0.25, 0.5, 0.3)) for _ in range(6)], rng.randrange(3)) for i in range(n)]
    rows += [rows[50], rows[7], rows[7], (50, [0.5] * 6, 1), (None, [0.5] * 6, 1), (None, [0.5] * 6, None), (200, None, 1), (250, [0.1, None], 2)]
    rows += [(300, [math.nan] * 6, 1), (350, [math.inf] + [0.0] * 5, 0), (400, [0.5, 0.5], 1), (450, [], 2), (-50, [0.5] * 8, 0), (-1, [0.25] * 6, 0)]
    return [(*r, "x", 1, 2, 3) for r in rows]


def usable(rows, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return kept


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def before(row):
    return (-row[0], row[1] is None, row[1] or 0)


def plain_mine(rows, every):
    rows = [r for r in usable(rows, 256) if r[2] is not None]
    out = []
    for i, v, label in {(i, tuple(v), label) for i, v, label in rows if i is not None and i % every == 0}:
        scored = sorted(((dot(v, w), j, m) for j, w, m in rows if j != i), key=before)
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(s, j) for s, j, m in scored if m != label and 50 * p <= 100 * s <= 95 * p][:3]
            out += [(i, positive, n + 1, j, p, s) for n, (s, j) in enumerate(fit)]
    return out


def plain_search(rows, every, k):
    rows, out = usable(rows, 64), []
    for i, v in {(i, tuple(v)) for i, v, _ in rows if i is not None and i % every == 0}:
        out += [(i, n + 1, j, s) for n, (s, j) in enumerate(sorted(((dot(v, w), j) for j, w, _ in rows if j != i), key=before)[:k])]
    return out


def order(rows):
    return sorted(tuple(r) for r in [tuple((x is None, x or 0) for x in r) for r in rows])


@pytest.fixture(params=[None, 2_000], ids=["one block", "many blocks"])
def block_bytes(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(exact_vectors, "BLOCK_BYTES", request.param)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_are_those_of_all_pairs(spark, block_bytes, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = mine(df.where("vec_id % 10 = 0"), df, positives=5, negatives=3, least=(1, 2), most=(19, 20), scale=256).collect()
    want = plain_mine(rows, 10)
    assert len(want) > 50
    assert order(got) == order(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_topk_is_that_of_all_pairs(spark, block_bytes, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = search(df.where("vec_id % 10 = 0"), df, k=20, scale=64).select("query_id", "rank", "vec_id", "score").collect()
    assert order(got) == order(plain_search(rows, 10, 20))


def test_topk_with_fewer_candidates_than_k_and_without_any(spark):
    rows = made(3)[:8]
    df = spark.createDataFrame(rows, VECTORS)
    assert order(search(df, df, k=20, scale=64).select("query_id", "rank", "vec_id", "score").collect()) == order(plain_search(rows, 1, 20))
    none = df.where("false")
    assert search(none, df, k=20, scale=64).collect() == search(df, none, k=20, scale=64).collect() == []
    assert mine(none, df, 5, 3, (1, 2), (19, 20), 256).collect() == mine(df, none, 5, 3, (1, 2), (19, 20), 256).collect() == []


@pytest.mark.parametrize("most", [0, 1, 30, 500, 10**4, 10**6, 10**8, 10**9])
def test_packed_and_plain_products_are_exact(most):
    rng = np.random.default_rng(most)
    for a, c, d in ((1, 1, 1), (3, 7, 5), (9, 40, 8), (2, 0, 3), (0, 4, 3), (3, 4, 0)):
        left, right = rng.integers(-most, most + 1, (a, d)), rng.integers(-most, most + 1, (c, d))
        if a and c and d:
            left[0], right[-1] = most, -most
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in right] for p in left]
        assert packed_products(left, right).tolist() == want
        assert products(left, right).tolist() == want


def test_several_scores_share_a_word(monkeypatch):
    """Vectors as long as the given tables' take a third of the words that candidates have rows."""
    import brindle.llm.hard_negatives as h

    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.normal(size=(300, 64)) / 8).astype(np.int64)
    words = []
    real = np.zeros
    monkeypatch.setattr(h.np, "zeros", lambda shape, *a: words.append(shape) or real(shape, *a))
    assert (packed_products(rows[:5], rows) == rows[:5] @ rows.T).all()
    assert words[0][0] <= 150


def test_scores_beyond_64_bits_end_in_an_error():
    wide = np.full((1, 4), 2**40)
    for function in (packed_products, products):
        with pytest.raises(OverflowError):
            function(wide, wide)
        assert function(wide, wide // 2**20).tolist() == [[4 * 2**60]]


def test_best_keeps_ties_by_id_over_any_order():
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(-3, 4, (6, 200)), rng.permutation(200)
    nulls, allowed = ids % 17 == 0, rng.random((6, 200)) < 0.7
    best = Best(6, 5)
    for i in range(0, 200, 23):
        part = slice(i, i + 23)
        best.add(np.arange(6), scores[:, part], ids[part], nulls[part], allowed[:, part])
    row, name, score = best.found()
    got = list(zip(row.tolist(), name.to_pylist(), score.to_pylist(), strict=True))
    want = []
    for r in range(6):
        want += sorted(((r, None if nulls[j] else int(ids[j]), int(scores[r, j])) for j in range(200) if allowed[r, j]), key=lambda x: (-x[2], x[1] is None, x[1] or 0))[:5]
    assert got == want


def test_matrix_cuts_and_fills():
    assert matrix(pa.array([[1, 2, 3], [], [4]], pa.list_(pa.int64())), 2).tolist() == [[1, 2], [0, 0], [4, 0]]


# --- source divergence ---

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return [t.translate(UPPER) for t in TERM.findall(text or "")]


def plain_audit(rows, min_docs, scale, prior, top):
    rows = [(text or "", lang or "", source or "") for text, lang, source in rows]
    seen, count, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for i, (text, lang, source) in enumerate(rows):
        groups[lang].add(source)
        for t in terms_of(text):
            seen[lang, t].add(i)
            count[lang, source][t] += 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (at, t), docs in seen.items() if at == lang and len(docs) >= min_docs]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + scale * (c[t] + prior) // (total + prior * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, n + 1) for n, (v, _, o) in enumerate(pairs)]
            words = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, n + 1) for n, (v, _, t) in enumerate(words[:top])]
    return out


ODD = ["", None, "123 ...", "Aa aA aa", "naïve NAÏVE Ünder", "日本語 日本", "x" * 8, "x" * 9, "y" * 16, "y" * 17, "Z" * 40, "a\x00b", "donaudampfschifffahrt and donaudampfschifffahrten", "K K k", "word word", "é" * 30]


def texts(seed, n=120):
    rng = random.Random(seed)
    names = ["the", "cat", "Cat", "sat", "internationalisation", "straße", "ab", "abcdefgh", "abcdefghi", "naïveté", "日本語", "x" * 25, "x" * 26]
    rows = [(" ".join(rng.choice(names) for _ in range(rng.randrange(12))), rng.choice(("en", "de", None)), rng.choice(("a", "b", "", None, "ü"))) for _ in range(n)]
    return rows + [(t, rng.choice(("en", "xx")), rng.choice("abc")) for t in ODD * 2] + rows[:5]


@pytest.mark.parametrize("min_docs, scale", [(3, 1_000_000_000), (1, 50), (1_000, 1_000_000_000)])
def test_audit_against_plain_counts(spark, min_docs, scale):
    rows = texts(min_docs)
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(4)
    got = audit(df, min_docs=min_docs, scale=scale, prior=5, top=6).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_audit(rows, min_docs, scale, 5, 6))


def test_audit_over_more_sources_than_a_block_holds(spark):
    rng = random.Random(8)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(6))), rng.choice(("en", "de")), f"s{rng.randrange(11)}") for _ in range(200)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = audit(df, min_docs=2, scale=1_000_000, prior=5, top=3, block=3).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_audit(rows, 2, 1_000_000, 5, 3))


def test_audit_of_an_empty_table(spark):
    assert audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_share_is_exact_where_64_bits_are_too_few(spark):
    row = spark.range(1).select(divergence.share(F.lit(10**13 + 7), F.lit(3 * 10**13), F.lit(10**6), 10**9, 5).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**13 + 12) // (3 * 10**13 + 5 * 10**6)


@pytest.mark.parametrize("seed", range(6))
def test_packed_counts_are_those_of_the_pattern(seed):
    rng = random.Random(seed)
    alphabet = "abcXYZ éß日 \n\t.9" if seed % 2 else "aA b"
    some = ["".join(rng.choice(alphabet) * rng.choice((1, 1, 1, 9)) for _ in range(rng.randrange(40))) for _ in range(50)] + ODD[2:]
    some = [t for t in some if t is not None]
    group = np.array([rng.randrange(3) for _ in some])
    column = pa.array(["skipped before", *some]).slice(1)
    got, docs = Counter(), {}
    for g, terms, n, d in counted(column, group):
        for key in zip(g.tolist(), terms.to_pylist(), n.tolist(), d.tolist(), strict=True):
            assert key[:2] not in docs
            got[key[:2]], docs[key[:2]] = key[2], key[3]
    want, seen = Counter(), defaultdict(set)
    for i, t in enumerate(some):
        for term in terms_of(t):
            want[int(group[i]), term] += 1
            seen[int(group[i]), term].add(i)
    assert got == want and docs == {k: len(v) for k, v in seen.items()}


def test_radix_order_is_stable():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 3, 500).astype(np.uint64) << np.uint64(40), rng.integers(0, 2**63, 500).astype(np.uint64) // np.uint64(2**61)]
    group = rng.integers(0, 4, 500)
    assert radix_order(words, group).tolist() == np.lexsort((np.arange(500), group, words[1], words[0])).tolist()
