"""JSON, vectors and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BM25_K1, BM25_B = 1.5, 0.75
RRF_K = 60
COVERAGE_BOOST = 0.20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, length: Column, average: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def rrf_term(rank: Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (k + rank)


def coverage_score(score: Column, coverage: Column, boost: float = COVERAGE_BOOST) -> Column:
    return score * (1 + boost * (coverage - 1))


def json_array(text: Column, schema: str) -> Column:
    """The array in a text that may wrap it in fences or prose; null where there is none or it cannot be read."""
    bare = F.regexp_replace(text, r"```[a-z]*", "")
    return F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit("")), f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})


def json_texts(text: Column) -> Column:
    """The elements of the array in a text that may wrap it in fences or prose, each as JSON text; none where there is no array."""
    bare = F.regexp_replace(text, r"```[a-z]*", "")
    found = F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit("")), "array<string>")
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda e: e.isNotNull())


def json_object(text: Column, schema: str) -> Column:
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def salvage_status(text: Column, schema: str) -> Column:
    """error, empty or ok: a missing array is an error, not an empty result."""
    found = json_array(text, schema)
    return F.when(found.isNull(), "error").when(F.size(found) == 0, "empty").otherwise("ok")


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    return F.least(F.greatest(F.coalesce(value.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))
