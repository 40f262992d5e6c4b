"""Triples from a model's answers, and the chunks that are their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.ids import chunk_id
from brindle.functions.structured import json_texts

QUOTE = 40


def _node(raw: Column) -> Column:
    """A node's name and type, from an object or a plain text."""
    given = F.from_json(raw, "name STRING, type STRING")
    is_object = F.coalesce(raw.startswith("{"), F.lit(False))
    return F.struct(
        F.when(is_object, F.coalesce(given["name"], F.lit(""))).otherwise(F.coalesce(raw, F.lit(""))).alias("name"),
        F.when(is_object, F.coalesce(given["type"], F.lit("Unknown"))).otherwise("Unknown").alias("type"),
    )


def _predicate(raw: Column) -> Column:
    """A predicate's name, condition, duration and order; an order that is no whole number is left out."""
    given = F.from_json(raw, "name STRING, condition STRING, duration STRING, `order` STRING")
    is_object = F.coalesce(raw.startswith("{"), F.lit(False))
    return F.struct(
        F.when(is_object, F.coalesce(given["name"], F.lit(""))).otherwise(F.coalesce(raw, F.lit(""))).alias("name"),
        F.when(is_object, given["condition"]).alias("condition"),
        F.when(is_object, given["duration"]).alias("duration"),
        F.when(is_object, given["order"].try_cast("int")).alias("order"),
    )


def cleaned(answers: DataFrame, text: str) -> DataFrame:
    """A row for each triple of an answer (a JSON array, in fences or prose maybe) with a quote as evidence; other elements are dropped."""
    parts = answers.withColumn("_raw", F.explode(F.filter(json_texts(F.col(text)), lambda e: e.startswith("{"))))
    read = parts.withColumn("_t", F.from_json("_raw", "subject STRING, predicate STRING, object STRING, evidence_quote STRING"))
    quote = F.trim(F.coalesce(F.col("_t.evidence_quote"), F.lit("")))
    kept = read.withColumn("evidence_quote", quote).where("evidence_quote <> ''")
    return kept.select(
        *[c for c in answers.columns if c != text],
        _node(F.col("_t.subject")).alias("subject"), _predicate(F.col("_t.predicate")).alias("predicate"), _node(F.col("_t.object")).alias("object"), "evidence_quote",
    )


def with_evidence(edges: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Edges with the text of their evidence chunk (column evidence_chunk_id), null where there is none."""
    return edges.join(chunks.select(F.col(key).alias("evidence_chunk_id"), F.col("text").alias("evidence")), "evidence_chunk_id", "left")


def evidence_chunks(edges: DataFrame, chunks: DataFrame, url: str = "source_url") -> DataFrame:
    """Edges (url, evidence_quote) with evidence_chunk_index and evidence_chunk_id: the first chunk of their page that holds the quote's
    first letters, whatever their case; null where none does. An edge meets its page's chunks as one list and looks through it."""
    pages = chunks.groupBy(url).agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.lower("text").alias("t")))).alias("_chunks"))
    start = F.trim(F.lower(F.substring(F.coalesce("evidence_quote", F.lit("")), 1, QUOTE)))
    joined = edges.withColumn("_quote", start).join(pages, url, "left")
    first = F.get(F.filter("_chunks", lambda c: (F.col("_quote") != "") & F.contains(c["t"], F.col("_quote"))), F.lit(0))["chunk_index"]
    found = joined.withColumn("evidence_chunk_index", first)
    return found.withColumn("evidence_chunk_id", F.when(F.col("evidence_chunk_index").isNotNull(), chunk_id(F.col(url), F.col("evidence_chunk_index")))).drop("_quote", "_chunks")
