"""Chunks, pages and hybrid search over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import assemble, chunks

from .ranking import fuse, top_by


def chunked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each chunk: key, chunk_index, chunk_total and text."""
    pieces = docs.select(key, chunks(F.coalesce(F.col(text), F.lit(""))).alias("_pieces"))
    return pieces.select(key, F.posexplode("_pieces").alias("chunk_index", "text"), F.size("_pieces").cast("long").alias("chunk_total")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def assembled(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages from their chunks."""
    return parts.groupBy(key).agg(assemble(F.col("text"), F.col("chunk_index")).alias("text"), F.count(F.lit(1)).alias("chunks"))


def page_hits(hits: DataFrame, query_id: str, page_id: str, limit: int) -> DataFrame:
    """The best pages of each query from chunk hits (score, chunk): best score, and the hit chunks by score."""
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("chunk").alias("c")))), lambda x: x["c"])
    pages = hits.groupBy(query_id, page_id).agg(F.max("score").alias("score"), ranked.alias("chunks"))
    return top_by(pages, [query_id], limit, F.desc("score"), F.asc(page_id))


def hybrid(vector_hits: DataFrame, lexical_hits: DataFrame, query_id: str, page_id: str, limit: int) -> DataFrame:
    """Both ranked lists fused by reciprocal rank, the best pages of each query."""
    both = vector_hits.select(query_id, page_id, "rank").unionByName(lexical_hits.select(query_id, page_id, "rank"))
    fused = fuse(both, [query_id, page_id]).withColumn("score", F.round("score", 6))
    return top_by(fused, [query_id], limit, F.desc("score"), F.asc(page_id))
