"""The search tools as functions of a Store, and as table functions for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import is_complex

from . import events, graph, lexical, pages, ranking, vector


@dataclass(frozen=True)
class Store:
    """The tables of one department. chunks: page_id, source_url, chunk_index, text, embedding, chunk_id (long)."""

    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    decisions: DataFrame
    events: DataFrame


Embed = Callable[[str], list[float]]
Decompose = Callable[[str], list[str]]


def sub_queries(spark: SparkSession, question: str, decompose: Decompose | None) -> list[str]:
    """The question and, if it is complex, the parts that decompose names; a failure leaves the question alone."""
    if decompose is None or not spark.range(1).select(is_complex(F.lit(question))).first()[0]:
        return [question]
    try:
        parts = [p for p in decompose(question) if isinstance(p, str) and p.strip()]
    except Exception:  # an injected model may fail in any way; the search goes on without it
        parts = []
    return [question, *[p for p in parts if p != question]]


def semantic_search(store: Store, question: str, embed: Embed, limit: int = 5, oversample: int = 8) -> DataFrame:
    """The best pages by their nearest chunk."""
    spark = store.chunks.sparkSession
    asked = spark.createDataFrame([(0, [float(x) for x in embed(question)])], "query_id long, embedding array<double>")
    hits = vector.nearest(asked, store.chunks, limit * oversample, point_id="chunk_id").join(store.chunks.select("chunk_id", "source_url", "chunk_index"), "chunk_id")
    return pages.page_hits(hits.withColumn("chunk", F.col("chunk_index")), "query_id", "source_url", limit).drop("query_id")


def hybrid_search(store: Store, question: str, embed: Embed, decompose: Decompose | None = None, limit: int = 10, oversample: int = 8) -> DataFrame:
    """Vector and lexical hits of every sub-query fused, merged by coverage and cut to the response budget."""
    spark = store.chunks.sparkSession
    asked = sub_queries(spark, question, decompose)
    vectors = spark.createDataFrame([(i, [float(x) for x in embed(q)]) for i, q in enumerate(asked)], "query_id long, embedding array<double>")
    texts = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    k = limit * oversample
    near = vector.nearest(vectors, store.chunks, k, point_id="chunk_id").select("query_id", "chunk_id", "rank")
    words = lexical.search(store.chunks, texts, k, key="chunk_id", query_id="query_id").select("query_id", "chunk_id", "rank")
    fused = ranking.fuse(near.unionByName(words), ["query_id", "chunk_id"]).join(store.chunks.select("chunk_id", "source_url"), "chunk_id")
    best = fused.groupBy("query_id", "source_url").agg(F.max("score").alias("score"))
    merged = ranking.merge_by_coverage(best, [], "source_url").withColumn("_all", F.lit(0))
    top = ranking.top_by(merged, ["_all"], limit, F.desc("score"), F.asc("source_url"))
    whole = pages.assembled(store.chunks.join(top.select("source_url"), "source_url", "left_semi"), "source_url").drop("chunks")
    return ranking.fit_budget(top.join(whole, "source_url"), ["_all"], F.length("text")).drop("_all")


def graph_search(store: Store, entity: str, depth: int = 1) -> DataFrame:
    names = store.nodes.where(F.col("name") == entity).select("name").distinct()
    found = graph.neighbours(store.edges, names)
    return found if depth < 2 else found.select("name", "rel_name", "other").unionByName(graph.two_hops(store.edges, names).select("name", F.concat_ws(" > ", "rel_1", "rel_2").alias("rel_name"), F.col("target").alias("other")))


def path_search(store: Store, start: str, end: str, max_hops: int = 6) -> DataFrame:
    return graph.path_nodes(store.edges, start, end, max_hops)


def decision_trace(store: Store, entity: str, max_depth: int = 4) -> DataFrame:
    """Chains of decisions from (down) and to (up) those that name an entity."""
    roots = store.decisions.where(F.contains("subject", F.lit(entity)) | F.contains("outcome", F.lit(entity))).select("decision_id")
    down = graph.led_to(store.decisions)
    up = down.select(F.col("next_id").alias("decision_id"), F.col("decision_id").alias("next_id"))
    return graph.trace(down, roots, max_depth).withColumn("direction", F.lit("down")).unionByName(graph.trace(up, roots, max_depth).withColumn("direction", F.lit("up")))


def timeline_search(store: Store, **filters: object) -> DataFrame:
    return events.with_neighbours(events.timeline(store.events, **filters), told="title")


def register(spark: SparkSession, store: Store) -> None:
    """The store's tables as views, so that SQL reaches them; the SQL functions take their parameters as arguments."""
    for name in ("chunks", "nodes", "edges", "decisions", "events"):
        getattr(store, name).createOrReplaceTempView(f"store_{name}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION timeline(kind STRING, since BIGINT, until BIGINT) RETURNS TABLE (event_id STRING, scope STRING, title STRING, date_ts BIGINT)"
        " RETURN SELECT CAST(event_id AS STRING), CAST(scope AS STRING), title, date_ts FROM store_events e WHERE e.event_type = kind AND e.date_ts BETWEEN since AND until"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION relations(entity STRING) RETURNS TABLE (src STRING, rel_name STRING, dst STRING)"
        " RETURN SELECT src, rel_name, dst FROM store_edges e WHERE e.src = entity OR e.dst = entity"
    )


def applied(rows: DataFrame, function: Callable[..., object], key: str, *arguments: str) -> DataFrame:
    """key, result and error of a Python function over the rows' arguments, in Arrow batches; a row that fails has its error, and the
    others are not touched by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results: list[str | None] = []
            errors: list[str | None] = []
            for values in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                try:
                    found = function(*values)
                    results.append(None if found is None else str(found))
                    errors.append(None)
                except Exception as problem:  # whatever a given function raises is this row's alone
                    results.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(results, pa.string()), pa.array(errors, pa.string())], [key, "result", "error"])

    return rows.select(key, *arguments).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, result string, error string")
