"""Queries through the table functions and the page source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import lexical, table_functions, vector
from brindle.session import scratch
from brindle.sources import wiki

from .base import query, table
from .reports import timeline_events
from .search import _BM25, _COSINE, _nearest


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every fiftieth one; a vector's page is its label."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("page"))
    return _nearest(spark, sf_dir, 80).join(labels, "vec_id").select(F.col("query_id").alias("question"), "page", F.col("vec_id").alias("chunk"), "score")


@query(f"""WITH {_COSINE}, b AS (SELECT query_id AS question, label AS page, vec_id AS chunk, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS n FROM vector WHERE rank <= 80),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, page, chunk)::INT AS rank FROM b WHERE n = 1)
SELECT question, rank, page, round(score, 6) AS score, chunk FROM r WHERE rank <= 5""")
def search_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SELECT ... FROM search(TABLE(hits), 5)"""
    table_functions.register(spark)
    found = spark.sql("SELECT * FROM search(TABLE({hits}), 5)", hits=_vectors(spark, sf_dir))
    return found.select("question", "rank", "page", F.round("score", 6).alias("score"), F.variant_get("result", "$.chunk", "bigint").alias("chunk"))


@query(f"""WITH {_BM25}, near AS (
  SELECT item_id, vec_id AS doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS item_id, p.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS score
    FROM embeddings q JOIN benchmark ON q.vec_id = item_id, embeddings p)),
both_lists AS (SELECT item_id, doc_id, rank, 'near' AS list FROM near UNION ALL SELECT item_id, doc_id, rank, 'words' FROM lexical),
fused AS (SELECT item_id AS question, doc_id AS page, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, max(rank) FILTER (list = 'words') AS words_rank, count(*) AS lists FROM both_lists WHERE rank <= 10 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, page)::INT AS rank FROM fused)
SELECT question, rank, page, round(score, 6) AS score, words_rank, lists FROM r WHERE rank <= 10""")
def hybrid_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SELECT ... FROM hybrid(TABLE(ranked), 10, 10)"""
    asked, points = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    vectors = points.join(asked.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "question")
    near = vector.nearest(vectors, points, 10, query_id="question").select("question", F.lit("near").alias("list"), F.col("vec_id").alias("page"), "rank")
    words = lexical.search(table(spark, sf_dir, "documents"), asked, 10).select(F.col("item_id").alias("question"), F.lit("words").alias("list"), F.col("doc_id").alias("page"), "rank")
    table_functions.register(spark)
    found = spark.sql("SELECT * FROM hybrid(TABLE({ranked}), 10, 10)", ranked=near.unionByName(words))
    part = lambda name: F.variant_get("result", f"$.{name}", "bigint")
    return found.select("question", "rank", "page", F.round("score", 6).alias("score"), part("ranks.words").alias("words_rank"), part("lists").alias("lists"))


@query("""WITH e AS (SELECT event_id, user_id AS scope, event_type, floor(epoch(ts))::BIGINT AS date_ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
r AS (SELECT *, row_number() OVER w::INT AS rank, (date_ts - lag(date_ts) OVER w) // 86400 AS days FROM e WINDOW w AS (PARTITION BY scope ORDER BY date_ts, event_id))
SELECT scope, rank, event_id, days FROM r WHERE rank <= 20""")
def timeline_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SELECT ... FROM timeline_of(TABLE(events), kind, 0, 20)"""
    table_functions.register(spark)
    events = timeline_events(spark, sf_dir).select("scope", "event_id", "event_type", "date_ts")
    kind = events.agg(F.min("event_type")).first()[0]
    found = spark.sql("SELECT * FROM timeline_of(TABLE({events}), :kind, 0, 20)", args={"kind": kind}, events=events)
    return found.select("scope", "rank", "event_id", F.variant_get("result", "$.days", "bigint").alias("days"))


@query("SELECT page_id, url, length(html) AS n_chars FROM pages WHERE page_id > 20")
def pages_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages edited after a time, read through the page source from a landed folder; a page's edit time follows its number."""
    path = f"{scratch(spark, 'wiki')}"
    edited = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id"))
    wiki.land(table(spark, sf_dir, "pages").withColumn("last_edited_time", edited), path)
    since = F.timestamp_seconds(F.lit(1_704_067_200 + 20))
    return wiki.pages(spark, path).where(F.col("last_edited_time") > since).select("page_id", "url", F.length("html").cast("long").alias("n_chars"))
