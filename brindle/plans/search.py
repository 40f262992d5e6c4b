"""Queries: text functions, chunks, lexical, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import ids, text
from brindle.operators import context, lexical, pages, ranking, vector

from .base import query, table

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
_STATS = f"""
split AS (SELECT doc_id, {_TOKENS} AS terms FROM documents),
lens AS (SELECT doc_id, terms, len(terms) AS length FROM split),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(length) AS average FROM lens WHERE length > 0),
post AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, length, unnest(terms) AS term FROM lens) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
_BM25 = f"""{_STATS},
asked AS (SELECT DISTINCT item_id, unnest({_TOKENS}) AS term FROM benchmark),
summed AS (
  SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average)))), 6) AS score
  FROM asked JOIN dfs USING (term) JOIN post USING (term), corpus GROUP BY 1, 2),
lexical AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM summed WHERE score > 0) WHERE rank <= 10)"""
_COSINE = """
scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, p.label, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q, embeddings p WHERE q.vec_id % 50 = 0),
vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 80)"""


def _nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    points = table(spark, sf_dir, "embeddings")
    return vector.nearest(points.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), points, k)


@query(f"WITH {_COSINE} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM vector WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_COSINE} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM vector WHERE rank <= 10")
def vector_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, with stretches of points ruled out by the triangle inequality."""
    return _by_pivots(spark, sf_dir)[0].select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _by_pivots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = table(spark, sf_dir, "embeddings")
    return vector.nearest_by_pivots(points.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), points, 10)


@query()
def vector_pivots_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distances the search by pivots computed for each query, of how many points."""
    return _by_pivots(spark, sf_dir)[1]


@query(f"""WITH {_COSINE},
best AS (SELECT query_id, label, max(score) AS score, count(*) AS hits FROM vector GROUP BY 1, 2)
SELECT query_id, label, round(score, 6) AS score, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM best) WHERE rank <= 10""")
def vector_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _nearest(spark, sf_dir, 80).drop("rank").join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    found = pages.page_hits(hits.withColumn("chunk", F.col("vec_id")), "query_id", "label", 10)
    return found.select("query_id", "label", F.round("score", 6).alias("score"), F.size("chunks").cast("long").alias("hits"), "rank")


@query(f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM lexical")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10).select("item_id", "doc_id", "score", "rank")


@query()
def bm25_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many postings each question's terms have, and how many of them the pruned search reads."""
    return lexical.search_counted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)[1]


@query(f"WITH {_STATS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, (SELECT sum(tf) FROM post p WHERE p.term = d.term)::BIGINT AS occurrences FROM dfs d, corpus")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = lexical.tokenized(table(spark, sf_dir, "documents"), "doc_id", "text")
    n = lexical.corpus(split).select("n").scalar()
    counted = lexical.postings(split, "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))
    return counted.select("term", "df", F.round(lexical.idf(n, F.col("df")), 6).alias("idf"), "occurrences")


_HYBRID = f"""WITH {_BM25},
qs AS (SELECT item_id FROM benchmark), near AS (
  SELECT item_id, vec_id AS doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS item_id, p.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS score
    FROM embeddings q JOIN qs ON q.vec_id = qs.item_id, embeddings p)),
fused AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT item_id, doc_id, rank FROM near WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, rank FROM lexical) GROUP BY 1, 2)
SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 10"""


@query(_HYBRID)
def hybrid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions (their vector: the one of the same id) against documents and vectors."""
    asked, points = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    vectors = points.join(asked.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "item_id")
    near = vector.nearest(vectors, points, 10, query_id="item_id").withColumnRenamed("vec_id", "doc_id")
    return pages.hybrid(near, lexical.search(table(spark, sf_dir, "documents"), asked, 10), "item_id", "doc_id", 10)


@query(f"""WITH {_COSINE} SELECT label, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM vector WHERE rank <= 10 GROUP BY label""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _nearest(spark, sf_dir, 10).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return ranking.fuse(hits, ["label"]).select("label", F.round("score", 6).alias("score"))


@query(f"""WITH {_COSINE},
merged AS (SELECT vec_id, count(*) AS coverage, max(score) AS best FROM vector WHERE rank <= 10 GROUP BY 1)
SELECT vec_id, coverage, round(best * (1 + 0.20::DOUBLE * (coverage - 1)), 6) AS score FROM merged""")
def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = ranking.merge_by_coverage(_nearest(spark, sf_dir, 10), [], "vec_id")
    return merged.select("vec_id", "coverage", F.round("score", 6).alias("score"))


_CHUNKS = """SELECT doc_id, idx - 1 AS chunk_index, len(pieces) AS chunk_total, pieces[idx] AS text FROM (
  SELECT doc_id, pieces, unnest(generate_series(1, len(pieces))) AS idx FROM (
    SELECT doc_id, list_filter([regexp_replace(substring(text, i * 600 + 1, 800), '^\\s+|\\s+$', '', 'g') FOR i IN generate_series(0, greatest(ceil((length(text) - 800) / 600.0), 0)::INT)], lambda c: c <> '') AS pieces FROM documents))"""


@query(_CHUNKS)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.chunked(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS text, count(*) AS chunks FROM ({_CHUNKS}) GROUP BY doc_id")
def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.assembled(pages.chunked(table(spark, sf_dir, "documents")))


@query(f"""WITH c AS ({_CHUNKS}), p AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS page FROM c GROUP BY doc_id),
o AS (SELECT doc_id, chunk_index, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM c),
a AS (SELECT doc_id, b, greatest(b - 500, 0) AS s, chunk_index AS i FROM o WHERE contains(text, 'of the')),
n AS (SELECT x.doc_id, x.i, x.s, count(*) AS n FROM a x JOIN a y ON x.doc_id = y.doc_id AND y.b >= x.s AND y.b < x.s + 1500 GROUP BY ALL),
best AS (SELECT doc_id, s AS found FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS r FROM n) WHERE r = 1),
w AS (SELECT p.doc_id, page, coalesce(found, 0)::INT AS s FROM p LEFT JOIN best USING (doc_id))
SELECT doc_id, CASE WHEN length(page) <= 1500 THEN page ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || substring(page, s + 1, 1500) || CASE WHEN s + 1500 < length(page) THEN '…' ELSE '' END END AS text FROM w""")
def anchor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page the window around the chunks that hold the word pair "of the"."""
    parts = pages.chunked(table(spark, sf_dir, "documents"))
    whole = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("parts"))
    texts = F.transform("parts", lambda p: p["text"])
    anchors = F.transform(F.filter("parts", lambda p: F.contains(p["text"], F.lit("of the"))), lambda p: p["chunk_index"].cast("int"))
    return whole.select("doc_id", text.anchor_window(texts, anchors, 1500).alias("text"))


@query(f"SELECT doc_id, {_TOKENS} AS terms FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("terms"))


@query(r"SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS key, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM documents")
def norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_key(F.col("text")).alias("key"), text.word_count(F.col("text")).alias("words"))


@query(r"""WITH b AS (SELECT doc_id, source, regexp_replace(substring(coalesce(text, ''), 1, 600), '\s+', '', 'g') AS bare FROM documents),
g AS (SELECT doc_id, source, CASE WHEN length(bare) < 3 THEN [bare] ELSE list_distinct([substring(bare, i, 3) FOR i IN generate_series(1, length(bare) - 2)]) END AS s FROM b),
f AS (SELECT source, min_by(s, doc_id) AS t, min(doc_id) AS first_id FROM g GROUP BY source)
SELECT doc_id, first_id, round(len(list_intersect(s, t))::DOUBLE / len(list_distinct(list_concat(s, t))), 6) AS similarity FROM g JOIN f USING (source)""")
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each document is to the first one of its source, by the trigrams of what near copies are told by."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", text.trigram_set(F.substring(F.coalesce("text", F.lit("")), 1, context.PREFIX)).alias("s"))
    firsts = docs.groupBy("source").agg(F.min_by("s", "doc_id").alias("t"), F.min("doc_id").alias("first_id"))
    return docs.join(firsts, "source").select("doc_id", "first_id", F.round(text.jaccard(F.col("s"), F.col("t")), 6).alias("similarity"))


@query("""SELECT doc_id, substring(sha256(text), 1, 16) AS content_hash,
  concat_ws('-', substring(h, 1, 8), substring(h, 9, 4), '5' || substring(h, 14, 3), substring('89ab', (('0x' || substring(h, 17, 1))::INT % 4) + 1, 1) || substring(h, 18, 3), substring(h, 21, 12)) AS chunk_id
FROM (SELECT doc_id, text, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || '#chunk' || doc_id)) AS h FROM documents)""")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"), ids.chunk_id(F.col("source"), F.col("doc_id")).alias("chunk_id"))


@query("""WITH r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
f AS (SELECT *, sum(n_chars + 20) OVER (PARTITION BY source ORDER BY rank)::BIGINT AS filled FROM r)
SELECT source, doc_id, rank, filled FROM f WHERE filled <= 60000 OR rank = 1""")
def budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, its longest documents first, up to the response budget."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    # a budget holds at most budget / BLOCK_EXTRA documents: the rest cannot fit
    ranked = ranking.top_by(docs, ["source"], ranking.RESPONSE_BUDGET // ranking.BLOCK_EXTRA + 1, F.desc("n_chars"), F.asc("doc_id"))
    return ranking.fit_budget(ranked, ["source"], F.col("n_chars")).select("source", "doc_id", "rank", "filled")


_GONE = "|".join(rf"<{tag}\b.*?</{tag}\s*>" for tag in ("script", "style", "head", "noscript", "template"))
_BARE = rf"""regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|{_GONE}', '', 'g'), '(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|blockquote|pre)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"""
#: The references that the pages hold; the function knows them all.
_READ = _BARE
for _name, _code in (("nbsp", 160), ("lt", 60), ("gt", 62), ("quot", 34), ("#34", 34), ("apos", 39), ("#39", 39), ("#x27", 39), ("copy", 169), ("middot", 183), ("amp", 38)):
    _READ = f"replace({_READ}, '&{_name};', chr({_code}))"


@query(rf"""SELECT page_id, regexp_matches(lower(coalesce(url, '')), '\.html?$') OR contains(lower(substring(coalesce(html, ''), 1, 512)), '<!doctype html') OR contains(lower(substring(coalesce(html, ''), 1, 512)), '<html') AS is_html,
regexp_replace(regexp_replace(regexp_replace(regexp_replace({_READ}, '[ \t\r\f\x{{A0}}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{2,}}', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    html = text.looks_like_html(F.coalesce("url", F.lit("")), F.lit(""), F.coalesce("html", F.lit("")))
    return rows.select("page_id", html.alias("is_html"), text.html_to_text(F.coalesce("html", F.lit(""))).alias("text"))


@query("""WITH w AS (SELECT conv_id, turn, [regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') FOR x IN regexp_split_to_array(trim(text), '\\s+')] AS ws FROM conversations),
f AS (SELECT conv_id, turn, list_filter(ws, lambda x: length(x) >= 2) AS ws FROM w)
SELECT conv_id, turn, [ws[i] FOR i IN generate_series(1, len(ws)) IF list_position(ws, ws[i]) = i][1:6] AS candidates FROM f""")
def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.entity_candidates(F.col("text")).alias("candidates"))
