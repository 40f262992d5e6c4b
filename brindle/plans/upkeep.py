"""Queries: purges, integrity reports, what a glossary lacks, ranks of targets, budgets and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import context, evaluation, events, glossary, lexical, ranking, reports, tables
from brindle.sources import markdown

from .base import ORACLE_SQL, query, table
from .graph import _GLOSSARY, _glossary
from .reports import _EVENTS, _REGISTRY, registry, timeline_events
from .search import _BM25, _COSINE, _nearest

_GONE = f"""{_REGISTRY}, gone AS (SELECT page_id FROM reg WHERE page_id % 11 = 0),
chunks AS (SELECT doc_id AS page_id FROM documents, generate_series(1, n_chars // 600 + 1)), edges AS (SELECT o_custkey % 400 AS page_id, o_orderkey % 5 = 0 AS is_manual FROM orders), ev AS (SELECT event_id % 300 AS page_id FROM events)"""


@query(f"""WITH {_GONE}, n AS (SELECT page_id, (SELECT count(*) FROM chunks c WHERE c.page_id = g.page_id) AS chunks, (SELECT count(*) FROM edges e WHERE e.page_id = g.page_id AND NOT is_manual) AS edges, (SELECT count(*) FROM ev e WHERE e.page_id = g.page_id) AS events FROM gone g)
SELECT page_id::VARCHAR AS page, chunks, edges, events FROM n
UNION ALL SELECT 'left', (SELECT count(*) FROM chunks WHERE page_id NOT IN (FROM gone)), (SELECT count(*) FROM edges WHERE is_manual OR page_id NOT IN (FROM gone)), (SELECT count(*) FROM ev WHERE page_id NOT IN (FROM gone))""")
def purge_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes from each store with the pages that a listing no longer has, and what is left."""
    url = lambda c: F.concat(F.lit("u"), c.cast("string")).alias("source_url")
    pages = registry(spark, sf_dir).withColumn("source_url", url(F.col("page_id")))
    stores = {
        "chunks": table(spark, sf_dir, "documents").select(url(F.col("doc_id")), F.explode(F.sequence(F.lit(0), F.expr("n_chars div 600").cast("int"))).alias("chunk_index")),
        "edges": table(spark, sf_dir, "orders").select(url(F.col("o_custkey") % 400), (F.col("o_orderkey") % 5 == 0).alias("is_manual")),
        "events": table(spark, sf_dir, "events").select(url(F.col("event_id") % 300), "event_id"),
    }
    _, left, report = tables.purged(pages, pages.where("page_id % 11 <> 0"), "page_id", "source_url", stores)
    counts = [rows.agg(F.count(F.lit(1)).alias(name)) for name, rows in left.items()]
    kept = counts[0].select(F.lit("left").alias("page"), "chunks", counts[1].scalar().alias("edges"), counts[2].scalar().alias("events"))
    return report.select(F.col("page_id").cast("string").alias("page"), "chunks", "edges", "events").unionByName(kept)


@query(f"""WITH {_EVENTS}, t AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'u' || (event_id % 40) END AS url FROM e WHERE event_id % 17 <> 0 OR scope IS NULL),
c AS (SELECT scope, event_id, lead(event_id) OVER w AS next_id FROM t WHERE scope IS NOT NULL AND date_ts > 0 WINDOW w AS (PARTITION BY scope ORDER BY date_ts, event_id)),
led AS (SELECT 'u' || (event_id % 40) AS url, count(*) AS n FROM e GROUP BY 1), lost AS (SELECT n - coalesce(m, 0) AS lost FROM led LEFT JOIN (SELECT url, count(*) AS m FROM t GROUP BY url) USING (url) WHERE n > coalesce(m, 0))
SELECT 'events' AS item, count(*) AS found FROM t UNION ALL SELECT 'events without date', count(*) FROM t WHERE date_ts = 0 UNION ALL SELECT 'events without scope', count(*) FROM t WHERE scope IS NULL
UNION ALL SELECT 'events without type', count(*) FROM t WHERE coalesce(event_type, '') = '' UNION ALL SELECT 'links', count(*) FROM c WHERE next_id IS NOT NULL UNION ALL SELECT 'links that skip', 0
UNION ALL SELECT 'events without edge', count(*) FROM t WHERE event_id % 3 <> 0 UNION ALL SELECT 'events by the ledger', sum(n)::BIGINT FROM led UNION ALL SELECT 'pages with events by the ledger', count(*) FROM led
UNION ALL SELECT 'pages that lost events', count(*) FROM lost UNION ALL SELECT 'events lost', coalesce(sum(lost), 0)::BIGINT FROM lost""")
def event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the stored events: one in 17 is lost, one in 13 has no page, every third has an edge."""
    whole = timeline_events(spark, sf_dir)
    page = F.concat(F.lit("u"), (F.col("event_id") % 40).cast("string"))
    stored = whole.where("event_id % 17 <> 0 OR scope IS NULL").withColumn("source_url", F.when(F.col("event_id") % 13 != 0, page))
    ledger = whole.groupBy(page.alias("source_url")).agg(F.count(F.lit(1)).alias("events"))
    edges = whole.where("event_id % 3 = 0").select(F.col("event_id").alias("dst"))
    return events.integrity(stored, events.chain(stored), edges, ledger)


@query(f"""WITH {_GLOSSARY}, nodes AS (SELECT p_name AS name, p_brand AS label FROM part UNION ALL SELECT p_type, 'Type' FROM part), cov AS (SELECT DISTINCT regexp_replace(lower(alias), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS key FROM al),
k AS (SELECT *, regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS key FROM nodes), d AS (SELECT DISTINCT name, key FROM k WHERE length(key) >= 2)
SELECT 'conflict' AS problem, key, array_to_string(terms, ',') AS found FROM cl WHERE len(terms) > 1 AND key <> ''
UNION ALL SELECT 'labels', name, array_to_string(list_sort(list_distinct(list(label))), ',') FROM nodes GROUP BY name HAVING count(DISTINCT label) > 1
UNION ALL SELECT 'spellings', key, array_to_string(list_sort(list_distinct(list(name))), ',') FROM k GROUP BY key HAVING count(DISTINCT name) > 1
UNION ALL SELECT 'abbreviation', a.name, b.name FROM d a JOIN d b ON length(b.key) > length(a.key) AND starts_with(b.key, a.key)
UNION ALL SELECT DISTINCT 'unregistered', name, label FROM k WHERE label IN ('Brand#11', 'Brand#23', 'Type') AND key NOT IN (SELECT key FROM cov)""")
def glossary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the glossary of part types lacks for the parts' names and types."""
    part = table(spark, sf_dir, "part")
    nodes = part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("label")).unionByName(part.select(F.col("p_type").alias("name"), F.lit("Type").alias("label")))
    return glossary.to_do(nodes, glossary.aliases(_glossary(spark, sf_dir)), ("Brand#11", "Brand#23", "Type"))


@query(f"""WITH {_COSINE}, w AS (SELECT query_id, label, max(score) AS best, min(rank) AS first FROM vector WHERE rank <= 20 GROUP BY ALL),
p AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first) AS page_rank, count(*) OVER (PARTITION BY query_id) AS pages FROM w), t AS (SELECT vec_id AS query_id, (label + 1) % 10 AS label FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, t.label, (SELECT min(rank) FROM vector v WHERE v.query_id = t.query_id AND v.label = t.label) AS chunk_rank, page_rank, (SELECT count(*) FROM w WHERE w.query_id = t.query_id) AS pages, coalesce(page_rank <= 5, false) AS passes FROM t LEFT JOIN p USING (query_id, label)""")
def target_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the label after its own stands among the nearest vectors of each query, as a chunk and as a page."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = _nearest(spark, sf_dir, 80).join(labels, "vec_id")
    targets = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), ((F.col("label") + 1) % 10).alias("label"))
    return evaluation.target_ranks(hits, targets, "query_id", "label", 20, 5)


@query(f"""{ORACLE_SQL["budget_fit"].replace("60000", "20000").replace("SELECT source, doc_id, rank, filled FROM f", ", kept AS (SELECT source, doc_id, rank, filled FROM f", 1)}), u AS (SELECT source, max(filled) AS used FROM kept GROUP BY source),
s AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank FROM documents), l AS (SELECT *, sum(n_chars + 20) OVER (PARTITION BY source ORDER BY rank) AS own FROM s WHERE rank <= 10)
SELECT source, doc_id, rank, 'ranked' AS part FROM kept UNION ALL SELECT source, doc_id, rank, 'linked' FROM l JOIN u USING (source) WHERE used + own <= 20000""")
def budget_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source its longest documents up to a budget of 20,000, then its ten shortest as linked pages while there is room."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    ranked = ranking.top_by(docs, ["source"], 20_000 // ranking.BLOCK_EXTRA + 1, F.desc("n_chars"), F.asc("doc_id"))
    kept = ranking.fit_budget(ranked, ["source"], F.col("n_chars"), 20_000)
    linked = ranking.add_linked(kept, ranking.top_by(docs, ["source"], 10, F.asc("n_chars"), F.asc("doc_id")), ["source"], F.col("n_chars"), 20_000)
    part = lambda df, name: df.select("source", "doc_id", "rank", F.lit(name).alias("part"))
    return part(kept, "ranked").unionByName(part(linked, "linked"))


@query(rf"""WITH {_BM25}, q AS (SELECT item_id AS id, list_filter(regexp_extract_all(text, '[A-Za-z0-9_.\-]{{8,}}'), lambda w: regexp_matches(w, '[0-9._\-]')) AS ws FROM benchmark),
k AS (SELECT id, coalesce(lower(list_filter(ws, lambda w: length(w) = list_max([length(x) FOR x IN ws]))[1]), '') AS key, (SELECT min(doc_id) FROM lexical l WHERE l.item_id = id AND rank = 2) AS target FROM q),
r AS (SELECT item_id AS id, doc_id, rank, substring(text, 1, 2000) AS text, sum(length(substring(text, 1, 2000)) + length(source) + 20) OVER (PARTITION BY item_id ORDER BY rank) AS filled FROM lexical JOIN documents USING (doc_id)),
c AS (SELECT * FROM r WHERE rank <= 25 AND (rank = 1 OR filled <= 6000))
SELECT k.id, count(c.doc_id) AS used, coalesce(bool_or(c.doc_id = target), false) AS included, coalesce(bool_or(key <> '' AND contains(regexp_replace(lower(c.text), '\s+', '', 'g'), key)), false) AS answered, any_value(CASE WHEN target IS NOT NULL THEN 2 END)::BIGINT AS place FROM k LEFT JOIN c ON c.id = k.id GROUP BY k.id""")
def evidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as answers, the second best document of each as its evidence: is it in a context of 6,000 characters?"""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = lexical.search(docs, items, 10).select(F.col("item_id").alias("id"), "doc_id", "rank").join(docs.select("doc_id", "text", F.col("source").alias("title")), "doc_id")
    ranked = found.select("id", "rank", F.col("doc_id").cast("string").alias("url"), "title", "text")
    target = ranked.where("rank = 2").select("id", F.col("url").alias("source_url"))
    asked = items.select(F.col("item_id").alias("id"), F.col("text").alias("answer")).join(target, "id", "left")
    return context.evidence(ranked, asked, cap=2_000, budget=6_000).select("id", "used", "included", "answered", "place")


@query("""WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank FROM documents), b AS (SELECT *, '[' || doc_id || ']' || chr(10) || text AS block, sum(length(text) + length(doc_id::VARCHAR) + 20) OVER (PARTITION BY source ORDER BY rank) AS filled FROM r),
d AS (SELECT source, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS t FROM b WHERE rank <= 25 AND (rank = 1 OR filled <= 3000) GROUP BY source),
g AS (SELECT DISTINCT source, lang FROM documents), gl AS (SELECT source, string_agg(source || ' -[WRITES]-> ' || lang, chr(10) ORDER BY lang) AS t FROM g GROUP BY source),
e AS (SELECT 'src' || (event_id % 20) AS source, event_id, event_type, strftime(ts, '%Y-%m-%d') AS date, props FROM events), er AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY date, event_id) AS rank FROM e),
el AS (SELECT source, string_agg(date || ' [' || event_type || '] ' || coalesce(props, ''), chr(10) ORDER BY rank) AS t FROM er WHERE rank <= 20 GROUP BY source)
SELECT source, concat_ws(chr(10) || chr(10), '## relations' || chr(10) || gl.t, '## timeline' || chr(10) || el.t, '## documents' || chr(10) || d.t) AS context FROM d FULL JOIN gl USING (source) FULL JOIN el USING (source)""")
def context_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's relations, timeline and shortest documents as a model reads them."""
    docs = table(spark, sf_dir, "documents")
    ranked = ranking.top_by(docs, ["source"], 25, F.asc("n_chars"), F.asc("doc_id")).select("source", "rank", F.col("doc_id").cast("string").alias("title"), "text")
    edges = docs.select("source", F.col("source").alias("src"), F.lit("WRITES").alias("rel_name"), F.col("lang").alias("dst")).distinct()
    told = table(spark, sf_dir, "events").select(F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("source"), "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("props").alias("title"))
    return context.assembled(ranked, edges, told, ["source"], 3_000)


@query("""WITH o AS (SELECT event_id, event_type, value, event_id * 10 AS ts FROM events WHERE event_id % 3 <> 0), n AS (SELECT event_id, upper(event_type) AS event_type, value + 1 AS value, event_id * 10 + 7 AS ts FROM events WHERE event_id % 2 = 0)
SELECT event_id, n.event_type, n.value, coalesce(o.ts, n.ts) AS ts FROM n LEFT JOIN o USING (event_id) UNION ALL SELECT * FROM o WHERE event_id NOT IN (SELECT event_id FROM n)""")
def event_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second event told again over two thirds that are stored: new values, first time of storing."""
    whole = table(spark, sf_dir, "events").select("event_id", "event_type", "value", (F.col("event_id") * 10).alias("ts"))
    new = whole.where("event_id % 2 = 0").select("event_id", F.upper("event_type").alias("event_type"), (F.col("value") + 1).alias("value"), (F.col("ts") + 7).alias("ts"))
    return events.upserted(whole.where("event_id % 3 <> 0"), new)


@query(r"""WITH p AS (SELECT doc_id, doc_id % 4 = 0 AS has, text, 'lang: ' || lang || chr(10) || 'source: ' || source AS lines, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents),
b AS (SELECT doc_id, has, CASE WHEN has AND n < 30 THEN n + 4 ELSE n END AS word_count FROM p) SELECT doc_id, word_count FROM b WHERE word_count >= CASE WHEN has THEN 1 ELSE 30 END""")
def saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages long enough to be saved; every fourth has properties, which lengthen a short one."""
    properties = F.when(F.col("doc_id") % 4 == 0, F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")))
    pages = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), properties.alias("db_properties"))
    return markdown.savable(pages).select("doc_id", "word_count")


@query(f"""WITH {_REGISTRY} SELECT r.*, short_pages, long_pages FROM (
  SELECT dept, count(*) AS pages, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (event_count > 0) AS with_events, sum(word_count)::BIGINT AS word_count, sum(chunk_count)::BIGINT AS chunk_count, sum(event_count)::BIGINT AS event_count, max(last_edited_time) AS last_edited_time FROM reg GROUP BY dept) r
JOIN (SELECT dept, count(*) FILTER (chunk_count < 2) AS short_pages, count(*) FILTER (chunk_count >= 2) AS long_pages FROM reg GROUP BY dept) USING (dept)""")
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = registry(spark, sf_dir).withColumn("route", F.when(F.col("chunk_count") < 2, "short").otherwise("long"))
    return reports.route_summary(routed, ("short", "long"))


@query(f"WITH {_REGISTRY} SELECT count(*) AS rows, coalesce(sum(word_count), 0)::BIGINT AS word_count, coalesce(sum(chunk_count), 0)::BIGINT AS chunk_count, coalesce(sum(event_count), 0)::BIGINT AS event_count FROM reg WHERE status = 'ok'")
def ok_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ok_totals(registry(spark, sf_dir), "word_count", "chunk_count", "event_count")
