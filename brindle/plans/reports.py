"""Queries: registry reports, incremental writes, timelines and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import dates, routing, text
from brindle.operators import calls, evaluation, events, reports, tables
from brindle.session import scratch

from .base import query, table

_REGISTRY = """reg AS (SELECT doc_id AS page_id, lang AS dept, source, CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE substring(sha256(text), 1, 16) END AS content_hash,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word_count, n_chars // 600 AS chunk_count, doc_id % 3 AS event_count, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS last_edited_time FROM documents)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a page registry; every seventh page failed."""
    return registry_of(table(spark, sf_dir, "documents"))


def registry_of(docs: DataFrame) -> DataFrame:
    failed = F.col("doc_id") % 7 == 0
    from brindle.functions.ids import content_hash

    return docs.select(
        F.col("doc_id").alias("page_id"), F.col("lang").alias("dept"), "source", F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(~failed, content_hash(F.col("text"))).alias("content_hash"), text.word_count(F.col("text")).alias("word_count"),
        F.expr("n_chars div 600").alias("chunk_count"), (F.col("doc_id") % 3).alias("event_count"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("doc_id"))).alias("last_edited_time"),
    )


@query(f"""WITH {_REGISTRY} SELECT dept, count(*) AS pages, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (event_count > 0) AS with_events,
sum(word_count)::BIGINT AS word_count, sum(chunk_count)::BIGINT AS chunk_count, sum(event_count)::BIGINT AS event_count, max(last_edited_time) AS last_edited_time FROM reg GROUP BY dept""")
def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.department_summary(registry(spark, sf_dir))


@query(f"WITH {_REGISTRY} SELECT status, dept, count(*) AS rows, count(*) FILTER (coalesce(content_hash, '') = '') AS no_hash FROM reg GROUP BY ALL")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_histogram(registry(spark, sf_dir), "status", "dept")


@query("SELECT event_type, count(*) AS calls, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.usage(table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT count(*) AS points, count(DISTINCT user_id) AS distinct_user_id, count(*) FILTER (user_id IS NULL) AS no_user_id, count(DISTINCT event_type) AS distinct_event_type, count(*) FILTER (event_type IS NULL) AS no_event_type FROM events")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distinct_counts(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return reports.missing(table(spark, sf_dir, "documents").select("doc_id", "source"), vectors, "doc_id")


@query("SELECT source AS source_url, doc_id FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3)) AND source NOT IN (SELECT source FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 4))")
def cross_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the sources that vectors of one group come from and those of another do not."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("source_url"), "doc_id")
    group = lambda n: pages.join(table(spark, sf_dir, "embeddings").where(F.col("label") == n).select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return reports.cross_links(group(3), group(4), pages)


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def newest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.newest(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id")


_OLD = f"{_REGISTRY}, old AS (SELECT * FROM reg WHERE page_id % 5 <> 0), new AS (SELECT page_id, dept, source, 'ok' AS status, content_hash, CASE WHEN page_id % 2 = 0 THEN word_count + 1 END AS word_count, chunk_count, event_count, last_edited_time + INTERVAL 1 DAY AS last_edited_time FROM reg WHERE page_id % 3 = 0)"


def old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored four fifths of the registry, and a run over a third of it that counted the words of every other page."""
    whole = registry(spark, sf_dir)
    new = whole.where("page_id % 3 = 0").withColumns({
        "status": F.lit("ok"), "word_count": F.when(F.col("page_id") % 2 == 0, F.col("word_count") + 1), "last_edited_time": F.col("last_edited_time") + F.expr("INTERVAL 1 DAY"),
    })
    return whole.where("page_id % 5 <> 0"), new


@query(f"""WITH {_OLD} SELECT coalesce(n.page_id, o.page_id) AS page_id, coalesce(n.dept, o.dept) AS dept, coalesce(n.status, o.status) AS status, CASE WHEN n.page_id IS NOT NULL THEN n.content_hash ELSE o.content_hash END AS content_hash,
coalesce(n.word_count, o.word_count) AS word_count, coalesce(n.last_edited_time, o.last_edited_time) AS last_edited_time FROM old o FULL JOIN new n ON o.page_id = n.page_id AND o.dept = n.dept""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_and_new(spark, sf_dir)
    merged = tables.upsert_keeping(old, new, ["page_id", "dept"], ("word_count", "chunk_count", "event_count"))
    return merged.select("page_id", "dept", "status", "content_hash", "word_count", "last_edited_time")


@query(f"WITH {_OLD} SELECT page_id, source, last_edited_time FROM old WHERE source NOT IN (SELECT source FROM new WHERE source <> 'src0') UNION ALL SELECT page_id, source, last_edited_time FROM new WHERE source <> 'src0'")
def replace_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of src0 are not ready and keep their old state."""
    old, new = old_and_new(spark, sf_dir)
    return tables.replace_by_source(old, new, "source", F.col("source") != "src0").select("page_id", "source", "last_edited_time")


@query(f"WITH {_REGISTRY} SELECT page_id, dept, CASE WHEN page_id % 11 = 0 THEN 'deleted' ELSE status END AS status FROM reg")
def reconcile_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = registry(spark, sf_dir)
    return tables.reconcile(stored, stored.where("page_id % 11 <> 0"), "page_id").select("page_id", "dept", "status")


@query(f"""WITH {_OLD}, l AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN last_edited_time + INTERVAL 1 HOUR ELSE last_edited_time END AS edited FROM reg)
SELECT l.page_id, CASE WHEN o.page_id IS NULL THEN 'new' WHEN edited > o.last_edited_time OR o.status <> 'ok' OR o.content_hash IS NULL THEN 'modified' ELSE 'synced' END AS change FROM l LEFT JOIN old o ON l.page_id = o.page_id""")
def change_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = old_and_new(spark, sf_dir)
    return tables.classify_changes(listing(registry(spark, sf_dir)), old, "page_id").select("page_id", "change")


def listing(pages: DataFrame) -> DataFrame:
    """The pages as a wiki lists them: every other one was edited an hour later."""
    edited = F.when(F.col("page_id") % 2 == 0, F.col("last_edited_time") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("last_edited_time"))
    return pages.select("page_id", edited.alias("last_edited_time"))


@query(f"WITH {_OLD} SELECT n.page_id FROM new n JOIN old o ON n.page_id = o.page_id AND n.content_hash = o.content_hash")
def hash_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_and_new(spark, sf_dir)
    return tables.unchanged(new, old, "page_id").select("page_id")


_EVENTS = "e AS (SELECT event_id, user_id AS scope, event_type, floor(epoch(ts))::BIGINT AS date_ts, value, props, ts FROM events)"


def timeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("scope"), "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("date_ts"), "value", "props", "ts")


@query(f"""WITH {_EVENTS}, c AS (SELECT scope, event_id, date_ts, lead(event_id) OVER w AS next_id, lead(date_ts) OVER w AS next_ts FROM e WHERE scope IS NOT NULL AND date_ts > 0 WINDOW w AS (PARTITION BY scope ORDER BY date_ts, event_id))
SELECT scope, event_id, next_id, round((next_ts - date_ts) / 86400)::BIGINT AS days_diff FROM c WHERE next_id IS NOT NULL""")
def event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.chain(timeline_events(spark, sf_dir))


@query(f"WITH {_EVENTS} SELECT event_id, scope, lag(event_type) OVER w AS prev, lead(event_type) OVER w AS next FROM e WINDOW w AS (PARTITION BY scope ORDER BY date_ts, event_id)")
def event_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.with_neighbours(timeline_events(spark, sf_dir)).select("event_id", "scope", "prev", "next")


@query(f"""WITH {_EVENTS}, p AS (SELECT scope, event_id, row_number() OVER (PARTITION BY scope ORDER BY date_ts, event_id) AS place FROM e),
l AS (SELECT a.scope, a.event_id, b.event_id AS next_id, a.place, b.place AS next_place FROM p a JOIN p b ON a.scope = b.scope AND b.place = a.place + 1 + a.event_id % 2)
SELECT scope, event_id, next_id, next_place - place - 1 AS between FROM l WHERE next_place - place > 1""")
def chain_skip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain in which every other link was bent to jump over an event: the check finds just those."""
    found = timeline_events(spark, sf_dir)
    window = events._order("scope")
    bent = F.when(F.col("event_id") % 2 == 0, F.lead("event_id").over(window)).otherwise(F.lead("event_id", 2).over(window))
    links = found.select("scope", "event_id", bent.alias("next_id")).where("next_id IS NOT NULL")
    return events.skipped(links, found)


@query(f"""WITH {_EVENTS} SELECT event_id, scope, event_type, date_ts FROM e WHERE date_ts >= 1704067200 AND event_type = 'click' AND contains(lower(props), '"k": 6')""")
def timeline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.timeline(timeline_events(spark, sf_dir), start=1704067200, kind="click", keywords=F.array(F.lit('"k": 6')), fields=("props",), limit=None)
    return found.select("event_id", "scope", "event_type", "date_ts")


@query(f"WITH {_EVENTS} SELECT scope, event_type, count(*) AS events FROM e GROUP BY ALL")
def timeline_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline_events(spark, sf_dir).groupBy("scope", "event_type").agg(F.count(F.lit(1)).alias("events"))


@query(f"WITH {_EVENTS} SELECT event_id, scope, event_type, date_ts FROM e ORDER BY date_ts DESC, event_id DESC LIMIT 30")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline_events(spark, sf_dir).select("event_id", "scope", "event_type", "date_ts").orderBy(F.desc("date_ts"), F.desc("event_id")).limit(30)


@query(f"WITH {_EVENTS} SELECT count(*) AS events, count(*) FILTER (date_ts = 0) AS undated, count(*) FILTER (scope IS NULL) AS no_scope, count(*) FILTER (coalesce(event_type, '') = '') AS no_type FROM e")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.completeness(timeline_events(spark, sf_dir))


@query("""WITH s AS (SELECT l_orderkey % 50 AS k, l_shipdate AS snap, min(l_orderkey * 10 + l_linenumber) AS snap_id FROM lineitem GROUP BY ALL),
f AS (SELECT o_orderkey, o_orderdate, s.snap, row_number() OVER (PARTITION BY o_orderkey ORDER BY s.snap) AS r, s.snap_id FROM orders LEFT JOIN s ON o_orderkey % 50 = k AND s.snap >= o_orderdate)
SELECT o_orderkey, o_orderdate, snap, snap_id FROM f WHERE r = 1""")
def next_snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order (a run) with the first shipping snapshot of its group at or after it."""
    lines = table(spark, sf_dir, "lineitem")
    snaps = lines.groupBy((F.col("l_orderkey") % 50).alias("k"), F.col("l_shipdate").alias("snap")).agg(F.min(F.expr("l_orderkey * 10 + l_linenumber")).alias("snap_id"))
    runs = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("k"), "o_orderkey", "o_orderdate")
    return events.next_as_of(runs, snaps, ["k"], "o_orderdate", "snap", "snap_id").select("o_orderkey", "o_orderdate", "snap", "snap_id")


@query(r"""WITH r AS (SELECT event_id AS row, user_id::VARCHAR AS game, event_type, strftime(ts, '%Y-%m-%d') AS date, props AS title, 'https://example.org/e/' || event_id AS source_url FROM events),
h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws('|', source_url, game, 'user_event', date, substring(md5(title), 1, 8)))) AS h FROM r)
SELECT row, concat_ws('-', substring(h, 1, 8), substring(h, 9, 4), '5' || substring(h, 14, 3), substring('89ab', (('0x' || substring(h, 17, 1))::INT % 4) + 1, 1) || substring(h, 18, 3), substring(h, 21, 12)) AS event_id, event_type AS given_type, 'user_event' AS event_type, epoch(date::TIMESTAMP)::BIGINT AS date_ts, year(date::DATE)::INT AS year, month(date::DATE)::INT AS month, 'Q' || quarter(date::DATE) AS quarter, game AS scope,
  list_filter([CASE WHEN trim(coalesce(game, '')) = '' THEN 'row ' || row || ': game is missing' END, CASE WHEN trim(coalesce(title, '')) = '' THEN 'row ' || row || ': title is missing' END], lambda e: e IS NOT NULL) AS errors FROM h""")
def event_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with deterministic ids, dates, quarter and validation errors."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row"), F.col("user_id").cast("string").alias("game"), "event_type", F.col("event_type").alias("given_type"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.col("props").alias("title"), F.lit("").alias("scope"), F.concat(F.lit("https://example.org/e/"), F.col("event_id")).alias("source_url"),
    )
    return events.enriched(events.validated(rows)).select("row", "event_id", "given_type", "event_type", "date_ts", "year", "month", "quarter", "scope", "errors")


@query("""WITH t AS (SELECT conv_id, turn, text, (conv_id % 12 + 1)::INT AS m FROM conversations), q AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '2024년 ' || m || '월' WHEN 1 THEN '2025-' || m || '-31 patch' WHEN 2 THEN '25년 3분기' ELSE 'version 12.5' END AS ask, m FROM t)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN make_date(2024, m, 1) WHEN 1 THEN last_day(make_date(2025, m, 1)) WHEN 2 THEN DATE '2025-07-01' END AS "from",
CASE turn % 4 WHEN 0 THEN last_day(make_date(2024, m, 1)) WHEN 1 THEN last_day(make_date(2025, m, 1)) WHEN 2 THEN DATE '2025-09-30' END AS "to", turn % 4 <> 3 AS timeline FROM q""")
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with dates made from the turns, and the ranges they name."""
    m = F.col("conv_id") % 12 + 1
    kind = F.col("turn") % 4
    ask = F.when(kind == 0, F.concat(F.lit("2024년 "), m, F.lit("월"))).when(kind == 1, F.concat(F.lit("2025-"), m, F.lit("-31 patch"))).when(kind == 2, "25년 3분기").otherwise("version 12.5")
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", ask.alias("ask"))
    return found.select("conv_id", "turn", dates.date_range(F.col("ask")).alias("r"), dates.timeline_intent(F.col("ask")).alias("timeline")).select("conv_id", "turn", "r.from", "r.to", "timeline")


_SCORES = "s AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN toxic = 1 THEN 0.5::DOUBLE ELSE quality::DOUBLE END AS score FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {_SCORES} SELECT lang, count(*) AS total, count(score) AS scored, count(*) FILTER (score IS NULL) AS failed, count(*) FILTER (score >= 0.7) AS passed, round(avg(score), 4) AS average FROM s GROUP BY lang""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    score = F.when(F.col("doc_id") % 13 == 0, None).when(F.col("toxic") == 1, 0.5).otherwise(F.col("quality").cast("double"))
    return evaluation.summary(scores.withColumn("score", score), "lang")


_RESULTS = """truth AS (SELECT doc_id % 40 AS q, doc_id AS item FROM documents), results AS (
  SELECT 'base' AS config, q, item FROM truth WHERE item % 3 <> 0 UNION ALL SELECT 'wide', q, item FROM truth WHERE item % 4 <> 0 UNION ALL SELECT 'narrow', q, item FROM truth WHERE item % 6 = 1)"""


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    truth = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("q"), F.col("doc_id").alias("item"))
    config = lambda name, test: truth.where(test).withColumn("config", F.lit(name))
    return truth, config("base", "item % 3 <> 0").unionByName(config("wide", "item % 4 <> 0")).unionByName(config("narrow", "item % 6 = 1"))


@query(f"WITH {_RESULTS} SELECT config, round(count(*)::DOUBLE / (SELECT count(*) FROM truth), 6) AS recall, round(count(*)::DOUBLE / count(DISTINCT q), 6) AS used FROM results GROUP BY config")
def ab_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, results = _results(spark, sf_dir)
    return evaluation.recall(results, truth, "q", "item")


@query(f"""WITH {_RESULTS}, b AS (SELECT q, item FROM results WHERE config = 'base')
SELECT config, count(*) FILTER ((q, item) NOT IN (SELECT (q, item) FROM b)) AS gained, (SELECT count(*) FROM b) - count(*) FILTER ((q, item) IN (SELECT (q, item) FROM b)) AS lost FROM results WHERE config <> 'base' GROUP BY config""")
def ab_gained_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, results = _results(spark, sf_dir)
    return evaluation.compared(results, "base", "q", "item")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s, l_returnflag AS p, l_partkey % 10 AS src FROM lineitem),
b AS (SELECT o, s, CASE WHEN o % 5 = 0 THEN 'X' ELSE p END AS p, src FROM a WHERE o % 7 <> 0),
j AS (SELECT coalesce(a.src, b.src) AS src, coalesce(a.s, b.s) AS s, coalesce(a.o, b.o) AS o, a.src IS NOT NULL AS ia, b.src IS NOT NULL AS ib FROM (SELECT DISTINCT * FROM a) a FULL JOIN (SELECT DISTINCT * FROM b) b ON a.src = b.src AND a.s = b.s AND a.p = b.p AND a.o = b.o),
g AS (SELECT src, s, o, count(*) AS n, count(*) FILTER (ia AND ib) AS same, count(*) FILTER (NOT ib) AS gone, count(*) FILTER (NOT ia) AS fresh FROM j GROUP BY src, s, o)
SELECT src, round(sum(same)::DOUBLE / sum(n), 6) AS jaccard, sum(least(gone, fresh))::BIGINT AS renamed FROM g GROUP BY src""")
def extraction_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as triples (supplier, flag, order) of two runs, the second without some orders and with some flags renamed."""
    first = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("p"), (F.col("l_partkey") % 10).alias("src"))
    second = first.where("o % 7 <> 0").withColumn("p", F.when(F.col("o") % 5 == 0, "X").otherwise(F.col("p")))
    return evaluation.stability(first, second, "src")


_SKEW = "abs(({0}n + {2}) * 0.5 - ({1}n + {3}) * 0.5) + list_sum([abs(({0}c[i] + {2} * gc[i] / n) * 0.5 - ({1}c[i] + {3} * gc[i] / n) * 0.5) FOR i IN range(1, len(gc) + 1)])"


@query(f"""WITH RECURSIVE k AS (SELECT list(c ORDER BY c) AS cs FROM (SELECT DISTINCT coalesce(lang, '?') AS c FROM documents)),
q AS (SELECT CASE WHEN doc_id % 97 <> 0 THEN source END AS source, CASE WHEN doc_id % 97 = 0 OR source IS NULL THEN doc_id END AS doc_id, coalesce(lang, '?') AS c FROM documents),
z AS (SELECT source, doc_id, count(*) AS n, [len(list_filter(list(c), lambda x: x = y)) FOR y IN any_value(cs)] AS gc FROM q, k GROUP BY source, doc_id),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, sha256(coalesce(source, '__no_source__' || doc_id))) AS i FROM z),
d AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS source, NULL::BIGINT AS doc_id, 0::BIGINT AS n, '' AS side, 0::DOUBLE AS an, 0::DOUBLE AS bn, [0.0::DOUBLE FOR x IN cs] AS ac, [0.0::DOUBLE FOR x IN cs] AS bc FROM k
  UNION ALL SELECT i, source, doc_id, n, CASE WHEN dev THEN 'dev' ELSE 'holdout' END, an + CASE WHEN dev THEN n ELSE 0 END, bn + CASE WHEN dev THEN 0 ELSE n END,
    [ac[j] + CASE WHEN dev THEN gc[j] ELSE 0 END FOR j IN range(1, len(gc) + 1)], [bc[j] + CASE WHEN dev THEN 0 ELSE gc[j] END FOR j IN range(1, len(gc) + 1)]
  FROM (SELECT o.i, o.source, o.doc_id, o.n, o.gc, d.an, d.bn, d.ac, d.bc, {_SKEW.format("d.a", "d.b", "o.n", "0").replace("gc", "o.gc").replace("/ n", "/ o.n")} AS to_dev, {_SKEW.format("d.a", "d.b", "0", "o.n").replace("gc", "o.gc").replace("/ n", "/ o.n")} AS to_hold,
    to_dev < to_hold OR (to_dev = to_hold AND d.an <= d.bn) AS dev FROM d JOIN o ON o.i = d.i + 1))
SELECT source, doc_id, n, side FROM d WHERE i > 0""")
def split_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions of their source, their language as category; every 97th has no source."""
    source = F.when(F.col("doc_id") % 97 != 0, F.col("source")).alias("source")
    return evaluation.split(table(spark, sf_dir, "documents").select("doc_id", "lang", source), "source", "lang", "doc_id")


@query("""WITH p AS (SELECT lang, doc_id, length(text) AS chars, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) AS rank FROM documents WHERE length(text) >= 100 AND source <> '')
SELECT lang, doc_id, chars, rank, (rank - 1) // 5 AS "group" FROM p WHERE rank <= 40""")
def fixture_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of the pages that fixtures are made from: of each language 40 that have a source and 100 characters, in groups of five."""
    pages = table(spark, sf_dir, "documents").where((F.length("text") >= 100) & (F.col("source") != "")).select("lang", "doc_id", F.length("text").cast("long").alias("chars"))
    return evaluation.sampled(pages, ["lang"], "doc_id", 40).select("lang", "doc_id", "chars", "rank", "group")


@query("""SELECT lang AS department, 'budget' AS tool, 2::BIGINT AS calls, 1::BIGINT AS failed, count(*) AS results FROM documents WHERE n_chars > 500 AND lang IS NOT NULL GROUP BY lang""")
def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the request log says about one call a language that works and one that fails."""
    docs, log = table(spark, sf_dir, "documents"), scratch(spark, "calls")
    for (lang,) in docs.where("lang IS NOT NULL").select("lang").distinct().orderBy("lang").collect():
        pages = docs.where(F.col("lang") == lang).select("doc_id", "n_chars")
        calls.logged(spark, log, "budget", "n_chars > 500", lang, lambda p=pages: p.where("n_chars > 500"), f"{log}-{lang}-pages")
        calls.logged(spark, log, "budget", "no size", lang, lambda: F.lit(int("no size")), f"{log}-{lang}-none")
    return calls.usage(spark, log).drop("slowest_ms").where("results > 0")


@query("SELECT lang, source, doc_id, rank FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(doc_id::VARCHAR), doc_id) AS rank FROM documents) WHERE rank <= 3")
def stratified_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each language and source: a stated sample."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    return evaluation.stratified(docs, ["lang", "source"], "doc_id", 3).select("lang", "source", "doc_id", "rank")


@query("SELECT event_id, key, value::VARCHAR AS value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS value)")
def variant_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON properties of every event as rows."""
    found = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return found.select("event_id", F.explode("m").alias("key", "value"))


_SIGNS = lambda words: " OR ".join(f"contains(body, '{w}')" for w in words)
_TITLES = lambda words: " OR ".join(f"contains(title, '{w}')" for w in words)


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS body, len(list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '')) AS words, lower(CASE doc_id % 5 WHEN 0 THEN source || ' DRAFT' WHEN 1 THEN source || ' KPI' WHEN 2 THEN source || ' todo' ELSE source END) AS title, doc_id % 17 = 0 AS props FROM documents),
s AS (SELECT *, ({_SIGNS(routing.PLANNED)}) AS planned, ({_SIGNS(routing.APPLIED)}) AS applied FROM d)
SELECT doc_id, CASE WHEN props THEN CASE WHEN words >= 1 THEN 'core' ELSE 'excluded' END WHEN words < 30 OR {_TITLES(routing.EXCLUDED_TITLES)} THEN 'excluded' WHEN {_TITLES(routing.CORE_TITLES)} THEN 'core'
 WHEN {_TITLES(routing.DEFERRED_TITLES)} THEN 'defer' WHEN words < 80 THEN 'defer' ELSE 'core' END AS route,
CASE WHEN planned AND NOT applied THEN 'planned' WHEN applied AND NOT planned THEN 'applied' ELSE 'unconfirmed' END AS status, {_SIGNS(routing.DECIDED)} AS decision FROM s""")
def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes and realisation status of every document; its source makes a title, every 17th has properties."""
    docs = table(spark, sf_dir, "documents")
    body, kind = F.coalesce("text", F.lit("")), F.col("doc_id") % 5
    title = F.concat("source", F.when(kind == 0, " DRAFT").when(kind == 1, " KPI").when(kind == 2, " todo").otherwise(""))
    way = routing.route(title, text.word_count(body), F.col("doc_id") % 17 == 0)
    return docs.select("doc_id", way.alias("route"), routing.realization_status(body).alias("status"), routing.is_decision(body).alias("decision"))
