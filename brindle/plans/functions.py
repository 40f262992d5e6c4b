"""Queries: text, date and JSON functions, glossary and graph writes, and what a model gets to read, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import dates, ids, routing, structured, text
from brindle.operators import context, events, glossary, graph, reports, scopes, tables
from brindle.operators.ranking import top_by
from brindle.sources import markdown, tabular

from .base import query, table
from .graph import _GLOSSARY, _glossary
from .knowledge import _text
from .reports import _REGISTRY, registry

_KOREAN = ("데이터팀에서 POTC는", "서울은", "강", "이 문서를 승인한 팀은 어디인가요", "업데이트 v2_1 패치로", "", "나는 plain 텍스트에게서")
_SAID = f"said AS (SELECT doc_id, [{', '.join(repr(k) for k in _KOREAN)}][(doc_id % {len(_KOREAN)})::INT + 1] || ' ' || text AS said FROM documents)"


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Korean openings in front of the documents' own."""
    pick = F.element_at(F.array(*map(F.lit, _KOREAN)), (F.col("doc_id") % len(_KOREAN) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(pick, F.lit(" "), F.col("text")).alias("said"))


_PARTICLE = " ".join(f"WHEN ends_with(w, '{p}') AND length(w) >= {len(p) + 2} THEN substring(w, 1, length(w) - {len(p)})" for p in text.PARTICLES)
_HANGUL = "flatten(list_transform(regexp_extract_all(said, '[가-힣]+'), lambda w: CASE WHEN length(w) = 1 THEN [w] ELSE list_transform(generate_series(1, length(w) - 1), lambda i: substring(w, i::INT, 2)) END))"


@query(f"""WITH {_SAID}, s AS (SELECT doc_id, said, regexp_split_to_array(said, ' ')[1] AS w FROM said)
SELECT doc_id, array_to_string(list_concat(regexp_extract_all(lower(said), '[a-z0-9_]+'), {_HANGUL}), ' ') AS tokens, CASE {_PARTICLE} ELSE w END AS stem,
regexp_matches(said, '(^|[^A-Za-z0-9])POTC($|[^A-Za-z0-9])') AS names_code, contains(said, '팀') AS names_team,
(length(trim(said)) >= 12 AND ({" OR ".join(f"contains(said, '{s}')" for s in text.COMPLEX_SIGNS)})) OR len(list_filter(regexp_split_to_array(said, '\\s+'), lambda x: x <> '')) >= 5 AS complex FROM s""")
def korean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, stems, names and complexity of texts in two scripts."""
    said = F.col("said")
    return _said(spark, sf_dir).select(
        "doc_id", F.array_join(text.tokens(said), " ").alias("tokens"), text.strip_particle(F.split("said", " ")[0]).alias("stem"), text.names_token(said, F.lit("POTC")).alias("names_code"),
        text.names_token(said, F.lit("팀")).alias("names_team"), text.is_complex(said).alias("complex"),
    )


@query(r"""WITH d AS (SELECT doc_id, source || ': <' || coalesce(text, '') || '>' AS title, list_filter(regexp_extract_all(text, '[A-Za-z0-9_.\-]{8,}'), lambda w: regexp_matches(w, '[0-9._\-]')) AS ks FROM documents)
SELECT doc_id, substring(regexp_replace(title, '[\\/:*?"<>|\s]+', '_', 'g'), 1, 80) AS filename, coalesce(nullif(regexp_replace(substring(title, 1, 20), '[^A-Za-z0-9_]', '', 'g'), ''), 'Unknown') AS label, substring(md5(title), 1, 8) AS hash,
coalesce(lower(list_filter(ks, lambda k: length(k) = list_max(list_transform(ks, lambda x: length(x))))[1]), '') AS answer FROM d""")
def names_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names, labels and hashes of titles, and the answer keys of texts."""
    title = F.concat(F.col("source"), F.lit(": <"), F.coalesce("text", F.lit("")), F.lit(">"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", title.alias("title"))
    return docs.select("doc_id", text.safe_filename(F.col("title")).alias("filename"), text.safe_label(F.substring("title", 1, 20)).alias("label"), ids.title_hash(F.col("title")).alias("hash"), text.answer_key(F.col("text")).alias("answer"))


@query(r"""WITH w AS (SELECT doc_id, source, list_filter([substring(text, i * 5400 + 1, 6000) FOR i IN generate_series(0, greatest(ceil((length(text) - 6000) / 5400.0), 0)::INT)], lambda c: regexp_matches(c, '\S')) AS ws FROM documents)
SELECT doc_id, i - 1 AS place, length(concat_ws(chr(10) || chr(10), nullif(trim(source), ''), ws[i])) AS letters FROM w, LATERAL (SELECT unnest(generate_series(1, len(ws))) AS i)""")
def extraction_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that a model reads of every document, with its source as title."""
    found = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(text.extraction_windows(F.col("text"))).alias("place", "window"))
    return found.select("doc_id", F.col("place").cast("long").alias("place"), F.length(text.embedding_text(F.col("source"), F.col("window"))).alias("letters"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN epoch(o_orderdate)::BIGINT ELSE 0 END AS seconds, 'Q' || quarter(o_orderdate) AS quarter, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate + INTERVAL 10 HOUR END AS stamp,
round((epoch(o_orderdate) - epoch(TIMESTAMP '1996-01-01 12:00:00')) / 86400)::BIGINT AS days FROM orders""")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in four formats, wrongly or not at all, and read again."""
    orders, kind = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    at = lambda form: F.date_format("o_orderdate", form)
    written = F.when(kind == 0, at("yyyy-MM-dd")).when(kind == 1, at("yyyy/MM/dd")).when(kind == 2, at("yyyy.MM.dd")).when(kind == 3, F.concat(F.lit(" "), at("yyyyMMdd"))).when(kind == 4, "sometime").otherwise("")
    iso = F.when(F.col("o_orderkey") % 3 < 2, F.concat(at("yyyy-MM-dd"), F.lit("T10:00:00Z"))).otherwise(" ")
    noon = F.unix_timestamp(F.lit("1996-01-01 12:00:00").cast("timestamp"))
    return orders.select(
        "o_orderkey", dates.event_epoch(written).alias("seconds"), dates.quarter_label(F.col("o_orderdate")).alias("quarter"), dates.iso_timestamp(iso).cast("timestamp_ntz").alias("stamp"),
        dates.days_between(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), noon).alias("days"),
    )


@query("""SELECT event_id, ['ok', 'empty', 'error', 'error'][(event_id % 4)::INT + 1] AS status, CASE WHEN event_id % 4 = 0 THEN 2 WHEN event_id % 4 = 1 THEN 0 END AS items, CASE WHEN event_id % 4 = 0 THEN user_id END AS first,
CASE WHEN event_id % 4 < 2 THEN event_id END AS object FROM events""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays and objects in fences, in prose, broken or missing."""
    rows, kind = table(spark, sf_dir, "events"), F.col("event_id") % 4
    answer = F.when(kind == 0, _text('```json\nSure: [{"a": ', F.col("user_id"), '}, {"a": 0}] done```')).when(kind == 1, "none: []").when(kind == 2, "[{broken").otherwise("nothing")
    single = F.when(kind < 2, _text("It is {\"id\": ", F.col("event_id"), "}, so")).otherwise("no object")
    found = structured.json_array(answer, "a BIGINT")
    return rows.select("event_id", structured.salvage_status(answer, "a BIGINT").alias("status"), F.when(found.isNotNull(), F.size(found)).alias("items"), F.get(found, F.lit(0))["a"].alias("first"), structured.json_object(single, "id BIGINT")["id"].alias("object"))


_BLOCKS = ("heading_1", "heading_3", "bulleted_list_item", "numbered_list_item", "quote", "to_do", "code", "divider", "paragraph")


@query(f"""WITH b AS (SELECT doc_id, [{', '.join(repr(b) for b in _BLOCKS)}][(doc_id % {len(_BLOCKS)})::INT + 1] AS kind, regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g') AS line, (doc_id % 3)::INT AS depth FROM documents)
SELECT doc_id, CASE kind WHEN 'heading_1' THEN '# ' || line WHEN 'heading_3' THEN '### ' || line WHEN 'bulleted_list_item' THEN repeat('  ', depth) || '- ' || line WHEN 'numbered_list_item' THEN repeat('  ', depth) || '1. ' || line
 WHEN 'quote' THEN repeat('  ', depth) || '> ' || line WHEN 'to_do' THEN repeat('  ', depth) || CASE WHEN doc_id % 2 = 0 THEN '- [x] ' ELSE '- [ ] ' END || line WHEN 'code' THEN '```py' || chr(10) || line || chr(10) || '```' WHEN 'divider' THEN '---'
 ELSE repeat('  ', depth) || line END AS block, '| a | ' || kind || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | ' || depth || ' |' AS grid, 'kind: ' || kind || chr(10) || 'depth: ' || depth || CASE WHEN line <> '' THEN chr(10) || line ELSE '' END AS synthesized FROM b""")
def block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and tables as markdown, and short bodies with their properties in front."""
    kind = F.element_at(F.array(*map(F.lit, _BLOCKS)), (F.col("doc_id") % len(_BLOCKS) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " ").alias("line"), (F.col("doc_id") % 3).cast("int").alias("depth"))
    depth = F.col("depth").cast("string")
    grid = F.array(F.array(F.lit("a"), F.col("kind")), F.array(F.lit("1"), depth))
    props = routing.property_text(F.array(F.lit("kind"), F.lit("depth")), F.array(F.col("kind"), depth))
    return docs.select(
        "doc_id", text.block_markdown(F.col("kind"), F.col("line"), F.col("depth"), F.col("doc_id") % 2 == 0, F.lit("py")).alias("block"), text.table_markdown(grid, F.lit(True)).alias("grid"),
        routing.synthesized(F.col("line"), F.lit(5), props).alias("synthesized"),
    )


@query("""WITH d AS (SELECT *, source || '_' || lang || '_' || CASE WHEN doc_id % 4 = 0 THEN 'raw' ELSE 'x' END AS asset FROM documents)
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '0.0%' ELSE printf('%.1f%%', 100.0 * (doc_id % 97) / 97) END AS share, least(greatest(coalesce(CASE WHEN doc_id % 5 <> 0 THEN doc_id - 3 END, 10), 1), 50)::INT AS clamped,
[trim(k) FOR k IN string_split(lang || ', ' || source || ',x, ', ',') IF length(trim(k)) >= 2] AS keywords, contains(lower(text), 'the') OR contains(lower(source), 'the') AS any_keyword,
regexp_matches(asset, '^[A-Za-z0-9]+(_[A-Za-z0-9]+){2,}$') OR regexp_matches(asset, '_(view|raw|tbl|table)$') AS asset FROM d""")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares, clamped parameters, keywords and data assets."""
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    given = F.when(key % 5 == 0, "many").otherwise((key - 3).cast("string"))
    asset = F.concat_ws("_", "source", "lang", F.when(key % 4 == 0, "raw").otherwise("x"))
    words = text.keywords(F.concat(F.col("lang"), F.lit(", "), F.col("source"), F.lit(",x, ")))
    return docs.select(
        "doc_id", text.percentage(key % 97, F.when(key % 10 == 0, 0).otherwise(97)).alias("share"), structured.clamp(given, 1, 50, 10).alias("clamped"), words.alias("keywords"),
        text.any_keyword(F.array(F.lit("THE")), F.col("text"), F.col("source")).alias("any_keyword"), routing.is_data_asset(asset).alias("asset"),
    )


@query("SELECT lang, substring(sha256(array_to_string(list_sort(list(concat_ws(chr(31), doc_id::VARCHAR, coalesce(source, '')))), chr(30))), 1, 16) AS fingerprint FROM documents GROUP BY lang")
def set_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(ids.set_fingerprint(F.col("doc_id"), F.col("source")).alias("fingerprint"))


_LISTED = f"{_REGISTRY}, l AS (SELECT *, source || ' Title ' || page_id AS title FROM reg)"


@query(f"WITH {_LISTED} SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'success' WHEN page_id % 5 > 0 THEN 'partial' ELSE 'failed' END AS outcome FROM l WHERE last_edited_time > TIMESTAMP '2024-01-01 00:01:00' AND title ILIKE '%title 1%'")
def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages edited after a mark with a keyword in the title, and how a run over them ended."""
    titled = registry(spark, sf_dir).withColumn("title", _text(F.col("source"), " Title ", F.col("page_id")))
    found = tables.changed_since(titled, F.lit("2024-01-01 00:01:00").cast("timestamp_ntz"), "title 1")
    return found.select("page_id", tables.run_status(F.col("page_id") % 4, F.col("page_id") % 5).alias("outcome"))


@query("""WITH o AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linestatus AS mode FROM lineitem WHERE l_linenumber < 4), n AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'new' AS mode FROM lineitem WHERE l_linenumber > 2)
SELECT id, mode FROM n UNION ALL SELECT id, mode FROM o WHERE id NOT IN (SELECT id FROM n)""")
def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by id: new ones in the place of the old ones."""
    lines = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("id"), F.col("l_linestatus").alias("mode"), "l_linenumber")
    return tables.upsert(lines.where("l_linenumber < 4").drop("l_linenumber"), lines.where("l_linenumber > 2").drop("l_linenumber").withColumn("mode", F.lit("new")), ["id"])


_RAW = """raw AS (SELECT l_suppkey::VARCHAR AS src, 'ships ' || l_linestatus AS rel, l_returnflag AS dst, 'u' || (l_orderkey % 5) AS source_url, l_orderkey * 10 + l_linenumber AS seq, l_linenumber = 1 AS is_manual FROM lineitem)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_suppkey").cast("string").alias("src"), F.concat(F.lit("ships "), "l_linestatus").alias("rel_name"), F.col("l_returnflag").alias("dst"), _text("u", F.col("l_orderkey") % 5).alias("source_url"),
        F.expr("l_orderkey * 10 + l_linenumber").alias("seq"), (F.col("l_linenumber") == 1).alias("is_manual"),
    )


@query(f"WITH {_RAW} SELECT src, rel AS rel_name, dst, source_url, min(seq) AS seq FROM raw GROUP BY ALL")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge a key and source, the first one's properties."""
    return graph.merge_edges(_raw(spark, sf_dir)).select("src", "rel_name", "dst", "source_url", "seq")


@query(f"WITH {_RAW} SELECT dst AS label, src AS name, arg_min(source_url, seq) AS source_url FROM raw GROUP BY dst, src")
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_nodes(_raw(spark, sf_dir).select(F.col("dst").alias("label"), F.col("src").alias("name"), "source_url", "seq"))


@query(f"WITH {_RAW} SELECT src, dst, count(*) AS edges FROM raw WHERE NOT (source_url = 'u3' AND NOT is_manual) GROUP BY ALL")
def edges_without_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after a page's were deleted; those made by hand stay."""
    return tables.without_source(_raw(spark, sf_dir), "u3").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("edges"))


@query(f"""WITH {_GLOSSARY} SELECT al.alias, array_to_string(list_concat([gl.term], list_filter(synonyms, lambda s: s <> gl.term)), '|') AS forms, category FROM al JOIN gl USING (term) WHERE category = 'TYPE' OR starts_with(category, 'ECO') OR length(category) > 0""")
def glossary_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All aliases with the forms of their term."""
    terms = _glossary(spark, sf_dir)
    own = glossary.aliases(terms).select(F.col("alias").alias("name"), "alias", "term")
    return glossary.expand(own.select("name", "alias", "term"), terms).join(terms.select("term", "category"), "term").select("alias", F.array_join("forms", "|").alias("forms"), "category")


@query(f"WITH {_GLOSSARY}, al2 AS (SELECT al.alias, al.term, gl.category FROM al JOIN gl USING (term)) SELECT category, count(DISTINCT term) AS terms FROM al2 GROUP BY category")
def glossary_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.categories(glossary.aliases(_glossary(spark, sf_dir)))


@query("""WITH n AS (SELECT DISTINCT right(s_name, 3) AS name FROM supplier UNION SELECT DISTINCT right(s_name, 5) FROM supplier), k AS (SELECT name, regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '', 'g') AS key FROM n)
SELECT a.name AS short, b.name AS long FROM k a JOIN k b ON ends_with(b.key, a.key) AND length(b.key) > length(a.key) AND length(b.key) - length(a.key) <= 2 WHERE length(a.key) >= 2""")
def suffix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names that end longer ones by at most two letters more."""
    name = lambda n: table(spark, sf_dir, "supplier").select(F.right("s_name", F.lit(n)).alias("name"))
    return glossary.affix_pairs(name(3).union(name(5)).distinct(), suffix=True, extra=2)


_CONV = "c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rank FROM conversations)"


@query(f"""WITH RECURSIVE {_CONV}, b AS (SELECT conv_id, rank, 0 AS batch, length(text) AS chars, 1 AS items FROM c WHERE rank = 1
UNION ALL SELECT c.conv_id, c.rank, CASE WHEN chars + length(text) > 400 OR items >= 3 THEN batch + 1 ELSE batch END, CASE WHEN chars + length(text) > 400 OR items >= 3 THEN length(text) ELSE chars + length(text) END, CASE WHEN chars + length(text) > 400 OR items >= 3 THEN 1 ELSE items + 1 END
 FROM b JOIN c ON b.conv_id = c.conv_id AND c.rank = b.rank + 1) SELECT conv_id, rank, batch FROM b""")
def text_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation in batches of at most 400 letters and three turns."""
    talk = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("texts"))
    found = talk.select("conv_id", F.posexplode(context.batches(F.col("texts"), 400, 3)).alias("at", "batch"))
    return found.select("conv_id", (F.col("at") + 1).cast("long").alias("rank"), "batch")


@query(f"""WITH RECURSIVE {_CONV}, s AS (SELECT conv_id, rank, CASE WHEN length(bare) < 3 THEN [bare] ELSE list_distinct([substring(bare, i, 3) FOR i IN generate_series(1, length(bare) - 2)]) END AS s FROM (SELECT conv_id, rank, regexp_replace(substring(text, 1, 600), '\\s+', '', 'g') AS bare FROM c WHERE rank <= 100)),
k AS (SELECT conv_id, 0::BIGINT AS rank, []::VARCHAR[][] AS kept, false AS stays FROM (SELECT DISTINCT conv_id FROM s)
UNION ALL SELECT s.conv_id, s.rank, CASE WHEN near THEN kept ELSE list_append(kept, s.s) END, NOT near FROM (SELECT k.conv_id, k.kept, s.rank, s.s, coalesce(list_bool_or([len(list_intersect(x, s.s))::DOUBLE / len(list_distinct(list_concat(x, s.s))) >= 0.35::DOUBLE FOR x IN kept]), false) AS near FROM k JOIN s ON k.conv_id = s.conv_id AND s.rank = k.rank + 1) s)
SELECT conv_id, rank FROM k WHERE stays""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation that are not alike one kept before."""
    talk = table(spark, sf_dir, "conversations")
    ranked = talk.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")).cast("long"))
    return context.without_near_copies(ranked, ["conv_id"], "text", 0.35).select("conv_id", "rank")


@query("""SELECT doc_id, CASE WHEN quality = 0 THEN 'not in the source' WHEN doc_id % 3 = 0 THEN 'not retrieved' WHEN doc_id % 5 = 0 THEN 'cut from the context' ELSE 'generation' END AS miss,
CASE WHEN doc_id % 7 / 6.0 >= 0.7 THEN 'passed' WHEN doc_id % 5 / 4.0 >= 0.7 THEN 'distracted by the context' WHEN doc_id % 3 / 2.0 >= 0.7 THEN 'misled by the evidence' ELSE 'cannot answer' END AS generation FROM labels""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where answers were lost, by flags and scores that the labels stand for."""
    rows, key = table(spark, sf_dir, "labels"), F.col("doc_id")
    return rows.select("doc_id", context.miss_verdict(F.col("quality") != 0, key % 3 != 0, key % 5 != 0).alias("miss"), context.generation_verdict(key % 3 / 2, key % 5 / 4, key % 7 / 6).alias("generation"))


@query("""WITH e AS (SELECT 'user ' || user_id AS who, strftime(ts, '%Y-%m-%d') AS date, event_type, event_id, props FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY date, event_id) AS n FROM e)
SELECT who, string_agg(date || ' [' || event_type || '] ' || coalesce(props, ''), chr(10) ORDER BY n) AS timeline FROM r WHERE n <= 20 GROUP BY who""")
def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first events of every user as text."""
    rows = table(spark, sf_dir, "events").select(_text("user ", F.col("user_id")).alias("who"), F.date_format("ts", "yyyy-MM-dd").alias("date"), "event_type", "event_id", F.col("props").alias("title"))
    return context.event_lines(rows, ["who"])


@query(f"WITH {_SAID} SELECT doc_id, CASE WHEN contains(k, '데이터') AND contains(k, '팀') THEN 'BOTH' WHEN contains(k, '데이터') THEN 'KPI' ELSE 'ONTOLOGY' END AS route FROM (SELECT doc_id, regexp_replace(lower(said), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS k FROM said)")
def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("doc_id", context.query_route(F.col("said"), ("데이터",), ("팀",)).alias("route"))


@query("""WITH a AS (SELECT user_id AS k, count(*) AS ledger FROM events GROUP BY 1), b AS (SELECT user_id AS k, count(*) AS graph FROM events WHERE event_id % 3 <> 0 GROUP BY 1) SELECT a.k, ledger, coalesce(graph, 0) AS graph FROM a LEFT JOIN b USING (k) WHERE ledger <> coalesce(graph, 0)""")
def reconciled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts of a ledger and of a graph that lacks a third of them."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.col("user_id"))
    counted = lambda df, name: df.groupBy("k").agg(F.count(F.lit(1)).alias(name))
    return reports.reconciled(counted(rows, "ledger"), counted(rows.where("event_id % 3 <> 0"), "graph"), "k").select("k", "ledger", "graph")


@query("""WITH e AS (SELECT CASE user_id % 3 WHEN 0 THEN 'game' WHEN 1 THEN 'org' ELSE 'unknown' END AS scope_type, 's' || (user_id % 7) AS scope, user_id % 2 = 0 AS ok FROM events), n AS (SELECT count(*) AS n FROM e)
SELECT scope_type, scope, count(*) AS events, round(count(*)::DOUBLE / n, 6) AS share FROM e, n WHERE (scope_type = 'game' AND NOT ok) OR scope_type = 'unknown' GROUP BY scope_type, scope, n""")
def scope_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of events that are unknown or not verified."""
    user = F.col("user_id")
    rows = table(spark, sf_dir, "events").select(F.when(user % 3 == 0, "game").when(user % 3 == 1, "org").otherwise("unknown").alias("scope_type"), _text("s", user % 7).alias("scope"), (user % 2 == 0).alias("scope_verified"))
    return scopes.scope_issues(rows)


_PROPS = """p AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '2025-01-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') END AS day, ['캠페인 조정', 'server_update', 'Something', ''][(p_partkey % 4)::INT + 1] AS kind, p_brand, p_name FROM part)"""


@query(f"""WITH {_PROPS} SELECT p_partkey AS page_id, p_brand AS game, CASE kind WHEN '캠페인 조정' THEN 'ua_campaign' WHEN 'server_update' THEN 'server_update' WHEN 'Something' THEN 'ua_campaign' ELSE 'user_event' END AS event_type, day AS date,
CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'page ' || p_partkey END AS title, '' AS manager FROM p WHERE day <> ''""")
def property_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of pages whose properties hold a date, under names of two languages."""
    key = F.col("p_partkey")
    day = F.when(key % 9 == 0, "").otherwise(F.concat(F.lit("2025-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"), F.lit("T09:00")))
    kind = F.element_at(F.array(*map(F.lit, ("캠페인 조정", "server_update", "Something", ""))), (key % 4 + 1).cast("int"))
    props = F.create_map(F.lit("Date"), day, F.lit("게임"), F.col("p_brand"), F.lit("유형"), kind, F.lit("Name"), F.when(key % 2 == 0, F.col("p_name")).otherwise(" "))
    pages = table(spark, sf_dir, "part").select(key.alias("page_id"), F.lit("u").alias("source_url"), _text("page ", key).alias("title"), props.alias("db_properties"))
    return scopes.page_events(pages).select("page_id", "game", "event_type", "date", "title", "manager")


_NAMED = """asked AS (SELECT p_partkey AS id, ['Almond', ' antique ', 'BRAND 1', '기타', 'Unheard', NULL][(p_partkey % 6)::INT + 1] AS value, CASE WHEN p_partkey % 4 = 0 THEN 'Game' ELSE 'owner' END AS source_key, CASE WHEN p_partkey % 5 = 0 THEN 'by team Blue Sky, today' WHEN p_partkey % 5 = 1 THEN 'Blue and SKY' ELSE '' END AS text FROM part)"""


@query(f"""WITH {_NAMED}, c AS (SELECT id, trim(coalesce(value, '')) AS v, lower(source_key) IN ('game', 'product', 'project') AS g, CASE WHEN contains(text, 'Blue Sky') THEN 'Blue Sky' WHEN regexp_matches(text, '(^|[^A-Za-z0-9])SKY($|[^A-Za-z0-9])') THEN 'SKY' END AS team FROM asked),
d AS (SELECT *, lower(v) IN ('', '기타') AS none, CASE WHEN lower(regexp_replace(v, '[^A-Za-z0-9]', '', 'g')) = 'almond' THEN 'Almond Game' END AS game, CASE WHEN lower(v) = 'antique' THEN 'Antique Org' END AS org FROM c)
SELECT id, coalesce(game, org, CASE WHEN NOT none AND g THEN v END, team, CASE WHEN none THEN '' ELSE v END) AS scope, CASE WHEN game IS NOT NULL THEN 'game' WHEN org IS NOT NULL THEN 'org' WHEN NOT none AND g THEN 'game' WHEN team IS NOT NULL THEN 'org' ELSE 'unknown' END AS scope_type, game IS NOT NULL OR org IS NOT NULL AS scope_verified FROM d""")
def scope_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects by the glossary's games and organisations, by a game property, by a team in the text, or unknown."""
    key = F.col("p_partkey")
    value = F.element_at(F.array(F.lit("Almond"), F.lit(" antique "), F.lit("BRAND 1"), F.lit("기타"), F.lit("Unheard"), F.lit(None)), (key % 6 + 1).cast("int"))
    said = F.when(key % 5 == 0, "by team Blue Sky, today").when(key % 5 == 1, "Blue and SKY").otherwise("")
    rows = table(spark, sf_dir, "part").select(key.alias("id"), value.alias("value"), F.when(key % 4 == 0, "Game").otherwise("owner").alias("source_key"), said.alias("text"))
    known = spark.createDataFrame([("Almond", "Almond Game", "game"), ("Almond Game", "Almond Game", "game"), ("antique", "Antique Org", "organization"), ("Antique Org", "Antique Org", "organization")], "alias string, term string, category string")
    teams = spark.createDataFrame([("Blue Sky",), ("SKY",), ("B",)], "name string")
    return scopes.classify(rows, known, teams, "id").select("id", "scope", "scope_type", "scope_verified")


@query("""SELECT 'p' || doc_id || '.md' AS file, replace('p-' || doc_id, '-', '') AS page_id, CASE WHEN doc_id % 4 = 0 THEN 'p' || doc_id ELSE lang || ': ' || source END AS title, length(body) AS letters FROM (SELECT *, regexp_replace(coalesce(text, ''), '\\r', '', 'g') AS body FROM documents)""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as pages with front matter, and read again."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "\r", "")
    title = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.col("lang"), F.lit(": "), F.col("source")))
    made = table(spark, sf_dir, "documents").select(
        _text("p", F.col("doc_id"), ".md").alias("file"), title.alias("title"), F.lit("u").alias("source_url"), _text("p-", F.col("doc_id")).alias("page_id"), F.lit(None).cast("timestamp").alias("last_edited_time"),
        F.lit(None).cast("map<string,string>").alias("db_properties"), body.alias("body"),
    )
    return markdown.parse(markdown.page_text(made)).select("file", "page_id", "title", F.length("body").alias("letters"))


@query("""WITH b AS (SELECT page, n, t, coalesce(lag(n) OVER (PARTITION BY page ORDER BY n) = n - 1, false) AS follows FROM (SELECT l_orderkey AS page, l_linenumber AS n, min(l_linestatus) AS t FROM lineitem GROUP BY ALL))
SELECT page, string_agg(CASE WHEN n % 2 = 1 THEN t WHEN follows THEN '  - ' || t ELSE '- ' || t END, chr(10) ORDER BY n) AS body FROM b GROUP BY page""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as blocks: each even one is a list item, below the line before if there is one."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("pos")).agg(F.min("l_linestatus").alias("text"))
    even = F.col("pos") % 2 == 0
    before = F.lag("pos").over(Window.partitionBy("page_id").orderBy("pos"))
    blocks = lines.select(
        "page_id", F.col("pos").alias("block_id"), F.when(even & (before == F.col("pos") - 1), before).alias("parent_id"), "pos", F.when(even, "bulleted_list_item").otherwise("paragraph").alias("type"), "text",
        F.lit(False).alias("checked"), F.lit("").alias("language"),
    )
    return tabular.block_lines(blocks).select(F.col("page_id").alias("page"), "body")


@query("SELECT page_id, rank FROM (SELECT page_id, row_number() OVER (ORDER BY date_ts, page_id) AS rank FROM (SELECT event_id AS page_id, floor(epoch(ts))::BIGINT AS date_ts, event_type FROM events) WHERE date_ts > 0 AND event_type = 'view') WHERE rank <= 20")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty events of a type: a listing."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("date_ts"), "event_type")
    found = events.timeline(rows.where("date_ts > 0"), kind="view", limit=20)
    return top_by(found.withColumn("_all", F.lit(0)), ["_all"], 20, F.asc("date_ts"), F.asc("event_id")).select(F.col("event_id").alias("page_id"), "rank")
