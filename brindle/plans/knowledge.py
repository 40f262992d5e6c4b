"""Queries: page properties, triples and their evidence, subjects of events, entity lookup, question sets and sync state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import properties
from brindle.operators import api, events, glossary, golden, pages, reports, tables, triples
from brindle.operators import graph as g
from brindle.session import dealt

from .base import query, table
from .graph import _EDGES, _NODES, edges, nodes
from .reports import _REGISTRY, registry
from .search import _CHUNKS


def _text(*parts: Column | str) -> Column:
    """Texts joined; strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""WITH p AS (SELECT p_partkey, p_name, p_brand, p_size, string_split(p_type, ' ') AS words, p_partkey % 3 = 0 AS old FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'page-' || p_partkey ELSE p_name END AS title, p_brand AS brand, p_size::VARCHAR AS size, array_to_string(words, ', ') AS tags,
'2024-03-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS made, CASE WHEN old THEN 'true' ELSE 'false' END AS old, 6 AS n FROM p""")
def page_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages with typed properties: some without a title, all with an empty link and a relation."""
    quoted = lambda c: F.to_json(F.array(c))
    bare = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    # dealt out: a page is a short row with much to read, so that a file of one piece holds many
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey").withColumn("_title", F.when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.col("p_name")))
    tags = F.to_json(F.transform(F.split("p_type", " "), lambda w: F.struct(w.alias("name"))))
    made = _text("2024-03-", F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"), "T10:00:00Z")
    json = _text(
        '{"Name": {"type": "title", "title": [{"plain_text": ', bare("_title"), '}]}, "Brand": {"type": "select", "select": {"name": ', bare("p_brand"), '}}, "Size": {"type": "number", "number": ', F.col("p_size"),
        '}, "Tags": {"type": "multi_select", "multi_select": ', tags, '}, "Made": {"type": "date", "date": {"start": "', made, '"}}, "Old": {"type": "checkbox"',
        F.when(F.col("p_partkey") % 3 == 0, ', "checkbox": true').otherwise(""), '}, "Link": {"type": "url", "url": null}, "Of": {"type": "relation", "relation": [{"id": "x"}]}, "Note": {"type": "rich_text", "rich_text": ', quoted(F.struct(F.lit(" n ").alias("plain_text"))), "}}",
    )
    read = part.select("p_partkey", properties.entries(json).alias("e")).select("p_partkey", "e", properties.joined(properties.values_of(F.col("e"))).alias("m"))
    named = {name: F.col("m")[name.title()].alias(name) for name in ("brand", "size", "tags", "made", "old")}
    return read.select("p_partkey", properties.title_of(F.col("e"), _text("page-", F.col("p_partkey"))).alias("title"), *named.values(), F.size("m").alias("n"))


@query("""SELECT o_orderkey, 'Customer ' || o_custkey AS subject, CASE WHEN o_orderkey % 2 = 0 THEN 'Person' ELSE 'Unknown' END AS subject_type, 'ORDERED' AS predicate, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 7)::INT END AS place,
'Order ' || o_orderkey AS object, trim(o_orderpriority) AS evidence_quote FROM orders WHERE trim(o_orderpriority) <> ''""")
def triples_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a model would tell them: objects or plain texts, among noise, in fences."""
    orders, even = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 2 == 0
    customer = _text('"Customer ', F.col("o_custkey"), '"')
    subject = F.when(even, _text('{"name": ', customer, ', "type": "Person"}')).otherwise(customer)
    predicate = F.when(even, _text('{"name": "ORDERED", "order": "', F.col("o_orderkey") % 7, '"}')).otherwise('"ORDERED"')
    answer = _text(
        '```json\\nHere: [{"subject": ', subject, ', "predicate": ', predicate, ', "object": "Order ', F.col("o_orderkey"), '", "evidence_quote": " ', F.col("o_orderpriority"), ' "}, "noise", 7, {"subject": "a", "evidence_quote": "  "}]\\n```'
    )
    found = triples.cleaned(orders.select("o_orderkey", answer.alias("answer")), "answer")
    return found.select(
        "o_orderkey", F.col("subject.name").alias("subject"), F.col("subject.type").alias("subject_type"), F.col("predicate.name").alias("predicate"), F.col("predicate.order").alias("place"), F.col("object.name").alias("object"), "evidence_quote",
    )


@query(f"""WITH c AS ({_CHUNKS}), q AS (SELECT doc_id, substring(text, (doc_id * 37 % greatest(length(text) - 50, 1))::INT + 1, 60) AS quote FROM documents),
k AS (SELECT doc_id, quote, trim(lower(substring(quote, 1, 40))) AS key FROM q),
f AS (SELECT k.doc_id, min(chunk_index) AS evidence_chunk_index FROM k JOIN c ON k.doc_id = c.doc_id AND key <> '' AND contains(lower(c.text), key) GROUP BY 1)
SELECT q.doc_id, evidence_chunk_index, length(c.text) AS evidence_length FROM q LEFT JOIN f USING (doc_id) LEFT JOIN c ON c.doc_id = q.doc_id AND c.chunk_index = evidence_chunk_index""")
def edge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote from each document, the chunk it comes from, and that chunk by its id."""
    docs = table(spark, sf_dir, "documents")
    url = F.col("doc_id").cast("string").alias("source_url")
    at = (F.col("doc_id") * 37 % F.greatest(F.length("text") - 50, F.lit(1))).cast("int") + 1
    quotes = docs.select("doc_id", url, F.col("text").substr(at, F.lit(60)).alias("evidence_quote"))
    chunks = pages.chunked(docs).withColumn("source_url", F.col("doc_id").cast("string"))
    found = triples.evidence_chunks(quotes, chunks)
    stored = chunks.select(triples.chunk_id(F.col("source_url"), F.col("chunk_index")).alias("chunk_id"), "text")
    return triples.with_evidence(found, stored).select("doc_id", "evidence_chunk_index", F.length("evidence").alias("evidence_length"))


@query(f"""WITH c AS ({_CHUNKS}), p AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS content, count(*) AS chunks FROM c GROUP BY doc_id)
SELECT event_id, length(content) AS page_length, chunks AS page_chunk_count FROM events LEFT JOIN p ON user_id * 3 = doc_id""")
def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the document that their user stands for, where there is one."""
    whole = pages.assembled(pages.chunked(table(spark, sf_dir, "documents"))).withColumnRenamed("doc_id", "source_url")
    asked = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 3).alias("source_url"))
    return events.with_pages(asked, whole).select("event_id", F.length("page_content").alias("page_length"), "page_chunk_count")


_SUBJECTS = """ev AS (SELECT 'e' || event_id AS event_id, CASE WHEN user_id % 3 = 0 THEN 'org' WHEN user_id % 3 = 1 THEN 'game' ELSE 'unknown' END AS scope_type, CASE WHEN user_id % 3 = 1 THEN 'Game ' || (user_id % 40) ELSE '' END AS game,
  CASE WHEN user_id % 3 = 0 THEN (SELECT min(n_name) FROM nation WHERE n_nationkey = user_id % 25) ELSE 'Game ' || (user_id % 40) END AS scope, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN user_id % 4 = 0 THEN 'REGION_' || (user_id % 9) ELSE '' END AS manager FROM events),
had AS (SELECT DISTINCT CASE scope_type WHEN 'game' THEN 'Game' ELSE 'Team' END AS src_label, CASE scope_type WHEN 'game' THEN game ELSE scope END AS src, 'HAD_EVENT' AS rel_name, event_id AS dst, date FROM ev WHERE (scope_type = 'game' AND game <> '') OR (scope_type = 'org' AND coalesce(scope, '') <> '')),
managed AS (SELECT DISTINCT 'Event' AS src_label, event_id AS src, 'MANAGED_BY' AS rel_name, manager AS dst, date FROM ev WHERE manager IN (SELECT r_name FROM region) AND manager <> '')"""


def _subjects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events of games, nations or nothing, managed by regions (not all of them known); their edges; the nodes."""
    user = F.col("user_id")
    game = _text("Game ", user % 40)
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_k"), "n_name")
    made = table(spark, sf_dir, "events").withColumn("_k", user % 25).join(nation, "_k", "left").select(
        _text("e", F.col("event_id")).alias("event_id"), F.when(user % 3 == 0, "org").when(user % 3 == 1, "game").otherwise("unknown").alias("scope_type"), F.when(user % 3 == 1, game).otherwise("").alias("game"),
        F.when(user % 3 == 0, F.col("n_name")).otherwise(game).alias("scope"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(user % 4 == 0, _text("REGION_", user % 9)).otherwise("").alias("manager"),
        F.lit("https://example.org").alias("source_url"),
    )
    known = nodes(spark, sf_dir).withColumn("source_url", F.lit(""))
    made_edges, made_nodes = events.subject_edges(made, known)
    return made, made_edges, made_nodes


@query(f"WITH {_SUBJECTS} SELECT * FROM had UNION ALL SELECT * FROM managed")
def subject_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir)[1].select("src_label", "src", "rel_name", "dst", "date")


@query(f"WITH {_SUBJECTS} SELECT event_id, scope_type FROM ev WHERE event_id NOT IN (SELECT dst FROM had)")
def events_without_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, made_edges, _ = _subjects(spark, sf_dir)
    return events.without_edge(made, made_edges).select("event_id", "scope_type")


@query(f"WITH {_SUBJECTS} SELECT event_id, date, event_id IN (SELECT dst FROM had WHERE src = 'Game 7') AS by_edge, game = 'Game 7' AS by_property FROM ev WHERE game = 'Game 7' OR event_id IN (SELECT dst FROM had WHERE src = 'Game 7')")
def game_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of one game, by its edges and by their own property."""
    made, made_edges, _ = _subjects(spark, sf_dir)
    return events.of_game(made, made_edges, "Game 7").select("event_id", "date", "by_edge", "by_property")


@query(f"""WITH {_SUBJECTS}, asked AS (SELECT DISTINCT 'ame ' || (user_id % 60) AS asked FROM events UNION SELECT 'nothing like it'), gn AS (SELECT DISTINCT src AS name FROM had WHERE src_label = 'Game')
SELECT asked, coalesce((SELECT min(name) FROM gn WHERE contains(name, asked)), (SELECT min(game) FROM ev WHERE contains(game, asked)), asked) AS game FROM asked""")
def resolve_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of names, and the games they mean."""
    made, _, made_nodes = _subjects(spark, sf_dir)
    asked = table(spark, sf_dir, "events").select(_text("ame ", F.col("user_id") % 60).alias("asked")).union(spark.range(1).select(F.lit("nothing like it"))).distinct()
    return events.resolve_games(asked, made_nodes, made).select("asked", "game")


_FOLD = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query(f"""WITH {_EDGES}, {_NODES}, deg AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM edges UNION ALL SELECT dst FROM edges) GROUP BY name),
asked AS (SELECT DISTINCT upper(replace(r_name, '_', ' ')) AS asked FROM region UNION SELECT DISTINCT right(s_name, 3) FROM supplier),
c AS (SELECT asked, nodes.name, label, coalesce(degree, 0) AS degree, {_FOLD.format("nodes.name")} AS key, {_FOLD.format("asked")} AS want FROM nodes LEFT JOIN deg ON nodes.name = deg.name, asked),
t AS (SELECT *, CASE WHEN key = want THEN 0 WHEN starts_with(key, want) THEN 1 ELSE 2 END AS tier FROM c WHERE contains(key, want)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY tier, degree DESC, length(name), name, label) AS r FROM t) WHERE r = 1)
SELECT b.asked, b.name, b.label, array_to_string(list_sort(list_distinct(list(t.label))), ',') AS types, array_to_string(list_sort(list_distinct(list(t.name))), ',') AS names FROM b JOIN t ON b.asked = t.asked AND b.key = t.key GROUP BY 1, 2, 3""")
def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that regions in another spelling, and ends of supplier names, mean."""
    asked = table(spark, sf_dir, "region").select(F.upper(F.replace("r_name", F.lit("_"), F.lit(" "))).alias("asked")).union(table(spark, sf_dir, "supplier").select(F.right("s_name", F.lit(3)))).distinct()
    found = glossary.lookup_entities(asked, g.degrees(edges(spark, sf_dir), nodes(spark, sf_dir)))
    return found.select("asked", "name", "label", F.array_join("types", ",").alias("types"), F.array_join("names", ",").alias("names"))


_ASKED = "q AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'What of ' || n_name || ', please?' ELSE 'customer ' || lower(n_name) || ' Supplier' END AS text FROM nation), names AS (SELECT n_name AS name FROM nation UNION SELECT c_name FROM customer)"


@query(rf"""WITH {_ASKED}, ex AS (SELECT n_nationkey, name FROM q JOIN names ON length(name) >= 2 AND contains(text, name) AND (NOT regexp_matches(name, '^[A-Za-z0-9_-]+$') OR regexp_matches(text, '(^|[^A-Za-z0-9])' || name || '($|[^A-Za-z0-9])'))),
w AS (SELECT n_nationkey, i, ws[i] AS word FROM (SELECT n_nationkey, list_filter(ws, lambda x, i: length(x) >= 2 AND list_position(ws, x) = i)[1:6] AS ws FROM (SELECT n_nationkey, [regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') FOR x IN regexp_split_to_array(trim(text), '\s+')] AS ws FROM q WHERE n_nationkey NOT IN (SELECT n_nationkey FROM ex))), LATERAL (SELECT unnest(generate_series(1, len(ws))) AS i)),
lo AS (SELECT n_nationkey, i, name, row_number() OVER (PARTITION BY n_nationkey, i ORDER BY name) AS r FROM w JOIN names ON contains(name, word)),
l2 AS (SELECT n_nationkey, name, min((i, r)) AS o FROM lo WHERE r <= 2 GROUP BY ALL)
SELECT n_nationkey, name, rank FROM (SELECT n_nationkey, name, row_number() OVER (PARTITION BY n_nationkey ORDER BY length(name) DESC, name) AS rank FROM ex) WHERE rank <= 5
UNION ALL SELECT n_nationkey, name, rank FROM (SELECT n_nationkey, name, row_number() OVER (PARTITION BY n_nationkey ORDER BY o, name) AS rank FROM l2) WHERE rank <= 5""")
def entities_in_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about nations, half of which name one as it is written."""
    nation = table(spark, sf_dir, "nation")
    text = F.when(F.col("n_nationkey") % 2 == 0, _text("What of ", F.col("n_name"), ", please?")).otherwise(_text("customer ", F.lower("n_name"), " Supplier"))
    names = nation.select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "customer").select("c_name")).distinct()
    return glossary.entities_in_questions(nation.select("n_nationkey", text.alias("text")), names, "n_nationkey")


_ITEMS = """items AS (SELECT conv_id * 100 + turn AS id, ['담당자', '정책/규정', '관계', '문서위치', '복합', 'other'][(conv_id % 6 + 1)::INT] AS category, ['easy', 'medium', 'hard', 'odd'][(turn % 4 + 1)::INT] AS difficulty,
  CASE conv_id % 4 WHEN 0 THEN '이 문서에서 ' ELSE '' END || text AS question, substring(text, 1, (conv_id % 5)::INT) AS answer, 'u' || (conv_id % 30) AS source_url FROM conversations)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as candidates for questions."""
    talk = table(spark, sf_dir, "conversations")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    return talk.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), pick([*golden.CATEGORIES, "other"], F.col("conv_id") % 6).alias("category"), pick([*golden.DIFFICULTIES, "odd"], F.col("turn") % 4).alias("difficulty"),
        F.concat(F.when(F.col("conv_id") % 4 == 0, "이 문서에서 ").otherwise(""), "text").alias("question"), F.col("text").substr(F.lit(1), (F.col("conv_id") % 5).cast("int")).alias("answer"), _text("u", F.col("conv_id") % 30).alias("source_url"),
    )


_VALID = f"""{_ITEMS}, va AS (SELECT * FROM items WHERE category <> 'other' AND difficulty <> 'odd' AND length(question) >= 10 AND length(answer) >= 2),
dd AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(question), '[^\\p{{L}}\\p{{N}}]+', '', 'g') ORDER BY id) AS r FROM va) WHERE r = 1)"""


_POINTING = rf"(^|[\s,.(])({'|'.join(golden.DEICTIC)})\s*({'|'.join(golden.POINTED_AT)})"


@query(f"WITH {_VALID} SELECT id, category, difficulty, conv AS context_dependent FROM (SELECT *, regexp_matches(question, '{_POINTING}') AS conv FROM dd)")
def golden_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid candidates, one for each question, and whether they point outside themselves."""
    found = golden.deduplicated(golden.valid(_items(spark, sf_dir)), "id")
    return found.select("id", "category", "difficulty", golden.points_outside(F.col("question")).alias("context_dependent"))


_GOALS = {"담당자": 9, "정책/규정": 6, "관계": 12}


@query(f"""WITH {_VALID}, goals AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{d}', {k}, {n})" for c, n in _GOALS.items() for d, k in golden.targets(n).items())}) AS v(category, difficulty, goal, whole)),
r AS (SELECT dd.*, goal, whole, row_number() OVER (PARTITION BY category, difficulty ORDER BY sha256(id::VARCHAR), id) > goal AS fill FROM dd JOIN goals USING (category, difficulty))
SELECT id, category, difficulty, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY fill, sha256(id::VARCHAR), id) AS rank FROM r) WHERE rank <= whole""")
def golden_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions spread over difficulties, filled up where one has too few."""
    found = golden.selected(golden.deduplicated(golden.valid(_items(spark, sf_dir)), "id"), _GOALS, "id")
    return found.select("id", "category", "difficulty", "rank")


@query(f"WITH {_ITEMS} SELECT DISTINCT source_url FROM items WHERE id % 2 = 0 AND source_url IN (SELECT source_url FROM items WHERE id % 2 = 1)")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources on both sides of a split by question, which is no sound one."""
    items = _items(spark, sf_dir)
    return golden.overlap(items.where("id % 2 = 0"), items.where("id % 2 = 1"), "source_url")


@query(f"WITH {_ITEMS}, kept AS (SELECT id, category FROM items WHERE id % 3 <> 0 AND id % 7 <> 0) SELECT id, category FROM kept UNION ALL SELECT id, 'new' FROM items WHERE id % 21 = 0 AND id NOT IN (SELECT id FROM kept)")
def golden_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question set after some were deleted and others created."""
    items = _items(spark, sf_dir).select("id", "category")
    stored = golden.deleted(items.where("id % 3 <> 0"), items.where("id % 7 = 0"))
    return golden.listed(golden.created(stored, items.where("id % 21 = 0").withColumn("category", F.lit("new"))))


_JUDGED = """ex AS (SELECT item_id, [substring(text, 1, 12), 'No Such Title'] AS expected FROM benchmark),
rs AS (SELECT item_id, lower(substring(text, 1, 6 + (item_id % 9)::INT)) || CASE WHEN item_id % 3 = 0 THEN '#' ELSE '' END AS title, 1.0::DOUBLE / (1 + item_id % 7) AS score FROM benchmark WHERE item_id % 5 <> 0),
j AS (SELECT ex.item_id, score, list_filter(expected, lambda e: title IS NOT NULL AND (contains(title, lower(e)) OR contains(lower(e), title))) AS matched FROM ex LEFT JOIN rs USING (item_id))"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions whose search found a title like their opening, or failed."""
    asked = table(spark, sf_dir, "benchmark")
    expected = asked.select("item_id", F.array(F.substring("text", 1, 12), F.lit("No Such Title")).alias("expected"))
    title = F.concat(F.lower(F.col("text").substr(F.lit(1), (6 + F.col("item_id") % 9).cast("int"))), F.when(F.col("item_id") % 3 == 0, "#").otherwise(""))
    results = asked.where("item_id % 5 <> 0").select("item_id", title.alias("title"), (F.lit(1.0) / (1 + F.col("item_id") % 7)).alias("score"), F.lit(1).alias("rank"))
    return golden.judged(expected, results, "item_id")


@query(f"WITH {_JUDGED} SELECT item_id, len(matched) AS matches, len(matched) > 0 AS passed, round(score, 6) AS score FROM j")
def golden_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("item_id", F.size("matched").cast("long").alias("matches"), "passed", F.round("score", 6).alias("score"))


@query(f"WITH {_JUDGED} SELECT count(*) AS total, count(*) FILTER (len(matched) > 0) AS passed, count(*) FILTER (len(matched) = 0) AS failed, round(avg(score), 4) AS average FROM j")
def golden_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.run_summary(_judged(spark, sf_dir))


@query(f"WITH {_REGISTRY} SELECT page_id, title, dept FROM (SELECT *, source || ' Page ' || page_id AS title FROM reg) WHERE dept = 'en' AND status = 'ok' AND word_count >= 30 AND title ILIKE '%page 1%' ORDER BY page_id LIMIT 20 OFFSET 20")
def registry_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a title search over usable pages: a listing of 20 rows."""
    titled = registry(spark, sf_dir).withColumn("title", _text(F.col("source"), " Page ", F.col("page_id")))
    return reports.page_of(reports.searched(reports.usable(titled), "page 1", dept="en"), 2, 20, F.asc("page_id")).select("page_id", "title", "dept")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id % 8 = 0 ELSE contains(text, 'the') END AS has_html_attachment FROM documents")
def html_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of all pages after three quarters were scanned for a marker."""
    docs = table(spark, sf_dir, "documents")
    stored = docs.select("doc_id", (F.col("doc_id") % 8 == 0).alias("has_html_attachment"))
    return reports.flagged(stored, docs.where("doc_id % 4 <> 0").select("doc_id", "text"), "doc_id", "the")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'db' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a search found, and those of a direct query that it did not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return reports.with_others(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 2 = 0").withColumn("lang", F.lit("db")), "doc_id")


@query(f"""WITH {_EDGES}, {_NODES}, d AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM edges UNION ALL SELECT dst FROM edges) GROUP BY name),
l AS (SELECT label, name FROM nodes UNION ALL SELECT 'Team', n_name FROM nation)
SELECT l.name, sum(coalesce(degree, 0))::BIGINT AS edges, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, CASE WHEN min(label) = 'Team' THEN '#10B981' ELSE '#94A3B8' END AS colour FROM l LEFT JOIN d ON l.name = d.name GROUP BY l.name""")
def edges_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of every name over its labels (nations are teams too), with the first label's colour."""
    both = nodes(spark, sf_dir).unionByName(table(spark, sf_dir, "nation").select(F.lit("Team").alias("label"), F.col("n_name").alias("name")))
    found = reports.edges_per_name(g.degrees(edges(spark, sf_dir), both))
    return found.select("name", "edges", F.array_join("labels", ",").alias("labels"), reports.colour(F.col("labels")[0]).alias("colour"))


@query(f"WITH {_REGISTRY} SELECT count(*) AS rows, coalesce(sum(word_count), 0)::BIGINT AS word_count, coalesce(sum(chunk_count), 0)::BIGINT AS chunk_count, coalesce(sum(event_count), 0)::BIGINT AS event_count FROM reg WHERE status = 'ok'")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(registry(spark, sf_dir).where("status = 'ok'"), "word_count", "chunk_count", "event_count")


@query(f"WITH {_REGISTRY}, done AS (SELECT * FROM reg WHERE status = 'ok' ORDER BY last_edited_time DESC, page_id LIMIT 50) SELECT max(last_edited_time) AS last_sync_time, count(*) AS last_sync_count, 17 + count(*) AS total_synced FROM done")
def sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a run over the 50 pages edited last (the limit is the feature)."""
    done = tables.limited(registry(spark, sf_dir).where("status = 'ok'"), 50, "page_id")
    state = spark.range(1).select(F.lit(17).cast("long").alias("total_synced"))
    return tables.advanced(state, done, done.agg(F.max("last_edited_time").alias("t")).scalar())


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE (event_id * 2 + user_id)::VARCHAR END AS result, CASE WHEN event_id % 10 = 0 THEN 'ValueError: no tens' END AS error FROM events""")
def external_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function over every event, which fails for one in ten."""

    def function(a: int, b: int, c: int) -> int:
        if not c:
            raise ValueError("no tens")
        return a * 2 + b

    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("a"), F.col("user_id").alias("b"), (F.col("event_id") % 10).alias("c"))
    return api.applied(rows, function, "event_id", "a", "b", "c")


