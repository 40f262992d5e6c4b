"""Queries: the star schema as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import glossary
from brindle.operators import graph as g
from brindle.session import dealt

from .base import query, table

_EDGES = """edges AS (
  SELECT n_name AS src, 'IN_REGION' AS rel_name, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_name, 'LOCATED_IN', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_name, 'LOCATED_IN', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_name, 'ORDERED', 'Order ' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT DISTINCT 'Order ' || l_orderkey, 'SUPPLIED_BY', s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
_NODES = """nodes AS (
  SELECT 'Region' AS label, r_name AS name FROM region UNION ALL SELECT 'Nation', n_name FROM nation
  UNION ALL SELECT 'Customer', c_name FROM customer UNION ALL SELECT 'Supplier', s_name FROM supplier UNION ALL SELECT 'Order', 'Order ' || o_orderkey FROM orders)"""


def edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """The graph's edges, each once; as often as there are rows for it if not once, which saves a shuffle of the order lines."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, src, rel, dst: df.select(src.alias("src"), F.lit(rel).alias("rel_name"), dst.alias("dst"))
    order = lambda key: F.concat(F.lit("Order "), F.col(key).cast("string"))
    nation, lines = t("nation"), t("lineitem").select("l_orderkey", "l_suppkey")
    if once:
        lines = dealt(lines, "l_orderkey", rows=lines.count()).distinct()  # the count is read from the files' footers
    parts = [
        edge(nation.join(t("region"), F.expr("n_regionkey = r_regionkey")), F.col("n_name"), "IN_REGION", F.col("r_name")),
        edge(t("customer").join(nation, F.expr("c_nationkey = n_nationkey")), F.col("c_name"), "LOCATED_IN", F.col("n_name")),
        edge(t("supplier").join(nation, F.expr("s_nationkey = n_nationkey")), F.col("s_name"), "LOCATED_IN", F.col("n_name")),
        edge(t("orders").join(t("customer"), F.expr("o_custkey = c_custkey")), F.col("c_name"), "ORDERED", order("o_orderkey")),
        edge(lines.join(t("supplier"), F.expr("l_suppkey = s_suppkey")), order("l_orderkey"), "SUPPLIED_BY", F.col("s_name")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"Region": ("region", "r_name"), "Nation": ("nation", "n_name"), "Customer": ("customer", "c_name"), "Supplier": ("supplier", "s_name")}
    out = table(spark, sf_dir, "orders").select(F.lit("Order").alias("label"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"))
    for label, (name, column) in columns.items():
        out = out.unionByName(table(spark, sf_dir, name).select(F.lit(label).alias("label"), F.col(column).alias("name")))
    return out


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))


@query(f"WITH {_NODES} SELECT label, count(*) AS nodes FROM nodes GROUP BY label")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"WITH {_EDGES} SELECT rel_name, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY rel_name")
def relation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("rel_name").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query(f"WITH {_EDGES} SELECT src, dst, CASE rel_name WHEN 'ORDERED' THEN 'trade' WHEN 'SUPPLIED_BY' THEN 'trade' ELSE 'place' END AS kind, rel_name FROM edges")
def typed_edge_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("rel_name").isin("ORDERED", "SUPPLIED_BY"), "trade").otherwise("place")
    return edges(spark, sf_dir).select("src", "dst", kind.alias("kind"), "rel_name")


@query(f"""WITH {_EDGES}, names AS (SELECT n_name AS name FROM nation),
o AS (SELECT name, 'out' AS direction, rel_name, dst AS other FROM edges JOIN names ON src = name),
i AS (SELECT name, 'in' AS direction, min(rel_name) AS rel_name, src AS other FROM edges JOIN names ON dst = name GROUP BY name, src)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rel_name, other) AS rank FROM o) WHERE rank <= 20
UNION ALL SELECT name, direction, rel_name, other, rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rel_name, other) AS rank FROM i) WHERE rank <= 10""")
def neighbours_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.neighbours(edges(spark, sf_dir), _nations(spark, sf_dir)).select("name", "direction", "rel_name", "other", "rank")


@query(f"""WITH {_EDGES}, p AS (SELECT DISTINCT a.src AS name, a.rel_name AS rel_1, a.dst AS via, b.rel_name AS rel_2, b.dst AS target FROM edges a JOIN edges b ON a.dst = b.src JOIN customer ON a.src = c_name WHERE b.dst <> a.src)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rel_1, via, rel_2, target) AS rank FROM p) WHERE rank <= 30""")
def neighbours_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    return g.two_hops(edges(spark, sf_dir), names).select("name", "rel_1", "via", "rel_2", "target", "rank")


@query(f"""WITH {_EDGES}, names AS (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation),
near AS (SELECT name, src, min(rel_name) AS rel FROM edges JOIN names ON dst = name GROUP BY name, src),
listed AS (SELECT name, src FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rel, src) AS r FROM near) WHERE r <= 10),
far AS (SELECT names.name, a.src AS other, min(b.rel_name) AS rel_name FROM names JOIN edges b ON b.dst = names.name JOIN edges a ON a.dst = b.src GROUP BY 1, 2),
kept AS (SELECT * FROM far f WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.name = f.name AND l.src = f.other))
SELECT * FROM (SELECT name, rel_name, other, row_number() OVER (PARTITION BY name ORDER BY rel_name, other) AS rank FROM kept) WHERE rank <= 10""")
def incoming_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders and suppliers two edges before each region and nation."""
    names = table(spark, sf_dir, "region").select(F.col("r_name").alias("name")).union(_nations(spark, sf_dir))
    return g.incoming_two_hops(edges(spark, sf_dir, once=False), names).select("name", "rel_name", "other", "rank")


@query(f"""WITH RECURSIVE {_EDGES}, e AS (SELECT * FROM edges UNION SELECT DISTINCT s_name, 'OFFERS', 'Part ' || l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
b AS (SELECT src, dst, min(rel_name) AS rel FROM (SELECT src, rel_name, dst FROM e UNION ALL SELECT dst, rel_name, src FROM e) WHERE src <> dst GROUP BY ALL),
ends AS (SELECT min(src) FILTER (contains(lower(src), 'customer#')) AS a, min(src) FILTER (contains(lower(src), 'part 17')) AS z FROM b),
walk AS (SELECT a AS node, 0 AS hops FROM ends UNION SELECT dst, hops + 1 FROM walk JOIN b ON src = node WHERE hops < 4),
back AS (SELECT z AS node, 0 AS hops FROM ends UNION SELECT dst, hops + 1 FROM back JOIN b ON src = node WHERE hops < 4),
f AS (SELECT node, min(hops) AS h FROM walk GROUP BY node), r AS (SELECT node, min(hops) AS h FROM back GROUP BY node),
d AS (SELECT h AS hops FROM f, ends WHERE node = z), onp AS (SELECT f.node, f.h FROM f JOIN r USING (node), d WHERE f.h + r.h = hops),
p AS (SELECT [node] AS nodes, []::VARCHAR[] AS relations, 0 AS h, node FROM onp WHERE h = 0
  UNION ALL SELECT list_append(nodes, dst), list_append(relations, rel), p.h + 1, dst FROM p JOIN b ON src = p.node JOIN onp ON onp.node = dst AND onp.h = p.h + 1)
SELECT array_to_string(nodes, ' > ') AS nodes, array_to_string(relations, ',') AS relations, h::BIGINT AS hops FROM p, d WHERE h = hops ORDER BY p.nodes LIMIT 1""")
def path_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first shortest path from the first customer to the first part whose name holds "part 17"."""
    t = lambda name: table(spark, sf_dir, name)
    offers = t("lineitem").join(t("supplier"), F.expr("l_suppkey = s_suppkey")).select(F.col("s_name").alias("src"), F.lit("OFFERS").alias("rel_name"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("dst"))
    found = g.path_between(edges(spark, sf_dir, once=False).unionByName(offers), "customer#", "Part 17", 4)
    return found.select(F.array_join("nodes", " > ").alias("nodes"), F.array_join("relations", ",").alias("relations"), "hops")


@query(f"""WITH {_EDGES}, {_NODES}, d AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM edges UNION ALL SELECT dst FROM edges) GROUP BY name)
SELECT label, nodes.name, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN d ON nodes.name = d.name""")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.degrees(edges(spark, sf_dir), nodes(spark, sf_dir)).select("label", "name", "degree")


@query(f"""WITH RECURSIVE {_EDGES}, place AS (SELECT src, dst FROM edges WHERE rel_name IN ('IN_REGION', 'LOCATED_IN')),
both_ways AS (SELECT src, dst FROM place UNION SELECT dst, src FROM place),
walk AS (SELECT r_name AS start, r_name AS node, 0 AS hops FROM region
  UNION SELECT start, dst, hops + 1 FROM walk JOIN both_ways ON node = src WHERE hops < 3)
SELECT start, node AS "end", min(hops)::BIGINT AS hops FROM walk JOIN (SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier) ON node = name GROUP BY ALL""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from every region to every customer and supplier over the place relations."""
    place = edges(spark, sf_dir).where(F.col("rel_name").isin("IN_REGION", "LOCATED_IN"))
    starts = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    ends = nodes(spark, sf_dir).where(F.col("label").isin("Customer", "Supplier")).select("name").distinct()
    return g.shortest_paths(place, starts, ends, 3)


@query(f"""WITH {_EDGES} SELECT DISTINCT a.src AS cause, a.dst AS issue, b.dst AS effect FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel_name = 'ORDERED' AND b.rel_name = 'SUPPLIED_BY'""")
def cause_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.chains(edges(spark, sf_dir), ("ORDERED",), ("SUPPLIED_BY",))


@query(f"WITH {_EDGES} SELECT src, rel_name, dst FROM edges WHERE contains(src, 'NATION_1') OR contains(dst, 'NATION_1')")
def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.contains_either(edges(spark, sf_dir), F.lit("NATION_1")).select("src", "rel_name", "dst")


_DECISIONS = "d AS (SELECT conv_id || '-' || turn AS decision_id, conv_id || ':' || turn AS subject, conv_id || ':' || (turn + 1) AS outcome, turn FROM (SELECT DISTINCT conv_id, turn FROM conversations))"


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation is a decision that leads to the next turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    name = lambda sep, turn: F.concat(F.col("conv_id").cast("string"), F.lit(sep), turn.cast("string"))
    return turns.select(name("-", F.col("turn")).alias("decision_id"), name(":", F.col("turn")).alias("subject"), name(":", F.col("turn") + 1).alias("outcome"), "turn")


@query(f"WITH {_DECISIONS} SELECT DISTINCT a.decision_id, b.decision_id AS next_id FROM d a JOIN d b ON a.outcome = b.subject AND a.decision_id <> b.decision_id")
def decision_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.led_to(_decisions(spark, sf_dir))


@query(f"""WITH RECURSIVE {_DECISIONS}, l AS (SELECT DISTINCT a.decision_id, b.decision_id AS next_id FROM d a JOIN d b ON a.outcome = b.subject AND a.decision_id <> b.decision_id),
w AS (SELECT decision_id AS root, [decision_id] AS path FROM d WHERE turn = 0 UNION ALL SELECT root, list_append(path, next_id) FROM w JOIN l ON path[-1] = l.decision_id WHERE len(path) <= 4)
SELECT root, array_to_string(path, ' > ') AS path, len(path) - 1 AS depth FROM w WHERE len(path) > 1""")
def decision_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _decisions(spark, sf_dir)
    found = g.trace(g.led_to(made), made.where("turn = 0"), 4)
    return found.select("root", F.array_join("path", " > ").alias("path"), "depth")


@query("""WITH n AS (SELECT p_name AS name, p_brand AS label FROM part), k AS (SELECT *, regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '', 'g') AS key FROM n)
SELECT 'labels' AS problem, name AS key, array_to_string(list_sort(list_distinct(list(label))), ',') AS found FROM n GROUP BY name HAVING count(DISTINCT label) > 1
UNION ALL SELECT 'spellings', key, array_to_string(list_sort(list_distinct(list(name))), ',') FROM k GROUP BY key HAVING count(DISTINCT name) > 1""")
def dup_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("label"))
    return glossary.duplicate_names(named).withColumn("found", F.array_join("found", ","))


@query("""WITH n AS (SELECT n_name AS name FROM nation UNION SELECT s_name FROM supplier UNION SELECT p_name FROM part UNION SELECT p_type FROM part),
k AS (SELECT name, regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '', 'g') AS key FROM n)
SELECT a.name AS short, b.name AS long FROM k a JOIN k b ON length(b.key) > length(a.key) AND starts_with(b.key, a.key) WHERE length(a.key) >= 2""")
def abbreviation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name, column: table(spark, sf_dir, name).select(F.col(column).alias("name"))
    return glossary.affix_pairs(t("nation", "n_name").union(t("supplier", "s_name")).union(t("part", "p_name")).union(t("part", "p_type")).distinct())


_GLOSSARY = """gl AS (SELECT p_type AS term, list_sort(list_distinct(list(p_brand))) AS synonyms, min(split_part(p_type, ' ', 1)) AS category FROM part GROUP BY p_type),
terms AS (SELECT DISTINCT term AS alias, term FROM gl), al AS (SELECT * FROM terms UNION ALL SELECT * FROM (SELECT DISTINCT unnest(synonyms) AS alias, term FROM gl) WHERE alias NOT IN (SELECT alias FROM terms)),
cl AS (SELECT regexp_replace(lower(alias), '[^\\p{L}\\p{N}]+', '', 'g') AS key, list_sort(list_distinct(list(term))) AS terms FROM al GROUP BY 1)"""


def _glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("term")).agg(F.array_sort(F.collect_set("p_brand")).alias("synonyms"), F.min(F.split("p_type", " ")[0]).alias("category"))


@query(f"WITH {_GLOSSARY} SELECT key, array_to_string(terms, ',') AS terms, len(terms) = 1 AS usable FROM cl")
def glossary_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.claims(glossary.aliases(_glossary(spark, sf_dir))).withColumn("terms", F.array_join("terms", ","))


@query(f"""WITH {_GLOSSARY}, n AS (SELECT DISTINCT lower(p_type) AS name FROM part UNION SELECT DISTINCT p_brand FROM part),
ex AS (SELECT alias, min(term) AS t FROM al GROUP BY alias HAVING count(DISTINCT term) = 1)
SELECT name, coalesce(t, CASE WHEN len(terms) = 1 THEN terms[1] END, name) AS term FROM n LEFT JOIN ex ON name = alias LEFT JOIN cl ON regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', '', 'g') = key""")
def glossary_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = part.select(F.lower("p_type").alias("name")).union(part.select("p_brand")).distinct()
    return glossary.resolve(names, glossary.aliases(_glossary(spark, sf_dir))).select("name", "term")


@query("""WITH n AS (SELECT DISTINCT array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:k], ' ') AS name FROM benchmark, (SELECT unnest([1, 2]) AS k)),
f AS (SELECT DISTINCT doc_id, name FROM documents JOIN n ON contains(text, name) AND regexp_matches(name, '[\\p{L}\\p{N}]')
  AND (NOT regexp_matches(name, '^[A-Za-z0-9_-]+$') OR regexp_matches(text, '(^|[^A-Za-z0-9])' || name || '($|[^A-Za-z0-9])')))
SELECT * FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS rank FROM f) WHERE rank <= 30""")
def names_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening words and word pairs of benchmark items as names, in the documents."""
    first = lambda n: F.array_join(F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, n), " ")
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.array(first(1), first(2))).alias("name")).distinct()
    return glossary.names_in_text(table(spark, sf_dir, "documents"), names, "doc_id").select("doc_id", "name", "rank")


@query(f"""WITH {_EDGES}, {_NODES}, deg AS (SELECT name, count(*) AS degree FROM (SELECT src AS name FROM edges UNION ALL SELECT dst FROM edges) GROUP BY name),
asked AS (SELECT DISTINCT n_name AS asked FROM nation UNION SELECT DISTINCT substring(r_name, 1, 3) FROM region UNION SELECT DISTINCT right(s_name, 4) FROM supplier),
c AS (SELECT asked, nodes.name, label, coalesce(degree, 0) AS degree, regexp_replace(lower(nodes.name), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS key, regexp_replace(lower(asked), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS want FROM nodes LEFT JOIN deg ON nodes.name = deg.name, asked),
t AS (SELECT *, CASE WHEN key = want THEN 0 WHEN starts_with(key, want) THEN 1 ELSE 2 END AS tier FROM c WHERE contains(key, want))
SELECT asked, name, label, degree, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY tier, degree DESC, length(name), name, label) AS rank FROM t) WHERE rank <= 200""")
def entity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes whose name holds a nation's name, the first letters of a region's or the last ones of a supplier's."""
    t = lambda name: table(spark, sf_dir, name)
    asked = t("nation").select(F.col("n_name").alias("asked")).union(t("region").select(F.substring("r_name", 1, 3))).union(t("supplier").select(F.right("s_name", F.lit(4)))).distinct()
    found = g.degrees(edges(spark, sf_dir), nodes(spark, sf_dir))
    return glossary.rank_entities(found, asked).select("asked", "name", "label", "degree", "tier", "rank")


@query("""WITH n AS (SELECT DISTINCT p_name AS name, regexp_replace(lower(p_name), '\\s+', '', 'g') AS bare FROM part),
g AS (SELECT name, list_distinct([substring(bare, i, 3) FOR i IN generate_series(1, greatest(length(bare) - 2, 1))]) AS s FROM n),
p AS (SELECT a.name, b.name AS other, len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) AS similarity FROM g a JOIN g b ON a.name < b.name)
SELECT name, other, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.6""")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = glossary.similar_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))
    return found.withColumn("similarity", F.round("similarity", 6))
