"""A property graph as two tables: nodes(label, name) and edges(src, rel_name, dst, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import dealt, stage

from .ranking import first_by, top_by

LONGEST_PATH = 6


def merge_nodes(rows: DataFrame) -> DataFrame:
    """Nodes by (label, name); source_url is the first one's (column seq gives the order)."""
    return rows.groupBy("label", "name").agg(F.min_by("source_url", "seq").alias("source_url"))


def merge_edges(rows: DataFrame) -> DataFrame:
    """Edges by (src, rel_name, dst, source_url); the other properties are those of the first."""
    return first_by(rows, ["src", "rel_name", "dst", "source_url"], F.asc("seq"))


def neighbours(edges: DataFrame, names: DataFrame, out_limit: int = 20, in_limit: int = 10) -> DataFrame:
    """Edges of each name: direction, rel_name, other end and rank; incoming ones once for each source."""
    out = edges.join(names, edges.src == names.name).select("name", F.lit("out").alias("direction"), "rel_name", F.col("dst").alias("other"))
    into = edges.join(names, edges.dst == names.name).select("name", F.lit("in").alias("direction"), "rel_name", F.col("src").alias("other"))
    into = into.groupBy("name", "direction", "other").agg(F.min("rel_name").alias("rel_name"))
    order = (F.asc("rel_name"), F.asc("other"))
    return top_by(out, ["name"], out_limit, *order).unionByName(top_by(into, ["name"], in_limit, *order))


def two_hops(edges: DataFrame, names: DataFrame, limit: int = 30) -> DataFrame:
    """Distinct paths of two outgoing edges from each name, the first limit of each, by relation, middle, relation and target.

    A rank join: of a name only the first edges that lead on are needed, and of a middle only its first edges, as no later one can be
    among the first paths. So a hub's incoming edges never meet all of its outgoing ones.
    """
    edges = stage(edges.select("src", "rel_name", "dst"), "edges")
    hops = dealt(edges.select(F.col("src").alias("via"), F.col("rel_name").alias("rel_2"), F.col("dst").alias("target")), "via").distinct()
    # the edges back to the name are left out afterwards: as many more are kept as a middle has to one target
    own = Window.partitionBy("via")
    placed = hops.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("via", "target"))).withColumn("_at", F.row_number().over(own.orderBy("rel_2", "target")))
    placed = placed.withColumns({"_low": F.min("target").over(own), "_high": F.max("target").over(own), "_spare": F.max("_n").over(own)})
    kept = placed.where(F.col("_at") <= limit + F.col("_spare")).groupBy("via").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.collect_list(F.struct("rel_2", "target")).alias("_next"))
    first = edges.join(names, edges.src == names.name).select("name", F.col("rel_name").alias("rel_1"), F.col("dst").alias("via"))
    first = dealt(first, "via").distinct()
    # a middle that leads only back to the name leads nowhere
    first = first.join(kept, "via").where("_low <> name OR _high <> name").drop("_low", "_high")
    first = top_by(first, ["name"], limit, F.asc("rel_1"), F.asc("via")).drop("rank")
    paths = first.select("name", "rel_1", "via", F.inline("_next")).where("target <> name")
    return top_by(paths, ["name"], limit, F.asc("rel_1"), F.asc("via"), F.asc("rel_2"), F.asc("target"))


def incoming_two_hops(edges: DataFrame, names: DataFrame, limit: int = 10) -> DataFrame:
    """name, relation of the last edge, other and rank: sources two edges away that are not among the first limit sources one edge
    away, each once, by relation and name; the first limit.

    Of a node in between only its first sources are needed: those that are listed already, of smaller relations or one edge away, and limit more.
    Edges may come repeated: those to a node in between are dealt out by it and ranked as they are, and not made distinct before they meet.
    """
    near = stage(edges.join(names, edges.dst == names.name).select("name", "rel_name", F.col("src").alias("via")).distinct(), "near")
    listed = top_by(near.groupBy("name", F.col("via").alias("other")).agg(F.min("rel_name").alias("rel_name")), ["name"], limit, F.asc("rel_name"), F.asc("other"))
    ahead = edges.select(F.col("dst").alias("via"), F.col("src").alias("other")).join(near.select("via").distinct(), "via", "left_semi")
    place = F.dense_rank().over(Window.partitionBy("via").orderBy("other"))
    sources = dealt(ahead, "via").withColumn("_at", place).where(F.col("_at") <= 3 * limit).select("via", "other")
    found = near.join(sources, "via").groupBy("name", "other").agg(F.min("rel_name").alias("rel_name"))
    found = found.join(listed.select("name", "other"), ["name", "other"], "left_anti")
    return top_by(found, ["name"], limit, F.asc("rel_name"), F.asc("other"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with their number of edges in either direction, dealt out by name in all shuffle partitions, in more if there are very many nodes.

    Both sides are dealt out: Spark would take the number of the counted side for a join, and not the one that is asked for.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name"))  # one pass over the edges
    counted, rows = ends.groupBy("name").agg(F.count(F.lit(1)).alias("degree")), nodes.count()
    return dealt(nodes, "name", rows=rows).join(dealt(counted, "name", rows=rows), "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_hops: int = LONGEST_PATH) -> DataFrame:
    """Of each start (name) the undirected distance to every end (name) within max_hops: start, end, hops.

    Breadth first: a level is a join, and names that were reached before are left out of the next. Each level is written to the
    shared folder, so that the next one's plan reads it and does not grow; an empty level ends the search.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = stage(both, "edges")
    front = reached = stage(starts.select(F.col("name").alias("start"), F.col("name").alias("end"), F.lit(0).alias("hops")).distinct(), "level")
    for hop in range(1, max_hops + 1):
        step = front.select("start", F.col("end").alias("src")).join(both, "src").select("start", F.col("dst").alias("end")).distinct()
        front = stage(step.join(reached.select("start", "end"), ["start", "end"], "left_anti").withColumn("hops", F.lit(hop)), "level")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    wanted = ends.select(F.col("name").alias("end"))
    return reached.where("hops > 0").join(wanted, "end", "left_semi").select("start", "end", F.col("hops").cast("long").alias("hops"))


def path_nodes(spark_edges: DataFrame, start: str, end: str, max_hops: int = LONGEST_PATH) -> DataFrame:
    """The first shortest path between two names, as an array of names with hops; by joins with a cycle guard, a level at a time."""
    both = spark_edges.select("src", "rel_name", "dst").unionByName(spark_edges.select(F.col("dst").alias("src"), "rel_name", F.col("src").alias("dst"))).distinct()
    both = stage(both, "edges")
    seed = both.where(F.col("src") == start).limit(1).select(F.array("src").alias("nodes"), F.array().cast("array<string>").alias("relations"))
    found, paths = None, seed
    for _ in range(max_hops):
        last = paths.select("nodes", "relations", F.element_at("nodes", -1).alias("src"))
        longer = last.join(both, "src").where(~F.array_contains("nodes", F.col("dst")))
        longer = longer.select(F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("relations", F.col("rel_name")).alias("relations"))
        # one path a node: the first by its names, which keeps a level as small as the node set
        paths = stage(first_by(longer.withColumn("_end", F.element_at("nodes", -1)), ["_end"], F.asc("nodes"), F.asc("relations")).drop("_end"), "paths")
        if paths.isEmpty():
            break
        hit = paths.where(F.element_at("nodes", -1) == end)
        found = hit if found is None else found.unionByName(hit)
        if not hit.isEmpty():
            break
    if found is None:
        found = seed.where("false")
    return found.withColumn("hops", F.size("relations").cast("long")).orderBy("hops", "nodes").limit(1)


def first_holding(edges: DataFrame, *texts: str) -> list[str | None]:
    """Of each text the first end of an edge that holds it, regardless of case. One pass over the edges."""
    holds = lambda end, text: F.min(F.when(F.contains(F.lower(end), F.lit(text.lower())), F.col(end)))
    found = edges.agg(*[F.least(holds("src", text), holds("dst", text)) for text in texts]).first()
    return list(found)


def _beside(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The names that an edge in either direction joins to one of names (with repeats).

    The edges stay where they are while the names are few enough to be sent to them, which Spark decides by their size.
    """
    ahead = edges.join(names.select(F.col("name").alias("src")), "src", "left_semi").select(F.col("dst").alias("name"))
    return ahead.unionByName(edges.join(names.select(F.col("name").alias("dst")), "dst", "left_semi").select(F.col("src").alias("name")))


def path_between(edges: DataFrame, start_text: str, end_text: str, max_hops: int = LONGEST_PATH) -> DataFrame:
    """nodes, relations and hops of the first shortest path (by its names) between the first nodes that hold two texts; no row if none.

    Both ends are searched, always the one with the smaller front: levels of half the path's length hold far fewer nodes than one search
    of its whole length would. The levels then give the path back, node by node. Edges may come repeated: they are written once as they
    are, and neither turned round nor made distinct as a whole; only those between nodes of shortest paths are.
    """
    spark = edges.sparkSession
    edges = stage(edges.where("src <> dst").select("src", "rel_name", "dst"), "edges")
    ends = first_holding(edges, start_text, end_text)
    shape = "nodes array<string>, relations array<string>, hops long"
    if None in ends:
        return spark.createDataFrame([], shape)
    if ends[0] == ends[1]:
        return spark.createDataFrame([([ends[0]], [], 0)], shape)
    # of each side: the levels, the union of them, and the size of the last one
    # (written, as Spark knows the size of files and so can send them to the edges)
    levels = [[stage(spark.createDataFrame([(name,)], "name string"), "end")] for name in ends]
    seen, sizes = [side[0] for side in levels], [1, 1]
    meeting = None
    for _ in range(max_hops):
        side = 0 if sizes[0] <= sizes[1] else 1
        step = _beside(edges, levels[side][-1]).distinct()
        front = stage(step.join(seen[side], "name", "left_anti"), "front")
        levels[side].append(front)
        seen[side], sizes[side] = seen[side].unionByName(front), front.count()
        meeting = front.join(levels[1 - side][-1], "name", "left_semi")
        if not sizes[side] or not meeting.isEmpty():
            break
    if meeting is None or meeting.isEmpty():
        return spark.createDataFrame([], shape)
    # the nodes of shortest paths: from the meeting level back to either end, whose own level is the end alone
    meeting = stage(meeting, "on_path")
    halves = []
    for side in levels:
        half = [meeting]
        for level in reversed(side[1:-1]):
            half.append(stage(level.join(_beside(edges, half[-1]), "name", "left_semi"), "on_path"))
        halves.append([*half, side[0]] if len(side) > 1 else half)
    on_path = [*reversed(halves[0]), *halves[1][1:]]
    known = reduce(DataFrame.unionByName, on_path)
    inner = edges.join(known.select(F.col("name").alias("src")), "src", "left_semi").join(known.select(F.col("name").alias("dst")), "dst", "left_semi")
    inner = inner.select("src", "rel_name", "dst").unionByName(inner.select(F.col("dst").alias("src"), "rel_name", F.col("src").alias("dst")))
    inner = stage(inner.groupBy("src", "dst").agg(F.min("rel_name").alias("rel_name")), "inner")
    nodes, relations = [ends[0]], []
    for level in on_path[1:]:
        ahead = inner.where(F.col("src") == nodes[-1]).join(level, inner.dst == level.name, "left_semi")
        step = ahead.agg(F.min(F.struct("dst", "rel_name")).alias("s")).first().s
        nodes.append(step.dst)
        relations.append(step.rel_name)
    return spark.createDataFrame([(nodes, relations, len(relations))], shape)


def contains_either(edges: DataFrame, text: Column) -> DataFrame:
    """Edges with text in one of their ends' names."""
    return edges.where(F.contains("src", text) | F.contains("dst", text))


def chains(edges: DataFrame, first: tuple[str, ...], second: tuple[str, ...]) -> DataFrame:
    """Cause, issue and effect: an edge of the first relations that ends where one of the second begins.

    Each side is made distinct where its issues are dealt to, so that their pairs are distinct and need not be held again.
    """
    a = edges.where(F.col("rel_name").isin(*first)).select(F.col("src").alias("cause"), F.col("dst").alias("issue"))
    b = edges.where(F.col("rel_name").isin(*second)).select(F.col("src").alias("issue"), F.col("dst").alias("effect"))
    return dealt(a, "issue").distinct().join(dealt(b, "issue").distinct(), "issue").select("cause", "issue", "effect")


def led_to(decisions: DataFrame) -> DataFrame:
    """Decision pairs where the outcome of one is the subject of the other."""
    later = decisions.select(F.col("decision_id").alias("next_id"), F.col("subject").alias("outcome"))
    return decisions.select("decision_id", "outcome").join(later, "outcome").where("decision_id <> next_id").select("decision_id", "next_id").distinct()


def trace(links: DataFrame, roots: DataFrame, max_depth: int = 4, limit: int = 10) -> DataFrame:
    """Paths along links (decision_id, next_id) from each root (decision_id), by depth, the first limit of each root."""
    level = roots.select(F.col("decision_id").alias("root"), F.array("decision_id").alias("path"))
    found = None
    for _ in range(max_depth):
        ends = level.select("root", "path", F.element_at("path", -1).alias("decision_id"))
        level = ends.join(links, "decision_id").where(~F.array_contains("path", F.col("next_id"))).select("root", F.array_append("path", F.col("next_id")).alias("path"))
        level = top_by(level, ["root"], limit, F.asc("path")).drop("rank")
        found = level if found is None else found.unionByName(level)
    ranked = found.withColumn("depth", (F.size("path") - 1).cast("long"))
    return top_by(ranked, ["root"], limit, F.asc("depth"), F.asc("path"))
