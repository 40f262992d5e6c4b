"""Rank joins, paths from both ends, the split of questions, samples, the request log and pruned nearest neighbours against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle import session
from brindle.operators import calls, evaluation, graph, vector
from brindle.plans import graph as star
from brindle.plans.registry import QUERIES

EDGES = "src string, rel_name string, dst string"


def edges_of(seed, nodes=40, n=300, relations="abc"):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(nodes)}", rng.choice(relations), f"n{rng.randrange(nodes)}") for _ in range(n)]


def plain_two_hops(edges, names, limit):
    out = set()
    for name in names:
        paths = {(r1, via, r2, target) for s, r1, via in edges if s == name for s2, r2, target in edges if s2 == via and target != name}
        out |= {(name, *p, i + 1) for i, p in enumerate(sorted(paths)[:limit])}
    return out


@pytest.mark.parametrize("seed, limit", [(1, 30), (2, 4), (3, 1)])
def test_two_hops_by_rank_join(spark, seed, limit):
    edges = edges_of(seed) + [("n1", r, "back") for r in "ab"] + [("back", r, "n1") for r in "abcdef"] + [("back", "z", "n2"), ("n3", "a", "only"), ("only", "a", "n3")]
    names = [f"n{i}" for i in range(12)] + ["missing"]
    got = graph.two_hops(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(n,) for n in names], "name string"), limit).collect()
    assert {(r.name, r.rel_1, r.via, r.rel_2, r.target, r["rank"]) for r in got} == plain_two_hops(edges, names, limit)


def test_two_hops_at_a_hub(spark):
    """1,500 edges into a hub and 1,500 out of it would make 2.25 million paths."""
    edges = [(f"in{i:04d}", "r", "hub") for i in range(1_500)] + [("hub", "r", f"out{i:04d}") for i in range(1_500)]
    table = spark.createDataFrame(edges, EDGES)
    names = table.select(F.col("src").alias("name")).where("name <> 'hub'").distinct()
    found = graph.two_hops(table, names, 30)
    rows = found.collect()
    assert len(rows) == 1_500 * 30 and {r.target for r in rows} == {f"out{i:04d}" for i in range(30)}


@pytest.mark.parametrize("seed, limit", [(4, 10), (5, 2)])
def test_incoming_two_hops(spark, seed, limit):
    edges, names = edges_of(seed), [f"n{i}" for i in range(10)]
    want = set()
    for name in names:
        near, far = {}, {}
        for s, r, d in edges:
            if d == name:
                near[s] = min(near.get(s, r), r)
                for s2, _, d2 in edges:
                    if d2 == s:
                        far[s2] = min(far.get(s2, r), r)
        listed = {s for _, s in sorted((r, s) for s, r in near.items())[:limit]}
        want |= {(name, r, s, i + 1) for i, (r, s) in enumerate(sorted((r, s) for s, r in far.items() if s not in listed)[:limit])}
    got = graph.incoming_two_hops(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(n,) for n in names], "name string"), limit).collect()
    assert {(r.name, r.rel_name, r.other, r["rank"]) for r in got} == want


def test_sources_of_a_middle_are_ranked_where_they_are_dealt(spark):
    """Repeated edges count once, though the edges to nodes in between are dealt out and ranked as they come."""
    rows = [(f"far{i:03d}", "r", f"near{i % 3}") for i in range(90)] + [(f"near{i}", "q", "end") for i in range(3)]
    found = graph.incoming_two_hops(spark.createDataFrame(rows * 4, EDGES), spark.createDataFrame([("end",)], "name string"), 2)
    assert [(r.other, r["rank"]) for r in found.orderBy("rank").collect()] == [("far000", 1), ("far001", 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "dense_rank(other" in plan


def plain_path(edges, start, end, most):
    near = defaultdict(dict)
    for s, r, d in edges:
        for a, b in ((s, d), (d, s)):
            if a != b:
                near[a][b] = min(near[a].get(b, r), r)
    paths = [[start]]
    for _ in range(most):
        paths = [[*p, b] for p in paths for b in near[p[-1]] if b not in p]
        hits = sorted(p for p in paths if p[-1] == end)
        if hits:
            return hits[0], [near[a][b] for a, b in zip(hits[0], hits[0][1:], strict=False)]
    return None


@pytest.mark.parametrize("start, end", [("n1", "N2"), ("n30", "n11"), ("N5", "n77")])
def test_path_from_both_ends(spark, start, end):
    edges = edges_of(9, nodes=60, n=75) + [("n5", "a", "n770"), ("loop", "a", "loop")]
    names = sorted({n for s, _, d in edges for n in (s, d) if s != d})
    first = lambda text: next((n for n in names if text.lower() in n), None)
    got = [(r.nodes, r.relations, r.hops) for r in graph.path_between(spark.createDataFrame(edges, EDGES), start, end, 4).collect()]
    want = plain_path(edges, first(start), first(end), 4)
    assert got == ([(*want, len(want[1]))] if want else [])


def test_path_leaves_the_edges_where_they_are(spark, monkeypatch):
    """The edges are written as they come: neither grouped nor sorted as a whole. Repeats and loops change nothing."""
    plans, stage = {}, graph.stage

    def noted(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(graph, "stage", noted)
    edges = [e for e in edges_of(3) if e[0] != e[2]]
    once = graph.path_between(spark.createDataFrame(edges, EDGES), "n11", "n29", 4).collect()
    again = graph.path_between(spark.createDataFrame([*edges, *edges, ("n11", "a", "n11")], EDGES), "n11", "n29", 4).collect()
    assert once == again and len(once) == 1
    assert "Exchange" not in plans["edges"] and "Exchange" in plans["inner"]


def test_path_of_unknown_equal_or_distant_ends(spark):
    chain = spark.createDataFrame([(f"c{i}", "r", f"c{i + 1}") for i in range(8)], EDGES)
    assert graph.path_between(chain, "nothing", "c1").collect() == []
    assert [r.hops for r in graph.path_between(chain, "c1", "C1").collect()] == [0]
    assert [r.hops for r in graph.path_between(chain, "c1", "c7", 6).collect()] == [6]
    assert graph.path_between(chain, "c0", "c7", 6).collect() == []


def plain_split(rows, ratio):
    """The rule, a group at a time: (id, source, category) rows."""
    groups = defaultdict(list)
    for number, source, category in rows:
        groups[source or f"__no_source__{number}"].append(category or "?")
    totals, counts, placed = [0, 0], [Counter(), Counter()], {}
    for name in sorted(groups, key=lambda g: (-len(groups[g]), hashlib.sha256(g.encode()).hexdigest())):
        costs = []
        for side in (0, 1):
            tried = [Counter(c) for c in counts]
            tried[side].update(("all",))
            tried[side].update({"all": len(groups[name]) - 1})
            tried[side].update(("cat", c) for c in groups[name])
            costs.append((sum(abs(tried[0][c] * (1 - ratio) - tried[1][c] * ratio) for c in tried[0].keys() | tried[1].keys()), totals[side]))
        to = 0 if costs[0] <= costs[1] else 1
        counts[to].update({"all": len(groups[name])})
        counts[to].update(("cat", c) for c in groups[name])
        totals[to] += len(groups[name])
        placed[name] = ("dev", "holdout")[to]
    return placed


@pytest.mark.parametrize("ratio", [0.5, 0.25])
def test_split_deals_as_the_rule_says(spark, ratio):
    rng = random.Random(6)
    rows = [(i, rng.choice((None, "", *(f"u{rng.randrange(1 + j)}" for j in (5, 50, 1_200)))), rng.choice((None, "a", "b", "b", "c"))) for i in range(4_000)]
    got = {}
    for r in evaluation.split(spark.createDataFrame(rows, "id long, source string, category string").repartition(7), "source", "category", "id", ratio).collect():
        assert (r.source is None) != (r.id is None)
        got[r.source or f"__no_source__{r.id}"] = r.side
    want = plain_split(rows, ratio)
    assert len(want) > 1_000 and got == want


def test_samples_of_parts_merge(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(300)], "id long, kind string")
    whole = {(r.kind, r.id, r["rank"], r.group) for r in evaluation.sampled(rows, ["kind"], "id", 12).collect()}
    halves = [evaluation.sampled(rows.where(f"id {sign} 140"), ["kind"], "id", 12).drop("rank", "group") for sign in ("<", ">=")]
    assert {(r.kind, r.id, r["rank"], r.group) for r in evaluation.sampled(halves[0].union(halves[1]), ["kind"], "id", 12).collect()} == whole
    assert Counter(g for _, _, _, g in whole) == {0: 10, 1: 10, 2: 4}


def test_log_has_the_rows_of_each_call(spark, tmp_path):
    log = str(tmp_path / "log")
    found = calls.logged(spark, log, "search", "q", "en", lambda: spark.range(37), str(tmp_path / "a"))
    assert found.count() == 37
    assert calls.logged(spark, log, "search", "q", "en", lambda: spark.range(5).where("id > 9"), str(tmp_path / "b")).count() == 0

    def broken():
        raise RuntimeError("no model")

    assert calls.logged(spark, log, "search", "q2", "en", broken, str(tmp_path / "c")) is None
    rows = sorted(((r.query, r.result_count, r.error) for r in spark.read.schema(calls.LOG).parquet(log).collect()), key=str)
    assert rows == [("q", 0, None), ("q", 37, None), ("q2", 0, "RuntimeError: no model")]
    [used] = calls.usage(spark, log).collect()
    assert (used.calls, used.failed, used.results) == (3, 1, 37) and used.slowest_ms >= 0


def test_pivots_rule_out_most_of_clustered_points(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 16))
    vectors = [(middles[i % 30] + 0.05 * rng.normal(size=16)).tolist() for i in range(3_000)] + [[0.0] * 16, None, [1.0, None] + [0.0] * 14]
    vectors += [vectors[5]] * 3  # ties
    points = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    queries = points.where("vec_id % 100 = 0 OR vec_id = 5").withColumnRenamed("vec_id", "query_id")
    best, work = vector.nearest_by_pivots(queries, points, 10)
    row = lambda r: (r.query_id, r.vec_id, r["rank"], round(r.score, 9))
    assert sorted(map(row, best.collect())) == sorted(map(row, vector.nearest(queries, points, 10).collect()))
    spent = work.agg(F.sum("points"), F.sum("distances")).first()
    assert 3 * spent[1] < spent[0]
    none = vector.nearest_by_pivots(queries.where("false"), points, 3)
    assert none[0].count() == none[1].count() == 0


def test_chains_stay_dealt_and_are_distinct(spark):
    rows = [(f"c{i % 7}", "A", f"o{i}") for i in range(60)] * 2 + [(f"o{i}", "B", f"s{i % 5}") for i in range(60)] * 2
    got = graph.chains(spark.createDataFrame(rows, "src string, rel_name string, dst string"), ("A",), ("B",))
    assert sorted(map(tuple, got.collect())) == sorted({(f"c{i % 7}", f"o{i}", f"s{i % 5}") for i in range(60)})
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() == 4  # small shuffle partitions are not merged into one


def test_degrees_read_the_edges_once(spark, sf_dir):
    plan = QUERIES["degree"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("'Distinct") + plan.count("Aggregate [l_orderkey") == 1


def test_two_hops_read_the_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(name):
        seen.add(1)
        return name

    rows = [("a", "x", "b"), ("b", "y", "c"), ("b", "y", "a"), ("b", "z", "a"), ("a", "x", "d"), ("d", "y", "a"), ("a", "w", "b")]
    edges = spark.createDataFrame(rows, EDGES).withColumn("src", F.udf(told)("src"))
    got = graph.two_hops(edges, spark.createDataFrame([("a",)], "name string"), 1)
    assert [tuple(r) for r in got.select("rel_1", "via", "rel_2", "target").collect()] == [("w", "b", "y", "c")]
    assert seen.value == len(rows)


def test_what_is_dealt_out_has_tasks_by_its_rows(spark, sf_dir, monkeypatch):
    dealt_in = lambda: star.edges(spark, sf_dir).rdd.getNumPartitions()
    few = dealt_in()
    monkeypatch.setattr(session, "ROWS", 1_000)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert lines > 4_000 and dealt_in() - few == -(-lines // 1_000) - 4
    monkeypatch.setattr(session, "ROWS", 50)
    nodes = spark.range(401).select(F.lit("N").alias("label"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    edges = nodes.select(F.col("name").alias("src"), F.lit("R").alias("rel_name"), F.lit("n7").alias("dst")).where("name <> 'n8'")
    found = graph.degrees(edges, nodes)
    assert found.rdd.getNumPartitions() == 9
    assert {r.name: r.degree for r in found.collect()} == {f"n{i}": {7: 401, 8: 0}.get(i, 1) for i in range(401)}
