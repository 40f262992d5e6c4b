from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.operators import api, evaluation, events, glossary, graph, lexical, pages, ranking, tables, vector
from brindle.sources import markdown, tabular


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rrf_prefers_what_both_lists_have(spark):
    lists = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1), ("b", "y", 2)], "list string, k string, rank long")
    best = ranking.fuse(lists, ["k"]).orderBy(F.desc("score")).collect()
    assert best[0].k == "y" and len(best) == 3
    shuffled = ranking.fuse(lists.orderBy(F.desc("k")), ["k"])
    assert rows(shuffled) == rows(ranking.fuse(lists, ["k"]))
    assert ranking.fuse(lists.limit(0), ["k"]).count() == 0


def test_budget_stops_at_the_first_overflow(spark):
    docs = spark.createDataFrame([(0, 1, 100), (0, 2, 30), (0, 3, 500), (0, 4, 1), (1, 1, 900)], "q int, rank long, n int")
    kept = ranking.fit_budget(docs, ["q"], F.col("n"), 200)
    assert [(r.q, r.rank) for r in kept.orderBy("q", "rank").collect()] == [(0, 1), (0, 2), (1, 1)]
    linked = spark.createDataFrame([(0, 1, 5), (0, 2, 5), (1, 1, 5)], "q int, rank long, n int")
    assert [(r.q, r.rank) for r in ranking.add_linked(kept, linked, ["q"], F.col("n"), 200).collect()] == [(0, 1)]


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 8))
    points = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(99, None)], "vec_id long, embedding array<double>").repartition(3)
    asked = points.where("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q, group in enumerate(np.argsort(-(unit[:7] @ unit.T), axis=1)[:, :5]):
        got = vector.nearest(asked, points, 5).where(F.col("query_id") == q).orderBy("rank").collect()
        assert [r.vec_id for r in got] == group.tolist()


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "rare shared"), (2, "shared shared common"), (3, "common"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "rare"), (1, "unknown"), (2, "shared shared")], "item_id long, text string")
    found = lexical.search(docs, asked, 5).collect()
    assert {(r.item_id, r.doc_id) for r in found} == {(0, 1), (2, 1), (2, 2)} and all(r.score > 0 for r in found)


def test_pages_come_back_in_order(spark):
    docs = spark.createDataFrame([(1, "ab" * 900), (2, ""), (3, None)], "doc_id long, text string")
    got = pages.assembled(pages.chunked(docs)).collect()
    assert len(got) == 1 and got[0].chunks == 3 and got[0].text.count("\n\n") == 2


def test_shortest_paths(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("c", "r", "b"), ("c", "s", "d"), ("x", "r", "y")], "src string, rel_name string, dst string")
    names = spark.createDataFrame([("a",)], "name string")
    ends = spark.createDataFrame([("d",), ("c",), ("y",)], "name string")
    assert rows(graph.shortest_paths(edges, names, ends)) == [("a", "c", 2), ("a", "d", 3)]
    path = graph.path_nodes(edges.unionByName(spark.createDataFrame([("a", "t", "e")], edges.schema)), "a", "d").collect()
    assert not path or path[0].hops == 3


def test_merges_keep_the_first(spark):
    nodes = spark.createDataFrame([("L", "n", "u2", 2), ("L", "n", "u1", 1)], "label string, name string, source_url string, seq int")
    assert rows(graph.merge_nodes(nodes)) == [("L", "n", "u1")]


def test_chain_has_no_skips(spark):
    found = spark.createDataFrame([(i, i % 3, 86_400 * (i * 7 % 11 + 1), "t") for i in range(30)] + [(90, 1, 0, "t")], "event_id long, scope int, date_ts long, event_type string")
    links = events.chain(found)
    assert links.count() == 27 and events.skipped(links, found).count() == 0
    assert events.timeline(found).count() == 0 and events.timeline(found, scope=1, limit=4).count() == 4


def test_next_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 9, "c")], "k int, at int, v string")
    assert rows(events.next_as_of(left, right, ["k"], "t", "at", "v"))[:2] == [(1, 5, 5, "a"), (1, 9, 9, "c")]
    assert events.next_as_of(left, right, ["k"], "t", "at", "v").where("k = 2").first().v is None


def test_event_validation(spark):
    raw = spark.createDataFrame([(1, "g", "", "t", "patch"), (2, "g", "2024-01-01", "t", "??")], "row int, game string, date string, title string, event_type string")
    got = events.validated(raw).orderBy("row").collect()
    assert got[0].errors == ["row 1: date is missing"] and got[1].errors == [] and got[1].event_type == "user_event"


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, v string, n int")
    new = spark.createDataFrame([(2, None, None), (3, "c", 0)], "id int, v string, n int")
    once = tables.upsert(old, new, ["id"])
    assert rows(once.select("id")) == rows(tables.upsert(once, new, ["id"]).select("id")) == [(1,), (2,), (3,)]
    kept = tables.upsert_keeping(old, new, ["id"], ("n",)).orderBy("id").collect()
    assert [(r.v, r.n) for r in kept] == [("a", 5), (None, 6), ("c", 0)]
    assert rows(tables.replace_by_source(old, new, "id", F.col("id") != 2).select("id")) == [(1,), (2,), (3,)]


def test_glossary(spark):
    terms = spark.createDataFrame([("Alpha", ["al pha", "beta"], "x"), ("beta", [], "y"), ("Gamma", ["G1"], "x"), ("Delta", ["g-1"], "x")], "term string, synonyms array<string>, category string")
    names = spark.createDataFrame([("AL-PHA",), ("beta",), ("g1",), ("G1",), ("none",)], "name string")
    got = dict(rows(glossary.resolve(names, glossary.aliases(terms))))
    assert got == {"AL-PHA": "Alpha", "beta": "beta", "g1": "g1", "G1": "Gamma", "none": "none"}
    assert [r.key for r in glossary.claims(glossary.aliases(terms)).where("not usable").collect()] == ["g1"]


def test_similar_names_loses_no_pair(spark):
    names = ["payment team", "payments team", "payment teams", "delivery", "deliveries", "abc"]
    got = {(a, b) for a, b, _ in rows(glossary.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), 0.5))}
    grams = lambda n: {n.replace(" ", "")[i : i + 3] for i in range(len(n.replace(" ", "")) - 2)}
    want = {(a, b) for a in names for b in names if a < b and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.5}
    assert got == want and want


def test_split_and_targets(spark):
    questions = spark.createDataFrame([(s, i, "c") for s in range(9) for i in range(s + 1)], "source int, id int, category string")
    sides = rows(evaluation.split(questions, "source", "category", "id").select("source", "n", "side"))
    assert len({s for s, _, _ in sides}) == 9 and {side for *_, side in sides} == {"dev", "holdout"}
    assert abs(sum(n if side == "dev" else -n for _, n, side in sides)) <= 1
    assert evaluation.scaled_targets({"a": 5, "b": 4, "c": 5, "d": 3, "e": 3}, 40) == {"a": 10, "b": 8, "c": 10, "d": 6, "e": 6}


def test_evaluation_ignores_failures(spark):
    scores = spark.createDataFrame([("a", 1.0), ("a", 0.5), ("a", None)], "c string, score double")
    got = evaluation.summary(scores, "c").first()
    assert (got.total, got.scored, got.failed, got.passed, got.average) == (3, 2, 1, 1, 0.75)


def test_markdown_round_trip(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\ntitle: T: x\npage_id: 12-34\nnotion_url: https://e.org/1\nlast_edited_time: 2024-01-02T03:04:05Z\ndb_properties: {"k": "v"}\n---\nbody\n---\nmore')
    (tmp_path / "b.md").write_text("no front matter")
    found = {r.file: r for r in markdown.read_pages(spark, str(tmp_path)).collect()}
    assert (found["a.md"].page_id, found["a.md"].title, found["a.md"].body) == ("1234", "T: x", "body\n---\nmore")
    assert found["a.md"].db_properties == {"k": "v"} and found["b.md"].title == "b" and found["b.md"].body == "no front matter"
    again = markdown.parse(markdown.page_text(markdown.read_pages(spark, str(tmp_path)))).where("file = 'a.md'").first()
    assert again.body == found["a.md"].body and again.page_id == "1234"


def test_event_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("﻿game,date,title\ng,2024-01-01,t\n", encoding="utf-8")
    (tmp_path / "a.json").write_text('[{"game": "g", "title": "t"}]')
    (tmp_path / "b.json").write_text('{"events": [{"game": "h"}, {"game": "i"}]}')
    assert tabular.read_event_csv(spark, str(tmp_path / "e.csv")).first().game == "g"
    assert sorted(r.game for r in tabular.read_event_json(spark, str(tmp_path / "*.json")).collect()) == ["g", "h", "i"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tabular.read_questions(spark, str(tmp_path / "none.json")).collect()


def test_blocks_in_document_order(spark):
    blocks = spark.createDataFrame([("p", "b", None, 2, "paragraph", "two", None, None), ("p", "a", None, 1, "toggle", "one", None, None), ("p", "c", "a", 1, "paragraph", "in", None, None)], "page_id string, block_id string, parent_id string, pos int, type string, text string, checked boolean, language string")
    assert tabular.block_lines(blocks).first().body == "- one\n  in\ntwo"


def test_search_tools(spark):
    chunks = spark.createDataFrame([(1, "p1", "u1", 0, "spark engine", [1.0, 0.0]), (2, "p1", "u1", 1, "second part", [0.5, 0.5]), (3, "p2", "u2", 0, "other words", [0.0, 1.0])], "chunk_id long, page_id string, source_url string, chunk_index int, text string, embedding array<double>")
    nodes = spark.createDataFrame([("L", "a"), ("L", "b")], "label string, name string")
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "s", "c")], "src string, rel_name string, dst string")
    made = spark.createDataFrame([("1", "x", "y"), ("2", "y", "z")], "decision_id string, subject string, outcome string")
    found = spark.createDataFrame([(1, "g", "patch", 10, "t1"), (2, "g", "patch", 20, "t2")], "event_id long, scope string, event_type string, date_ts long, title string")
    store = api.Store(chunks, nodes, edges, made, found)
    embed = lambda _: [1.0, 0.1]
    assert api.semantic_search(store, "q", embed).orderBy("rank").first().source_url == "u1"
    assert api.hybrid_search(store, "spark engine", embed).orderBy("rank").first().source_url == "u1"
    assert rows(api.graph_search(store, "b").select("direction", "other")) == [("in", "a"), ("out", "c")]
    assert api.path_search(store, "a", "c").first().nodes == ["a", "b", "c"]
    assert {r.direction for r in api.decision_trace(store, "y").collect()} == {"down", "up"}
    assert api.timeline_search(store, kind="patch").count() == 2
    api.register(spark, store)
    assert spark.sql("SELECT title FROM timeline('patch', 0, 15)").collect()[0].title == "t1"
    assert spark.sql("SELECT * FROM relations('a')").count() == 1
    assert api.sub_queries(spark, "one two three four five six", lambda q: ["part one", "part two"]) == ["one two three four five six", "part one", "part two"]


def test_a_vector_of_another_length_hurts_no_other(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1, 0.3]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [1.0, None])], "vec_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(7, [1.0, 0.2]), (8, [1.0, 0.0, 0.0]), (9, None), (10, [1.0])], "query_id long, embedding array<double>")
    got = vector.nearest(asked, points, 2)
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got.collect()) == [(7, 1, 1), (7, 3, 2), (8, 2, 1)]
    assert vector.nearest(asked.limit(0), points, 2).count() == 0


def test_queries_come_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(40)], "vec_id long, embedding array<double>")
    asked = points.where("vec_id < 9").withColumnRenamed("vec_id", "query_id")
    want = rows(vector.nearest(asked, points, 3))
    monkeypatch.setattr(vector, "BLOCK", 4)
    assert rows(vector.nearest(asked, points, 3)) == want and len(want) == 27


def test_nearest_in_slices_keeps_ties_and_holds_few_scores(monkeypatch):
    rng = np.random.default_rng(3)
    base = np.round(rng.normal(size=(300, 8)), 1)
    values, ids = base[rng.integers(0, 300, 3_000)], rng.permutation(3_000)  # copies tie
    asked = np.vstack([base[:50], np.zeros((1, 8))])
    matrix = vector._unit(asked)
    scores = np.round(matrix @ vector._unit(values).T, 9)
    want = {(q, int(ids[p]), float(scores[q, p])) for q in range(51) for p in np.lexsort((ids, -scores[q]))[:7]}
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 1_100]), pa.array(values[i : i + 1_100].tolist())], ["vec_id", "embedding"]) for i in range(0, 3_000, 1_100)]
    monkeypatch.setattr(vector, "ROWS", 16)
    monkeypatch.setattr(vector, "COLUMNS", 100)
    got = [tuple(r.values()) for b in vector._scored(iter(batches), list(range(51)), matrix, 7) for r in b.to_pylist()]
    assert len(got) == len(want) == 357 and set(got) == want
    monkeypatch.undo()
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(rng.normal(size=(10_000, 8)).tolist())], ["vec_id", "embedding"])
    tracemalloc.start()
    assert sum(b.num_rows for b in vector._scored(iter([batch]), list(range(4_096)), vector._unit(rng.normal(size=(4_096, 8))), 10)) == 40_960
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20  # all scores of the batch would take 312 MB at once, and their order as much


def test_a_vector_that_is_not_finite_takes_no_part(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("inf"), 1.0]), (3, [float("nan"), 1.0])], "vec_id long, embedding array<double>").coalesce(1)
    got = vector.nearest(points.withColumnRenamed("vec_id", "query_id"), points, 3)
    assert rows(got.select("query_id", "vec_id", "score")) == [(1, 1, 1.0)]


def test_names_beside_punctuation_and_particles(spark):
    texts = spark.createDataFrame([(1, "by Acme, then (Acme Corp) again"), (2, "POTC는 어제, MILESTONE 달성"), (3, "신메이플스토리는"), (4, None), (5, "XAcme Corporation; acme"), (6, "one-two ONE."), (7, "***")], "id long, text string")
    names = spark.createDataFrame([(n,) for n in ("Acme", "Acme Corp", "POTC", "ONE", "메이플", "***", "", None)], "name string")
    assert rows(glossary.named(texts, names, "id")) == [(1, "Acme"), (1, "Acme Corp"), (2, "POTC"), (3, "메이플"), (5, "Acme Corp"), (6, "ONE")]
    assert glossary.named(texts, names.limit(0), "id").count() == 0


def test_paths_over_many_hops_and_none(spark):
    edges = spark.createDataFrame([(f"n{i}", "to", f"n{i + 1}") for i in range(6)], "src string, rel_name string, dst string")
    one, name = spark.createDataFrame([("n0",)], "name string"), spark.createDataFrame([("n6",), ("n2",)], "name string")
    assert rows(graph.shortest_paths(edges, one, name)) == [("n0", "n2", 2), ("n0", "n6", 6)]
    assert graph.shortest_paths(edges, one, name, 3).count() == 1
    assert graph.path_nodes(edges, "n6", "n3").first().nodes == ["n6", "n5", "n4", "n3"]
    assert graph.path_nodes(edges, "n0", "nowhere").count() == 0


def test_as_of_takes_the_first_of_equals(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (1, 10), (2, 1), (None, 3)], "k int, at int")
    right = spark.createDataFrame([(1, 5, 8), (1, 5, 7), (1, 9, 1), (3, 1, 1)], "k int, snap int, id int")
    assert sorted(map(str, rows(events.next_as_of(left.where("k IS NOT NULL"), right, ["k"], "at", "snap", "id")))) == ["(1, 10, None, None)", "(1, 5, 5, 7)", "(1, 9, 9, 1)", "(2, 1, None, None)"]


def test_stability_deals_the_triples_out_once(spark):
    """One shuffle of the triples and one of the sources' sums; repeats count once, and a null equals nothing."""
    shape = "src string, s string, p string, o string"
    first = [("x", "a", "p", "b"), ("x", "a", "p", "b"), ("x", "a", "q", "c"), ("x", "n", None, "c"), ("y", "a", "p", "b"), (None, "a", "p", "b")]
    second = [("x", "a", "p", "b"), ("x", "a", "r", "c"), ("x", "n", None, "c"), ("z", "a", "p", "b"), (None, "a", "p", "b")]
    found = evaluation.stability(spark.createDataFrame(first, shape), spark.createDataFrame(second, shape), "src")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert {tuple(r) for r in found.collect()} == {("x", 0.2, 2), ("y", 0.0, 0), ("z", 0.0, 0), (None, 0.0, 1)}
