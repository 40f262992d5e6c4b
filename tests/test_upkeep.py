"""Purges, kept times, pages worth saving, glossaries from several places, ranks of targets, near copies of long lists."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import context, evaluation, events, glossary, tables
from brindle.sources import markdown, tabular


def test_purge_takes_a_lost_page_out_of_every_store(spark):
    registry = spark.createDataFrame([(1, "u1", "ok"), (2, "u2", "ok"), (3, "u3", "deleted"), (4, "", "ok"), (5, None, "ok")], "page_id long, source_url string, status string")
    chunks = spark.createDataFrame([("u1", 0), ("u2", 0), ("u2", 1), ("u3", 0), ("", 9), (None, 8)], "source_url string, chunk_index long")
    edges = spark.createDataFrame([("u2", False), ("u2", True), ("u2", None), ("u1", False)], "source_url string, is_manual boolean")
    new, left, report = tables.purged(registry, registry.where("page_id IN (1, 3)"), "page_id", "source_url", {"chunks": chunks, "edges": edges})
    assert {r.page_id: r.status for r in new.collect()} == {1: "ok", 2: "deleted", 3: "deleted", 4: "deleted", 5: "deleted"}
    assert sorted(str(r.source_url) for r in left["chunks"].collect()) == ["", "None", "u1", "u3"]
    assert sorted((r.source_url, r.is_manual) for r in left["edges"].collect()) == [("u1", False), ("u2", True)]
    assert {(r.page_id, r.chunks, r.edges) for r in report.collect()} == {(2, 2, 2), (4, 0, 0), (5, 0, 0)}


def test_a_known_event_keeps_its_first_time(spark):
    shape = "event_id string, title string, ts long"
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], shape)
    new = spark.createDataFrame([("b", None, 9), ("c", "z", 9)], shape)
    assert {tuple(r) for r in events.upserted(old, new).collect()} == {("a", "x", 1), ("b", None, 2), ("c", "z", 9)}


def test_integrity_of_nothing(spark):
    none = spark.createDataFrame([], "event_id long, scope string, event_type string, date_ts long, source_url string")
    ledger = spark.createDataFrame([], "source_url string, events long")
    found = events.integrity(none, events.chain(none), spark.createDataFrame([], "dst long"), ledger)
    assert {r.item: r.found for r in found.collect()} == dict.fromkeys([r.item for r in found.collect()], 0) and found.count() == 11


def test_pages_worth_saving(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(1, words(30), None), (2, words(29), None), (3, words(2), {"b": "two words", "a": None}), (4, None, {"k": "v"}), (5, " ", {}), (6, words(40), {"k": "v"}), (7, None, None)]
    got = {r.id: (r.body, r.word_count) for r in markdown.savable(spark.createDataFrame(rows, "id long, body string, db_properties map<string,string>")).collect()}
    assert got == {1: (words(30), 30), 3: ("a: \nb: two words\n\nw w", 6), 4: ("k: v", 2), 6: (words(40), 40)}


def test_stale_files_of_renamed_pages(spark):
    files = spark.createDataFrame([("p1", "p1_old.md"), ("p1", "p1_new.md"), ("p2", "p2.md"), ("p3", "p3.md")], "page_id string, file string")
    saved = spark.createDataFrame([("p1", "p1_new.md"), ("p2", "p2.md")], "page_id string, file string")
    assert [tuple(r) for r in markdown.stale_files(files, saved).collect()] == [("p1", "p1_old.md")]


def test_the_first_glossary_that_can_be_read(spark, tmp_path):
    (tmp_path / "empty.json").write_text(json.dumps({"terms": []}))
    (tmp_path / "kept.json").write_text(json.dumps({"terms": [{"term": "a", "synonyms": ["b"], "category": "c"}]}))
    paths = [str(tmp_path / f"{n}.json") for n in ("missing", "empty", "kept")]
    assert [r.term for r in tabular.first_glossary(spark, *paths).collect()] == ["a"]
    with pytest.raises(ValueError, match="missing.json: AnalysisException; .*empty.json: empty"):
        tabular.first_glossary(spark, *paths[:2])


def test_where_targets_stand(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.9), (1, "a", 2, 0.8), (1, "b", 3, 0.7), (1, "c", 4, 0.6), (2, "a", 1, 0.5)], "q int, page string, rank long, score double")
    targets = spark.createDataFrame([(1, "b"), (2, "z"), (3, "a")], "q int, page string")
    got = {r.q: (r.chunk_rank, r.page_rank, r.pages, r.passes) for r in evaluation.target_ranks(hits, targets, "q", "page", 3, 1).collect()}
    assert got == {1: (3, 2, 2, False), 2: (None, None, 1, False), 3: (None, None, 0, False)}


def test_what_a_glossary_lacks(spark):
    nodes = spark.createDataFrame([("Acme", "Org"), ("acme", "Org"), ("Acme Corp", "Org"), ("Bolt", "Org"), ("Bolt", "Thing")], "name string, label string")
    table = glossary.aliases(spark.createDataFrame([("ACME", ["x"], "Org"), ("Other", ["x"], "Org")], "term string, synonyms array<string>, category string"))
    got = {tuple(r) for r in glossary.to_do(nodes, table, ("Org",)).collect()}
    assert got == {
        ("conflict", "x", "ACME,Other"), ("labels", "Bolt", "Org,Thing"), ("spellings", "acme", "Acme,acme"), ("abbreviation", "Acme", "Acme Corp"), ("abbreviation", "acme", "Acme Corp"),
        ("unregistered", "Acme Corp", "Org"), ("unregistered", "Bolt", "Org"),
    }


def grams(text):
    bare = "".join((text or "")[:600].split())
    return {bare} if len(bare) < 3 else {bare[i : i + 3] for i in range(len(bare) - 2)}


def test_near_copies_of_long_lists(spark):
    """No list is too long: the 150th document is compared as the second one is."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(("alpha", "beta", "gamma", "delta", "omega", "x")) for _ in range(6)) for _ in range(300)] + ["", "", "a", None]
    docs = spark.createDataFrame([(q, i + 1, t, "clash") for q in (1, 2) for i, t in enumerate(texts[q:])], "q int, rank long, text string, _trigrams string").repartition(4)
    kept = context.without_near_copies(docs, ["q"], "text", 0.6)
    want = set()
    for q in (1, 2):
        sets: list[set] = []
        for i, t in enumerate(texts[q:]):
            own = grams(t)
            if all(len(own & s) / len(own | s) < 0.6 for s in sets):
                sets.append(own)
                want.add((q, i + 1))
    assert {(r.q, r["rank"]) for r in kept.collect()} == want and kept.columns == docs.columns
    assert max(r for _, r in want) > 150 and len(want) < 400


def test_context_of_what_there_is(spark):
    docs = spark.createDataFrame([("a", 1, "t", "text"), ("a", 2, "u", "y" * 90)], "k string, rank long, title string, text string")
    edges = spark.createDataFrame([("a", "s", "r", "o"), ("b", "s", "r", "o")], "k string, src string, rel_name string, dst string")
    told = spark.createDataFrame([], "k string, event_id long, date string, event_type string, title string")
    got = {r.k: r.context for r in context.assembled(docs, edges, told, ["k"], 60).collect()}
    assert got == {"a": "## relations\ns -[r]-> o\n\n## documents\n[t]\ntext", "b": "## relations\ns -[r]-> o"}
    assert context.assembled(docs, edges, told, ["k"]).where(F.contains("context", F.lit("[u]"))).count() == 1
