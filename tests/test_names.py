"""Names in texts, against looking for every name in every text."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from brindle.operators import glossary
from brindle.plans.registry import QUERIES


def holds(text, name):
    if not re.search(r"[^\W_]", name):
        return False
    if re.fullmatch(r"[A-Za-z0-9_-]+", name):
        return re.search(rf"(?<![A-Za-z0-9]){re.escape(name)}(?![A-Za-z0-9])", text) is not None
    return name in text


def test_names_are_found_wherever_a_text_holds_them(spark):
    rng = random.Random(2)
    names = ["the", "of the", "e c", "user_login", "a-b", "-x", "x-", "메이플", "메", "메이플 월드", "월드2", "(the)", " cat ", "C++", "é", "café au", "2024", "---", "", "th e", "A"]
    pieces = ["the", "bathe", "cat", "of", "user_login", "user_loginx", "a-b", "-x", "x-y", "메이플은", "THE메", "메이플 월드2", "(the)", "C++", "café", "au", "é2", "2024년", "A", "A1", "lathe cats", "_", "."]
    texts = [(i, rng.choice((" ", "", ", ")).join(rng.choice(pieces) for _ in range(rng.randrange(7)))) for i in range(400)] + [(999, None)]
    got = glossary.named(spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame([(n,) for n in names] * 2, "name string"), "id")
    want = {(i, n) for i, t in texts for n in names if t and n and holds(t, n)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len({n for _, n in want}) >= 15


def test_ranked_nodes_are_read_once(spark, sf_dir):
    """Orders are read for the edges and for the nodes, and not again for the names."""
    plan = QUERIES["entity_rank"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_orderkey") == 2


def test_closest_candidates_of_names_with_several_forms(spark, monkeypatch):
    monkeypatch.setattr(glossary, "CANDIDATES", 3)
    rng = random.Random(5)
    nodes = [("".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))), rng.choice("XY"), rng.randrange(4)) for _ in range(150)]
    nodes = [*{(n, k): (n, k, d) for n, k, d in nodes}.values()]
    forms = [("p", "ab"), ("p", "b"), ("p", "a"), ("q", "cc"), ("q", "c"), ("r", "zz")]
    want = set()
    for asked in "pqr":
        tiers = {}
        for n, _, _ in nodes:
            for form in (f for a, f in forms if a == asked and f in n):
                tiers[n] = min(tiers.get(n, 2), 0 if n == form else 1 if n.startswith(form) else 2)
        close = sorted(tiers, key=lambda n: (tiers[n], len(n), n))[:3]
        ranked = sorted((tiers[n], -d, len(n), n, k) for n, k, d in nodes if n in close)
        if ranked:
            name = ranked[0][3]
            want.add((asked, name, ranked[0][4], ",".join(sorted(k for n, k, _ in nodes if n == name))))
    got = glossary.lookup_entities(spark.createDataFrame([(a,) for a in "pqr"], "asked string"), spark.createDataFrame(nodes, "name string, label string, degree long"), spark.createDataFrame(forms, "asked string, form string"))
    assert {(r.asked, r.name, r.label, ",".join(r.types)) for r in got.collect()} == want and len(want) == 2


def test_the_busiest_name_is_found_among_any_number_of_shorter_ones(spark):
    """More names hold the text than a ranked list has; the one with the most edges and its other spelling are the longest."""
    nodes = [(f"a db {i:03}", "X", 0) for i in range(300)] + [("the team that runs a DB", "Team", 7), ("The team, that runs a db", "Org", 2)]
    forms = [("db", "db"), ("q", "db"), ("q", "THE"), ("q", "team"), ("r", "zz")]
    names = spark.createDataFrame(nodes, "name string, label string, degree long")
    wanted = spark.createDataFrame([("db",), ("q",), ("r",)], "asked string")
    found = ("the team that runs a DB", "Team", ["Org", "Team"], ["The team, that runs a db", "the team that runs a DB"])
    assert list(map(tuple, glossary.lookup_entities(wanted, names).where("asked = 'db'").collect())) == [("db", *found)]
    got = glossary.lookup_entities(wanted, names, spark.createDataFrame(forms, "asked string, form string"))
    assert sorted(map(tuple, got.collect())) == [("db", *found), ("q", *found)]


def test_names_of_one_run_need_no_look_at_texts(spark, monkeypatch):
    monkeypatch.setattr(glossary, "names_token", lambda text, name: F.lit(False))
    texts = spark.createDataFrame([(1, "se que bathe ñat"), (2, "sea-que 메이플은"), (3, "at se")], "id long, text string")
    names = spark.createDataFrame([(n,) for n in ("se", "que", "at", "메이플", "se que")], "name string")
    assert sorted(map(tuple, glossary.named(texts, names, "id").collect())) == [(1, "at"), (1, "que"), (1, "se"), (2, "que"), (2, "메이플"), (3, "at"), (3, "se")]
