from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import context, events, scopes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_batches_keep_both_limits(spark):
    numbers = lambda n, size, chars, items: one(spark, context.batches(F.array(*[F.lit("a" * size)] * n), chars, items))
    assert numbers(5, 100, 250, 50) == [0, 0, 1, 1, 2] and numbers(7, 1, 1000, 3) == [0, 0, 0, 1, 1, 1, 2]
    assert one(spark, context.batches(F.array(F.lit("a" * 9), F.lit("b")), 5, 50)) == [0, 1]


def test_near_copies_go(spark):
    docs = spark.createDataFrame([(0, 1, "the same text of a page"), (0, 2, "the same text of a page!"), (0, 3, "something else"), (1, 1, "alone")], "q int, rank long, text string")
    kept = context.without_near_copies(docs, ["q"], "text", 0.8)
    assert sorted((r.q, r.rank) for r in kept.collect()) == [(0, 1), (0, 3), (1, 1)]
    assert context.without_near_copies(docs, ["q"], "text", 1.0).count() == 4


def test_evidence_is_included_and_answered(spark):
    docs = spark.createDataFrame([(1, 1, "u1", "t", "x" * 30), (1, 2, "u2", "t", "see user_login_v2 now"), (2, 1, "u9", "t", "y")], "id int, rank long, url string, title string, text string")
    asked = spark.createDataFrame([(1, "u2", "table user_login_v2"), (2, "u1", "none"), (3, "u1", "")], "id int, source_url string, answer string")
    got = {r.id: (r.included, r.answered, r.place, r.used) for r in context.evidence(docs, asked).collect()}
    assert got == {1: (True, True, 2, 2), 2: (False, False, None, 1), 3: (False, False, None, 0)}
    cut = {r.id: (r.included, r.answered) for r in context.evidence(docs, asked, cap=6).collect()}
    assert cut[1] == (True, False)


def test_lines(spark):
    edges = spark.createDataFrame([("a", "x", "r", "y"), ("a", "w", "r", "y")], "k string, src string, rel_name string, dst string")
    assert context.relation_lines(edges, ["k"]).first().relations == "w -[r]-> y\nx -[r]-> y"
    found = spark.createDataFrame([("a", 1, "2024-01-02", "patch", "t")], "k string, event_id long, date string, event_type string, title string")
    assert context.event_lines(found, ["k"]).first().timeline == "2024-01-02 [patch] t"


def test_verdicts(spark):
    assert one(spark, context.miss_verdict(F.lit(True), F.lit(True), F.lit(False))) == "cut from the context"
    assert one(spark, context.generation_verdict(F.lit(0.0), F.lit(1.0), F.lit(0.0))) == "distracted by the context"
    assert one(spark, context.query_route(F.lit("Revenue of the team"), ("revenue",), ("team",))) == "BOTH"


def test_events_of_properties(spark):
    pages = spark.createDataFrame([("p", "u", "T", {"Date": "2024-01-02T00:00", "Game": "G", "Category": "소재 변경", "Memo": " "}), ("q", "u", "T", {"Game": "G"})], "page_id string, source_url string, title string, db_properties map<string,string>")
    got = scopes.page_events(pages).collect()
    assert len(got) == 1 and (got[0].date, got[0].game, got[0].event_type, got[0].title) == ("2024-01-02", "G", "ua_creative", "T")
    assert [one(spark, scopes.event_type(F.lit(v))) for v in ("", "incident", "odd")] == ["user_event", "incident", "ua_campaign"]


def test_scopes(spark):
    aliases = spark.createDataFrame([("Pirates", "POTC", "game"), ("POTC", "POTC", "game"), ("HR", "HR", "organization")], "alias string, term string, category string")
    teams = spark.createDataFrame([("Data",), ("Data Lab",), ("운영팀",)], "name string")
    rows = spark.createDataFrame([(1, "pirates", "", "t"), (2, "HR", "", "t"), (3, "New", "Game", "t"), (4, "기타", "", "by the Data Lab team"), (5, "-", "", "운영팀은 일한다"), (6, "Odd", "", "nothing"), (7, None, None, "nothing")], "id int, value string, source_key string, text string")
    got = {r.id: (r.scope, r.scope_type, r.scope_verified) for r in scopes.classify(rows, aliases, teams, "id").collect()}
    assert got == {
        1: ("POTC", "game", True), 2: ("HR", "org", True), 3: ("New", "game", False), 4: ("Data Lab", "org", False),
        5: ("운영팀", "org", False), 6: ("Odd", "unknown", False), 7: ("", "unknown", False),
    }


def test_timeline_questions(spark):
    made = spark.createDataFrame([(1, "Alpha", "patch", 1704153600), (2, "Beta", "patch", 1704240000), (3, "Alpha", "patch", 1714521600)], "event_id long, scope string, event_type string, date_ts long")
    games = spark.createDataFrame([("Alpha",), ("Beta",)], "name string")
    asked = spark.createDataFrame([(1, "Alpha 이력"), (2, "2024년 1월 패치"), (3, "Alpha 2024년 1월"), (4, "패치 일정"), (5, "이력")], "q int, text string")
    got = sorted((r.q, r.event_id) for r in events.resolve_timeline(asked, made, games, "q").collect())
    assert got == [(1, 1), (1, 3), (2, 1), (2, 2), (3, 1)]
