from __future__ import annotations

import datetime as dt
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import dates, ids, routing, structured, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens_are_ascii_words_then_hangul_pairs(spark):
    assert one(spark, text.tokens(F.lit("Spark 엔진을"))) == ["spark", "엔진", "진을"]
    assert one(spark, text.tokens(F.lit("강 A_1"))) == ["a_1", "강"]
    assert one(spark, text.tokens(F.lit(""))) == []


def test_norm_key_keeps_letters_and_digits(spark):
    assert one(spark, text.norm_key(F.lit(" Data-Base_팀 2 "))) == "database팀2"


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=30))
def test_norm_key_twice_is_once(spark, value):
    once = one(spark, text.norm_key(F.lit(value)))
    assert one(spark, text.norm_key(F.lit(once))) == once


def test_trigrams_and_jaccard(spark):
    assert sorted(one(spark, text.trigram_set(F.lit("ab cd")))) == ["abc", "bcd"]
    assert one(spark, text.trigram_set(F.lit("a"))) == ["a"]
    assert one(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5


@pytest.mark.parametrize(("word", "stem"), [("서울은", "서울"), ("부산에서", "부산"), ("나는", "나는"), ("plain", "plain")])
def test_particles(spark, word, stem):
    assert one(spark, text.strip_particle(F.lit(word))) == stem


def test_ascii_names_need_boundaries(spark):
    hit = lambda t, n: one(spark, text.names_token(F.lit(t), F.lit(n)))
    assert not hit("the FACTOR", "ACT") and hit("the ACT now", "ACT") and hit("CODE는", "CODE") and hit("한국팀", "국팀")


def test_chunks_cover_the_text(spark):
    assert [len(c) for c in one(spark, text.chunks(F.lit("x" * 25), 10, 3))] == [10, 10, 10, 4]
    value = "".join(chr(97 + i % 26) for i in range(2000))
    parts = one(spark, text.chunks(F.lit(value)))
    assert parts[0] + "".join(p[200:] for p in parts[1:]) == value
    assert one(spark, text.chunks(F.lit("   "))) == []


def test_anchor_window_prefers_most_anchors(spark):
    chunks = F.array(*[F.lit(c * 100) for c in "abcdef"])
    got = one(spark, text.anchor_window(chunks, F.array(F.lit(0), F.lit(4), F.lit(5)), 250))
    assert got.startswith("…") and "e" * 100 in got and "a" not in got


def test_answer_key(spark):
    assert one(spark, text.answer_key(F.lit("use Table_user.log_v2 here"))) == "table_user.log_v2"
    assert one(spark, text.answer_key(F.lit("a plain sentence"))) == ""


def test_blocks_and_tables(spark):
    line = lambda kind, **k: one(spark, text.block_markdown(F.lit(kind), F.lit("t"), F.lit(k.get("depth", 0)), F.lit(k.get("checked", False)), F.lit(None).cast("string")))
    assert (line("heading_2"), line("bulleted_list_item", depth=1), line("to_do", checked=True)) == ("## t", "  - t", "- [x] t")
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"), F.lit("d")))
    assert one(spark, text.table_markdown(rows, F.lit(True))) == "| a | b |\n| --- | --- |\n| c | d |"


def test_html_to_text(spark):
    assert one(spark, text.html_to_text(F.lit("<script>var a='<p>';</script><h1>A &amp; B</h1><p>c<b>d</b></p>"))) == "A & B\ncd"


def test_uuid5_is_pythons(spark):
    for name in ("https://example.org/#chunk0", "가나", ""):
        assert one(spark, ids.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_event_ids_differ_by_title_date_and_page(spark):
    make = lambda **k: one(spark, ids.event_id(*[F.lit(k.get(n, n)) for n in ("url", "game", "kind", "date", "title")]))
    assert make() == make() and len({make(), make(title="x"), make(date="x"), make(url="x")}) == 4


@pytest.mark.parametrize(
    ("question", "start", "end"),
    [
        ("2025년 3분기", "2025-07-01", "2025-09-30"), ("2024-02-31 work", "2024-02-29", "2024-02-29"), ("24년 2월", "2024-02-01", "2024-02-29"),
        ("2023년 이력", "2023-01-01", "2023-12-31"), ("2024.05", "2024-05-01", "2024-05-31"), ("2023년 13월", "2023-01-01", "2023-12-31"), ("version 12.5", None, None), ("", None, None),
    ],
)
def test_date_ranges(spark, question, start, end):
    got = one(spark, dates.date_range(F.lit(question)))
    iso = lambda s: dt.date.fromisoformat(s) if s else None
    assert (got["from"], got["to"]) == (iso(start), iso(end))


def test_timeline_intent(spark):
    intent = lambda t: one(spark, dates.timeline_intent(F.lit(t)))
    assert intent("배포 이력") and intent("2024년 패치") and not intent("패치 일정")


def test_event_epoch(spark):
    assert [one(spark, dates.event_epoch(F.lit(d))) for d in ("2024-01-02", "2024/01/02", "20240102", "soon")] == [1704153600] * 3 + [0]


def test_json_salvage(spark):
    schema = "a int"
    status = lambda t: one(spark, structured.salvage_status(F.lit(t), schema))
    wrapped = 'Here:\n```json\n[{"a": 1}]\n``` done'
    assert status(wrapped) == "ok" and status("[]") == "empty" and status("nothing") == "error"
    assert one(spark, structured.json_array(F.lit(wrapped), schema))[0].a == 1


def test_clamp(spark):
    assert [one(spark, structured.clamp(F.lit(v), 1, 50, 10)) for v in ("0", "7", "99", "x")] == [1, 7, 50, 10]


def test_routes(spark):
    route = lambda words, props=False, title="t": one(spark, routing.route(F.lit(title), F.lit(words), F.lit(props), excluded=("draft",), core=("policy",)))
    assert [route(1, True), route(0, True), route(29), route(50), route(80), route(100, title="Draft"), route(40, title="Policy")] == ["core", "excluded", "excluded", "defer", "core", "excluded", "core"]


def test_realization(spark):
    status = lambda t: one(spark, routing.realization_status(F.lit(t)))
    assert (status("배포 예정"), status("배포 완료"), status("배포 완료 예정"), status("x")) == ("planned", "applied", "unconfirmed", "unconfirmed")


def test_data_assets(spark):
    found = [one(spark, routing.is_data_asset(F.lit(n))) for n in ("https://a", "a/b", "a.b.c", "user_login_log", "daily_view", "Payment team")]
    assert found == [True] * 5 + [False]


def test_a_shared_folder_is_needed(spark, sessionless):
    import pytest

    from brindle.session import scratch

    assert scratch(spark, "x") != scratch(spark, "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(sessionless, "x")


def test_character_references(spark):
    from brindle.functions import text

    given = "a&amp;lt;b &#65;&#x1F600; &eacute;&nbsp;&hellip;&nosuch; &#0;&#xD800; &#38;gt; &amp;#39; &copy"
    assert one(spark, text.decoded(F.lit(given))) == "a&lt;b A\U0001f600 é\xa0…&nosuch; �� &gt; &#39; &copy"


def test_korean_tokens(spark):
    from brindle.functions import text

    assert one(spark, text.tokens(F.lit("POTC 업데이트 는 v2"))) == ["potc", "v2", "업데", "데이", "이트", "는"]
    assert one(spark, text.strip_particle(F.lit("데이터팀에서"))) == "데이터팀" and one(spark, text.strip_particle(F.lit("나는"))) == "나는"


def test_shares_of_scope_issues(spark):
    from brindle.operators import scopes

    events = spark.createDataFrame([("game", "A", True), ("game", "B", False), ("unknown", "", False), ("unknown", "", False)], "scope_type string, scope string, scope_verified boolean")
    assert sorted((r.scope_type, r.events, r.share) for r in scopes.scope_issues(events).collect()) == [("game", 1, 0.25), ("unknown", 2, 0.5)]


def test_properties_are_parsed_once_and_dealt_out(spark, sf_dir):
    from brindle.plans.registry import QUERIES

    plan = QUERIES["page_properties"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("map_entries(from_json") == 1 and "REPARTITION_BY_NUM" in plan
