"""Event properties of free pages, and the subject (scope) of an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.routing import first_present

from .events import EVENT_TYPES
from .glossary import in_category, resolve
from .glossary import named as all_named
from .ranking import top_by

#: Property names by meaning, earlier ones first; compared in lower case.
TITLE_KEYS = ("메모", "memo", "제목", "이벤트명", "이벤트제목", "내용", "description", "설명", "name", "이름")
DATE_KEYS = ("이벤트날짜", "날짜", "일자", "date", "event_date", "시작일", "시작날짜", "변경일", "적용일")
GAME_KEYS = ("게임명", "게임", "game", "product", "서비스명", "서비스", "project")
TYPE_KEYS = ("이벤트유형", "유형", "event_type", "type", "종류", "변경카테고리", "카테고리", "category", "change_type", "변경유형")
MANAGER_KEYS = ("담당자", "담당팀", "manager", "owner", "담당", "생성자", "작성자", "creator")
#: Categories of changes and their event types, and values that name no subject.
CATEGORY_TYPES = {
    "캠페인조정": "ua_campaign", "캠페인 조정": "ua_campaign", "소재변경": "ua_creative", "소재 변경": "ua_creative", "예산변경": "ua_budget",
    "예산 변경": "ua_budget", "국가변경": "ua_targeting", "국가 변경": "ua_targeting", "타겟변경": "ua_targeting", "타겟 변경": "ua_targeting",
    "채널변경": "ua_channel", "채널 변경": "ua_channel", "ab테스트": "ua_abtest", "a/b테스트": "ua_abtest",
}
PLACEHOLDERS = ("", "기타", "미정", "없음", "-", "n/a", "na")


def lowered(properties: Column) -> Column:
    """A map with its keys in lower case; of keys that fall together the first by name stays."""
    entries = F.array_sort(F.map_entries(properties))
    keys = F.transform(entries, lambda e: F.lower(e["key"]))
    first = F.filter(entries, lambda e, i: F.array_position(keys, F.lower(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def first_filled(properties: Column, names: tuple[str, ...]) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(properties[n]), F.lit("")) for n in names])


def event_type(category: Column) -> Column:
    """Mapped categories, known types, ua_campaign for anything else, user_event for nothing."""
    raw = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    out = F.when(raw == "", "user_event").when(raw.isin(*EVENT_TYPES), raw).otherwise("ua_campaign")
    for name, kind in CATEGORY_TYPES.items():
        out = F.when(raw == name, kind).otherwise(out)
    return out


def page_events(pages: DataFrame) -> DataFrame:
    """An event for each page (page_id, source_url, title, db_properties) whose properties hold a date."""
    props = pages.withColumn("_p", lowered("db_properties"))
    date = first_present(F.col("_p"), DATE_KEYS)
    return props.select(
        "page_id", "source_url",
        F.coalesce(first_present(F.col("_p"), GAME_KEYS), F.lit("")).alias("game"),
        event_type(first_present(F.col("_p"), TYPE_KEYS)).alias("event_type"),
        F.substring(date, 1, 10).alias("date"),
        F.coalesce(first_filled(F.col("_p"), TITLE_KEYS), F.col("title")).alias("title"),
        F.coalesce(first_present(F.col("_p"), MANAGER_KEYS), F.lit("")).alias("manager"),
    ).where("date IS NOT NULL AND trim(date) <> ''")


def classify(rows: DataFrame, aliases: DataFrame, teams: DataFrame, key: str) -> DataFrame:
    """rows (key, value, source_key, text) with scope, scope_type and scope_verified.

    The value as a game of the glossary, as an organisation of it, as an unregistered game if it came from a game property;
    else the longest team named in the text; else unknown.
    """
    placeholder = F.lower(F.trim(F.coalesce("value", F.lit("")))).isin(*PLACEHOLDERS)
    named = rows.withColumn("value", F.trim(F.coalesce("value", F.lit("")))).withColumn("_none", placeholder)
    for category, column in (("game", "_game"), ("organization", "_org")):
        known = in_category(aliases, category)
        found = resolve(named.where(~F.col("_none")).select(F.col("value").alias("name")).distinct(), known)
        terms = known.select("term").distinct().withColumn("_known", F.lit(True))
        named = named.join(found.join(terms, "term").select(F.col("name").alias("value"), F.col("term").alias(column)), "value", "left")
    inside = all_named(rows, teams.where("length(name) >= 2"), key)
    team = top_by(inside, [key], 1, F.desc(F.length("name")), F.asc("name")).select(key, F.col("name").alias("_team"))
    joined = named.join(team, key, "left")
    from_game = ~F.col("_none") & F.lower(F.coalesce("source_key", F.lit(""))).isin(*GAME_KEYS)
    scope = F.coalesce("_game", "_org", F.when(from_game, F.col("value")), "_team", F.when(F.col("_none"), F.lit("")).otherwise(F.col("value")))
    kind = F.when(F.col("_game").isNotNull(), "game").when(F.col("_org").isNotNull(), "org").when(from_game, "game").when(F.col("_team").isNotNull(), "org").otherwise("unknown")
    verified = F.col("_game").isNotNull() | F.col("_org").isNotNull()
    return joined.select(*rows.columns, scope.alias("scope"), kind.alias("scope_type"), verified.alias("scope_verified"))


def scope_issues(events: DataFrame) -> DataFrame:
    """Unverified games and unknown scopes: how many events they have, and the share of all events."""
    total = events.agg(F.count(F.lit(1))).scalar()
    bad = events.where("(scope_type = 'game' AND NOT scope_verified) OR scope_type = 'unknown'")
    return bad.groupBy("scope_type", "scope").agg(F.count(F.lit(1)).alias("events")).withColumn("share", F.round(F.col("events") / total, 6))
