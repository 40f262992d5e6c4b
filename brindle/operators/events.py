"""Events: validation, chains, timelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.dates import days_between, event_epoch, quarter_label
from brindle.functions.ids import event_id
from brindle.functions.text import any_keyword

#: The event types; anything else is the default.
EVENT_TYPES = (
    "client_update", "server_update", "user_event", "season", "content_release", "maintenance", "incident", "kpi_milestone",
    "ua_budget", "ua_creative", "ua_channel", "ua_targeting", "ua_abtest", "ua_campaign",
)
REQUIRED = ("game", "date", "title")


def validated(rows: DataFrame, number: str = "row") -> DataFrame:
    """rows with errors (an array of texts with the row number) and a known event_type."""
    missing = F.filter(
        F.array(*[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.concat(F.lit("row "), F.col(number).cast("string"), F.lit(f": {c} is missing"))) for c in REQUIRED]),
        lambda e: e.isNotNull(),
    )
    kind = F.when(F.col("event_type").isin(*EVENT_TYPES), F.col("event_type")).otherwise("user_event")
    return rows.withColumn("errors", missing).withColumn("event_type", kind)


def enriched(rows: DataFrame) -> DataFrame:
    """rows with event_id, date_ts, year, month, quarter and scope."""
    at = event_epoch(F.col("date"))
    day = F.to_date(F.timestamp_seconds(at))
    dated = at > 0
    return (
        rows.withColumn("event_id", event_id(F.col("source_url"), F.col("game"), F.col("event_type"), F.col("date"), F.col("title")))
        .withColumn("date_ts", at)
        .withColumn("year", F.when(dated, F.year(day)))
        .withColumn("month", F.when(dated, F.month(day)))
        .withColumn("quarter", F.when(dated, quarter_label(day)))
        .withColumn("scope", F.coalesce(F.nullif(F.col("scope"), F.lit("")), F.col("game")))
    )


def _order(scope: str) -> Window:
    return Window.partitionBy(scope).orderBy("date_ts", "event_id")


def chain(events: DataFrame, scope: str = "scope") -> DataFrame:
    """Neighbouring events of each scope: event_id, next_id and the days between; undated ones and empty scopes are left out."""
    usable = events.where(F.col(scope).isNotNull() & (F.col(scope).cast("string") != "") & (F.col("date_ts") > 0))
    paired = usable.withColumn("next_id", F.lead("event_id").over(_order(scope))).withColumn("next_ts", F.lead("date_ts").over(_order(scope)))
    return paired.where("next_id IS NOT NULL").select(scope, "event_id", "next_id", days_between(F.col("next_ts"), F.col("date_ts")).alias("days_diff"))


def with_neighbours(events: DataFrame, scope: str = "scope", told: str = "event_type") -> DataFrame:
    """Events with the one before and the one after in their scope."""
    window = _order(scope)
    return events.withColumn("prev", F.lag(told).over(window)).withColumn("next", F.lead(told).over(window))


def skipped(links: DataFrame, events: DataFrame, scope: str = "scope") -> DataFrame:
    """Links of a chain that jump over an event of their scope: none in a sound chain.

    An event lies strictly between a link's ends when its place in the scope does; places turn the range join into arithmetic.
    """
    placed = events.where("date_ts > 0").select(scope, "event_id", F.row_number().over(_order(scope)).alias("place"))
    ends = links.join(placed, [scope, "event_id"]).join(placed.select(scope, F.col("event_id").alias("next_id"), F.col("place").alias("next_place")), [scope, "next_id"])
    return ends.where("next_place - place > 1").select(scope, "event_id", "next_id", (F.col("next_place") - F.col("place") - 1).cast("long").alias("between"))


def timeline(
    events: DataFrame, *, start: int | None = None, end: int | None = None, scope: object = None, kind: str | None = None, keywords: Column | None = None, fields: tuple[str, ...] = (), limit: int | None = 20
) -> DataFrame:
    """Events in a range of seconds, of a scope, a type or with a keyword, oldest first; without any filter, none."""
    tests = []
    if start is not None:
        tests.append(F.col("date_ts") >= start)
    if end is not None:
        tests.append(F.col("date_ts") <= end)
    if scope is not None:
        tests.append(F.col("scope") == scope)
    if kind is not None:
        tests.append(F.col("event_type") == kind)
    if keywords is not None:
        tests.append(any_keyword(keywords, *[F.col(f) for f in fields]))
    found = events
    for test in tests or [F.lit(False)]:
        found = found.where(test)
    return found if limit is None else found.orderBy("date_ts", "event_id").limit(limit)


def next_as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with the first right row of its keys at or after its time (null if there is none).

    Both are laid in one order, latest first, and the value seen last is carried on by a window: a sort a key instead of a range
    join. The frame grows by a row at a time, so the work is that of the sort.
    """
    marks = right.select(*keys, F.col(right_time).alias("_at"), F.lit(1).alias("_side"), F.struct(F.col(right_time), F.col(value)).alias("_found"))
    asked = left.select(*keys, F.col(left_time).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(marks.schema["_found"].dataType).alias("_found"), F.struct("*").alias("_row"))
    both = asked.unionByName(marks.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)))
    window = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_side"), F.desc(f"_found.{value}")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_next", F.last("_found", ignorenulls=True).over(window)).where("_side = 0")
    return carried.select("_row.*", F.col(f"_next.{right_time}").alias(right_time), F.col(f"_next.{value}").alias(value))


def completeness(events: DataFrame) -> DataFrame:
    """One row of counts: all, and those without a date, scope or type."""
    blank = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    return events.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("date_ts") == 0).alias("undated"), blank("scope").alias("no_scope"), blank("event_type").alias("no_type"))


def resolve_timeline(questions: DataFrame, events: DataFrame, games: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """Events that a question (key, text) asks for: it must ask for a history, and name a date or a game (column name).

    Oldest first, at most limit a question; questions without date and game get none.
    """
    from brindle.functions.dates import date_range, timeline_intent

    from .glossary import names_in_text
    from .ranking import top_by

    asked = questions.select(key, "text", date_range(F.col("text")).alias("_r")).where(timeline_intent(F.col("text")))
    game = names_in_text(asked, games, key).where("rank = 1").select(key, F.col("name").alias("_game"))
    wanted = asked.join(game, key, "left").where("_r.from IS NOT NULL OR _game IS NOT NULL")
    span = wanted.select(key, "_game", F.unix_timestamp(F.col("_r.from").cast("timestamp")).alias("_from"), (F.unix_timestamp(F.col("_r.to").cast("timestamp")) + 86_399).alias("_to"))
    inside = (F.col("_from").isNull()) | F.col("date_ts").between(F.col("_from"), F.col("_to"))
    by_game = span.where("_game IS NOT NULL").join(events, F.col("_game") == F.col("scope")).where(inside)
    # without a game a range is spelled out in days, which keeps the join an equi-join
    days = span.where("_game IS NULL").withColumn("_day", F.explode(F.sequence(F.expr("_from div 86400"), F.expr("_to div 86400"))))
    by_day = days.join(events.withColumn("_day", F.expr("date_ts div 86400")), "_day").drop("_day")
    columns = [key, *events.columns]
    return top_by(by_game.select(*columns).unionByName(by_day.select(*columns)), [key], limit, F.asc("date_ts"), F.asc("event_id"))


def with_pages(events: DataFrame, pages: DataFrame, url: str = "source_url") -> DataFrame:
    """Events with their page's text (column text) and chunks, null where the page is not stored."""
    whole = pages.select(url, F.col("text").alias("page_content"), F.col("chunks").alias("page_chunk_count"))
    return events.join(whole, url, "left")


def without_edge(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Events that no edge leads to (dst is an event_id)."""
    return events.join(edges.select(F.col("dst").alias("event_id")).distinct(), "event_id", "left_anti")


def subject_edges(events: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """HAD_EVENT and MANAGED_BY edges of enriched events, and the nodes with those that HAD_EVENT needs.

    An event belongs to its game (node Game) or its organisation (node Team), by scope_type. Its manager is one node of that name:
    the first by label; unknown managers get no edge.
    """
    is_game = (F.col("scope_type") == "game") & (F.coalesce("game", F.lit("")) != "")
    is_org = (F.col("scope_type") == "org") & (F.coalesce("scope", F.lit("")) != "")
    owner = F.when(is_game, F.struct(F.lit("Game").alias("label"), F.col("game").alias("name"))).when(is_org, F.struct(F.lit("Team").alias("label"), F.col("scope").alias("name")))
    owned = events.withColumn("_o", owner).where("_o IS NOT NULL")
    had = owned.groupBy(F.col("_o.label").alias("src_label"), F.col("_o.name").alias("src"), F.lit("HAD_EVENT").alias("rel_name"), F.col("event_id").alias("dst"), "date").agg(F.min("source_url").alias("source_url"))
    one = nodes.where("name IS NOT NULL").groupBy(F.col("name").alias("manager")).agg(F.min("label").alias("_label"))
    managed = events.where("manager <> ''").join(one, "manager").select(F.lit("Event").alias("src_label"), F.col("event_id").alias("src"), F.lit("MANAGED_BY").alias("rel_name"), F.col("manager").alias("dst"), "date", "source_url").distinct()
    made = owned.groupBy(F.col("_o.label").alias("label"), F.col("_o.name").alias("name")).agg(F.min("source_url").alias("source_url"))
    fresh = made.join(nodes.select("label", "name").distinct(), ["label", "name"], "left_anti")
    return had.unionByName(managed), nodes.select("label", "name", "source_url").unionByName(fresh)


def upserted(old: DataFrame, new: DataFrame, key: str = "event_id", created: str = "ts") -> DataFrame:
    """old events and new ones over them: a known event takes every new value but keeps the time at which it was first stored."""
    first = old.groupBy(key).agg(F.min(created).alias("_first"))
    fresh = new.join(first, key, "left").withColumn(created, F.coalesce("_first", created)).drop("_first")
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(fresh.select(*old.columns))


def integrity(events: DataFrame, links: DataFrame, edges: DataFrame, ledger: DataFrame, page: str = "source_url") -> DataFrame:
    """What is wrong with stored events, as rows (item, found): events and those without date, scope or type; links, and those that skip
    an event; events without an edge; events by the ledger (page, events), its pages, and those of which events were lost."""
    names = {"events": "events", "undated": "events without date", "no_scope": "events without scope", "no_type": "events without type"}
    counted = completeness(events).select(F.explode(F.create_map(*(x for c, name in names.items() for x in (F.lit(name), F.col(c))))).alias("item", "found"))
    rows = lambda df, item: df.agg(F.count(F.lit(1)).alias("found")).select(F.lit(item).alias("item"), "found")
    stored = events.groupBy(page).agg(F.count(F.lit(1)).alias("_stored"))
    lost = ledger.join(stored, page, "left").withColumn("_lost", F.col("events") - F.coalesce("_stored", F.lit(0))).where("_lost > 0")
    parts = [
        rows(links, "links"), rows(skipped(links, events), "links that skip"), rows(without_edge(events, edges), "events without edge"),
        ledger.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("found")).select(F.lit("events by the ledger").alias("item"), "found"),
        rows(ledger.where("events > 0"), "pages with events by the ledger"), rows(lost, "pages that lost events"),
        lost.agg(F.coalesce(F.sum("_lost"), F.lit(0)).alias("found")).select(F.lit("events lost").alias("item"), "found"),
    ]
    return reduce(DataFrame.unionByName, parts, counted)


def of_game(events: DataFrame, edges: DataFrame, game: str) -> DataFrame:
    """Events that a game's HAD_EVENT edges lead to, or that name it themselves, and by which of the two."""
    linked = edges.where((F.col("rel_name") == "HAD_EVENT") & (F.col("src") == game)).select(F.col("dst").alias("event_id"), F.lit(True).alias("by_edge")).distinct()
    both = events.join(linked, "event_id", "left").withColumn("by_edge", F.coalesce("by_edge", F.lit(False))).withColumn("by_property", F.coalesce(F.col("game") == game, F.lit(False)))
    return both.where("by_edge OR by_property")


def resolve_games(asked: DataFrame, nodes: DataFrame, events: DataFrame) -> DataFrame:
    """asked names (column asked) with the game they mean: the first Game node by name that holds the name, else the first game of an
    event that does, else the name itself."""
    from .glossary import holding

    plain = lambda c: c
    first = lambda names, to: holding(names, asked, plain).groupBy("asked").agg(F.min("name").alias(to))
    by_node = first(nodes.where(F.col("label") == "Game"), "_node")
    by_event = first(events.select(F.col("game").alias("name")).where("name <> ''"), "_event")
    found = asked.join(by_node, "asked", "left").join(by_event, "asked", "left")
    return found.withColumn("game", F.coalesce("_node", "_event", "asked")).drop("_node", "_event")
