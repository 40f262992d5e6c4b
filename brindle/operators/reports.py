"""Reports over the page registry, logs and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_by


def department_summary(registry: DataFrame, by: str = "dept") -> DataFrame:
    """Per department: pages, those ok, failed and with events, totals and the last edit."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return registry.groupBy(by).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("failed"),
        F.count_if(F.col("event_count") > 0).alias("with_events"), total("word_count"), total("chunk_count"), total("event_count"),
        F.max("last_edited_time").alias("last_edited_time"),
    )


def route_summary(registry: DataFrame, routes: tuple[str, ...], by: str = "dept", route: str = "route") -> DataFrame:
    """department_summary with the pages of each route beside it."""
    counted = registry.groupBy(by).agg(*(F.count_if(F.col(route) == r).alias(f"{r}_pages") for r in routes))
    return department_summary(registry, by).join(counted, by)


def ok_totals(registry: DataFrame, *columns: str) -> DataFrame:
    """One row: the pages that are ok, and their sums."""
    return totals(registry.where(F.col("status") == "ok"), *columns)


def status_histogram(registry: DataFrame, *keys: str) -> DataFrame:
    """Rows by status (and more keys), with those that lack a content hash."""
    return registry.groupBy(*(keys or ("status",))).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce("content_hash", F.lit("")) == "").alias("no_hash"))


def usage(log: DataFrame, tool: str, duration: str) -> DataFrame:
    """Calls and mean duration of each tool."""
    return log.groupBy(tool).agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg(duration), 4).alias("mean"))


def distinct_counts(points: DataFrame, *columns: str) -> DataFrame:
    """One row: all points, and per column the distinct values and the missing ones."""
    out = [F.count(F.lit(1)).alias("points")]
    for c in columns:
        out += [F.countDistinct(c).alias(f"distinct_{c}"), F.count_if(F.col(c).isNull()).alias(f"no_{c}")]
    return points.agg(*out)


def newest(files: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The newest file of each page."""
    return first_by(files, [key], F.desc(time), F.asc(tie))


def missing(registry: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Registered rows that the store does not have."""
    return registry.join(store.select(key).distinct(), key, "left_anti")


def reconciled(ledger: DataFrame, graph: DataFrame, key: str) -> DataFrame:
    """Counts of a ledger (column ledger) and a graph (column graph) side by side, where they differ."""
    both = ledger.join(graph, key, "left").withColumn("graph", F.coalesce("graph", F.lit(0)))
    return both.where("ledger <> graph")


def cross_links(edges: DataFrame, shown: DataFrame, pages: DataFrame, url: str = "source_url") -> DataFrame:
    """Pages of edges' sources that are not shown yet."""
    wanted = edges.select(url).where(f"{url} IS NOT NULL AND {url} <> ''").distinct()
    return pages.join(wanted.join(shown.select(url).distinct(), url, "left_anti"), url, "left_semi")


#: Colours of node labels, and that of all others.
COLOURS = {
    "Game": "#3B82F6", "Team": "#10B981", "Person": "#F59E0B", "Event": "#EF4444", "Metric": "#8B5CF6",
    "Strategy": "#06B6D4", "Issue": "#F97316", "Insight": "#EC4899", "Decision": "#6B7280",
}
OTHER_COLOUR = "#94A3B8"


def colour(label: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])[label], F.lit(OTHER_COLOUR))


def edges_per_name(degrees: DataFrame) -> DataFrame:
    """Edges of each name over all its labels, with the labels."""
    return degrees.groupBy("name").agg(F.sum("degree").alias("edges"), F.array_sort(F.collect_set("label")).alias("labels"))


def totals(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: how many rows, and the sum of each column (0 where there is nothing)."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def searched(registry: DataFrame, title: str | None = None, **equal: str) -> DataFrame:
    """Rows with a keyword in the title, whatever its case, and with given values in columns."""
    found = registry
    for column, value in equal.items():
        found = found.where(F.col(column) == value)
    return found.where(F.col("title").ilike(f"%{title}%")) if title else found


def usable(registry: DataFrame, words: int = 30) -> DataFrame:
    """Pages that questions can be made from."""
    return registry.where((F.col("status") == "ok") & (F.col("word_count") >= words) & F.col("title").isNotNull())


def page_of(rows: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """A page of the rows in a total order; pages count from 1, and lower numbers are the first page."""
    return rows.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def flagged(registry: DataFrame, files: DataFrame, key: str, marker: str) -> DataFrame:
    """registry with has_html_attachment as the scanned files (key, text) tell it; pages that were not scanned keep theirs."""
    seen = files.groupBy(key).agg(F.max(F.contains("text", F.lit(marker))).alias("_html"))
    return registry.join(seen, key, "left").withColumn("has_html_attachment", F.coalesce("_html", "has_html_attachment")).drop("_html")


def with_others(first: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """first, and of others the rows whose key first does not have."""
    return first.unionByName(others.join(first.select(key).distinct(), key, "left_anti"))
