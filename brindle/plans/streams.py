"""Queries over the event stream (additions of our own): run until all input is processed, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.session import scratch
from brindle.streaming import events, keyed, scopes

from . import reports
from .base import ORACLE_SQL, query, table


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    events.write(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


# the glob makes a single file a source of a stream
_PATH = "{}/events.parque[t]"


_MARK = "e AS (SELECT DISTINCT ON (event_id) * FROM events ORDER BY event_id, ts), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)"


@query(f"""WITH {_MARK}, w AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM e GROUP BY ALL)
SELECT start, start + INTERVAL 1 DAY AS "end", event_type, events, total FROM w, m WHERE start + INTERVAL 1 DAY <= mark""")
def stream_dedupe_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts that the watermark has closed."""
    return _run(spark, events.windows(events.read(spark, _PATH.format(sf_dir))), "windows")


@query(f"""WITH {_MARK}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS start, max(ts)::TIMESTAMP + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s, m GROUP BY user_id, n, mark HAVING max(ts) + INTERVAL 30 MINUTE <= mark""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    return _run(spark, events.sessions(events.read(spark, _PATH.format(sf_dir))), "sessions")


_SCOPED = "SELECT event_id, user_id AS scope, ts FROM e WHERE user_id IS NOT NULL AND epoch(ts) >= 1"


@query(f"""WITH {_MARK}, s AS ({_SCOPED}),
c AS (SELECT scope, event_id, ts, lead(event_id) OVER w AS next_id, lead(ts) OVER w AS next_ts FROM s WINDOW w AS (PARTITION BY scope ORDER BY ts, event_id))
SELECT scope, event_id, next_id, round((floor(epoch(next_ts)) - floor(epoch(ts))) / 86400)::BIGINT AS days_diff FROM c, m WHERE next_ts < mark""")
def stream_event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each user's events that the watermark has passed."""
    with events.with_store(spark, scopes.STORE):
        return _run(spark, scopes.chained(events.read(spark, _PATH.format(sf_dir))), "chain")


@query(f"""WITH {_MARK}, s AS ({_SCOPED})
SELECT DISTINCT ON (scope) scope, event_id, epoch_us(ts) AS ts, count(*) OVER (PARTITION BY scope) AS events FROM s ORDER BY scope, s.ts DESC, event_id DESC""")
def stream_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and the number of events, kept in a keyed table."""
    path = scratch(spark, "last")
    with events.with_store(spark, scopes.STORE):
        events.each_batch(scopes.last_events(events.read(spark, _PATH.format(sf_dir))), keyed.writer(f"{path}/out"), f"{path}/checkpoint", "update")
    return keyed.current(spark, f"{path}/out", ["scope"], scopes.LAST)


@query(ORACLE_SQL["change_classification"])
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of a stream of listed pages, each against the registry."""
    path = scratch(spark, "changes")
    docs = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")
    old, _ = reports.old_and_new(spark, sf_dir)
    events.each_batch(reports.listing(reports.registry_of(docs)), keyed.classified(old, "page_id", f"{path}/out"), f"{path}/checkpoint")
    return keyed.current(spark, f"{path}/out", ["page_id"], "page_id LONG, last_edited_time TIMESTAMP_NTZ, change STRING").select("page_id", "change")
