"""Stateful streams, keyed writes of batches, table functions and the page source."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from brindle.operators import events as batch
from brindle.operators import table_functions, tables
from brindle.sources import wiki
from brindle.streaming import events, keyed, scopes

START = datetime(2024, 1, 1)


def event(number, minutes, user):
    return (number, START + timedelta(minutes=minutes), user, "kind", 1.0, "{}")


def folder_of(spark, path, batches):
    """A folder with a file a batch, in the order of their names."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, events.EVENT).coalesce(1).write.parquet(f"{path}/made/{i}")
        [file] = (path / "made" / str(i)).glob("part-*.parquet")
        (path / "in").mkdir(exist_ok=True)
        file.rename(path / "in" / f"{i}.parquet")
    return str(path / "in")


def read(spark, path):
    rows = spark.readStream.schema(events.EVENT).option("maxFilesPerTrigger", 1).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", events.LATENESS)


BATCHES = [
    [event(1, 10, 7), event(2, 30, 7), event(3, 5, 8), event(4, 20, 7), event(40, 20, 7)],
    [event(5, 25, 7), event(2, 30, 7), event(6, 90, 8), event(7, 200, 7)],  # late but within the hour, a repeat, a jump
    [event(8, 15, 7), event(9, 210, 7), event(10, 95, 8), event(2, 30, 7), event(11, 220, None)],  # 8 and 10 come just in time
    [event(12, 600, 7), event(13, 600, 8), event(15, 100, 7)],  # 15 comes after the watermark has passed
    [event(14, 900, 9)],
]


def test_chain_of_a_stream_is_that_of_the_batch(spark, tmp_path):
    path = folder_of(spark, tmp_path, BATCHES)
    with events.with_store(spark, scopes.STORE):
        out = scopes.chained(read(spark, path))
        events.write(out, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.scope, r.event_id, r.next_id) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
    known = {e[0]: e for rows in BATCHES for e in rows if e[0] != 15 and e[2] is not None}
    whole = spark.createDataFrame(list(known.values()), events.EVENT).select("event_id", F.col("user_id").alias("scope"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("date_ts"))
    want = {(r.scope, r.event_id, r.next_id) for r in batch.chain(whole).collect()}
    assert got == want and (7, 4, 40) in got and len(got) == 11
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != scopes.STORE


class Kept:
    """State and timers of one scope; counts the calls."""

    def __init__(self):
        self.calls, self.rows, self.timers = 0, {}, []

    def getValueState(self, name, _):
        return State(self, name)

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class State:
    def __init__(self, kept, name):
        self.kept, self.name = kept, name

    def __getattr__(self, call):
        self.kept.calls += 1
        rows = self.kept.rows.setdefault(self.name, {"waiting": []}.get(self.name))
        change = lambda new: self.kept.rows.__setitem__(self.name, new)
        return {
            "get": lambda: iter(list(rows)) if self.name == "waiting" else rows, "exists": lambda: bool(rows), "update": change, "put": change,
            "appendValue": lambda row: rows.append(row), "clear": lambda: self.kept.rows.pop(self.name, None),
        }[call]


class Clock:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_chain_does_not_call_the_store_for_single_events():
    """1,000 events in two batches, some twice, of which the watermark passes 600: a few calls, and every link once."""
    kept, chain = Kept(), scopes.Chain()
    chain.init(kept)
    rows = pd.DataFrame({"event_id": range(1_000), "ts": [n * 1_000 for n in range(1_000)]}).sample(frac=1, random_state=1)
    assert list(chain.handleInputRows((7,), iter([rows[:300], rows[300:500]]), None)) == []
    later = rows[:100].assign(ts=rows["ts"] + 500)
    assert list(chain.handleInputRows((7,), iter([rows[500:], later]), None)) == []
    assert len(kept.timers) == 1
    kept.timers.clear()
    [first] = chain.handleExpiredTimer((7,), Clock(600), None)
    assert kept.timers == [600]
    kept.timers.clear()
    assert list(chain.handleInputRows((7,), iter([rows[rows["event_id"] < 600]]), None)) == []  # late
    [second] = chain.handleExpiredTimer((7,), Clock(5_000), None)
    found = pd.concat([first, second])
    assert len(first) == 599 and found["event_id"].tolist() == list(range(999)) and found["next_id"].tolist() == list(range(1, 1_000))
    assert found["ts"].tolist() == [n * 1_000 for n in range(999)] and set(found["scope"]) == {7}
    assert kept.calls < 30 and not kept.timers


def test_chain_goes_on_after_a_restart(spark, tmp_path):
    path = folder_of(spark, tmp_path, BATCHES[:2])
    with events.with_store(spark, scopes.STORE):
        for more in (BATCHES[2:4], BATCHES[4:]):
            out = scopes.chained(read(spark, path))
            events.write(out, str(tmp_path / "out"), str(tmp_path / "check"))
            for rows in more:
                name = f"later{rows[0][0]:04d}"
                spark.createDataFrame(rows, events.EVENT).coalesce(1).write.parquet(str(tmp_path / name))
                [file] = (tmp_path / name).glob("part-*.parquet")
                file.rename(tmp_path / "in" / f"{name}.parquet")
        events.write(scopes.chained(read(spark, path)), str(tmp_path / "out"), str(tmp_path / "check"))
    got = [(r.event_id, r.next_id) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("scope = 7").collect()]
    # the first run ends when the watermark has passed all but the last hour: 8 is late in the second
    assert sorted(got) == [(1, 4), (2, 7), (4, 40), (5, 2), (7, 9), (9, 12), (40, 5)]


def test_last_event_of_each_scope(spark, tmp_path):
    path = folder_of(spark, tmp_path, BATCHES)
    with events.with_store(spark, scopes.STORE):
        events.each_batch(scopes.last_events(read(spark, path)), keyed.writer(str(tmp_path / "out")), str(tmp_path / "check"), "update")
    got = {r.scope: (r.event_id, r.events) for r in keyed.current(spark, str(tmp_path / "out"), ["scope"], scopes.LAST).collect()}
    assert got == {7: (12, 9), 8: (13, 4), 9: (14, 1)}


def test_a_batch_that_comes_twice_counts_once(spark, tmp_path):
    listing = "page_id long, last_edited_time timestamp"
    registry = spark.createDataFrame([(1, START, "ok", "h"), (2, START, "ok", "h"), (3, START, "error", "h"), (4, START, "ok", None)], "page_id long, last_edited_time timestamp, status string, content_hash string")
    later = START + timedelta(days=1)
    first = spark.createDataFrame([(1, START), (2, START), (2, later), (3, START), (5, START)], listing)
    second = spark.createDataFrame([(1, later), (4, START)], listing)
    write = keyed.classified(registry, "page_id", str(tmp_path / "t"))
    for rows, number in ((first, 0), (second, 1), (first, 0), (second, 1)):
        write(rows, number)
    schema = f"{listing}, change string"
    got = sorted((r.page_id, r.change) for r in keyed.current(spark, str(tmp_path / "t"), ["page_id"], schema).collect())
    last = spark.createDataFrame([(1, later), (2, later), (3, START), (4, START), (5, START)], listing)
    assert got == sorted((r.page_id, r.change) for r in tables.classify_changes(last, registry, "page_id").collect())
    assert got == [(1, "modified"), (2, "modified"), (3, "modified"), (4, "modified"), (5, "new")]
    keyed.compacted(spark, str(tmp_path / "t"), str(tmp_path / "c"), ["page_id"], schema)
    assert sorted((r.page_id, r.change) for r in keyed.current(spark, str(tmp_path / "c"), ["page_id"], schema).collect()) == got


def test_table_functions_keep_partitions_apart(spark):
    table_functions.register(spark)
    hits = spark.createDataFrame([(1, "a", i, 1.0 - i / 100) for i in range(50)] + [(1, "b", 60, 0.9), (1, "c", 61, 0.1), (2, "é", 5, 0.5), (2, "a", 7, 0.5)], "question int, page string, chunk int, score double")
    rows = spark.sql("SELECT question, rank, page, to_json(result) AS result FROM search(TABLE({hits}), 2)", hits=hits.repartition(7)).collect()
    assert sorted((r.question, r["rank"], r.page) for r in rows) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "é")]
    assert json.loads(next(r.result for r in rows if r.page == "é")) == {"page": "é", "chunk": 5, "score": 0.5}
    ranked = spark.createDataFrame([(1, "x", "p", 1), (1, "y", "p", 3), (1, "x", "q", 2), (1, "y", "r", 1), (1, "x", "deep", 9), (2, "x", "p", 1)], "question int, list string, page string, rank int")
    rows = spark.sql("SELECT question, rank, page, variant_get(result, '$.lists', 'int') AS lists FROM hybrid(TABLE({ranked}), 2, 5)", ranked=ranked).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1, "p", 2), (1, 2, "r", 1), (2, 1, "p", 1)]
    with pytest.raises(Exception, match="no column page"):
        spark.sql("SELECT * FROM search(TABLE({hits}), 2)", hits=hits.drop("page")).collect()
    with pytest.raises(Exception, match="must be a table"):
        spark.sql("SELECT * FROM search(1, 2)").collect()


def test_page_source_reads_only_what_a_filter_leaves(spark, tmp_path):
    made = [(i, f"u{i}", f"<p>{i}\n</p>", START + timedelta(hours=i)) for i in range(40)] + [(90, None, None, None), (91, "u", "", None)]
    path = str(tmp_path / "wiki")
    wiki.land(spark.createDataFrame(made, wiki.SCHEMA).repartition(5), path, 4)
    assert sorted(tuple(r) for r in wiki.pages(spark, path).collect() if r.page_id < 90) == made[:40]
    assert {r.page_id: r.html for r in wiki.pages(spark, path).where("last_edited_time IS NULL").collect()} == {90: None, 91: ""}
    some = wiki.pages(spark, path).where(F.col("last_edited_time") > F.lit(START + timedelta(hours=30)))
    assert sorted(r.page_id for r in some.collect()) == list(range(31, 40))
    assert some.rdd.getNumPartitions() < wiki.pages(spark, path).rdd.getNumPartitions()
    none = wiki.pages(spark, path).where(F.col("last_edited_time") > F.lit(START + timedelta(days=900)))
    assert none.collect() == []


def test_page_reader_takes_what_it_can(spark, tmp_path):
    path = str(tmp_path / "wiki")
    wiki.land(spark.createDataFrame([(i, "u", "h", START + timedelta(hours=i)) for i in range(40)], wiki.SCHEMA), path, 4)
    reader = wiki.WikiReader(path)
    other = EqualTo(("page_id",), 3)
    assert list(reader.pushFilters([other, GreaterThan(("last_edited_time",), START + timedelta(hours=5)), LessThanOrEqual(("last_edited_time",), START + timedelta(hours=6))])) == [other]
    read = [n for p in reader.partitions() for b in reader.read(p) for n in b.column("page_id").to_pylist()]
    assert read == [6] and len(reader.partitions()) == 1
