"""Raw pages of a landed folder as a data source, with the edit time pushed into the reader.

A landed folder holds the pages as JSON lines in ranges of their edit time, the way a wiki's cursor hands them out, and an index of the
ranges. The reader has one partition a range, and passes over the ranges that a pushed filter rules out.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

EDITED = "last_edited_time"
SCHEMA = f"page_id LONG, url STRING, html STRING, {EDITED} TIMESTAMP"
KINDS = (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


def land(pages: DataFrame, path: str, ranges: int = 16) -> None:
    """Write pages (page_id, url, html, last_edited_time) below path; a page without an edit time lies in a range of its own."""
    rows = pages.select("page_id", "url", "html", F.unix_micros(EDITED).alias("micros"))
    dealt = rows.repartitionByRange(ranges, F.asc_nulls_first("micros"))
    placed = dealt.withColumn("range", F.when(F.col("micros").isNull(), -1).otherwise(F.spark_partition_id()))
    placed.write.partitionBy("range").option("ignoreNullFields", "false").json(f"{path}/pages")
    spark = pages.sparkSession
    kept = spark.read.schema("micros LONG, range INT").json(f"{path}/pages")
    index = kept.groupBy("range").agg(F.min("micros").alias("first"), F.max("micros").alias("last"), F.count(F.lit(1)).alias("pages"))
    index.coalesce(1).write.json(f"{path}/index")  # a row a range


@dataclass
class Range(InputPartition):
    number: int


class WikiReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.bounds = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of the edit time with a constant; the others go back to Spark."""
        for one in filters:
            if isinstance(one, KINDS) and one.attribute == (EDITED,) and isinstance(one.value, datetime):
                at = one.value if one.value.tzinfo else one.value.replace(tzinfo=UTC)
                past = at - datetime(1970, 1, 1, tzinfo=UTC)
                self.bounds.append((type(one), (past.days * 86_400 + past.seconds) * 1_000_000 + past.microseconds))
            else:
                yield one

    def _store(self) -> tuple[fs.FileSystem, str]:
        """The file system of the landed folder, as driver and executors reach it."""
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _files(self, store: fs.FileSystem, folder: str) -> list[str]:
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and f.size and not posixpath.basename(f.path).startswith(("_", ".")))

    def _may_hold(self, first: int | None, last: int | None) -> bool:
        if first is None:
            return not self.bounds  # no comparison holds for a page without an edit time
        tests = {GreaterThan: lambda at: last > at, GreaterThanOrEqual: lambda at: last >= at, LessThan: lambda at: first < at, LessThanOrEqual: lambda at: first <= at}
        return all(tests[kind](at) for kind, at in self.bounds)

    def partitions(self) -> list[Range]:
        store, folder = self._store()
        lines = [line for f in self._files(store, f"{folder}/index") for line in store.open_input_stream(f).read().decode().splitlines()]
        rows = sorted((json.loads(line) for line in lines), key=lambda r: r["range"])
        return [Range(r["range"]) for r in rows if self._may_hold(r.get("first"), r.get("last"))]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in for no partition at all
            return
        store, folder = self._store()
        kept = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("micros", pa.int64())])
        for file in self._files(store, f"{folder}/pages/range={partition.number}"):
            with store.open_input_stream(file) as stream:
                rows = pa.json.read_json(stream, parse_options=pa.json.ParseOptions(explicit_schema=kept), read_options=pa.json.ReadOptions(block_size=64 << 20))
            for kind, at in self.bounds:
                name = {GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal"}[kind]
                rows = rows.filter(pc.call_function(name, [rows.column("micros"), pa.scalar(at)]))
            micros = rows.column("micros")
            rows = rows.drop_columns(["micros"]).append_column(EDITED, micros.cast(pa.timestamp("us", "UTC")))
            yield from rows.to_batches(max_chunksize=1_000)


class WikiPages(DataSource):
    """spark.read.format("wiki_pages").option("path", ...): the pages of a landed folder."""

    @classmethod
    def name(cls) -> str:
        return "wiki_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WikiReader:
        return WikiReader(self.options["path"])


def pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of a landed folder. Load them anew for each query: Spark 4.1 keeps the filters it has pushed with the loaded DataFrame, and
    another query over the same one would read what the first asked for."""
    register(spark)
    return spark.read.format("wiki_pages").option("path", path).load()


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark push filters into Python sources."""
    spark.dataSource.register(WikiPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
