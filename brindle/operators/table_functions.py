"""The search tools as table functions over a table argument: SELECT * FROM hybrid(TABLE(t) PARTITION BY question, 10).

A function sees one partition at a time, in the order of the query. It keeps what its limit allows, so that partitions may be of any
size; each row carries its result as a VARIANT beside the columns that queries sort and join by.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException, udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType, VariantType, VariantVal


def _needed(table: AnalyzeArgument, *names: str) -> dict:
    """Types of the table argument's columns; an error that names the missing ones."""
    if not table.isTable:
        raise ValueError("the first argument must be a table: TABLE(name) PARTITION BY ...")
    kinds = {f.name: f.dataType for f in table.dataType.fields}
    missing = [n for n in names if n not in kinds]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return kinds


def _variant(**values: object) -> VariantVal:
    return VariantVal.parseJson(json.dumps(values, ensure_ascii=False))


@udtf
class Search:
    """Hits (question, page, chunk, score), best first: the first pages of a question, by their best chunk."""

    def __init__(self) -> None:
        self.pages: dict = {}

    @staticmethod
    def analyze(hits: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        kinds = _needed(hits, "question", "page", "chunk", "score")
        schema = StructType().add("question", kinds["question"]).add("rank", IntegerType()).add("page", kinds["page"]).add("score", DoubleType()).add("result", VariantType())
        order = [OrderingColumn("score", ascending=False), OrderingColumn("page"), OrderingColumn("chunk")]
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("question")], orderBy=order)

    def eval(self, hit: Row, limit: int) -> Iterator[tuple]:
        if hit["page"] in self.pages:
            return
        if len(self.pages) >= limit:
            raise SkipRestOfInputTableException
        rank = self.pages[hit["page"]] = len(self.pages) + 1
        yield hit["question"], rank, hit["page"], float(hit["score"]), _variant(page=hit["page"], chunk=hit["chunk"], score=float(hit["score"]))


@udtf
class Hybrid:
    """Ranked lists (question, list, page, rank) fused by reciprocal ranks: the first pages of a question."""

    def __init__(self) -> None:
        self.found: dict = {}

    @staticmethod
    def analyze(ranked: AnalyzeArgument, limit: AnalyzeArgument, depth: AnalyzeArgument) -> AnalyzeResult:
        kinds = _needed(ranked, "question", "list", "page", "rank")
        schema = StructType().add("question", kinds["question"]).add("rank", IntegerType()).add("page", kinds["page"]).add("score", DoubleType()).add("result", VariantType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("question")], orderBy=[OrderingColumn("rank"), OrderingColumn("list"), OrderingColumn("page")])

    def eval(self, row: Row, limit: int, depth: int) -> None:
        if row["rank"] > depth:  # rows come by rank
            raise SkipRestOfInputTableException
        self.limit, self.question = limit, row["question"]
        self.found.setdefault(row["page"], {})[row["list"]] = row["rank"]

    def terminate(self) -> Iterator[tuple]:
        if not self.found:
            return
        scored = sorted(((-round(sum(1 / (60 + r) for r in ranks.values()), 12), page) for page, ranks in self.found.items()))[: self.limit]
        for n, (score, page) in enumerate(scored):
            yield self.question, n + 1, page, -score, _variant(page=page, ranks=self.found[page], lists=len(self.found[page]))


@udtf
class Timeline:
    """Events (scope, event_id, event_type, date_ts) of a kind from a time on, oldest first: the first of each scope, with the days since
    the one before."""

    def __init__(self) -> None:
        self.told, self.before = 0, None

    @staticmethod
    def analyze(events: AnalyzeArgument, kind: AnalyzeArgument, since: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        kinds = _needed(events, "scope", "event_id", "event_type", "date_ts")
        schema = StructType().add("scope", kinds["scope"]).add("rank", IntegerType()).add("event_id", kinds["event_id"]).add("date_ts", LongType()).add("event_type", StringType()).add("result", VariantType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("scope")], orderBy=[OrderingColumn("date_ts"), OrderingColumn("event_id")])

    def eval(self, event: Row, kind: str | None, since: int, limit: int) -> Iterator[tuple]:
        if event["date_ts"] < since or (kind is not None and event["event_type"] != kind):
            return
        if self.told >= limit:
            raise SkipRestOfInputTableException
        self.told += 1
        days = None if self.before is None else (event["date_ts"] - self.before) // 86_400
        self.before = event["date_ts"]
        yield event["scope"], self.told, event["event_id"], event["date_ts"], event["event_type"], _variant(event=event["event_id"], days=days)


def register(spark: SparkSession) -> None:
    """search, hybrid and timeline_of for the session's SQL."""
    for name, function in (("search", Search), ("hybrid", Hybrid), ("timeline_of", Timeline)):
        spark.udtf.register(name, function)
