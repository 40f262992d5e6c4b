"""Event files, question sets, glossaries, blocks and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_FIELDS = ("game", "event_type", "date", "title", "description", "target", "manager", "source_url")
EVENT = ", ".join(f"{f} STRING" for f in EVENT_FIELDS)
QUESTION = "id STRING, category STRING, difficulty STRING, question STRING, answer STRING, source_url STRING, source_title STRING, grounded BOOLEAN, baseline_pass BOOLEAN"
TERM = "term STRING, synonyms ARRAY<STRING>, category STRING"


def read_event_csv(spark: SparkSession, path: str) -> DataFrame:
    """Events of CSV files with a header, which may begin with a byte order mark."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    named = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    return named.select(*[(F.col(f) if f in named.columns else F.lit(None).cast("string")).alias(f) for f in EVENT_FIELDS])


def _wrapped(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Objects of JSON files that hold an array, or an object with the array in a field."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    inner = F.from_json("value", f"{field} ARRAY<STRUCT<{schema}>>")
    rows = F.when(F.trim("value").startswith("["), F.from_json("value", f"ARRAY<STRUCT<{schema}>>")).otherwise(inner[field])
    return text.select(F.explode(rows).alias("r")).select("r.*")


def read_event_json(spark: SparkSession, path: str) -> DataFrame:
    return _wrapped(spark, path, "events", EVENT)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions; a path that does not exist is an error."""
    return _wrapped(spark, path, "questions", QUESTION)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    return _wrapped(spark, path, "terms", TERM)


def first_glossary(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of the places that can be read and holds a term: the live export first, then its snapshots."""
    problems = []
    for path in paths:
        try:
            terms = read_glossary(spark, path)
            if not terms.isEmpty():
                return terms
            problems.append(f"{path}: empty")
        except Exception as problem:  # a place that fails in any way is passed over
            problems.append(f"{path}: {type(problem).__name__}")
    raise ValueError("no glossary: " + "; ".join(problems))


def glossary_snapshot(terms: DataFrame, path: str) -> None:
    """Write a glossary's three fields; an empty one is refused."""
    if terms.isEmpty():
        raise ValueError("an empty glossary does not replace a snapshot")
    terms.select("term", "synonyms", "category").write.mode("overwrite").json(path)


def block_lines(blocks: DataFrame, max_depth: int = 4) -> DataFrame:
    """Documents from their blocks (page_id, block_id, parent_id, pos, type, text, checked, language), in document order.

    Descends level by level, at most max_depth deep, carrying each block's path of positions; then one ordered aggregate a page.
    """
    from brindle.functions.text import block_markdown

    level = blocks.where("parent_id IS NULL").withColumn("path", F.array("pos")).withColumn("depth", F.lit(0))
    out = level
    for depth in range(1, max_depth):
        up = level.select("page_id", F.col("block_id").alias("parent_id"), F.col("path").alias("_up"))
        level = blocks.join(up, ["page_id", "parent_id"]).withColumn("path", F.array_append("_up", F.col("pos"))).withColumn("depth", F.lit(depth)).drop("_up")
        out = out.unionByName(level)
    line = block_markdown(F.col("type"), F.col("text"), F.col("depth"), F.col("checked"), F.col("language"))
    ordered = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
    return out.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("body"))


def append(rows: DataFrame, path: str) -> None:
    """Append to a log table."""
    rows.write.mode("append").parquet(path)


def replace_table(new: DataFrame, path: str) -> str:
    """Write the new state of a table beside the old one and return its path: readers switch to it when it is whole."""
    import uuid

    target = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    new.write.parquet(target)
    return target


def graph_export(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, and the counts of labels and relations."""
    return nodes, edges, nodes.groupBy("label").count(), edges.groupBy("rel_name").count()
