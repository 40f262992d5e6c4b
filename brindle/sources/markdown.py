"""Markdown pages with front matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRONT = r"(?s)\A(?:\x{FEFF})?---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def read_pages(spark: SparkSession, path: str, glob: str = "*.md", excluded: tuple[str, ...] = ()) -> DataFrame:
    """A row for each file: page_id, title, source_url, last_edited_time, db_properties, body and file.

    The front matter ends at a line of its own; its lines are split at the first colon; properties that are no JSON are left
    out; a page without a title or an id is named by its file.
    """
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
    named = files.select("value", F.col("_metadata.file_name").alias("file"))
    if excluded:
        named = named.where(~F.col("file").isin(*excluded))
    return parse(named)


def parse(files: DataFrame) -> DataFrame:
    """files: value (the text) and file (its name)."""
    head = F.regexp_extract("value", FRONT, 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda line: line.rlike("^[^:]+:"))
    pair = lambda line: F.struct(F.trim(F.regexp_extract(line, "^([^:]+):(.*)$", 1)).alias("k"), F.trim(F.regexp_extract(line, "^([^:]+):(.*)$", 2)).alias("v"))
    pairs = F.transform(lines, pair)
    get = lambda name: F.nullif(F.get(F.filter(F.col("_pairs"), lambda p: p["k"] == name), F.lit(0))["v"], F.lit(""))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    rows = files.withColumn("_pairs", pairs)
    return rows.select(
        F.coalesce(F.replace(get("page_id"), F.lit("-"), F.lit("")), stem).alias("page_id"),
        F.coalesce(get("title"), stem).alias("title"),
        get("notion_url").alias("source_url"),
        F.try_to_timestamp(get("last_edited_time")).alias("last_edited_time"),
        F.from_json(get("db_properties"), "map<string,string>", {"mode": "PERMISSIVE"}).alias("db_properties"),
        F.regexp_replace("value", FRONT, "").alias("body"),
        "file",
    )


def latest_files(pages: DataFrame) -> DataFrame:
    """Of the files of one page the last edited."""
    from brindle.operators.ranking import first_by

    return first_by(pages, ["page_id"], F.desc_nulls_last("last_edited_time"), F.asc("file"))


def savable(pages: DataFrame, min_words: int = 30) -> DataFrame:
    """Pages (body, db_properties) worth saving, with word_count. A page with properties whose body is short has them put in front of it as
    lines, and needs one word only."""
    from brindle.functions.text import word_count

    has = F.coalesce(F.size("db_properties") > 0, F.lit(False))
    body = F.coalesce("body", F.lit(""))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("db_properties")), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")
    longer = F.trim(F.concat(lines, F.when(F.trim(body) != "", F.concat(F.lit("\n\n"), body)).otherwise("")))
    made = pages.withColumn("body", F.when(has & (word_count(body) < min_words), longer).otherwise(body)).withColumn("word_count", word_count(F.col("body")))
    return made.where(F.col("word_count") >= F.when(has, 1).otherwise(min_words))


def stale_files(files: DataFrame, saved: DataFrame) -> DataFrame:
    """Files (page_id, file) of pages that are now saved under another name."""
    now = saved.select("page_id", F.col("file").alias("_now")).distinct()
    return files.join(now, "page_id").groupBy("page_id", "file").agg(F.bool_or(F.col("file") == F.col("_now")).alias("_same")).where("NOT _same").drop("_same")


def page_text(pages: DataFrame) -> DataFrame:
    """Pages as files again: file and value, with front matter."""
    line = lambda name, col: F.concat(F.lit(f"{name}: "), F.coalesce(col, F.lit("")))
    head = F.concat_ws(
        "\n",
        F.lit("---"),
        line("title", F.col("title")),
        line("notion_url", F.col("source_url")),
        line("page_id", F.col("page_id")),
        line("last_edited_time", F.col("last_edited_time").cast("string")),
        F.when(F.col("db_properties").isNotNull(), line("db_properties", F.to_json("db_properties"))),
        F.lit("---"),
    )
    return pages.select("file", F.concat(head, F.lit("\n"), F.col("body")).alias("value"))
