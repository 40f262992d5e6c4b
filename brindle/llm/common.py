"""Helpers shared by the training-data operators: table reads, the shared scratch folder, words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import scratch

#: A word is a run of anything but ASCII space, tab, LF, VT, FF and CR.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate: lower-cases A-Z and nothing else.
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def words(text: str | None) -> list[str]:
    """The words of a text, as WORD finds them, but faster."""
    if not text:
        return []
    for space in "\t\n\x0b\x0c\r":
        if space in text:
            text = text.replace(space, " ")
    return list(filter(None, text.split(" ")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_column(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)
