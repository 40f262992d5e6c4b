"""Ranked lists: top-k, fusion, coverage, budgets. Every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.structured import coverage_score, rrf_term

RESPONSE_BUDGET, LINKED_PAGES, BLOCK_EXTRA = 60_000, 10, 20


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order (not dropDuplicates, which takes any)."""
    return top_by(df, keys, 1, *order).drop("rank")


def top_by(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key, with their rank."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k)


def fuse(ranked: DataFrame, keys: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists in one table with a rank column: the fused score of each key."""
    return ranked.groupBy(*keys).agg(F.sum(rrf_term(F.col("rank"), k)).alias("score"))


def merge_by_coverage(hits: DataFrame, keys: list[str], item: str, boost: float = 0.20) -> DataFrame:
    """Hits of several sub-queries: an item's best score, raised by the number of sub-queries that found it."""
    merged = hits.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("coverage"), F.max("score").alias("best"))
    return merged.withColumn("score", coverage_score(F.col("best"), F.col("coverage"), boost))


def fit_budget(docs: DataFrame, keys: list[str], size: Column, budget: int = RESPONSE_BUDGET) -> DataFrame:
    """The ranked documents (column rank) of each key that fit: the first always, then up to the first overflow."""
    window = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = docs.withColumn("filled", F.sum(size + BLOCK_EXTRA).over(window).cast("long"))
    return filled.where((F.col("filled") <= budget) | (F.col("rank") == 1))


def add_linked(kept: DataFrame, linked: DataFrame, keys: list[str], size: Column, budget: int = RESPONSE_BUDGET, limit: int = LINKED_PAGES) -> DataFrame:
    """Linked documents (rank from 1) that go on from what the kept ones fill, at most limit of each key."""
    used = kept.groupBy(*keys).agg(F.max("filled").alias("used"))
    window = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = linked.where(F.col("rank") <= limit).withColumn("own", F.sum(size + BLOCK_EXTRA).over(window))
    return filled.join(used, keys, "left").where(F.coalesce("used", F.lit(0)) + F.col("own") <= budget).drop("own", "used")
