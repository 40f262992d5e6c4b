"""Evaluation of retrieval and of extraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import dealt

from .ranking import top_by

PASS = 0.7
#: Fixed value: in front of the key of a question without a source.
ALONE = "__no_source__"


def summary(scores: DataFrame, *groups: str) -> DataFrame:
    """Scored and failed rows, average and passes; rows with a null score are failures of the harness and not averaged."""
    found = scores.groupBy(*groups) if groups else scores.groupBy()
    return found.agg(
        F.count(F.lit(1)).alias("total"), F.count("score").alias("scored"), F.count_if(F.col("score").isNull()).alias("failed"),
        F.count_if(F.col("score") >= PASS).alias("passed"), F.round(F.avg("score"), 4).alias("average"),
    )


def recall(results: DataFrame, truth: DataFrame, query_id: str, item: str) -> DataFrame:
    """Per configuration (column config) the share of truth found, and the mean number of results."""
    wanted = truth.select(query_id, item).distinct()
    hits = results.join(wanted.withColumn("_hit", F.lit(1)), [query_id, item], "left")
    size = wanted.agg(F.count(F.lit(1))).scalar()
    return hits.groupBy("config").agg(F.round(F.coalesce(F.sum("_hit"), F.lit(0)) / size, 6).alias("recall"), F.round(F.count(F.lit(1)) / F.countDistinct(query_id), 6).alias("used"))


def compared(results: DataFrame, base: str, query_id: str, item: str) -> DataFrame:
    """Per configuration the results gained and lost against a base configuration."""
    own = results.select("config", query_id, item).distinct()
    kept = own.where(F.col("config") == base).select(query_id, item, F.lit(1).alias("_base"))
    others = own.where(F.col("config") != base)
    gained = others.join(kept, [query_id, item], "left_anti").groupBy("config").agg(F.count(F.lit(1)).alias("gained"))
    size = kept.agg(F.count(F.lit(1))).scalar()
    shared = others.join(kept, [query_id, item], "left_semi").groupBy("config").agg((size - F.count(F.lit(1))).alias("lost"))
    return shared.join(gained, "config", "full").select("config", F.coalesce("gained", F.lit(0)).alias("gained"), F.coalesce("lost", size).alias("lost"))


def stability(first: DataFrame, second: DataFrame, source: str) -> DataFrame:
    """Per source the overlap of the triples (s, p, o) of two runs, and those that changed their predicate only. A triple with a null
    equals none of the other run.

    Both runs are dealt out once, by what a changed triple keeps; repeats and equal triples then meet without another shuffle.
    """
    keys = [source, "s", "p", "o"]
    unknown = F.greatest(*[F.col(k).isNull() for k in keys])
    run = lambda df, n: df.select(*keys, F.lit(n).alias("_run"), F.when(unknown, n).alias("_alone"))
    told = dealt(run(first, 1).unionByName(run(second, 2)), source, "s", "o")
    told = told.groupBy(*keys, "_alone").agg(F.min("_run").alias("_low"), F.max("_run").alias("_high"))
    both = told.groupBy(source, "s", "o").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_low") < F.col("_high")).alias("same"),
        F.count_if(F.col("_high") == 1).alias("gone"), F.count_if(F.col("_low") == 2).alias("fresh"),
    )
    return both.groupBy(source).agg(F.round(F.sum("same") / F.sum("n"), 6).alias("jaccard"), F.sum(F.least("gone", "fresh")).alias("renamed"))


def split(questions: DataFrame, source: str, category: str, key: str, ratio: float = 0.5) -> DataFrame:
    """Sources dealt to dev and holdout so that no source is on both sides: source, key, n and side of each group.

    A question without a source is a group of its own, told by its key (null for the others). Groups go largest first (ties by the
    SHA-256 of their name) to the side that leaves the smaller skew, which counts the totals and every category; then to the smaller side;
    then to dev. Questions are summed by Spark; the fold that follows sees a row a group in order and keeps a count a category.
    """
    blank = F.coalesce(F.col(source).cast("string"), F.lit("")) == ""
    own = F.when(blank, F.concat(F.lit(ALONE), F.col(key).cast("string")))
    named = questions.select(F.when(~blank, F.col(source)).alias(source), F.when(blank, F.col(key)).alias(key), F.coalesce(own, F.col(source).cast("string")).alias("_name"), F.coalesce(F.col(category).cast("string"), F.lit("?")).alias("_c"))
    counts = named.groupBy("_name", source, key, "_c").agg(F.count(F.lit(1)).alias("_n"))
    groups = counts.groupBy("_name", source, key).agg(F.sum("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_c", "_n"))).alias("_counts"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[dict, dict] = ({}, {})
        totals = [0, 0]

        def skew(more: dict, to: int) -> float:
            dev, hold = ({**side, **{c: side.get(c, 0) + n for c, n in more.items()}} if i == to else side for i, side in enumerate(sides))
            return sum(abs(dev.get(c, 0) * (1 - ratio) - hold.get(c, 0) * ratio) for c in sorted(dev.keys() | hold.keys()))

        for batch in batches:
            dealt = []
            for row in batch.to_pylist():
                more = {"": row["n"]} | {f"={c['_c']}": c["_n"] for c in row["_counts"]}
                to = 0 if (skew(more, 0), totals[0]) <= (skew(more, 1), totals[1]) else 1
                for c, n in more.items():
                    sides[to][c] = sides[to].get(c, 0) + n
                totals[to] += row["n"]
                dealt.append("dev" if to == 0 else "holdout")
            yield pa.RecordBatch.from_arrays([batch.column(source), batch.column(key), batch.column("n"), pa.array(dealt, pa.string())], [source, key, "n", "side"])

    kinds = dict(questions.dtypes)
    ordered = groups.repartition(1).sortWithinPartitions(F.desc("n"), F.sha2("_name", 256))
    return ordered.mapInArrow(deal, f"`{source}` {kinds[source]}, `{key}` {kinds[key]}, n long, side string")


def stratified(rows: DataFrame, strata: list[str], key: str, targets: int) -> DataFrame:
    """At most targets rows of each stratum, in the order of a hash of their key."""
    return top_by(rows, strata, targets, F.asc(F.sha2(F.col(key).cast("string"), 256)), F.asc(key))


def scaled_targets(weights: dict[str, int], total: int) -> dict[str, int]:
    """Targets in proportion to weights that sum to total: largest remainders first, ties in the given order."""
    whole = sum(weights.values())
    exact = {k: w * total / whole for k, w in weights.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(weights, key=lambda k: out[k] - exact[k])[: total - sum(out.values())]:
        out[k] += 1
    return out


def sampled(rows: DataFrame, strata: list[str], key: str, size: int, per_group: int = 5) -> DataFrame:
    """A sample of fixtures: of each stratum the size rows with the smallest hash of their key, in groups of per_group along that order.

    The hashes' order is the same for any part of the rows, so that samples of parts merge: Spark keeps the first size of each task
    before it shuffles. Adds rank and group.
    """
    return stratified(rows, strata, key, size).withColumn("group", F.expr(f"(rank - 1) div {per_group}"))


def target_ranks(hits: DataFrame, targets: DataFrame, query_id: str, page: str, window: int, limit: int) -> DataFrame:
    """Where each query's target page stands among the hits (query_id, page, rank, score): chunk_rank in all of them; page_rank among the
    pages of the first window hits, by their best score; pages in the window; and whether it is within limit. Null ranks: not there."""
    first = hits.where(F.col("rank") <= window).groupBy(query_id, page).agg(F.max("score").alias("_best"), F.min("rank").alias("_first"))
    placed = top_by(first, [query_id], window, F.desc("_best"), F.asc("_first")).withColumnRenamed("rank", "page_rank")
    pages = first.groupBy(query_id).agg(F.count(F.lit(1)).alias("pages"))
    chunk = hits.join(targets, [query_id, page]).groupBy(query_id).agg(F.min("rank").alias("chunk_rank"))
    found = targets.join(placed.select(query_id, page, "page_rank"), [query_id, page], "left").join(chunk, query_id, "left").join(pages, query_id, "left")
    return found.select(query_id, page, "chunk_rank", "page_rank", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce(F.col("page_rank") <= limit, F.lit(False)).alias("passes"))
