"""What a model gets to read: near-copies removed, batches, summaries, and what of the evidence survives."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import answer_key, norm_key, trigram_set

from .ranking import RESPONSE_BUDGET, fit_budget, top_by

PREFIX = 600
RELATIONS, EVENTS, DOCUMENTS = 15, 20, 25


def without_near_copies(ranked: DataFrame, keys: list[str], text: str, threshold: float) -> DataFrame:
    """The ranked documents (column rank) of each key that are not alike one kept before them, by the trigrams of their first PREFIX
    characters. A key's documents pass in rank order; what is kept of it in memory are the trigrams of the kept ones."""
    if threshold >= 1:
        return ranked
    own = "_trigrams"
    while own in ranked.columns:
        own += "_"
    shaped = ranked.withColumn(own, trigram_set(F.substring(F.coalesce(F.col(text), F.lit("")), 1, PREFIX)))
    dealt = shaped.repartition(*keys).sortWithinPartitions(*keys, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sizes, holders = None, [], {}
        for batch in batches:
            stays = []
            for now, grams in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), batch.column(own).to_pylist(), strict=True):
                if now != key:
                    key, sizes, holders = now, [], {}
                shared = Counter(n for g in grams for n in holders.get(g, ()))
                stays.append(all(n / (sizes[i] + len(grams) - n) < threshold for i, n in shared.items()))
                if stays[-1]:
                    for g in grams:
                        holders.setdefault(g, []).append(len(sizes))
                    sizes.append(len(grams))
            yield batch.drop_columns([own]).filter(pa.array(stays, pa.bool_()))

    return dealt.mapInArrow(run, ranked.schema)


def batches(texts: Column, max_chars: int = 20_000, max_items: int = 50) -> Column:
    """Batch number of each text of an array, in order: a batch ends before it would pass either limit; a longer text is alone."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).alias("chars"), F.lit(0).alias("items"))

    def step(state: Column, item: Column) -> Column:
        size = F.length(item)
        full = (state["items"] > 0) & ((state["chars"] + size > max_chars) | (state["items"] >= max_items))
        batch = state["batch"] + full.cast("int")
        return F.struct(
            F.array_append(state["out"], batch).alias("out"), batch.alias("batch"),
            F.when(full, size).otherwise(state["chars"] + size).alias("chars"), F.when(full, 1).otherwise(state["items"] + 1).alias("items"),
        )

    return F.aggregate(texts, start, step, lambda s: s["out"])


def relation_lines(edges: DataFrame, keys: list[str], limit: int = RELATIONS) -> DataFrame:
    """The first relations of each key as lines of text."""
    line = F.concat(F.col("src"), F.lit(" -["), F.col("rel_name"), F.lit("]-> "), F.col("dst"))
    told = top_by(edges, keys, limit, F.asc("src"), F.asc("rel_name"), F.asc("dst")).withColumn("_l", F.struct("rank", line.alias("l")))
    return told.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["l"]), "\n").alias("relations"))


def event_lines(events: DataFrame, keys: list[str], limit: int = EVENTS) -> DataFrame:
    """The first events of each key as a timeline."""
    line = F.concat(F.coalesce(F.col("date"), F.lit("?")), F.lit(" ["), F.col("event_type"), F.lit("] "), F.coalesce(F.col("title"), F.lit("")))
    told = top_by(events, keys, limit, F.asc("date"), F.asc("event_id")).withColumn("_l", F.struct("rank", line.alias("l")))
    return told.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["l"]), "\n").alias("timeline"))


def assembled(docs: DataFrame, edges: DataFrame, events: DataFrame, keys: list[str], budget: int = RESPONSE_BUDGET, limit: int = DOCUMENTS) -> DataFrame:
    """Of each key what a model reads: its relations, its timeline and its ranked documents (rank, title, text) to the budget."""
    block = F.concat(F.lit("["), F.coalesce(F.col("title"), F.lit("")), F.lit("]\n"), F.coalesce(F.col("text"), F.lit("")))
    kept = fit_budget(docs.where(F.col("rank") <= limit), keys, F.length(F.coalesce("text", F.lit(""))) + F.length(F.coalesce("title", F.lit(""))), budget)
    told = kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("documents"))
    parts = told.join(relation_lines(edges, keys), keys, "full").join(event_lines(events, keys), keys, "full")
    headed = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"## {c}\n"), F.col(c))) for c in ("relations", "timeline", "documents")]
    return parts.select(*keys, F.concat_ws("\n\n", *headed).alias("context"))


def evidence(ranked: DataFrame, questions: DataFrame, cap: int | None = None, budget: int = RESPONSE_BUDGET, limit: int = DOCUMENTS) -> DataFrame:
    """Per question (id, source_url, answer) and its ranked documents (id, rank, url, title, text): place of the evidence page,
    whether it is in the context, and whether the answer's key is still in what was kept of it."""
    text = F.col("text") if cap is None else F.substring("text", 1, cap)
    cut = ranked.where(F.col("rank") <= limit).withColumn("text", text)
    kept = fit_budget(cut, ["id"], F.length("text") + F.length(F.coalesce("title", F.lit(""))), budget)
    asked = questions.select("id", "source_url", answer_key(F.coalesce("answer", F.lit(""))).alias("_key"))
    found = asked.join(kept.select("id", "url", "text"), "id", "left").groupBy("id", "source_url", "_key").agg(
        F.count("url").alias("used"), F.coalesce(F.bool_or(F.col("url") == F.col("source_url")), F.lit(False)).alias("included"),
        F.coalesce(F.bool_or((F.col("_key") != "") & F.contains(F.regexp_replace(F.lower("text"), r"\s+", ""), F.col("_key"))), F.lit(False)).alias("answered"),
    )
    place = ranked.select("id", F.col("url").alias("source_url"), "rank").groupBy("id", "source_url").agg(F.min("rank").alias("place"))
    return found.join(place, ["id", "source_url"], "left").drop("_key")


def miss_verdict(grounded: Column, retrieved: Column, delivered: Column) -> Column:
    """Where a question was lost: in the source, in retrieval, or on the way into the context."""
    return F.when(~grounded, "not in the source").when(~retrieved, "not retrieved").when(~delivered, "cut from the context").otherwise("generation")


def generation_verdict(closed: Column, given: Column, full: Column, passing: float = 0.7) -> Column:
    """Why an answer fails, from scores without context, with the evidence, and with the whole context."""
    return F.when(full >= passing, "passed").when(given >= passing, "distracted by the context").when(closed >= passing, "misled by the evidence").otherwise("cannot answer")


def query_route(question: Column, numeric: tuple[str, ...], relational: tuple[str, ...]) -> Column:
    """KPI, ONTOLOGY or BOTH by the words of a question; without either, ONTOLOGY."""
    low = norm_key(question)
    any_of = lambda ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(low, w))
    a, b = any_of(numeric), any_of(relational)
    return F.when(a & b, "BOTH").when(a, "KPI").otherwise("ONTOLOGY")


