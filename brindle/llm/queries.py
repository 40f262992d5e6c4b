"""The registered queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import table


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_reputation import judge

    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_index import archive_and_index

    return archive_and_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_fst import encode

    return encode(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), "embedding")
    return mine(rows.where("vec_id % 50 = 0"), rows, positives=5, negatives=3, least=(1, 2), most=(19, 20), scale=256)


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_search import search

    rows = table(spark, sf_dir, "embeddings")
    return search(rows.where("vec_id % 20 = 0"), rows, k=20, scale=64)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"), min_docs=30, scale=1_000_000_000, prior=5, top=50)


_ALL = (
    op1_sentencepiece, op2_quality_rules, op3_decontamination, op4_url_reputation, op5_toxicity, op6_substring_dedup, op7_html_extraction,
    op8_simhash, op9_warc, op10_secret_scan, op11_hard_negatives, op12_topk_search, op13_source_divergence,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": oracles.op2(),
    "op4_url_reputation": oracles.op4(),
    "op6_substring_dedup": oracles.op6(),
    "op9_warc": oracles.op9(),
    "op11_hard_negatives": oracles.op11(),
    "op12_topk_search": oracles.op12(),
    "op13_source_divergence": oracles.op13(),
}
