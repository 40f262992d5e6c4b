"""The corpus pipeline: five stages over documents, each calling one training-data operator.

STAGES lists (name, function) in order. A function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's result as Parquet to the shared folder and reads it back as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import stage, table
from brindle.llm.decontam import clean
from brindle.llm.secret_scan import redact
from brindle.llm.sentencepiece_fst import encode
from brindle.llm.simhash_dedup import firsts, mark
from brindle.llm.toxicity import score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 and over go."""
    network = train(docs, table(spark, sf_dir, "labels"))
    own = "_toxicity"
    while own in docs.columns:
        own += "_"
    return score(docs, network, into=own).where(F.col(own) < 0.5).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: of the smallest doc_id, its first text by hash; documents without id stay."""
    kept = stage(firsts(docs), "kept")
    own = "_mark"
    while own in docs.columns:
        own += "_"
    # sorted and merged at every size: both sides grow with the input, and a sort can spill
    wanted = kept.select("doc_id", F.col("mark").alias(own)).hint("merge")
    one = docs.withColumn(own, mark(F.col("text"))).join(wanted, ["doc_id", own], "left_semi")
    if not kept.where("rows > 1").isEmpty():
        one = one.dropDuplicates(["doc_id"])
    return one.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, with n_chars of its new text."""
    found = redact(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return found.select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, with their digest and whether they decode to the text."""
    return encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("sentencepiece", sentencepiece),
]

#: A trained network, near-duplicate components, edit distances and a token model are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
