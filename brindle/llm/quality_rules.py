"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every rule is a metric and a fixed grid of cutoffs from lenient to strict. On the labelled documents that pass the base
rules, an exact binomial test per stratum asks whether a cutoff falsely rejects more than RULE_RISK of the good ones.
Cutoffs are tested from lenient to strict and testing stops at the first that fails (fixed-sequence testing: no further
correction along a grid); the level is divided by strata times rules (Bonferroni). The strictest accepted cutoff is used;
with too few labels no cutoff is accepted and the rule rejects nothing.

Defined results: null and empty texts have no words and fail the base rules; a null stratum is a stratum of its own; null
labels and labels without a document count for nothing; a document labelled twice is good if any label says so; repeated
documents are judged row by row; without labels only the base rules act.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stage, words_column
from .stats_sql import binomial_tail

#: Greatest share of a stratum's good documents that one rule may reject, and the error level over all tests.
RULE_RISK, LEVEL = 0.005, 0.05
#: Rule -> (metric over the feature columns, cutoffs from lenient to strict); values above the cutoff are rejected.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", (8.0, 4.0, 2.0, 1.0, 0.5, 0.25)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.18, 0.15, 0.12, 0.1)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.75, 0.6, 0.5, 0.4, 0.3)),
    "long_words": ("word_chars / greatest(n_words, 1)", (20.0, 15.0, 12.0, 10.0, 9.0)),
    "short_words": ("-word_chars / greatest(n_words, 1)", (-1.5, -2.0, -2.5, -3.0)),
    "few_words": ("-n_words", (-11.0, -12.0, -14.0, -16.0, -20.0)),
}
WINDOW = 5


def _repeat_words(words: Column) -> Column:
    """Words in WINDOW-word windows found twice or more. Windows of equal hashes alone are compared as words."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # works value out once

    def again(w: Column) -> Column:
        """Starts whose neighbour in the sorted pairs (w, i) has the same w."""
        same = lambda x, i, d: F.get(w, i + d)["w"].eqNullSafe(x["w"])
        return F.transform(F.filter(w, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"])

    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("w"), i.alias("i"))))
    # a word never holds a space, so the joined window names its words without doubt
    by_words = lambda at: F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("w"), i.alias("i"))))
    covered = lambda a: F.aggregate(F.transform(a, lambda p, k: F.least(F.coalesce(F.get(a, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda s, g: s + g)
    exact = bind(by_hash, lambda h: bind(again(h), lambda at: bind(by_words(at), lambda w: bind(F.sort_array(again(w)), covered))))
    return F.when(n < WINDOW, F.lit(0)).when(F.size(F.array_distinct(hashes)) == n - WINDOW + 1, F.lit(0)).otherwise(exact).cast("long")


def features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """Per document: the keep columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed."""
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    split = source.select(
        *keep,
        words_column(F.col("_text")).alias("_words"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    counted = split.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )
    return counted.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def _stratum(column: str) -> Column:
    """A stratum's name; null is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def cutoffs(labelled: DataFrame, stratum: str = "lang") -> DataFrame:
    """labelled: features with a boolean column good. Returns the stratum and, per rule, the accepted cutoff (null: none)."""
    good = labelled.where("good AND NOT base_failed")
    counts = [F.sum(F.when(F.expr(metric) > cut, 1).otherwise(0)).cast("long").alias(f"{rule}_{i}") for rule, (metric, grid) in RULES.items() for i, cut in enumerate(grid)]
    per = good.groupBy(_stratum(stratum).alias("_stratum")).agg(F.count(F.lit(1)).alias("n"), *counts)
    strata = per.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata")).scalar()
    # a row a test, so that the test is one expression
    tests = [F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(float(cut)).alias("cut"), F.col(f"{rule}_{i}").alias("k")) for rule, (_, grid) in RULES.items() for i, cut in enumerate(grid)]
    rows = per.select("_stratum", "n", F.explode(F.array(*tests)).alias("t")).select("_stratum", "n", "t.*")
    tested = rows.withColumn("ok", F.expr(binomial_tail("n", "k", RULE_RISK)) <= F.lit(LEVEL) / (strata * len(RULES)))
    # the strictest cutoff before the first that fails
    run = tested.groupBy("_stratum", "rule").agg(F.min(F.when(~F.col("ok"), F.col("i"))).alias("fail"), F.collect_list(F.struct("i", "cut")).alias("all"))
    passed = F.array_max(F.filter("all", lambda x: F.col("fail").isNull() | (x["i"] < F.col("fail"))))["cut"]
    picked = run.select("_stratum", "rule", passed.alias("cut"))
    return picked.groupBy("_stratum").agg(*[F.max(F.when(F.col("rule") == rule, F.col("cut"))).alias(f"cut_{rule}") for rule in RULES])


def judge(feats: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """feats with kept added. labels: key and quality (1: good). feats is read twice; stage it first."""
    marked = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(key).agg((F.max("quality") == 1).alias("good"))
    # staged: Spark then knows how small it is and broadcasts it, whatever share of the documents a stratum has
    chosen = stage(cutoffs(feats.join(marked, key), stratum), "cutoffs")
    rejected = " OR ".join(f"coalesce({metric} > cut_{rule}, false)" for rule, (metric, _) in RULES.items())
    joined = feats.withColumn("_stratum", _stratum(stratum)).join(chosen, "_stratum", "left")
    return joined.withColumn("kept", F.expr(f"NOT base_failed AND NOT ({rejected})"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    staged = stage(features(docs), "quality")
    return judge(staged, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
