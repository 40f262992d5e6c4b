"""Question sets: candidates, selection, keeping and judging them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import norm_key

from .ranking import first_by, top_by

#: Categories and difficulties of questions; words that point at something, and what they point at.
CATEGORIES = ("담당자", "정책/규정", "관계", "문서위치", "복합")
DIFFICULTIES = ("easy", "medium", "hard")
DEICTIC = ("이", "그", "해당", "위", "아래", "앞", "제시된", "위의", "앞선", "본", "동")
POINTED_AT = (
    "문서", "테이블", "쿼리", "단계", "프로세스", "제보", "표", "그림", "항목", "내용", "자료", "리스트", "목록", "결과", "파일", "워크플로우", "이슈", "사례", "케이스",
)
SHARES = {"easy": 0.3, "medium": 0.5, "hard": 0.2}


def points_outside(question: Column, pointers: tuple[str, ...] = DEICTIC, things: tuple[str, ...] = POINTED_AT) -> Column:
    """Whether a question points at something that it does not hold: one of the pointers begins a word, and a thing follows it."""
    longest_first = "|".join(re.escape(p) for p in sorted(pointers, key=len, reverse=True))
    followers = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(rf"(?<![^\s,.(])(?:{longest_first})\s*(?=(\S+))"), F.lit(1))
    return F.exists(followers, lambda f: reduce(lambda a, b: a | b, (F.startswith(f, F.lit(t)) for t in things)))


def valid(items: DataFrame) -> DataFrame:
    """Candidates (category, difficulty, question, answer) that are whole, known and long enough."""
    known = F.col("category").isin(*CATEGORIES) & F.col("difficulty").isin(*DIFFICULTIES)
    return items.where(known & (F.length("question") >= 10) & (F.length("answer") >= 2))


def deduplicated(items: DataFrame, key: str) -> DataFrame:
    """The first item by key of each question, whatever its spelling; questions without a letter or digit go."""
    named = items.withColumn("_q", norm_key(F.coalesce("question", F.lit("")))).where("_q <> ''")
    return first_by(named, ["_q"], F.asc(key)).drop("_q")


def targets(total: int, shares: dict[str, float] | None = None) -> dict[str, int]:
    """How many questions of each difficulty make total: one at least, medium takes the rest."""
    out = {d: max(1, round(total * share)) for d, share in (shares or SHARES).items()}
    out["medium"] += total - sum(out.values())
    return out


def selected(items: DataFrame, per_category: dict[str, int], key: str) -> DataFrame:
    """per_category questions of each category, spread over the difficulties, in the order of a hash of their key; where a difficulty
    has too few, the category's other questions fill up."""
    goals = F.create_map(*[F.lit(x) for c, n in per_category.items() for d, k in targets(n).items() for x in (f"{c}/{d}", k)])
    whole = F.create_map(*[F.lit(x) for c, n in per_category.items() for x in (c, n)])
    wanted = items.where(F.col("category").isin(*per_category)).withColumn("_h", F.sha2(F.col(key).cast("string"), 256))
    ranked = top_by(wanted, ["category", "difficulty"], max(per_category.values()), F.asc("_h"), F.asc(key))
    spread = ranked.withColumn("_fill", (F.col("rank") > F.coalesce(goals[F.concat_ws("/", "category", "difficulty")], F.lit(0))).cast("int")).drop("rank")
    chosen = top_by(spread, ["category"], max(per_category.values()), F.asc("_fill"), F.asc("_h"), F.asc(key))
    return chosen.where(F.col("rank") <= whole[F.col("category")]).drop("_h", "_fill")


def overlap(dev: DataFrame, holdout: DataFrame, source: str) -> DataFrame:
    """Sources on both sides of a split: none in a sound one."""
    filled = lambda df: df.select(source).where(f"{source} IS NOT NULL AND {source} <> ''")
    return filled(dev).intersect(filled(holdout))


def created(questions: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """questions with new ones, but those whose id is taken."""
    return questions.unionByName(new.join(questions.select(key), key, "left_anti"))


def deleted(questions: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return questions.join(ids.select(key).distinct(), key, "left_anti")


def listed(questions: DataFrame, key: str = "id", dept: str | None = None) -> DataFrame:
    """The questions (of a department) in the order of their id."""
    found = questions if dept is None else questions.where(F.col("dept") == dept)
    return found.orderBy(key)


def judged(expected: DataFrame, results: DataFrame, query_id: str) -> DataFrame:
    """Per question: the expected titles (array column expected) that hold a result's title (title, score, rank) or are held by it,
    whether there is any, and the best score; questions whose search failed have no results."""
    found = results.groupBy(query_id).agg(F.collect_list(F.lower("title")).alias("_titles"), F.min_by("score", "rank").alias("score"))
    both = expected.join(found, query_id, "left").withColumn("_titles", F.coalesce("_titles", F.array().cast("array<string>")))
    meets = lambda e: F.exists("_titles", lambda t: F.contains(t, F.lower(e)) | F.contains(F.lower(e), t))
    matched = both.withColumn("matched", F.filter("expected", meets))
    return matched.withColumn("passed", F.size("matched") > 0).drop("_titles")


def run_summary(judgements: DataFrame) -> DataFrame:
    """One row: questions, passes, failures and the mean best score; questions without a score are not in the mean."""
    return judgements.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.round(F.avg("score"), 4).alias("average"))
