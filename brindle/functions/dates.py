"""Dates in text and event dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that ask for a history.
STRONG = ("이력", "언제", "타임라인", "히스토리", "연혁", "추이", "날짜", "일자", "시점", "며칠")
# a year beside . or / has four digits, so that versions and decimals are no dates
YMD = r"(?:([0-9]{2,4})\s*[년-]|([0-9]{4})\s*[./])\s*([0-9]{1,2})\s*[월./-]\s*([0-9]{1,2})\s*일?"
QUARTER = r"([0-9]{2,4})\s*년?\s*(?:([1-4])\s*분기|[Qq]([1-4]))"
YM = r"(?:([0-9]{2,4})\s*[년-]|([0-9]{4})\s*[./])\s*([0-9]{1,2})\s*월?(?!\s*[0-9])"
YEAR = r"([0-9]{2,4})\s*년"


def _number(text: Column, pattern: str, *groups: int) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, g), F.lit("")).try_cast("int") for g in groups])


def _year(year: Column) -> Column:
    return F.when(year < 100, year + 2000).otherwise(year)


def date_range(text: Column) -> Column:
    """Struct of from and to (dates, null where the text names none): a day, a quarter, a month or a year, in this order.

    Rules with an impossible month fall through to the next; days are clamped to the month's end.
    """
    day = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d))
    year, month, dom = _year(_number(text, YMD, 1, 2)), _number(text, YMD, 3), _number(text, YMD, 4)
    first = day(year, F.when(month.between(1, 12), month), F.lit(1))
    exact = F.when((dom >= 1) & (dom <= 31), F.least(F.date_add(first, dom - 1), F.last_day(first)))
    q_year, q = _year(_number(text, QUARTER, 1)), _number(text, QUARTER, 2, 3)
    q_from = day(q_year, q * 3 - 2, F.lit(1))
    m_from = day(_year(_number(text, YM, 1, 2)), F.when(_number(text, YM, 3).between(1, 12), _number(text, YM, 3)), F.lit(1))
    y_from = day(_year(_number(text, YEAR, 1)), F.lit(1), F.lit(1))
    start = F.coalesce(exact, q_from, m_from, y_from)
    end = F.coalesce(exact, F.last_day(F.add_months(q_from, 2)), F.last_day(m_from), F.last_day(F.add_months(y_from, 11)))
    return F.struct(start.alias("from"), end.alias("to"))


def timeline_intent(text: Column) -> Column:
    """Whether text asks for a history: it names a date, or a strong keyword."""
    found = date_range(text)["from"].isNotNull()
    for word in STRONG:
        found = found | F.contains(text, F.lit(word))
    return found


def event_epoch(date: Column) -> Column:
    """Seconds since 1970 of a date in one of four formats; 0 if in none."""
    trimmed = F.trim(date)
    tries = [F.unix_timestamp(F.try_to_timestamp(trimmed, F.lit(f))) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd")]
    return F.coalesce(*tries, F.lit(0)).cast("long")


def quarter_label(date: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(date))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days between two times in seconds, rounded."""
    return F.round((later - earlier) / 86400).cast("long")


def iso_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))
