"""Rules that route pages and classify statements. Keyword sets are parameters; the defaults are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that something is planned, and that it was done.
PLANNED = (
    "예정", "할 예정", "진행 예정", "검토 중", "검토 예정", "계획", "예정입니다", "할 계획",
    "가능성", "논의 중", "준비 중", "예정으로", "검토하고", "진행할", "배포 예정", "오픈 예정",
)
APPLIED = (
    "완료", "적용됨", "배포됨", "출시", "오픈됨", "시행됨", "확정됨", "실시됨", "반영됨",
    "실행됨", "시작됨", "완료되었", "됩니다", "했습니다", "출시됨", "배포 완료", "오픈 완료", "적용 완료",
)
#: Titles of pages that are left out, that matter, and that can wait.
EXCLUDED_TITLES = ("테스트", "test", "임시", "draft", "삭제 예정", "미사용", "untitled")
CORE_TITLES = (
    "전략", "기획", "의사결정", "결정", "승인", "회의록", "회의", "미팅", "ua", "마케팅", "예산", "목표", "kpi", "매출", "dau",
    "arpu", "분석", "인사이트", "보고서", "계획", "방향", "로드맵", "okr", "이슈", "리스크", "문제", "개선", "제안", "검토", "결론",
)
DEFERRED_TITLES = ("링크 모음", "참고 자료", "자료 모음", "업무 연락", "단순 안내", "일정 공유", "todo", "체크리스트")
DECIDED = (
    "승인", "결정", "채택", "선택", "완료", "확정", "검토", "허가", "처리", "배정", "지정", "선정", "의결",
    "보고", "승낙", "거부", "반려", "취소", "변경", "수정", "합의", "위임", "지시", "요청", "승계", "이관",
)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def route(
    title: Column,
    words: Column,
    has_properties: Column,
    excluded: tuple[str, ...] = EXCLUDED_TITLES,
    core: tuple[str, ...] = CORE_TITLES,
    defer: tuple[str, ...] = DEFERRED_TITLES,
) -> Column:
    """core, defer or excluded: the first rule that applies. Long pages are core whatever their body says."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(has_properties, F.when(words >= 1, "core").otherwise("excluded"))
        .when((words < 30) | any_of(low, excluded), "excluded")
        .when(any_of(low, core), "core")
        .when(any_of(low, defer), "defer")
        .when(words < 80, "defer")
        .otherwise("core")
    )


def realization_status(text: Column, planned: tuple[str, ...] = PLANNED, applied: tuple[str, ...] = APPLIED) -> Column:
    """planned or applied if signs of just one kind are there, else unconfirmed."""
    a, b = any_of(text, planned), any_of(text, applied)
    return F.when(a & ~b, "planned").when(b & ~a, "applied").otherwise("unconfirmed")


def is_decision(predicate: Column, words: tuple[str, ...] = DECIDED) -> Column:
    return any_of(predicate, words)


def property_text(names: Column, values: Column) -> Column:
    """Properties as lines "name: value", in their order."""
    return F.array_join(F.zip_with(names, values, lambda k, v: F.concat(k, F.lit(": "), v)), "\n")


def synthesized(body: Column, words: Column, properties: Column) -> Column:
    """Short bodies get their properties put in front."""
    return F.when((words < 30) & (properties != ""), F.concat_ws("\n", properties, F.nullif(body, F.lit("")))).otherwise(body)


def first_present(properties: Column, aliases: tuple[str, ...]) -> Column:
    """The value of the first alias that properties (a map) has, even if blank."""
    out = F.lit(None).cast("string")
    for name in reversed(aliases):
        out = F.when(F.map_contains_key(properties, name), properties[name]).otherwise(out)
    return out


def is_data_asset(name: Column) -> Column:
    """Names of tables, files and addresses rather than of things."""
    return name.rlike("^https?://") | F.contains(name, F.lit("/")) | (F.size(F.split(name, r"\.")) >= 3) | name.rlike("^[A-Za-z0-9]+(_[A-Za-z0-9]+){2,}$") | name.rlike("_(view|raw|tbl|table)$")
