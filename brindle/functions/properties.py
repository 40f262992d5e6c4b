"""Typed page properties, kept as JSON: {name: {"type": t, t: value}}."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of the property types that carry a value of their own. Others (relations, formulas) have no text.
VALUE = (
    "type STRING, select STRUCT<name: STRING>, multi_select ARRAY<STRUCT<name: STRING>>, date STRUCT<start: STRING>, people ARRAY<STRUCT<name: STRING>>,"
    " rich_text ARRAY<STRUCT<plain_text: STRING>>, title ARRAY<STRUCT<plain_text: STRING>>, number STRING, checkbox BOOLEAN, url STRING, email STRING, phone_number STRING"
)


def entries(properties: Column) -> Column:
    """Name and typed value of each property, in their order. Parsing is most of the work: keep them in a column where both values and title are wanted."""
    raw = F.map_entries(F.from_json(properties, "MAP<STRING, STRING>"))
    return F.transform(F.coalesce(raw, F.array().cast("ARRAY<STRUCT<key: STRING, value: STRING>>")), lambda e: F.struct(e["key"].alias("name"), F.from_json(e["value"], VALUE).alias("v")))


def _texts(parts: Column) -> Column:
    return F.trim(F.array_join(F.transform(parts, lambda t: F.coalesce(t["plain_text"], F.lit(""))), ""))


def _filled(text: Column) -> Column:
    return F.when(text != "", F.array(text))


def _value(v: Column) -> Column:
    """The values as an array, null where there is none. A checkbox always has one: false says something too."""
    kind = v["type"]
    names = lambda items: F.transform(items, lambda x: x["name"])
    people = F.filter(names(v["people"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return (
        F.when(kind == "select", F.when(v["select"]["name"].isNotNull(), F.array(v["select"]["name"])))
        .when(kind == "multi_select", F.when(F.size(v["multi_select"]) > 0, names(v["multi_select"])))
        .when(kind == "date", _filled(F.substring(v["date"]["start"], 1, 10)))
        .when(kind == "people", F.when(F.size(people) > 0, people))
        .when(kind == "rich_text", _filled(_texts(v["rich_text"])))
        .when(kind == "number", F.when(v["number"].isNotNull(), F.array(v["number"])))
        .when(kind == "checkbox", F.array(F.coalesce(v["checkbox"], F.lit(False)).cast("string")))
        .when(kind == "url", _filled(v["url"]))
        .when(kind == "email", _filled(v["email"]))
        .when(kind == "phone_number", _filled(v["phone_number"]))
    )


def values_of(read: Column) -> Column:
    """Of entries the map of name -> values of those that have any; the title is none of them."""
    found = F.transform(read, lambda e: F.struct(e["name"].alias("key"), _value(e["v"]).alias("value")))
    return F.map_from_entries(F.filter(found, lambda e: e["value"].isNotNull()))


def extracted(properties: Column) -> Column:
    """Map of name -> values of the properties that have any; the title is none of them."""
    return values_of(entries(properties))


def joined(values: Column) -> Column:
    """A map of lists as a map of texts, the values of a list apart by commas."""
    return F.transform_values(values, lambda _, v: F.array_join(v, ", "))


def title_of(read: Column, default: Column) -> Column:
    """Of entries the first non-empty one of type title, else the default."""
    texts = F.transform(F.filter(read, lambda e: e["v"]["type"] == "title"), lambda e: _texts(e["v"]["title"]))
    return F.coalesce(F.get(F.filter(texts, lambda t: t != ""), F.lit(0)), default)


def title(properties: Column, default: Column) -> Column:
    """The first non-empty property of type title, else the default."""
    return title_of(entries(properties), default)
