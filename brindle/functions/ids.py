"""Hashes and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def title_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 8)


def uuid5(name: Column) -> Column:
    """Version 5 UUID of name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def chunk_id(url: Column, index: Column) -> Column:
    return uuid5(F.concat(url, F.lit("#chunk"), index.cast("string")))


def event_id(url: Column, game: Column, kind: Column, date: Column, title: Column) -> Column:
    return uuid5(F.concat_ws("|", url, game, kind, date, title_hash(title)))


def decision_id(url: Column, subject: Column, predicate: Column, object_: Column) -> Column:
    return uuid5(F.concat_ws("|", url, subject, predicate, object_))


def set_fingerprint(*fields: Column) -> Column:
    """Aggregate: SHA-256 prefix of all rows in order, fields apart by unit and rows by record separators."""
    row = F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    return F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "\x1e"), 256), 1, 16)
