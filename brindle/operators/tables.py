"""Keyed writes without MERGE: each returns the new state of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows, and the old ones whose key they do not have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_by_source(old: DataFrame, new: DataFrame, source: str, ready: Column | None = None) -> DataFrame:
    """All rows of the sources that new has are replaced; sources with rows that are not ready keep their old ones."""
    if ready is not None:
        failed = new.where(~ready).select(source).distinct()
        new = new.join(failed, source, "left_anti")
    return old.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def upsert_keeping(old: DataFrame, new: DataFrame, keys: list[str], kept: tuple[str, ...]) -> DataFrame:
    """Full outer upsert: kept columns keep their old value where the new one is null; the others take the new value even if null."""
    present = new.withColumn("_new", F.lit(True))
    both = old.alias("o").join(present.alias("n"), keys, "full")
    take = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in kept else F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*keys, *[take(c).alias(c) for c in old.columns if c not in keys])


def without_source(edges: DataFrame, url: str) -> DataFrame:
    """Edges but those of a source; edges made by hand stay."""
    return edges.where(~((F.col("source_url") == url) & ~F.coalesce("is_manual", F.lit(False))))


def reconcile(stored: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Stored rows with a status: deleted where the listing no longer has the key."""
    gone = stored.join(listing.select(key).distinct(), key, "left_anti").select(key).distinct().withColumn("_gone", F.lit(True))
    return stored.join(gone, key, "left").withColumn("status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))).drop("_gone")


def classify_changes(listing: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """new, modified or synced for each listed row; rows that failed or have no hash are to be done again."""
    known = registry.select(key, F.col("last_edited_time").alias("_known"), F.col("status").alias("_status"), F.col("content_hash").alias("_hash"))
    again = (F.col("last_edited_time") > F.col("_known")) | (F.col("_status") != "ok") | F.col("_hash").isNull()
    change = F.when(F.col("_status").isNull(), "new").when(again, "modified").otherwise("synced")
    return listing.join(known, key, "left").withColumn("change", change).drop("_known", "_status", "_hash")


def changed_since(listing: DataFrame, mark: Column, search: str | None = None) -> DataFrame:
    """Rows edited after a mark, with a keyword in the title if given."""
    found = listing.where(F.col("last_edited_time") > mark)
    return found.where(F.col("title").ilike(f"%{search}%")) if search else found


def unchanged(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Rows whose content hash the registry has already."""
    return rows.join(registry.select(key, "content_hash").where("content_hash IS NOT NULL"), [key, "content_hash"], "left_semi")


def run_status(failed: Column, done: Column, dry: bool = False) -> Column:
    if dry:
        return F.lit("dry_run")
    return F.when(failed == 0, "success").when(done > 0, "partial").otherwise("failed")


def limited(changed: DataFrame, n: int | None, key: str) -> DataFrame:
    """At most n of the changed rows, those edited last (ties by key); all without n."""
    return changed if not n else changed.orderBy(F.desc("last_edited_time"), F.asc(key)).limit(n)


def advanced(state: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    """The sync state (one row: last_sync_time, last_sync_count, total_synced) after a run with the rows done; a first run has no row."""
    counted = done.agg(F.count(F.lit(1)).alias("_n"))
    total = F.coalesce(state.agg(F.max("total_synced").alias("t")).scalar(), F.lit(0))
    return counted.select(at.alias("last_sync_time"), F.col("_n").alias("last_sync_count"), (total + F.col("_n")).alias("total_synced"))


def purged(registry: DataFrame, listing: DataFrame, key: str, url: str, stores: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """What a listing that lost pages leaves: the registry with their status deleted, each store (with a column url) without their rows,
    and for each lost page how many rows went from every store. Edges made by hand (is_manual) stay; pages already deleted are not counted
    again."""
    gone = registry.where("status <> 'deleted'").join(listing.select(key).distinct(), key, "left_anti").select(key, url).distinct()
    urls = gone.where(F.coalesce(F.col(url), F.lit("")) != "").select(url).distinct()
    left, report = {}, gone
    for name, store in stores.items():
        manual = F.coalesce(F.col("is_manual"), F.lit(False)) if "is_manual" in store.columns else F.lit(False)
        left[name] = store.where(~manual).join(urls, url, "left_anti").unionByName(store.where(manual))
        counts = store.where(~manual).join(urls, url, "left_semi").groupBy(url).agg(F.count(F.lit(1)).alias(name))
        report = report.join(counts, url, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return reconcile(registry, listing, key), left, report
