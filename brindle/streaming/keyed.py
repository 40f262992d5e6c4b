"""A keyed table that a stream's batches write: each batch in a folder of its own, so that a batch that comes twice counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def writer(path: str, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the batch's rows, through change, replace what an earlier try of the same batch has written."""

    def write(rows: DataFrame, batch_id: int) -> None:
        change(rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """The last row of each key: of the latest batch that has it. A batch should hold a key once."""
    rows = spark.read.schema(f"{schema}, batch LONG").parquet(path)
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_last")).select(*keys, *(f"_last.{c}" for c in others if c != "batch"))


def compacted(spark: SparkSession, path: str, into: str, keys: list[str], schema: str) -> None:
    """Write the current rows to a new folder as its batch 0, so that a long log is read no more; the old folder stays as it is."""
    current(spark, path, keys, schema).write.mode("overwrite").parquet(f"{into}/batch=0")


def classified(registry: DataFrame, key: str, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over listed rows: their change against the registry as it is when the batch runs, by key; of a key that is listed
    twice in a batch, its last edit."""
    from brindle.operators.ranking import first_by
    from brindle.operators.tables import classify_changes

    def change(rows: DataFrame) -> DataFrame:
        return classify_changes(first_by(rows, [key], F.desc("last_edited_time")), registry, key).select(key, "last_edited_time", "change")

    return writer(path, change)
