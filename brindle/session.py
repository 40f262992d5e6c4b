"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. A folder of the driver's own would hide from it what executors write, so there is none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/brindle/{name}-{uuid.uuid4().hex}"


#: Rows that a task gets at most of what is dealt out by a known number of rows.
ROWS = 500_000


def dealt(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """df by a hash of keys in all of the session's shuffle partitions, and in more if df has more rows than ROWS for each of them.

    Spark merges small shuffle partitions by their compressed size; rows of keys and names as alike as those of a graph take some twenty
    times as much in a task that aggregates and sorts them. A number that is asked for is not merged. With the number of rows given, a task's memory does not grow with the table.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS)), *keys)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
