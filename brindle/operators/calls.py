"""The log of requests: rows, duration and error of each, taken while the result is written."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "call_id STRING, department STRING, tool STRING, query STRING, result_count LONG, duration_ms LONG, error STRING, called_at TIMESTAMP"


def logged(spark: SparkSession, log: str, tool: str, query: str, department: str, make: Callable[[], DataFrame], out: str) -> DataFrame | None:
    """Write what make returns to out, append a row about it to the log, and return the written result (None after an error).

    The number of rows is observed while they are written: there is no second pass. An error is logged with its kind and not raised.
    """
    seen, began, called = Observation(), time.perf_counter(), datetime.now(UTC)
    error, rows, result = None, 0, None
    try:
        made = make()
        made.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(out)
        rows, result = seen.get["rows"], spark.read.schema(made.schema).parquet(out)
    except Exception as problem:  # a tool may fail in any way; the log has it, and the caller no result
        error = f"{type(problem).__name__}: {str(problem).splitlines()[0] if str(problem) else ''}"[:500]
    took = round((time.perf_counter() - began) * 1000)
    row = (uuid.uuid4().hex, department, tool, query, rows, took, error, called)
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(log)
    return result


def usage(spark: SparkSession, log: str) -> DataFrame:
    """Calls, failed ones, results and the slowest duration of each tool."""
    rows = spark.read.schema(LOG).parquet(log)
    counts = (F.count(F.lit(1)).alias("calls"), F.count("error").alias("failed"), F.sum("result_count").alias("results"), F.max("duration_ms").alias("slowest_ms"))
    return rows.groupBy("department", "tool").agg(*counts)
