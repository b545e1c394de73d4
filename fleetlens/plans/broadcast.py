"""Broadcast only what has a known size.

A table built from a Python list (a registry, a parameter list) has its size
known on the driver; anything else is left to Catalyst / AQE, which choose a
broadcast from measured sizes and fall back to a shuffle join beyond the
threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side at most this many rows is shipped to every executor.
DEFAULT_MAX_ROWS = 100_000


def literal_table(spark: SparkSession, rows: list, schema,
                  max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """A DataFrame from a Python list (a registry, a parameter list).

    Its size is known on the driver, so it is broadcast without a job when
    within the bound.
    """
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= max_rows else df
