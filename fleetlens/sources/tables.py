"""Loader for the parquet tables fleetlens queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table: ``<base>/<name>.parquet`` (a file or a folder of parts).

    Only a lazy scan is built; Catalyst prunes columns and pushes filters into
    it, so callers select and filter freely.
    """
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def tables(spark: SparkSession, base: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: table(spark, base, n) for n in names}
