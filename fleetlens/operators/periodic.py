"""Periodic statistics (the same function serves batch and streams).

One row per key and period with count, exact sum (decimal with ``scale`` places, 38
digits), min, max and the first / last value by time.  ``groupBy(window(...))`` aggregates partially on
the map side.  In a stream the caller adds ``withWatermark`` first (see
``streaming.periodic``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SCALE = 6


def periodic_stats(events: DataFrame, ts: str, period: str, keys, value: str,
                   tiebreak: str | None = None, scale: int = SCALE) -> DataFrame:
    keys = list(keys)
    by = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    return (events.groupBy(F.window(F.col(ts), period).alias("_ps_w"), *keys)
                  .agg(F.count(F.lit(1)).alias("n"),
                       F.sum(F.col(value).cast(f"decimal(28,{scale})")).alias("sum_value"),
                       F.min(value).alias("min_value"),
                       F.max(value).alias("max_value"),
                       F.min_by(value, by).alias("first_value"),
                       F.max_by(value, by).alias("last_value"))
                  .select(F.col("_ps_w.start").alias("window_start"),
                          F.col("_ps_w.end").alias("window_end"), *keys,
                          "n", "sum_value", "min_value", "max_value", "first_value", "last_value"))
