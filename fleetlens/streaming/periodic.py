"""Periodic statistics on a stream.

The batch operator (``operators.periodic.periodic_stats``) behind a
watermark: append mode emits a window once the watermark passes its end.
Spark drops a row that is older than the previous micro-batch's watermark
when it arrives; a row arriving in the same batch in which its window closes
still counts.  ``withWatermark`` needs
a zoned timestamp, so ``timestamp_ntz`` input is converted through epoch
microseconds (independent of the session time zone) and the window bounds
are converted back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetlens.functions.times import instant_to_ntz, ntz_to_instant
from fleetlens.operators.periodic import periodic_stats


def periodic_stats_stream(stream: DataFrame, ts: str, period: str, keys, value: str,
                          lateness: str, tiebreak: str | None = None) -> DataFrame:
    ntz = stream.schema[ts].dataType.typeName() == "timestamp_ntz"
    x = stream.withColumn(ts, ntz_to_instant(ts)) if ntz else stream
    out = periodic_stats(x.withWatermark(ts, lateness), ts, period, keys, value, tiebreak=tiebreak)
    if ntz:
        out = (out.withColumn("window_start", instant_to_ntz("window_start"))
                  .withColumn("window_end", instant_to_ntz("window_end")))
    return out
