"""P5: capture filter and truncation as a data operator.

The capture command keeps traffic matching a filter and truncates each packet
to a snap length.  As data: a predicate (pushed into the Parquet scan by
Catalyst when it is a simple comparison) plus a prefix of the payload, with
the original length kept.  Binary payloads are cut by bytes, strings by
characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.fixed import CAPTURE_SNAPLEN


def capture_filter(df: DataFrame, predicate: Column, payload: str,
                   snaplen: int = CAPTURE_SNAPLEN, out: str = "payload",
                   orig_len: str = "orig_len", truncated: str = "truncated") -> DataFrame:
    n = F.length(F.col(payload)).cast("bigint")
    return (df.filter(predicate)
              .withColumn(orig_len, n)
              .withColumn(truncated, n > F.lit(snaplen))
              .withColumn(out, F.substring(F.col(payload), 1, snaplen)))
