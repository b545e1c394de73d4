"""Nearest following event (a forward as-of match within one table).

For each ``from`` event, the first later event (by a total order) of the same
key that satisfies ``to``, and the delay to it.  Spark has no as-of join in the
DataFrame API; within one table it is a window: ordered **descending**, the
latest non-null ``to`` value over the rows strictly before the current one is
the nearest later match.  A frame that starts at UNBOUNDED PRECEDING is
evaluated incrementally (linear), unlike ``rowsBetween(1, unboundedFollowing)``
which recomputes each frame.

Only rows that are ``from`` or ``to`` enter the window; that filter is pushed
into the scan.  The window runs as a segmented scan (``plans.scan``): a key
with very many events is cut into time buckets, each its own task, and the
nearest match of a later bucket is carried back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.plans.scan import HOT_ROWS, bucketize, prefix_scan


def delay_us(a, b) -> Column:
    """Microseconds from timestamp ``a`` to ``b`` (NTZ or LTZ)."""
    return F.expr(f"timestampdiff(MICROSECOND, {a}, {b})")


def next_event(df: DataFrame, key, order, is_from: Column, is_to: Column,
               carry, ts: str = "ts", prefix: str = "next_",
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of ``df`` where ``is_from`` holds, plus ``next_<c>`` for each
    column of ``carry`` taken from the nearest later ``is_to`` row of the same
    key, and ``delay_us`` (null when there is none)."""
    key, order, carry = list(key), list(order), list(carry)
    if ts not in carry:
        carry = [ts] + carry
    x = (df.filter(is_from | is_to)
           .withColumn("_ne_from", is_from)
           .withColumn("_ne_to", F.when(is_to, F.struct(*[F.col(c) for c in carry]))))
    b = bucketize(x, key, order, hot_rows)
    s = prefix_scan(b, key, order, [("_ne_next", "last", F.col("_ne_to"))],
                    descending=True)
    s = s.filter("_ne_from").select(*df.columns,
                                    *[F.col(f"_ne_next.{c}").alias(prefix + c) for c in carry])
    return s.withColumn("delay_us", delay_us(f"`{ts}`", f"`{prefix}{ts}`"))
