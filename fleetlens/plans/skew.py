"""Skew-safe per-key selections.

A single key may hold a large share of all rows.  A window partitioned by that
key would put the whole group into one task, so the operators here avoid it:

* ``flag_extreme`` flags the first / last row of each key by a segmented scan
  (``plans.scan``): kept = no row of the key before it.  One algorithm for
  every type of order column; exactly one row of a key is kept, also among
  equal rows.
* ``top_n`` keeps the first ``n`` rows per key with ``row_number() <= n``;
  Catalyst turns this into a partial ``WindowGroupLimit`` before the
  exchange, so each map task ships at most ``n`` rows per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.plans.scan import B, HOT, HOT_ROWS, bucketize, prefix_scan


def flag_extreme(df: DataFrame, keys, order, first: bool = True,
                 flag: str = "kept", hot_rows: int | None = None) -> DataFrame:
    """All rows of ``df`` plus a boolean ``flag``: true for the first
    (``first=True``) or last row of each key under ``order``; of rows that are equal
    in it, one."""
    keys, order = list(keys), list(order)
    b = bucketize(df, keys, order, HOT_ROWS if hot_rows is None else hot_rows)
    s = prefix_scan(b, keys, order, [("_fx_before", "count", None)], descending=not first)
    return s.withColumn(flag, F.col("_fx_before") == 0).drop("_fx_before", B, HOT)


def top_n(df: DataFrame, keys, order, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key under ``order`` with their 1-based
    ``rank`` (bigint).  Planned as partial + final WindowGroupLimit."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) if isinstance(c, str) else c for c in order])
    return (df.withColumn(rank, F.row_number().over(w))
              .filter(F.col(rank) <= n)
              .withColumn(rank, F.col(rank).cast("bigint")))
