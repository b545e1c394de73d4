"""Skew-safe ordered prefix scans ("segmented scans").

Running aggregates over the rows of a key in a total order (ranks, prefix
sums, sticky flags, nearest following match) are windows partitioned by the
key, which puts a whole key into one task.  Here a key is cut into buckets of
its order, so the work of a hot key spreads over many tasks:

1. ``bucketize``: a sample of the rows (about ``SAMPLES`` for each ``hot_rows``
   rows, chosen by a hash of key and order columns) is grouped by key.  A key
   with two buckets' worth of samples or more is *hot*, and every
   ``SAMPLES``-th of its sorted samples is a bucket boundary.  Boundaries are tuples of
   **all** order columns, so ties in the leading ones and outliers cannot
   pile up, and any type that can be ordered will do.
2. ``prefix_scan``: a window per (key, bucket) computes each measure over the
   rows strictly before the current one inside its bucket.
3. For hot keys only, per-bucket totals are carried across the key's
   buckets with a small window and added to the in-bucket value.

The sample has at most ``MAX_SAMPLES`` tuples in all, however large the input: beyond that fewer
rows are taken, so no group and no task of it holds more.  What is broadcast is bounded by it: at most
``MAX_HOT_KEYS`` keys are cut (any other key holds less than 1 / ``MAX_HOT_KEYS`` of
the rows), and every boundary stands for ``SAMPLES`` tuples of the sample, so there are at
most ``MAX_BUCKETS``.  All of this is part of the plan: building a scan runs no
job, and where no key is hot adaptive execution drops both joins.

Measure kinds: ``count`` (rows before), ``sum``, ``or`` (any true before),
``last`` (nearest earlier non-null value) and ``total`` (whole key).  With
``descending=True`` "before" means later in the order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# rows one window task sorts and scans comfortably
HOT_ROWS = 2_000_000
SAMPLES = 16
MAX_HOT_KEYS = 10_000
MAX_BUCKETS = 20_000
GROUP = 64  # tuples of a group of the sample
MAX_SAMPLES = SAMPLES * MAX_BUCKETS  # tuples in the whole sample, whatever the input
STRIDE = 128  # boundaries are looked up in two steps: every STRIDE-th, then the ones between
B, HOT = "_sg_b", "_sg_hot"


def _null_safe(left: str, right: str, cols) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols])


def _sample(df: DataFrame, keys, order, rate: int, most: int) -> DataFrame:
    """``keys``, ``_sg_t`` (order tuple), ``_sg_c`` (rows that have it) of one row in ``rate``, by hash, or of so many fewer that at
    most ``most`` tuples are left.

    Tuples are counted in each task before they are shuffled, then dealt to groups by hash, and of each group those of the
    smallest hash are kept (a partial group limit does that in each task already): where the sample is larger than
    that, the groups' limits fall at nearly the same hash, so it gets thinner evenly."""
    t = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    some = df.select(*keys, t.alias("_sg_t"))
    if rate > 1:
        some = some.filter(F.pmod(F.xxhash64(*keys, "_sg_t"), F.lit(rate)) == 0)
    groups = max(1, most // GROUP)
    own = F.xxhash64(F.lit(1), *keys, "_sg_t")
    some = some.groupBy(*keys, "_sg_t").agg(F.count(F.lit(1)).alias("_sg_c")) \
        .withColumn("_sg_g", F.pmod(F.xxhash64(F.lit(2), *keys, "_sg_t"), F.lit(groups)))
    place = F.row_number().over(Window.partitionBy("_sg_g").orderBy(own))
    return some.withColumn("_sg_p", place).where(F.col("_sg_p") <= most // groups).drop("_sg_g", "_sg_p")


def boundaries(df: DataFrame, keys, order, hot_rows: int = HOT_ROWS, max_samples: int | None = None) -> DataFrame:
    """``keys``, ``_sg_bounds`` (sorted array of order tuples) of each hot key."""
    keys, order = list(keys), list(order)
    per = max(1, min(SAMPLES, hot_rows))
    sample = _sample(df, keys, order, max(1, hot_rows // per), max_samples or MAX_SAMPLES)
    by_key = sample.groupBy(*keys).agg(F.sum("_sg_c").alias("_sg_n"), F.collect_list("_sg_t").alias("_sg_all"))
    hot = by_key.filter(F.col("_sg_n") >= 2 * per).orderBy(F.desc("_sg_n")).limit(MAX_HOT_KEYS)
    step = F.lit(per)
    hot = hot.withColumn("_sg_all", F.array_sort("_sg_all"))
    at = F.sequence(step, F.greatest(F.size("_sg_all") - 1, step), step)
    picked = F.filter(F.transform(at, lambda i: F.get("_sg_all", i)), lambda t: t.isNotNull())
    return hot.select(*keys, picked.alias("_sg_bounds"))


def _bucket_of(t: Column, bounds: str) -> Column:
    """How many boundaries are at or below the tuple."""
    coarse = F.filter(F.col(bounds), lambda b, i: (i % STRIDE == 0) & (b <= t))
    skipped = F.greatest(F.size(coarse) - 1, F.lit(0)) * STRIDE
    fine = F.filter(F.slice(F.col(bounds), skipped + 1, F.lit(STRIDE)), lambda b: b <= t)
    return (skipped + F.size(fine)).cast("bigint")


def bucketize(df: DataFrame, keys, order, hot_rows: int = HOT_ROWS, base: DataFrame | None = None) -> DataFrame:
    """``df`` + ``_sg_b`` (bucket, 0 for keys that are not hot) + ``_sg_hot``.

    ``base``: what ``df`` was made from, with the same rows; the boundaries are taken from it, so that a scan
    of a scan does not sample the first one's result."""
    keys, order = list(keys), list(order)
    l, r = df.alias("_sl"), F.broadcast(boundaries(df if base is None else base, keys, order, hot_rows)).alias("_sr")
    j = l.join(r, _null_safe("_sl", "_sr", keys), "left")
    hot = F.col("_sr._sg_bounds").isNotNull()
    t = F.struct(*[F.col(f"_sl.{c}").alias(f"o{i}") for i, c in enumerate(order)])
    return j.select(*[F.col(f"_sl.{c}") for c in df.columns],
                    F.when(hot, _bucket_of(t, "_sr._sg_bounds")).otherwise(F.lit(0).cast("bigint")).alias(B), hot.alias(HOT))


def _local(kind: str, inp: Column, w_frame, w_all) -> Column:
    if kind == "count":
        return F.count(F.lit(1)).over(w_frame)
    if kind == "sum":
        return F.sum(inp).over(w_frame)
    if kind == "or":
        return F.max(inp).over(w_frame)
    if kind == "last":
        return F.last(inp, ignorenulls=True).over(w_frame)
    if kind == "total":
        return F.sum(inp).over(w_all)
    raise ValueError(kind)


def prefix_scan(bdf: DataFrame, keys, order, measures, descending: bool = False) -> DataFrame:
    """Add one column per ``(name, kind, expr)`` of ``measures`` to a
    bucketized frame (see module doc)."""
    keys, order = list(keys), list(order)
    ordc = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    part = Window.partitionBy(*keys, B)
    w_frame = part.orderBy(*ordc).rowsBetween(Window.unboundedPreceding, -1)
    inp = bdf
    for name, kind, expr in measures:
        inp = inp.withColumn(f"_ps_i_{name}", F.lit(1) if kind == "count" else expr)
    # one select, so window expressions of the same spec share one operator
    x = inp.select("*", *[_local(kind, F.col(f"_ps_i_{name}"), w_frame, part).alias(f"_ps_l_{name}")
                          for name, kind, _ in measures])

    # per-bucket totals of hot keys, carried over the key's earlier buckets
    hot = inp.filter(F.col(HOT))
    ord_struct = F.struct(*[F.col(c) for c in order])
    aggs = []
    for name, kind, _ in measures:
        i = F.col(f"_ps_i_{name}")
        if kind in ("count", "sum", "total"):
            aggs.append(F.sum(i).alias(f"_ps_t_{name}"))
        elif kind == "or":
            aggs.append(F.max(i).alias(f"_ps_t_{name}"))
        else:  # last: the bucket's value nearest to the following buckets
            pick = F.min_by if descending else F.max_by
            aggs.append(pick(i, F.when(i.isNotNull(), ord_struct)).alias(f"_ps_t_{name}"))
    summ = hot.groupBy(*keys, B).agg(*aggs)
    wb = Window.partitionBy(*keys).orderBy(F.col(B).desc() if descending else F.col(B).asc())
    wbf = wb.rowsBetween(Window.unboundedPreceding, -1)
    carry = []
    for name, kind, _ in measures:
        t = F.col(f"_ps_t_{name}")
        c = {"count": F.sum(t).over(wbf), "sum": F.sum(t).over(wbf), "or": F.max(t).over(wbf),
             "last": F.last(t, ignorenulls=True).over(wbf),
             "total": F.sum(t).over(Window.partitionBy(*keys))}[kind]
        carry.append(c.alias(f"_ps_c_{name}"))
    # at most MAX_BUCKETS boundaries and MAX_HOT_KEYS keys, so that many rows
    carry_df = F.broadcast(summ.select(*keys, B, *carry))

    l, r = x.alias("_pl"), carry_df.alias("_pr")
    j = l.join(r, _null_safe("_pl", "_pr", keys + [B]), "left")
    outs = []
    for name, kind, _ in measures:
        lo, ca = F.col(f"_pl._ps_l_{name}"), F.col(f"_pr._ps_c_{name}")
        if kind == "count":
            v = lo + F.coalesce(ca, F.lit(0))
        elif kind == "sum":
            v = F.when(lo.isNull() & ca.isNull(), F.lit(None)).otherwise(
                F.coalesce(lo, F.lit(0)) + F.coalesce(ca, F.lit(0)))
        elif kind == "or":
            v = F.when(lo.isNull() & ca.isNull(), F.lit(None)).otherwise(
                F.coalesce(lo, F.lit(False)) | F.coalesce(ca, F.lit(False)))
        elif kind == "last":
            v = F.coalesce(lo, ca)
        else:
            v = F.coalesce(ca, lo)
        outs.append(v.alias(name))
    return j.select(*[F.col(f"_pl.{c}") for c in bdf.columns], *outs)
