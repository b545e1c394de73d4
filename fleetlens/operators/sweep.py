"""Parameter sweep grid, and the inverse (run name -> parameters).

A test is a set of experiments, one per combination of parameter values; the
run folder name encodes the values, ``_<name1><value1>_<name2><value2>...``.

The grid is generated, not joined: run ``i`` of ``prod(n_j)`` runs takes value
``(i / stride_j) % n_j`` of axis ``j`` (mixed-radix digits).  ``spark.range``
spreads the run ids over all tasks, and each axis is joined on its value index
by an equi-join.  An axis is broadcast up to ``MAX_BROADCAST`` values, and joined by shuffle
beyond; its values are numbered in ranges, so no task holds an axis.
There is no Cartesian product in the plan.  A run name that could not be read back (a null value, or a value that
holds another axis's mark) fails the query.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fleetlens.session import ensure_checkpoint_dir

MAX_BROADCAST = 100_000


def _indexed_axis(axis: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The distinct values with their number in order (``_sg_<name>``), and how many there are."""
    ensure_checkpoint_dir(axis.sparkSession)
    vals = axis.select(F.col(axis.columns[0]).alias(name)).distinct().repartitionByRange(F.col(name).asc_nulls_first())
    vals = vals.withColumn("_sg_p", F.spark_partition_id()).checkpoint()  # numbered once, whatever runs again
    counts = vals.groupBy("_sg_p").agg(F.count(F.lit(1)).alias("_sg_n"))
    n = counts.agg(F.sum("_sg_n")).first()[0] or 0
    before = Window.orderBy("_sg_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    starts = counts.select("_sg_p", F.coalesce(F.sum("_sg_n").over(before), F.lit(0)).alias("_sg_at"))
    rank = F.row_number().over(Window.partitionBy("_sg_p").orderBy(F.col(name).asc_nulls_first()))
    idx = vals.withColumn("_sg_r", rank).join(starts, "_sg_p").select(name, (F.col("_sg_at") + F.col("_sg_r") - 1).cast("bigint").alias(f"_sg_{name}"))
    return (F.broadcast(idx) if n <= MAX_BROADCAST else idx), n


def _readable(name: str, value: Column, names) -> Column:
    v = value.cast("string")
    marked = reduce(lambda a, b: a | b, [v.contains(f"_{n}") for n in names])
    return F.when(v.isNull(), F.raise_error(F.lit(f"sweep axis {name!r} has a null value"))) \
            .when(marked, F.raise_error(F.concat(F.lit(f"sweep axis {name!r} has a value that can't be read back: "), v))).otherwise(v)


def run_name(names, cols=None) -> Column:
    cols = cols or names
    return F.concat(F.lit("_"), F.concat_ws("_", *[F.concat(F.lit(n), _readable(n, F.col(c), names)) for n, c in zip(names, cols)]))


def sweep_grid(spark: SparkSession, axes: dict, max_runs: int | None = None,
               num_partitions: int | None = None, run: str = "run") -> DataFrame:
    """``{name: single-column DataFrame of values}`` -> one row per run:
    ``run`` plus one column per axis (named as the axis).  ``max_runs``: refuse a larger grid."""
    names = list(axes)
    indexed = [_indexed_axis(axes[n], n) for n in names]
    sizes = [n for _, n in indexed]
    total = reduce(lambda a, b: a * b, sizes, 1)
    if max_runs is not None and total > max_runs:
        raise ValueError(f"sweep grid has {total} runs, more than {max_runs}")
    grid = spark.range(0, total, numPartitions=num_partitions) if num_partitions \
        else spark.range(0, total)
    stride = 1
    strides = []
    for n in reversed(sizes):
        strides.append(stride)
        stride *= n
    strides.reverse()
    for name, (idx, n), s in zip(names, indexed, strides):
        grid = (grid.withColumn(f"_sg_{name}", (F.expr(f"id div {s}") % F.lit(n)).cast("bigint"))
                    .join(idx, f"_sg_{name}", "inner"))
    return grid.select(run_name(names).alias(run), *names)


def decode_run(run: Column, names) -> list[Column]:
    """Run name -> one column per parameter (values as strings), in the
    ``_<name><value>`` layout; values may contain ``_``."""
    names = list(names)
    pat = "^" + "".join(f"_{re.escape(n)}(.*)" for n in names) + "$"
    return [F.regexp_extract(run, pat, i + 1).alias(n) for i, n in enumerate(names)]
