"""Connected components of a table of links, without a driver or one task holding them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import saved


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each linked node reaches; a root itself has no row.

    ``links`` has the columns ``a`` and ``b`` in any order, repeats allowed.  Alternates two steps
    until nothing changes: each node links its larger neighbours to the smallest
    neighbour, then its smaller neighbours.  A long chain takes a number of rounds that grows with the logarithm of its
    length.  Each round is checkpointed.  A node with very many links only makes a hot join
    key, which Spark splits; minima are pre-aggregated.
    """
    links = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _state(links)) != before:
        before = now
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x"))
        links = saved(joined.select("x.a", "x.b").where("a <> b").distinct())
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
