"""Mixing sources to target weights by Poisson replication (built-in functions only).

With target weight ``w`` (of all sources present: sum 1), a source of ``n`` of
the ``N`` rows is to be repeated ``rate = epochs * w * N / n`` times on average.
Each row draws its number of copies from Poisson(rate): a uniform number from a
hash of seed and key is put through the inverse of the distribution function.
A rate above ``CHUNK`` is split into equal parts that are drawn apart and
added (a sum of Poisson numbers is one), so the table of the function stays
short at any rate and no count is capped.  The row is exploded by its count and the copies are put
into one global random order, by a hash of seed, key and copy.  Nothing is
drawn at run time, so a lost executor's rows come back alike.

The sources are counted by one partial aggregation over one column.  Their table is
broadcast up to ``MAX_SOURCES`` rows and joined by shuffle beyond.  The order
needs one exchange of the rows, by ranges of the hash, which is uniform, so a hot
source does not make a hot task.

Defined results: a null source is a source of its own; a null key draws like
``''``; rows with equal keys get equal counts; sources without weight
(``weights`` given) are dropped, as weight 0 says; an empty table gives no rows;
input columns called ``copy`` or ``position`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .frames import add, any_names, uniform, unused

CHUNK = 16.0
STEPS = 120  # P(Poisson(16) > 120) is far below 2 ** -52
MAX_SOURCES = 100_000
SEED, ALPHA = "mix-1", 0.5  # production parameters: weight as the root of a source's size


def _thresholds(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... below 1, for X of Poisson(rate)."""
    p0 = F.exp(-rate)
    start = F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("all"))

    def step(a, k):
        p = a["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.concat(a["all"], F.array(a["c"] + p)).alias("all"))

    table = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda a: a["all"])
    return F.filter(table, lambda c: c < 1.0)


def rates(df: DataFrame, source: str, weights: dict | None = None, alpha: float = ALPHA,
          epochs: float = 1.0) -> DataFrame:
    """``source, n, rate, parts, thresholds``, one row for each source.

    Without ``weights`` a source's weight is ``n ** alpha`` over the sum.
    """
    n = df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    else:
        if any(x < 0 for x in weights.values()):
            raise ValueError("weights must not be negative")
        w = F.lit(0.0)
        for s, x in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(x))).otherwise(w)
    n = n.withColumn("w", w)
    total = n.agg(F.sum("n").alias("rows"), F.sum("w").alias("weight")).first()
    share = F.col("w") / F.lit(float(total["weight"] or 1.0))
    rate = F.lit(float(epochs)) * share * F.lit(float(total["rows"] or 0)) / F.col("n").cast("double")
    n = n.where("w > 0")
    n = n.withColumn("rate", rate).withColumn("parts", F.ceil(F.col("rate") / CHUNK).cast("int"))
    return n.withColumn("thresholds", _thresholds(F.col("rate") / F.col("parts").cast("double"))) \
            .select("source", "n", "rate", "parts", "thresholds")


def replicate(df: DataFrame, source: str, key: str, seed: str = SEED, weights: dict | None = None,
              alpha: float = ALPHA, epochs: float = 1.0) -> DataFrame:
    """``df`` with each row as often as drawn, numbered by ``copy`` from 0 (in no order)."""
    s, parts, table, n = unused(df, "source", "parts", "table", "copies")
    by_source = rates(df, source, weights, alpha, epochs) \
        .select(F.col("source").alias(s), F.col("parts").alias(parts), F.col("thresholds").alias(table))
    if by_source.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES:
        by_source = F.broadcast(by_source)
    out = df.join(by_source, df[source].eqNullSafe(by_source[s]))

    draws = F.transform(F.sequence(F.lit(1), out[parts]), lambda part: uniform(F.lit(seed), df[key], part))
    count = F.aggregate(draws, F.lit(0), lambda total, u: total + F.size(F.filter(out[table], lambda c: c <= u)))
    out = out.withColumn(n, count).where(F.col(n) > 0)
    copies = F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    return out.select(*[df[c] for c in df.columns if c.lower() != "copy"], copies.alias("copy"))


def shuffled(df: DataFrame, key: str, seed: str = SEED, partitions: int | None = None) -> DataFrame:
    """``df`` in one global random order: sorted by ``position``, a hash in [0, 1).

    Partition ``i`` of ``n`` holds the positions from ``i / n``; no sampling pass is needed.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = add(df, position=uniform(F.lit(seed), F.lit("order"), df[key], df["copy"]))
    return out.repartitionById(n, F.floor(F.col("position") * n).cast("int")) \
              .sortWithinPartitions("position", key, "copy")


@any_names
def mix(df: DataFrame, source: str = "source", key: str = "doc_id", seed: str = SEED,
        weights: dict | None = None, alpha: float = ALPHA, epochs: float = 1.0) -> DataFrame:
    """Replicate and shuffle: the columns of ``df``, ``copy`` and ``position``."""
    return shuffled(replicate(df, source, key, seed, weights, alpha, epochs), key, seed)
