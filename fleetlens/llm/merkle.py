"""Merkle manifest of a dataset, with every leaf's proof climbed by a recursive query.

``leaves``: a row's leaf is the digest of its fields.  ``build``: per group, leaves in order; while a level
has several nodes, every ``ARITY`` consecutive ones become the digest of their digests.  The groups' last nodes (subroots)
are the leaves of one more tree, whose last node is the root.  Every level is a stored table of node rows, each with its
parent's name and the digests of its siblings before and after it.  ``climb``: one Spark recursive query starts from all
leaves and steps from node to parent, appending siblings and folding the digest on the way; nothing of the
tree passes through the driver but the root.  The leaves of one run have the same path above it, so a run climbs as one row that
holds a fold for each of its leaves: an eighth of the rows, and siblings above the run are carried once.

Places in a group come from one range partitioning: a row's place in its partition, and the counts of the
group's earlier partitions.  A group with a third of all rows is spread over as many partitions as its rows need; runs have at most ``ARITY`` rows.

Defined results: a null field is ``-``, any other its UTF-8 byte count, ``:`` and value; a null group comes first and is not the empty
one; null order values come first; rows equal in group and order are in the order of their leaf; equal rows are each a leaf;
an empty table has no leaves and no root (None).  Other columns are kept in ``keep``, under any name; those
named like a result give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import column, saved

ARITY = 8


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the strings, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*fields: Column) -> Column:
    return digest(*[field(c) for c in fields])


def _places(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df``, stored, with ``pos`` (from 0, in its group) and ``n`` (rows of its group)."""
    part, at = F.shiftright("_at", 33), F.col("_at")
    salted = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))  # equal rows need not share a partition
    by = [*group, *order, "_salt"]
    ordered = saved(salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("_salt")
                    .withColumn("_at", F.monotonically_increasing_id()))
    counts = ordered.groupBy(*group, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
    parts = Window.partitionBy(*group)  # a row for each partition that the group has rows in
    before = F.coalesce(F.sum("_n").over(parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), "_first",
                           before.alias("_before"), F.sum("_n").over(parts).alias("n"))
    same = reduce(Column.__and__, [F.col(g) == F.col(f"_g{i}") for i, g in enumerate(group)], part == F.col("_p"))
    return ordered.join(counts, same).select(*df.columns, (at - F.col("_first") + F.col("_before")).alias("pos"), "n")


def _name(tree: int, group: Column, level: int, pos: Column) -> Column:
    return F.concat_ws("/", F.lit(tree), F.lit(level), pos, group)


def _levels(now: DataFrame, tree: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Node rows of the trees above ``grp, pos, n, hash`` (``n``: nodes that the group has on this level), and their tops (``grp, hash, node``)."""
    empty = now.where("false").select(*[F.lit("").alias(c) for c in ("node", "up", "before", "after")])
    nodes, tops = [], []
    while True:
        tops.append(now.where("n = 1").select("grp", "hash", _name(tree, F.col("grp"), level, F.col("pos")).alias("node")))
        run = F.expr(f"pos div {ARITY}")
        runs = now.where("n > 1").groupBy("grp", "n", run.alias("run")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("of"))
        runs = saved(runs.select("grp", "n", "run", F.transform("of", lambda x: x["hash"]).alias("of")))
        if runs.isEmpty():
            break
        up = _name(tree, F.col("grp"), level + 1, F.col("run"))
        nodes.append(runs.select("grp", "run", F.posexplode("of").alias("i", "hash"), "of", up.alias("up")).select(
            _name(tree, F.col("grp"), level, F.col("run") * ARITY + F.col("i")).alias("node"), "up",
            F.array_join(F.slice("of", 1, F.col("i")), "").alias("before"),
            F.array_join(F.slice("of", F.col("i") + 2, F.lit(ARITY)), "").alias("after")))
        now, level = _parents(runs, F.col("of")), level + 1
    return reduce(DataFrame.union, nodes, empty), reduce(DataFrame.union, tops)


def _parents(runs: DataFrame, hashes: Column) -> DataFrame:
    return runs.select("grp", F.col("run").alias("pos"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"),
                       digest(F.array_join(hashes, "")).alias("hash"))


@dataclass
class Manifest:
    """``runs``: ``grp, run, n`` and ``of``, the run's leaves in order (``hash`` and ``own``, the columns kept);
    ``nodes``: ``node, up, before, after`` of the nodes above them, but for the root;
    ``tops``: ``grp, subroot, node``; ``root``: its digest; ``root_node``: its name."""

    runs: DataFrame
    nodes: DataFrame
    tops: DataFrame
    root: str | None
    root_node: str | None


def build(df: DataFrame, group: str, order: list[str], hash: str, keep: list[str]) -> Manifest:
    """The manifest of ``df``, whose column ``hash`` is the rows' leaf, with the columns ``keep``; ``group`` is a string column."""
    # null before all others, and no group's name another's
    grp = F.coalesce(F.concat(F.lit("="), column(df, group)), F.lit(""))
    keyed = df.select(grp.alias("grp"), F.struct(*[column(df, c).alias(f"o{i}") for i, c in enumerate(order)]).alias("ord"),
                      column(df, hash).alias("hash"), F.struct(*[column(df, c) for c in keep]).alias("own"))
    leaves = _places(keyed, ["grp"], ["ord", "hash"])
    of = F.array_sort(F.collect_list(F.struct("pos", "hash", "own")), lambda x, y: (x["pos"] - y["pos"]).cast("int"))
    runs = leaves.groupBy("grp", "n", F.expr(f"pos div {ARITY}").alias("run")).agg(of.alias("of"))
    runs = saved(runs.select("grp", "n", "run", F.transform("of", lambda x: F.struct(x["hash"].alias("hash"), x["own"].alias("own"))).alias("of")))
    nodes, tops = _levels(saved(_parents(runs.where("n > 1"), F.transform("of", lambda x: x["hash"]))), 0, 1)
    lone = runs.where("n = 1").select("grp", F.col("of")[0]["hash"].alias("hash"), _name(0, F.col("grp"), 0, F.lit(0)).alias("node"))
    upper = saved(_places(tops.union(lone).select(F.lit("").alias("grp"), F.col("grp").alias("of"), "hash", F.col("node").alias("under")), ["grp"], ["of"]))
    above, top = _levels(upper, 1, 0)
    root = top.first()
    # a subroot is the node that its group ends in and a leaf of the upper tree: its name there is its parent's here
    name = _name(1, F.lit(""), 0, F.col("pos"))
    link = upper.select(F.col("under").alias("node"), name.alias("up"))
    renamed = nodes.alias("n").join(link.alias("l"), F.col("n.up") == F.col("l.node"), "left") \
        .select("n.node", F.coalesce("l.up", "n.up").alias("up"), "n.before", "n.after")
    tops = upper.select(F.col("of").alias("grp"), F.col("hash").alias("subroot"), name.alias("node"))
    return Manifest(runs, saved(renamed.union(above)), saved(tops), root and root["hash"], root and root["node"])


CLIMB = """
WITH RECURSIVE climb(run, at, folds, siblings) MAX RECURSION LEVEL 1000 AS (
  SELECT run, at, folds, '' FROM {runs}
  UNION ALL
  SELECT c.run, n.up, transform(c.folds, f -> sha2(concat(n.before, f, n.after), 256)), concat(c.siblings, n.before, n.after)
  FROM climb c JOIN {nodes} n ON n.node = c.at)
SELECT run, folds, siblings FROM climb WHERE at = :root"""


def climb(m: Manifest, claimed: str, keep: list[str]) -> DataFrame:
    """For every leaf ``keep``, ``leaf``, ``subroot``, ``root``, ``siblings`` (the proof: digests by level, left to right, joined) and
    ``folded`` (the root that follows from the digest ``claimed``, a column of the leaves, and the proof)."""
    keep = [c for c in keep if c.lower() not in ("leaf", "subroot", "root", "siblings", "folded")]
    # the first step: a run's leaves fold with the run's others (a group of one leaf has no run: the leaf is its subroot)
    folds = F.when(F.col("n") == 1, F.transform("of", lambda x: x["own"][claimed])).otherwise(F.transform("of", lambda x, i: digest(F.array_join(
        F.transform("of", lambda y, j: F.when(i == j, x["own"][claimed]).otherwise(y["hash"])), ""))))
    ends = m.tops.select(F.col("grp").alias("g"), F.col("node").alias("end"), "subroot")
    run = _name(0, F.col("grp"), 1, F.col("run"))
    # a run that is its group's only one folds to the subroot at once
    runs = m.runs.join(ends, F.col("grp") == F.col("g")).select(run.alias("run"), "of", "subroot", F.when(F.col("n") <= ARITY, F.col("end")).otherwise(run).alias("at"), folds.alias("folds"))
    if m.root is None:
        up = m.runs.select(F.lit("").alias("run"), F.array(F.lit("")).alias("folds"), F.lit("").alias("siblings"))
    else:
        up = _climbed(m, runs.select("run", "at", "folds"))
    up = up.select(F.col("run").alias("r"), F.col("folds").alias("roots"), "siblings")
    hashes = F.transform("of", lambda x: x["hash"])
    each = runs.select("run", "of", "subroot").join(up, F.col("run") == F.col("r")) \
        .select("subroot", "siblings", "roots", hashes.alias("hashes"), F.posexplode("of").alias("i", "x"))
    others = F.array_join(F.concat(F.slice("hashes", 1, F.col("i")), F.slice("hashes", F.col("i") + 2, F.lit(ARITY))), "")
    return each.select(*[F.col("x.own")[c].alias(c) for c in keep], F.col("x.hash").alias("leaf"), "subroot", F.lit(m.root).alias("root"),
                       F.concat(others, "siblings").alias("siblings"), F.get("roots", F.col("i")).alias("folded"))


def _climbed(m: Manifest, runs: DataFrame) -> DataFrame:
    """``run, folds, siblings`` at the root."""
    spark = runs.sparkSession
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the climb has a row for each run and level
    try:
        return saved(spark.sql(CLIMB, {"root": m.root_node}, runs=runs, nodes=m.nodes))
    finally:
        if limit is None:
            spark.conf.unset("spark.sql.cteRecursionRowLimit")
        else:
            spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
