"""Segmented scans: forcing every key to be "hot" (split into buckets) must
not change any result."""

import pytest
from pyspark.sql import Window, functions as F

from helpers import SF_SMALL, rows
from fleetlens.operators.asof import next_event
from fleetlens.operators.lifecycle import lifecycle_check
from fleetlens.operators.ordering import order_tasks, timeline
from fleetlens.plans.catalog import EVENT_ORDER, LINE_COLS, LINE_ORDER, _action
from fleetlens.plans.scan import bucketize
from fleetlens.sources.tables import table


@pytest.fixture(scope="module")
def lines(spark):
    return table(spark, SF_SMALL, "lineitem").select(*LINE_COLS)


@pytest.fixture(scope="module")
def events(spark):
    return table(spark, SF_SMALL, "events")


def test_hot_keys_are_split(events):
    b = bucketize(events, ["user_id"], EVENT_ORDER, hot_rows=3)
    per_key = b.groupBy("user_id").agg(F.countDistinct("_sg_b").alias("nb"), F.count("*").alias("n"))
    assert per_key.filter("n >= 6 AND nb < 2").count() == 0
    assert b.groupBy("user_id", "_sg_b").count().filter("count > 6").count() == 0


@pytest.mark.parametrize("kind", ["all equal", "seven values", "one outlier", "strings"])
def test_buckets_of_one_key_are_bounded(spark, kind):
    """Ties and outliers of the leading order column do not pile up in a bucket."""
    lead = {"all equal": F.lit(5), "seven values": F.col("id") % 7, "strings": F.concat(F.lit("s"), F.col("id") % 3),
            "one outlier": F.when(F.col("id") == 0, F.lit(10 ** 15)).otherwise(F.col("id") % 1000)}[kind]
    df = spark.range(200_000).select(F.lit("k").alias("k"), lead.alias("a"), F.col("id").alias("b"))
    sizes = bucketize(df, ["k"], ["a", "b"], hot_rows=1000).groupBy("_sg_b").count()
    assert sizes.agg(F.max("count")).first()[0] <= 3000
    assert sizes.count() > 100


@pytest.mark.parametrize("rows_in", [1_000, 20_000, 200_000])
def test_the_sample_does_not_grow(spark, rows_in):
    """At any input size the sample has at most so many tuples, also of one key, and enough of them to cut it."""
    from fleetlens.plans.scan import _sample, boundaries
    df = spark.range(rows_in).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), F.col("id").alias("a"))
    n = _sample(df, ["k"], ["a"], 1, 2_000).count()
    assert n == rows_in if rows_in <= 2_000 else 500 < n <= 2_000
    b = boundaries(df, ["k"], ["a"], hot_rows=16, max_samples=2_000).collect()
    assert [r["k"] for r in b] == ["hot"] and 10 < len(b[0]["_sg_bounds"]) <= 2_000 / 16
    same = spark.range(rows_in).select(F.lit("k").alias("k"), F.lit(1).alias("a"))
    assert [r["_sg_c"] for r in _sample(same, ["k"], ["a"], 1, 2_000).collect()] == [rows_in]


def test_many_boundaries_are_found_in_two_steps(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    got = bucketize(df, ["k"], ["a"], hot_rows=2).groupBy("_sg_b").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    assert all(r["lo"] == 2 * r["_sg_b"] and r["hi"] == r["lo"] + 1 for r in got.collect())


def test_building_a_query_starts_no_job(spark):
    from fleetlens.plans.catalog import QUERIES
    names = ["reconcile", "next_event", "first_wins", "last_wins", "order_tasks", "timeline", "flatten_paths",
             "lifecycle_check", "launch_probe", "stop_escalation"]
    sc, ran = spark.sparkContext, {}
    for n in names:
        sc.setJobGroup(f"build-{n}", n)
        QUERIES[n](spark, SF_SMALL)
        ran[n] = len(sc.statusTracker().getJobIdsForGroup(f"build-{n}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    # reading a table's schema is one job
    tables = {"reconcile": 2}
    assert all(v <= tables.get(n, 1) for n, v in ran.items()), ran


@pytest.mark.parametrize("hot", [1, 3])
def test_honoured_stop_order_same(lines, hot):
    kw = dict(honor_stop_order=True, stop_order="l_suppkey")
    x = lines.withColumn("l_suppkey", F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey")))
    order = [c for c in LINE_ORDER if c != "l_suppkey"]
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_suppkey").isNull(), "l_suppkey", *[F.col(c).desc() for c in order])
    want = x.withColumn("stop_rank", F.row_number().over(w).cast("bigint"))
    got = order_tasks(x, ["l_orderkey"], order, hot_rows=hot, **kw)
    assert rows(got, *LINE_COLS, "stop_rank") == rows(want, *LINE_COLS, "stop_rank")
    cost = dict(start_cost=F.col("l_quantity").cast("bigint"), stop_cost=F.col("l_linenumber").cast("bigint"), stop_after=70)
    assert rows(timeline(x, ["l_orderkey"], order, **cost, **kw)) == rows(timeline(x, ["l_orderkey"], order, hot_rows=hot, **cost, **kw))


@pytest.mark.parametrize("hot", [1, 3])
def test_order_tasks_same(lines, hot):
    a = order_tasks(lines, ["l_orderkey"], LINE_ORDER)
    b = order_tasks(lines, ["l_orderkey"], LINE_ORDER, hot_rows=hot)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("hot", [1, 3])
def test_timeline_same(lines, hot):
    kw = dict(start_cost=F.col("l_quantity").cast("bigint"),
              stop_cost=F.col("l_linenumber").cast("bigint"), stop_after=70)
    a = timeline(lines, ["l_orderkey"], LINE_ORDER, **kw)
    b = timeline(lines, ["l_orderkey"], LINE_ORDER, hot_rows=hot, **kw)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("hot", [2, 5])
def test_lifecycle_same(events, hot):
    ev = events.filter(F.col("event_type").isin("signup", "error", "purchase"))
    a = lifecycle_check(ev, ["user_id"], EVENT_ORDER, _action())
    b = lifecycle_check(ev, ["user_id"], EVENT_ORDER, _action(), hot_rows=hot)
    assert rows(a, "event_id", "verdict") == rows(b, "event_id", "verdict")


@pytest.mark.parametrize("hot", [2, 5])
def test_next_event_same(events, hot):
    kw = dict(is_from=F.col("event_type") == "error", is_to=F.col("event_type") == "purchase",
              carry=["event_id"])
    a = next_event(events, ["user_id"], EVENT_ORDER, **kw)
    b = next_event(events, ["user_id"], EVENT_ORDER, hot_rows=hot, **kw)
    assert rows(a, "event_id", "next_event_id", "delay_us") == rows(b, "event_id", "next_event_id", "delay_us")


def _random_frame(spark, seed, n=400):
    import random
    rnd = random.Random(seed)
    keys = [None, "a", "b", "c"] + [f"k{i}" for i in range(5)]
    weights = [1, 30, 10, 5] + [1] * 5          # one key holds most rows
    data = []
    for i in range(n):
        k = rnd.choices(keys, weights)[0]
        t = None if rnd.random() < 0.05 else rnd.randint(-50, 50)
        data.append((i, k, t, rnd.randint(0, 3), rnd.random() < 0.4))
    return spark.createDataFrame(data, "id bigint, k string, t int, c int, flag boolean")


@pytest.mark.parametrize("seed,hot", [(1, 7), (2, 20), (3, 1), (4, 50)])
def test_prefix_scan_matches_plain_windows(spark, seed, hot):
    """Random data with null keys, null and tied order values: every measure
    kind, both directions, equals a plain per-key window."""
    from fleetlens.plans.scan import prefix_scan
    df = _random_frame(spark, seed)
    order = ["t", "id"]
    b = bucketize(df, ["k"], order, hot_rows=hot)
    assert b.filter("_sg_hot").count()
    measures = [("n", "count", None), ("s", "sum", F.col("c")), ("o", "or", F.col("flag")),
                ("l", "last", F.when(F.col("flag"), F.col("id"))), ("tot", "total", F.col("c"))]
    up = prefix_scan(b, ["k"], order, measures)
    down = prefix_scan(b, ["k"], order, measures[:4], descending=True)
    for got, desc in ((up, False), (down, True)):
        ordc = [F.col(c).desc() if desc else F.col(c).asc() for c in order]
        w = Window.partitionBy("k").orderBy(*ordc).rowsBetween(Window.unboundedPreceding, -1)
        want = df.select(
            "id", F.count(F.lit(1)).over(w).alias("n"), F.sum("c").over(w).alias("s"),
            F.max("flag").over(w).alias("o"),
            F.last(F.when(F.col("flag"), F.col("id")), ignorenulls=True).over(w).alias("l"),
            F.sum("c").over(Window.partitionBy("k")).alias("tot"))
        cols = ["id", "n", "s", "o", "l"] + ([] if desc else ["tot"])
        assert rows(got, *cols) == rows(want, *cols), (seed, hot, desc)
