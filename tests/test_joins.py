"""Joins against brute force, ties, NULL keys, hot keys."""

import itertools
import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import joins
from tallyloom.operators.joins import (
    agg_then_join,
    ancestor_paths,
    basket_pairs,
    having_match,
    join_first,
    join_on_name,
    last_before,
    merge_intervals,
    next_after,
    outer_by_key,
    pairs_within_days,
    parent_levels,
    range_join,
    same_day,
    sum_in_intervals,
    without_match,
)
from tallyloom.session import GROUP_ROWS_KEY
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def test_aggregate_then_join_does_not_multiply(spark):
    parent = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    a = spark.createDataFrame([(1, 5), (1, 6), (None, 9)], "k int, v int")
    b = spark.createDataFrame([(1, 1), (1, 1), (1, 1)], "kk int, v int")
    got = agg_then_join(
        parent, "k", [(a, "k", {"s": F.sum("v")}), (b, "kk", {"n": F.count("v")})], {"n": 0}
    )
    assert rows(got) == [(1, 11, 3), (2, None, 0), (None, None, 0)]


def test_outer_by_key_keeps_every_date(spark):
    a = spark.createDataFrame([(date(2024, 1, 1), 2)], "d date, v int")
    b = spark.createDataFrame([(date(2024, 1, 2), 3)], "d date, v int")
    v = F.col("v")
    got = outer_by_key("d", [(a, F.col("d"), {"x": v}), (b, F.col("d"), {"y": v})])
    assert rows(got) == [(date(2024, 1, 1), 2, 0), (date(2024, 1, 2), 0, 3)]


def test_pairs_within_days(spark):
    r = random.Random(3)
    data = [(r.choice([1, 1, 2, None]), i, date(1969, 11, 1) + timedelta(days=r.randrange(150))) for i in range(80)]
    got = rows(pairs_within_days(spark.createDataFrame(data, "k int, id int, d date"), "k", "id", "d", 7))
    want = [
        (k, i, d, j, e)
        for (k, i, d), (m, j, e) in itertools.permutations(data, 2)
        if k is not None and k == m and abs((d - e).days) <= 7
    ]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize("width", [3, 100])
def test_basket_pairs_with_giants(spark, least, width):
    """Two baskets hold a large part of the rows."""
    r = random.Random(least * 100 + width)
    data = [(b, r.randrange(12)) for b in range(15) for _ in range(4)]
    data += [(b, i) for b in (100, 101, 102) for i in range(r.randrange(8, 14))]
    data += [(5, None)]
    df = spark.createDataFrame(data, "b int, i int")
    baskets = {}
    for b, i in data:
        if i is not None:
            baskets.setdefault(b, set()).add(i)
    counts = Counter(p for items in baskets.values() for p in itertools.combinations(sorted(items), 2))
    want = sorted(((a, b, n) for (a, b), n in counts.items() if n >= least), key=repr)
    got = basket_pairs(df, "b", "i", least, width=width)
    assert rows(got.select("item_a", "item_b", "pair_count")) == want


def test_basket_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """No task counts more than its share, whatever the shuffle settings; a pair
    that most baskets hold reaches its last count as a few rows."""
    monkeypatch.setattr(joins, "PAIRS_PER_TASK", 100)
    data = [(b, i) for b in range(400) for i in (1, 2, 1000 + b, 2000 + b)] + [(None, 1), (None, 2)]
    got = basket_pairs(spark.createDataFrame(data, "b int, i int"), "b", "i")
    per_task = Counter(r.p for r in got.select(F.spark_partition_id().alias("p")).collect())
    assert len(per_task) > 20 and max(per_task.values()) < 300
    counts = {(r.item_a, r.item_b): r.pair_count for r in got.collect()}
    assert counts.pop((1, 2)) == 400 and set(counts.values()) == {1} and len(counts) == 400 * 5


def events(spark, n, seed):
    r = random.Random(seed)
    data = [(r.choice(["u", "u", "v", "w"]), at(r.randrange(60)), i, r.randrange(9)) for i in range(n)]
    return data, spark.createDataFrame(data, "u string, ts timestamp_ntz, id int, v int")


@pytest.mark.parametrize("limit", [1000, 6])
def test_nearest_events(spark, limit):
    left, ldf = events(spark, 40, 1)
    right, rdf = events(spark, 30, 2)
    spark.conf.set(GROUP_ROWS_KEY, str(limit))
    try:
        back = rows(last_before(ldf, rdf, "u", "ts", "m").select("id", "m"))
        ahead = rows(next_after(ldf, rdf, "u", "ts", "m").select("id", "m"))
    finally:
        spark.conf.unset(GROUP_ROWS_KEY)
    want_back = [(i, max((s for k, s, _, _ in right if k == u and s <= t), default=None)) for u, t, i, _ in left]
    want_ahead = [(i, min((s for k, s, _, _ in right if k == u and s >= t), default=None)) for u, t, i, _ in left]
    assert back == sorted(want_back, key=repr) and ahead == sorted(want_ahead, key=repr)


@pytest.mark.parametrize("limit", [1000, 6])
def test_sums_in_overlapping_and_equal_intervals(spark, limit):
    r = random.Random(5)
    spans = [(r.choice(["u", "v"]), at(s := r.randrange(50)), at(s + r.randrange(20))) for _ in range(25)]
    spans += spans[:3]
    points, pdf = events(spark, 60, 6)
    sdf = spark.createDataFrame(spans, "u string, start timestamp_ntz, end timestamp_ntz")
    spark.conf.set(GROUP_ROWS_KEY, str(limit))
    try:
        got = rows(sum_in_intervals(sdf, pdf.withColumn("one", F.lit(1)), "u", "ts", {"n": "one", "s": "v"}))
    finally:
        spark.conf.unset(GROUP_ROWS_KEY)
    want = []
    for u, a, b in spans:
        inside = [v for k, t, _, v in points if k == u and a <= t <= b]
        want.append((u, a, b, len(inside), sum(inside)))
    assert got == sorted(want, key=repr)


def test_merge_intervals_touching_ends_join(spark):
    df = spark.createDataFrame([("u", at(h)) for h in (0, 2, 4, 9, 9, 30)], "u string, ts timestamp_ntz")
    got = rows(merge_intervals(df, ["u"], "ts", F.expr("INTERVAL 2 HOURS")))
    assert got == sorted([("u", at(0), at(6)), ("u", at(9), at(11)), ("u", at(30), at(32))], key=repr)


def test_matches_and_null_keys(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (1,), (None,)], "r int")
    assert rows(having_match(left, right, {"k": "r"})) == [(1,)]
    assert rows(without_match(left, right, {"k": "r"})) == [(2,), (None,)]


def test_same_day_ignores_null_keys(spark):
    a = spark.createDataFrame([("u", at(1)), ("u", at(30)), (None, at(1))], "u string, ts timestamp_ntz")
    b = spark.createDataFrame([("u", at(20)), ("u", at(21)), (None, at(1))], "u string, o timestamp_ntz")
    assert [r[-1] for r in rows(same_day(a, b, "u", "ts", "o", "hit"))] == [True, False, False]


def test_name_join_and_hierarchy(spark):
    a = spark.createDataFrame([(" Tools ",), ("None",)], "name string")
    b = spark.createDataFrame([("tools", 3)], "kind string, n int")
    assert rows(join_on_name(a, b, "name", "kind").select("name", "n")) == [(" Tools ", 3), ("None", None)]
    nodes = spark.createDataFrame([("c", "b", "C"), ("b", "a", "B"), ("a", None, "A")], "id string, up string, name string")
    got = rows(parent_levels(nodes, "id", "up", "name", 2))
    assert got == [("a", "A", None, None), ("b", "B", "A", None), ("c", "C", "B", "A")]


def test_join_first_keeps_unmatched_left_rows(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 5, "w"), (1, 6, "v")], "k int, o int, s string")
    assert rows(join_first(left, right, "k", ["o", "s"], "left")) == [(1, 5, "w"), (2, None, None)]


def test_hot_key_is_split_by_the_adaptive_skew_join(spark):
    """One key owns a third of the rows: its partition is cut for the join and
    the result stays whole."""
    facts = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"), "id",
        F.repeat(F.lit("x"), F.lit(40)).alias("pad"),
    )
    dims = spark.range(5000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("name"))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        joined = agg_then_join(facts.repartition(12), "k", [(dims, "k", {"name": F.max("name")})])
        assert joined.groupBy().agg(F.count("name")).first()[0] == 60_000
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for key in small:
            spark.conf.unset(key)


def test_null_keys_and_inverted_periods_match_nothing(spark):
    left = spark.createDataFrame([(None, at(5), 1), ("u", at(5), 2)], "u string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([(None, at(4)), (None, at(6)), ("u", at(3))], "u string, ts timestamp_ntz")
    assert rows(last_before(left, right, "u", "ts", "m").select("id", "m")) == [(1, None), (2, at(3))]
    assert rows(next_after(left, right, "u", "ts", "m").select("id", "m")) == [(1, None), (2, None)]
    periods = [(1, "u", at(0), at(9)), (2, "u", at(9), at(0)), (3, None, at(0), at(9)), (4, "u", at(0), None)]
    spans = spark.createDataFrame(periods, 'id int, u string, start timestamp_ntz, `end` timestamp_ntz')
    points = spark.createDataFrame([("u", at(1), 7), (None, at(1), 9), ("u", at(3), 5)], "u string, ts timestamp_ntz, v int")
    got = sum_in_intervals(spans, points, "u", "ts", {"s": "v"})
    assert rows(got.select("id", "s")) == [(1, 12), (2, 0), (3, 0), (4, 0)]


def chain(spark, n, cycle=False):
    data = [(k, k - 1 if k else (n - 1 if cycle else None), f"n{k}") for k in range(n)]
    return spark.createDataFrame(data, "id int, up int, name string")


def test_paths_of_a_long_chain(spark):
    got = {r.node: r for r in ancestor_paths(chain(spark, 1000), "id", "up", "name").collect()}
    assert len(got) == 1000 and got[999].depth == 999 and got[999].root == 0
    assert got[700].path == [f"n{k}" for k in range(701)] and not got[700].in_cycle


def test_cycles_orphans_and_repeated_nodes(spark):
    loop = chain(spark, 3, cycle=True).unionByName(spark.createDataFrame(
        [(10, 2, "below"), (20, 99, "orphan"), (21, 20, "child"), (21, 20, "a child"), (30, 30, "self"), (None, 20, "none"), (40, None, None)],
        "id int, up int, name string",
    ))
    got = {r.node: (r.root, r.depth, r.path, r.in_cycle) for r in ancestor_paths(loop, "id", "up", "name").collect()}
    lost = (None, None, None, True)
    assert got == {0: lost, 1: lost, 2: lost, 10: lost, 30: lost, 20: (20, 0, ["orphan"], False),
                   21: (20, 1, ["orphan", "a child"], False), 40: (40, 0, [None], False)}
    assert ancestor_paths(loop.limit(0), "id", "up", "name").count() == 0


def test_range_join_against_brute_force(spark):
    rng = random.Random(3)
    ranges = [(k, low, low + rng.randrange(-3, 1 << rng.randrange(1, 16))) for k in range(10_000) for low in [rng.randrange(-70_000, 70_000)]]
    ranges += [(-1, None, 5), (-2, 5, None), (-3, 0, 1 << 61), (-4, -(1 << 61), 0), (-5, 7, 7)]
    points = [(k, rng.randrange(-80_000, 80_000)) for k in range(300)] + [(900, None), (901, 7), (902, 0), (902, 0), (903, -1)]
    left = spark.createDataFrame(points, "p int, x long")
    right = spark.createDataFrame(ranges, "r int, low long, high long")
    joined = range_join(left, F.col("x"), right, F.col("low"), F.col("high"))
    want = sorted(
        (p, r) for p, x in points for r, a, b in ranges if None not in (x, a, b) and a <= x <= b
    )
    assert sorted((r.p, r.r) for r in joined.collect()) == want
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert range_join(left, F.col("x"), right.limit(0), F.col("low"), F.col("high")).count() == 0


def test_range_join_by_block_meets_no_range_twice(spark):
    """A point meets a row per level, not one per range that holds it."""
    rng = random.Random(4)
    ranges = [(k, low, low + rng.randrange(-2, 90)) for k in range(3_000) for low in [rng.randrange(-50, 50)]]
    ranges += [(-1, None, 5), (-2, 5, None), (None, 0, 3)]
    points = [(k, rng.randrange(-60, 150)) for k in range(100)] + [(900, None), (901, 7), (901, 7), (None, 1)]
    left = spark.createDataFrame(points, "p int, x int")
    right = spark.createDataFrame(ranges, "r int, low int, high int")
    sums = [F.count(F.lit(1)).alias("n"), F.min("r").alias("first")]
    held = range_join(left, F.col("x"), right, F.col("low"), F.col("high"), per_block=sums)
    assert held.count() <= 8 * len(points)
    want = {}
    for p, x in points:
        for r, a, b in ranges:
            if None not in (x, a, b) and a <= x <= b:
                n, first = want.get(p, (0, None))
                want[p] = n + 1, r if first is None else first if r is None else min(first, r)
    got = held.groupBy("p").agg(F.sum("n"), F.min("first")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want
