"""Window operators, in the one-task and in the split plan."""

import random
from datetime import date

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.aggregates import exact_median, mode_per_group
from tallyloom.operators.windows import (
    Lag,
    Lead,
    RowNumber,
    Running,
    by_group_size,
    first_last,
    first_rows,
    group_values,
    moving_average,
    moving_days,
    moving_rows,
    ntile_column,
    ordered_columns,
    rank_columns,
    top_ranked,
)
from tallyloom.session import GROUP_ROWS_KEY
from tests.conftest import rows

MEASURES = [
    RowNumber("rn"), Running("total", "v"), Running("n", "v", "count"), Running("high", "v", "max"),
    Running("low", "v", "min"), Lag("before", "v"), Lead("behind", "v"),
]


def skewed(spark, n=240, seed=7):
    """A third of the rows has one key; keys, values and orders may be NULL."""
    r = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else r.choice(["a", "b", "c", "d", None])
        at = r.choice([None, *range(12)])
        data.append((key, at, i, r.choice([None, *range(-5, 20)])))
    return spark.createDataFrame(data, "k string, at int, id int, v int").repartition(4)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("order", [["at", "id"], ["-at", "-id"]])
def test_split_equals_one_task(spark, keys, order):
    df = skewed(spark)
    plain = rows(ordered_columns(df, keys, order, MEASURES))
    spark.conf.set(GROUP_ROWS_KEY, "5")
    try:
        assert by_group_size(df, keys).large is not None
        assert rows(ordered_columns(df, keys, order, MEASURES)) == plain
    finally:
        spark.conf.unset(GROUP_ROWS_KEY)


@pytest.mark.parametrize("limit, large", [(5, {"hot", "a", "b", "c", "d", None}), (60, {"hot"}), (100, set())])
def test_only_large_groups_are_split(spark, limit, large):
    """One hot key among others: all groups, the hot one, or none take the plan
    for large groups; the results are the same."""
    df = skewed(spark)
    plain = rows(ordered_columns(df, ["k"], ["at", "id"], MEASURES))
    spark.conf.set(GROUP_ROWS_KEY, str(limit))
    try:
        groups = by_group_size(df, ["k"])
        split = [] if groups.large is None else groups.large.select("k").collect()
        assert {r.k for r in split} == large and groups.large_rows == len(split)
        assert rows(ordered_columns(df, ["k"], ["at", "id"], MEASURES)) == plain
    finally:
        spark.conf.unset(GROUP_ROWS_KEY)


def test_large_group_among_many_keys(spark):
    """More keys than the summary tracks: the hot one is found, and no small one
    is missing from the results. Names with a space and NULL keys are fine."""
    kind = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id"))
    df = spark.range(300_000).select(kind.alias("k 1"), "id")
    spark.conf.set(GROUP_ROWS_KEY, "50000")
    try:
        groups = by_group_size(df, ["k 1"])
        assert groups.large_rows >= 100_000 and groups.large.count() == 100_000
        got = ordered_columns(groups.large, [], ["id"], [RowNumber("n")])
        assert got.agg(F.max("n"), F.count_distinct("n")).first() == (100_000, 100_000)
        assert groups.plain.count() == 200_000
    finally:
        spark.conf.unset(GROUP_ROWS_KEY)


def test_no_rows_above_the_bound(spark, split_groups):
    empty = spark.createDataFrame([], "k string, at int, id int, v int")
    groups = by_group_size(empty, ["k"], 10)
    assert groups.large is None and rows(groups.plain) == []


@pytest.mark.parametrize("keys", [["k"], []])
def test_split_ranks_and_tiles(spark, keys):
    df = skewed(spark)

    def ranks():
        return rows(rank_columns(df, keys, ["-v"], "r", "d", "p"))

    def tiles(n):
        return rows(ntile_column(df, keys, ["v", "id"], n, "tile"))

    plain = ranks(), tiles(4), tiles(7), tiles(500)
    spark.conf.set(GROUP_ROWS_KEY, "5")
    try:
        assert (ranks(), tiles(4), tiles(7), tiles(500)) == plain
    finally:
        spark.conf.unset(GROUP_ROWS_KEY)


def test_all_rows_tied_in_split_rank(split_groups):
    df = split_groups.range(40).select(F.lit(1).alias("v"))
    assert set(rows(rank_columns(df, [], ["v"], "r", "d", "p"))) == {(1, 1, 1, 0.0)}


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "k string, at int, id int, v int")
    assert rows(ordered_columns(empty, ["k"], ["at"], MEASURES)) == []
    one = spark.createDataFrame([("a", 1, 1, 5)], "k string, at int, id int, v int")
    got = rows(ordered_columns(one, ["k"], ["at"], MEASURES))
    assert got == [("a", 1, 1, 5, 1, 5, 1, 5, 5, None, None)]


def test_group_values_keeps_null_group(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v int")
    got = rows(group_values(df, ["k"], {"s": F.sum("v"), "n": F.count("v")}))
    assert got == [("a", 1, 1, 1), (None, 2, 5, 2), (None, 3, 5, 2)]
    assert rows(group_values(df, [], {"s": F.sum("v")}))[0][-1] == 6


def test_first_rows_and_top_ranked(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 2, 9), ("a", 3, 8), ("b", 4, 1)], "k string, id int, v int")
    assert rows(first_rows(df, ["k"], ["-v", "id"])) == [("a", 1, 9), ("b", 4, 1)]
    # Both rows that share the first rank are kept.
    assert [r[1] for r in rows(top_ranked(df, ["k"], ["-v"], 1, "r"))] == [1, 2, 4]
    got = rows(first_last(df, ["k"], ["id"], "v", "first", "last"))
    assert got == [("a", 9, 8), ("b", 1, 1)]


def test_moving_average_counts_rows_not_days(spark):
    days = [(date(2024, 1, d), float(d)) for d in (11, 12, 20)]
    series = spark.createDataFrame(days, "d date, v double")
    assert [r[2] for r in rows(moving_average(series, "d", "v", "m", rows=2))] == [11.0, 11.5, 16.0]


def test_exact_median(spark):
    data = [("a", 1.0), ("a", 3.0), ("a", 3.0), ("a", 10.0), ("b", 5.0), ("b", 6.0), ("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    want = [("a", 3.0), ("b", 5.5)]
    assert rows(exact_median(df, ["k"], "v", "m")) == want
    spark.conf.set(GROUP_ROWS_KEY, "2")
    try:
        assert rows(exact_median(df, ["k"], "v", "m")) == want
        assert rows(exact_median(df, [], "v", "m")) == [(4.0,)]
    finally:
        spark.conf.unset(GROUP_ROWS_KEY)


def test_mode_takes_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "w"), ("a", None), ("a", None)], "k string, v string")
    assert rows(mode_per_group(df, ["k"], "v", "m", "n")) == [("a", "w", 1)]


@pytest.mark.parametrize("band", [1, 8, 100])
def test_moving_frames_in_bands(spark, split_groups, band):
    data = [(k, k % 3 if k % 7 else None, date(2024, 1, 1 + (k * k) % 29) if k % 11 else None, k) for k in range(200)]
    df = spark.createDataFrame(data, "id int, g int, d date, v long")
    by_row = W.partitionBy("g").orderBy(F.col("d").asc_nulls_last(), "id").rowsBetween(-4, 0)
    want = df.withColumn("s", F.sum("v").over(by_row)).withColumn("n", F.count("*").over(by_row))
    got = moving_rows(df, ["g"], ["d", "id"], {"s": F.sum("v"), "n": F.count("*")}, 5, band=band)
    assert rows(got) == rows(want)
    whole = moving_rows(df, [], ["d", "id"], {"s": F.sum("v")}, 5, band=band)
    assert rows(whole) == rows(df.withColumn("s", F.sum("v").over(W.orderBy(F.col("d").asc_nulls_last(), "id").rowsBetween(-4, 0))))
    by_day = W.partitionBy("g").orderBy(F.unix_date("d")).rangeBetween(-6, 0)
    want = df.withColumn("s", F.sum("v").over(by_day)).withColumn("n", F.count(F.lit(1)).over(by_day))
    assert rows(moving_days(df, ["g"], "d", {"s": "v"}, 7, "n", band=band)) == rows(want)
