"""Column functions, unions and projections on hand-written rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import conditions as cond
from tallyloom.functions import dates, money, text
from tallyloom.operators import aggregates, sets
from tallyloom.operators.aggregates import (
    any_true,
    estimated_distinct,
    estimated_quantile,
    guarded_avg,
    list_per_group,
    merge_sketches,
    pivot_sums,
    share_of_total,
    sorted_list,
    value_sketches,
)
from tallyloom.operators.projections import clean_columns, surrogate_key, with_load_stamp
from tallyloom.session import GROUP_ROWS_KEY
from tests.conftest import rows


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def d(text_):
    return F.lit(text_).cast("date")


def ts(text_):
    return F.lit(text_).cast("timestamp_ntz")


def test_money(spark):
    none = F.lit(None).cast("double")
    assert one(spark, money.to_minor(F.lit(1013.7)), money.to_minor(F.lit(-0.29)), money.to_major(F.lit(1999))) == (
        101370, -29, 19.99)
    assert one(spark, money.ratio(F.lit(1), F.lit(0)), money.ratio(none, F.lit(2)), money.ratio_or(F.lit(1), F.lit(0), -1.0)) == (
        None, None, -1.0)
    assert one(spark, money.weighted_score([(F.lit(2), 10), (none, 5), (F.lit(1), -3)])) == (17.0,)
    kind = F.lit("percent")
    assert one(spark, money.to_major_if(F.lit(250), kind == "fixed"), money.to_major_if(F.lit(250), kind == "percent")) == (250.0, 2.5)


@pytest.mark.parametrize(("day", "year", "week", "label"), [
    ("2021-01-03", 2020, 53, "2020-W53"), ("2021-01-04", 2021, 1, "2021-W01"), ("2024-12-30", 2025, 1, "2025-W01")])
def test_iso_weeks(spark, day, year, week, label):
    assert one(spark, dates.iso_year(d(day)), dates.iso_week(d(day)), dates.week_label(d(day))) == (year, week, label)


@pytest.mark.parametrize(("day", "fy", "fq"), [("2024-03-31", 2023, 4), ("2024-04-01", 2024, 1), ("2024-12-31", 2024, 3), ("2025-01-01", 2024, 4)])
def test_fiscal_calendar(spark, day, fy, fq):
    assert one(spark, dates.fiscal_year(d(day)), dates.fiscal_quarter(d(day))) == (fy, fq)


def test_dates(spark):
    a, b = ts("2024-01-31 23:59:59"), ts("2024-02-01 00:00:29.5")
    assert one(spark, dates.days_between(a, b), dates.seconds_between(a, b), dates.whole_months_between(a, b)) == (1, 30.5, 1)
    assert one(spark, dates.minutes_between(b, a), dates.hours_between(a, a)) == (-30.5 / 60, 0.0)
    monday = d("2024-01-01")
    assert one(spark, dates.iso_day(monday), dates.day_name(monday), dates.quarter_label(monday), dates.month_label(monday)) == (
        1, "Monday", "2024-Q1", "2024-01")
    assert one(spark, dates.period_start(d("2024-01-07"), "week"), dates.hour_start(a)) == (
        date(2024, 1, 1), datetime(2024, 1, 31, 23))
    assert one(spark, dates.is_expired(monday, "2024-01-01"), dates.days_left(monday, "2024-01-01"),
               dates.days_left(monday, "2024-01-02")) == (False, 0, None)
    bands = [one(spark, dates.time_band(ts(f"2024-01-01 {h:02d}:59:59")))[0] for h in (5, 6, 11, 12, 17, 18, 22, 23)]
    assert bands == ["night", "morning", "morning", "afternoon", "afternoon", "evening", "evening", "night"]


def test_date_spines(spark):
    spine = rows(dates.date_spine(spark, "2022-01-01", "2024-12-31"))
    assert len(spine) == 1096 and spine[0] == (date(2022, 1, 1),)
    df = spark.createDataFrame([(date(2024, 2, 28),), (date(2024, 3, 1),)], "x date")
    assert len(rows(dates.spine_of(df, "x"))) == 3
    assert rows(dates.spine_of(df.limit(0), "x")) == []


def test_results_do_not_depend_on_the_session_zone(spark):
    def look():
        a, b = ts("2024-03-31 00:30:00"), ts("2024-03-31 12:30:00")
        return one(spark, dates.hour_of(b), dates.hour_start(b), dates.iso_day(a), dates.period_start(b, "month"))

    utc = look()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert look() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_text(spark):
    none = F.lit(None).cast("string")
    assert one(spark, text.joined(F.lit("a"), none), text.joined_present(F.lit("a"), none, F.lit("b"))) == (None, "a b")
    assert one(spark, text.after(F.lit("u@x@y"), "@"), text.before(F.lit("u@x"), "@"), text.after(F.lit("u"), "@")) == ("x@y", "u", None)
    assert one(spark, text.initials(F.lit("ada"), F.lit("b")), text.length_or_zero(none), text.stars(F.lit(3))) == ("AB", 0, "***")
    assert one(spark, text.blank_to_null(F.lit("  ")), text.has_text(F.lit(" ")), text.has_text(none)) == (None, False, False)
    assert one(spark, text.strip(F.lit(" \x1f a b\n\x85"))) == ("a b",)
    assert text.clean_name(" Raw First-Name ", "raw ") == "first_name"


def test_conditions(spark):
    none = F.lit(None).cast("double")
    bands = [(1, "low"), (3, "mid")]
    got = one(spark, *[cond.tiers(F.lit(v), bands, "top", "none") for v in (0.5, 1.0, 3.0)], cond.tiers(none, bands, "top", "none"),
              cond.tiers(none, bands, "top"), cond.tiers(F.lit(3.0), bands, "top", inclusive=True))
    assert got == ("low", "mid", "top", "none", None, "mid")
    groups = {"digital": ["web", "mobile"], "voice": ["phone"]}
    assert one(spark, cond.map_codes(F.lit("phone"), groups), cond.map_codes(F.lit("fax"), groups, "other"), cond.map_codes(F.lit("fax"), groups)) == ("voice", "other", None)
    assert one(spark, cond.range_map(F.lit(11), [(1, 10, "a"), (11, 20, "b")]), cond.range_map(F.lit(99), [(1, 10, "a")])) == ("b", None)
    assert one(spark, cond.first_present(F.lit(" "), F.lit(None).cast("string"), F.lit(" x "), default="n")) == ("x",)
    assert one(spark, cond.text_or(d("2024-01-01"), "-"), cond.text_or(none, "-")) == ("2024-01-01", "-")
    assert one(spark, cond.completeness([F.lit(True), F.lit(False), none.isNull()])) == (2,)
    assert cond.flag_name("In Store") == "in_store"


def test_aggregates(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", None, 3), ("b", "x", 4)], "k string, c string, v int")
    assert rows(pivot_sums(df, ["k"], "c", ["x", "z"], F.col("v"), "sum")) == [("a", 1, 0), ("b", 4, 0)]
    got = df.groupBy("k").agg(guarded_avg(F.col("v"), 3), sorted_list(F.col("c")), any_true(F.col("c") == "y"))
    assert rows(got) == [("a", 2.0, "x, y", True), ("b", None, "x", False)]
    assert rows(share_of_total(df, ["k"], F.sum("v"), "s", "p")) == [("a", 6, 60.0), ("b", 4, 40.0)]
    assert share_of_total(df.limit(0), ["k"], F.sum("v"), "s", "p").count() == 0


def test_unions(spark):
    a = spark.createDataFrame([(1, date(2024, 1, 1))], "id int, at date")
    b = spark.createDataFrame([(1, datetime(2024, 1, 1))], "id int, at timestamp_ntz")
    with pytest.raises(sets.UnionTypeError, match="at: date / timestamp_ntz"):
        sets.union_strict([a, b])
    with pytest.raises(sets.UnionTypeError, match="at: date / missing"):
        sets.union_strict([a, b.drop("at")])
    assert sets.union_strict([a, b.withColumn("at", F.col("at").cast("date"))]).count() == 2
    assert sets.union_distinct([a, a]).count() == 1
    assert rows(sets.union_padded([a, a.drop("at")])) == [(1, None), (1, date(2024, 1, 1))]


def test_projections(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "`Raw Id` int, `Raw Name` string")
    assert clean_columns(df, "raw ").columns == ["id", "name"]
    keys = df.select(surrogate_key(F.col("Raw Id"), F.col("Raw Name")).alias("k"))
    assert rows(keys) == rows(keys.repartition(3))
    assert with_load_stamp(df, "2024-01-01 00:00:00").first()["loaded_at"] == datetime(2024, 1, 1)
    assert "loaded_at" in with_load_stamp(df).columns


@pytest.mark.parametrize("limit", ["1000000", "20"])
def test_list_of_a_giant_group(spark, monkeypatch, limit):
    """In one task and in pieces of three; NULLs, empty texts and repeats."""
    monkeypatch.setattr(aggregates, "LIST_PIECE", 3)
    data = [("hot", f"v{i % 97}") for i in range(500)] + [("hot", None), ("b", "y"), ("b", "x"), ("b", "x")]
    data += [("none", None), ("blank", ""), ("both", ""), ("both", "z"), (None, "q")]
    df = spark.createDataFrame(data, "k string, v string")
    spark.conf.set(GROUP_ROWS_KEY, limit)
    try:
        got = dict(rows(list_per_group(df, ["k"], "v", "l")))
        whole = rows(list_per_group(df, [], "v", "l"))
    finally:
        spark.conf.unset(GROUP_ROWS_KEY)
    hot = ", ".join(sorted({f"v{i}" for i in range(97)}))
    assert got == {"hot": hot, "b": "x, y", "none": None, "blank": "", "both": ", z", None: "q"}
    assert whole == [(", ".join(sorted({v for _, v in data if v is not None})),)]


def test_sketches_of_days_merge_to_wider_groups(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 30).alias("day"), (F.col("id") * 7 % 20_000).alias("buyer"),
        F.when(F.col("id") % 5 > 0, F.col("id") / 10).alias("v"),
    )
    stored = value_sketches(df, ["day"], "buyer", "v")
    wide = merge_sketches(stored, {"third": F.col("day") % 3})
    made = wide.select("third", estimated_distinct().alias("n"), estimated_quantile(0.5).alias("m")).collect()
    exact = {r.third: (r.n, r.m) for r in df.groupBy((F.col("day") % 3).alias("third")).agg(
        F.count_distinct("buyer").alias("n"), F.expr("percentile(v, 0.5)").alias("m")).collect()}
    assert len(made) == 3
    for r in made:
        n, m = exact[r.third]
        # Five standard errors of either.
        assert abs(r.n - n) <= 5 * 0.0163 * n and abs(r.m - m) <= 5 * 0.0133 * 6_000
    one = value_sketches(df.filter("v IS NULL"), ["day"], measured="v").select(estimated_quantile(0.5)).first()[0]
    assert one is None
    with pytest.raises(ValueError):
        value_sketches(df, ["day"])
