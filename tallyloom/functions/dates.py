"""Date and time helpers.

All of them work on DATE or zone-less timestamps, so no result depends on a
session time zone. "Today" is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS = 1_000_000


def as_date(moment: Column) -> Column:
    return moment.cast("date")


def date_parts(moment: Column, prefix: str) -> list[Column]:
    """Year, quarter, month and day columns as bigint."""
    return [
        F.year(moment).cast("bigint").alias(f"{prefix}_year"),
        F.quarter(moment).cast("bigint").alias(f"{prefix}_quarter"),
        F.month(moment).cast("bigint").alias(f"{prefix}_month"),
        F.dayofmonth(moment).cast("bigint").alias(f"{prefix}_day"),
    ]


def hour_of(moment: Column) -> Column:
    return F.hour(moment).cast("bigint")


def hour_start(moment: Column) -> Column:
    return F.date_trunc("hour", moment).cast("timestamp_ntz")


def period_start(moment: Column, unit: str) -> Column:
    """First day of the week (Monday), month, quarter or year."""
    return F.trunc(as_date(moment), unit)


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(as_date(end), as_date(start)).cast("bigint")


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def seconds_between(start: Column, end: Column) -> Column:
    return micros_between(start, end).cast("double") / float(MICROS)


def minutes_between(start: Column, end: Column) -> Column:
    return micros_between(start, end).cast("double") / float(60 * MICROS)


def hours_between(start: Column, end: Column) -> Column:
    return micros_between(start, end).cast("double") / float(3600 * MICROS)


def whole_months_between(start: Column, end: Column) -> Column:
    """Calendar months crossed from ``start`` to ``end``."""
    years = F.year(end) - F.year(start)
    return (years * 12 + F.month(end) - F.month(start)).cast("bigint")


def iso_day(moment: Column) -> Column:
    """Monday is 1, Sunday is 7."""
    return (F.weekday(moment) + 1).cast("bigint")


def day_name(moment: Column) -> Column:
    return F.date_format(as_date(moment), "EEEE")


def iso_week(moment: Column) -> Column:
    return F.weekofyear(moment).cast("bigint")


def iso_year(moment: Column) -> Column:
    """The year the ISO week belongs to."""
    return F.extract(F.lit("YEAROFWEEK"), as_date(moment)).cast("bigint")


def quarter_label(moment: Column) -> Column:
    return F.concat(F.year(moment).cast("string"), F.lit("-Q"), F.quarter(moment).cast("string"))


def month_label(moment: Column) -> Column:
    return F.date_format(as_date(moment), "yyyy-MM")


def week_label(moment: Column) -> Column:
    week = F.lpad(iso_week(moment).cast("string"), 2, "0")
    return F.concat(iso_year(moment).cast("string"), F.lit("-W"), week)


def fiscal_year(moment: Column, first_month: int = 4) -> Column:
    """The calendar year in which the fiscal year starts."""
    return F.year(F.add_months(as_date(moment), 1 - first_month)).cast("bigint")


def fiscal_quarter(moment: Column, first_month: int = 4) -> Column:
    return F.quarter(F.add_months(as_date(moment), 1 - first_month)).cast("bigint")


def age_days(moment: Column, as_of: str) -> Column:
    return days_between(moment, F.lit(as_of).cast("date"))


def is_expired(end: Column, as_of: str) -> Column:
    return as_date(end) < F.lit(as_of).cast("date")


def days_left(end: Column, as_of: str) -> Column:
    """Days until ``end``; NULL once expired."""
    today = F.lit(as_of).cast("date")
    return F.when(as_date(end) >= today, days_between(today, end))


def time_band(moment: Column) -> Column:
    hour = F.hour(moment)
    return (
        F.when(hour.isNull(), None)
        .when(hour.between(6, 11), "morning")
        .when(hour.between(12, 17), "afternoon")
        .when(hour.between(18, 22), "evening")
        .otherwise("night")
    )


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day from ``start`` to ``end``."""
    return spark.sql(
        "SELECT explode(sequence(to_date(:start), to_date(:end), INTERVAL 1 DAY)) AS date_day",
        args={"start": start, "end": end},
    )


def spine_of(df: DataFrame, date_col: str) -> DataFrame:
    """One row per day between the first and the last date found in ``df``."""
    span = df.agg(F.min(date_col).alias("first"), F.max(date_col).alias("last"))
    days = F.sequence(as_date(F.col("first")), as_date(F.col("last")))
    return span.select(F.explode(days).alias("date_day"))
