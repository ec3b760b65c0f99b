"""The supplied tables in the roles the models speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.dates import as_date
from tallyloom.functions.money import line_total_minor, to_minor
from tallyloom.sources.readers import Tables

UNITS = 10_000


def n_rows() -> Column:
    return F.count(F.lit(1))


def day() -> Column:
    return as_date(F.col("o_orderdate"))


def amount_cents() -> Column:
    return to_minor("o_totalprice")


def line_units() -> Column:
    """Line revenue after discount in hundredths of a cent, exact."""
    return line_total_minor(F.lit(1), to_minor("l_extendedprice"), to_minor("l_discount"))


def staged_orders(t: Tables) -> DataFrame:
    """Orders with a date and an integer amount in cents."""
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        day().alias("order_date"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        amount_cents().alias("amount"),
    )


def staged_events(t: Tables, *kinds: str) -> DataFrame:
    """Events of the given kinds, of all kinds without one, with an integer
    value and their campaign number."""
    events = t.events.filter(F.col("event_type").isin(*kinds)) if kinds else t.events
    return events.select(
        "event_id",
        "user_id",
        "ts",
        "event_type",
        to_minor("value").alias("value_cents"),
        F.get_json_object("props", "$.k").cast("bigint").alias("campaign_id"),
    )


def dollars(minor) -> Column:
    return (F.col(minor) if isinstance(minor, str) else minor).cast("double") / 100.0


def units_to_dollars(units) -> Column:
    col = F.col(units) if isinstance(units, str) else units
    return col.cast("double") / float(UNITS)
