"""Exact money and safe arithmetic.

Money is an integer count of minor units (cents). Sums of integers do not
depend on the order in which tasks deliver them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_minor(amount: Column | str, scale: int = 100) -> Column:
    """Major units (double) to an integer count of minor units.

    Rounds half away from zero. Written with floor and ceil: ``round`` on a
    double goes through a decimal for every row. NaN, infinities and what does
    not fit a 64-bit integer become NULL.
    """
    col = F.col(amount) if isinstance(amount, str) else amount
    scaled = col * float(scale)
    rounded = F.when(scaled < 0, F.ceil(scaled - 0.5)).otherwise(F.floor(scaled + 0.5))
    return F.when(F.abs(scaled) < 9.2e18, rounded)  # NaN compares as larger


def to_major(minor: Column | str, scale: int = 100) -> Column:
    """Integer minor units to major units as a double."""
    col = F.col(minor) if isinstance(minor, str) else minor
    return col.cast("double") / float(scale)


def to_major_if(value: Column, condition: Column, scale: int = 100) -> Column:
    """Convert only the rows that hold minor units (a fixed amount, not a percent)."""
    return F.when(condition, to_major(value, scale)).otherwise(value.cast("double"))


def line_total_minor(quantity: Column, unit_minor: Column, discount_pct: Column) -> Column:
    """``quantity * price * (100 - discount)`` in hundredths of a minor unit."""
    return quantity.cast("bigint") * unit_minor * (F.lit(100) - discount_pct.cast("bigint"))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``; NULL when the divisor is zero or NULL."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def ratio_or(top: Column, bottom: Column, default: float = 0.0) -> Column:
    return F.coalesce(ratio(top, bottom), F.lit(default))


def percent(top: Column, bottom: Column) -> Column:
    return ratio(top, bottom) * 100.0


def margin_percent(price: Column, cost: Column) -> Column:
    return percent(price - cost, price)


def weighted_score(parts: list[tuple[Column, float]]) -> Column:
    """Sum of ``weight * value``; a missing value counts as zero."""
    total = F.lit(0.0)
    for value, weight in parts:
        total = total + F.coalesce(value.cast("double"), F.lit(0.0)) * float(weight)
    return total
