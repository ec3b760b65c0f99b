"""Conditional columns: tiers, code maps, flags, ordered rules, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tiers(
    value: Column,
    bands: list[tuple[float, str]],
    top: str,
    missing: str | None = None,
    inclusive: bool = False,
) -> Column:
    """Label a number by ascending upper limits.

    ``bands`` lists ``(limit, label)``; a value below the limit (or equal to
    it when ``inclusive``) takes the label, anything above the last limit
    takes ``top``. A NULL value takes ``missing``, never a band.
    """
    label = F.when(value.isNull(), F.lit(missing))
    for limit, name in bands:
        label = label.when(value <= limit if inclusive else value < limit, name)
    return label.otherwise(top)


def map_codes(code: Column, groups: dict[str, list], default: str | None = None) -> Column:
    """Replace a code by the group that lists it."""
    label = None
    for group, codes in groups.items():
        hit = code.isin(*codes)
        label = F.when(hit, group) if label is None else label.when(hit, group)
    return label.otherwise(F.lit(default))


def value_flags(code: Column, values: list[str], prefix: str = "is_") -> list[Column]:
    """One boolean column per value; NULL codes give NULL flags."""
    return [(code == v).alias(prefix + flag_name(v)) for v in values]


def flag_name(value: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in value.lower())


def first_match(rules: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule that holds."""
    label = None
    for condition, value in rules:
        label = F.when(condition, value) if label is None else label.when(condition, value)
    return label.otherwise(F.lit(default))


def range_map(value: Column, ranges: list[tuple[int, int, object]]) -> Column:
    """Rule-based key: the result of the closed range that holds the value."""
    return first_match([(value.between(low, high), key) for low, high, key in ranges])


def completeness(checks: list[Column]) -> Column:
    """How many of the checks hold."""
    score = F.lit(0)
    for check in checks:
        score = score + F.coalesce(check, F.lit(False)).cast("int")
    return score.cast("bigint")


def text_or(value: Column, default: str) -> Column:
    """Any value as text, ``default`` when NULL."""
    return F.coalesce(value.cast("string"), F.lit(default))


def first_present(*values: Column, default: str) -> Column:
    """First value that is neither NULL nor blank, else ``default``."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(default))


def sentinel(value: Column, stand_in: object) -> Column:
    """A stand-in for a missing key or date."""
    return F.coalesce(value, F.lit(stand_in))
