"""Unions of sources into timelines, ledgers and registries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(DataFrame.unionByName, frames)


def union_padded(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL; a column a source lacks is NULL of the right type."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    """UNION: each side is made distinct first, so duplicates are dropped
    before the exchange."""
    return union_rows([f.distinct() for f in frames]).distinct()


def tagged(df: DataFrame, tag: str, **columns: Column) -> DataFrame:
    """One timeline source: a constant type and the shared columns."""
    return df.select(F.lit(tag).alias("event_type"), *[c.alias(n) for n, c in columns.items()])


def union_sources(
    sources: dict[str, DataFrame], mapper: Callable[[str, DataFrame], DataFrame]
) -> DataFrame:
    """A union generated from a list of sources by one mapping function."""
    return union_rows([mapper(name, df) for name, df in sources.items()])


class UnionTypeError(TypeError):
    """The two sides of a strict union differ."""


def union_strict(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL that refuses to coerce.

    Spark widens types silently (date and timestamp become timestamp); here
    names and types have to be the same.
    """
    first = {f.name: f.dataType.simpleString() for f in frames[0].schema}
    for number, frame in enumerate(frames[1:], start=2):
        other = {f.name: f.dataType.simpleString() for f in frame.schema}
        if other != first:
            wrong = sorted(
                f"{name}: {first.get(name, 'missing')} / {other.get(name, 'missing')}"
                for name in first.keys() | other.keys()
                if first.get(name) != other.get(name)
            )
            raise UnionTypeError(f"source {number} differs in " + "; ".join(wrong))
    return union_rows(frames)


def first_dates(sources: dict[str, tuple[DataFrame, str, Column]], key: str) -> DataFrame:
    """Milestones: the first date per key and source, one row each."""
    return union_rows(
        [
            df.groupBy(F.col(source_key).alias(key)).agg(
                F.min(day).alias("event_date"), F.lit(name).alias("event_type")
            )
            for name, (df, source_key, day) in sources.items()
        ]
    )
