"""Models with parameters: ordinary keyword arguments with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_least(df: DataFrame, column: str, minimum: float = 5000) -> DataFrame:
    return df.filter(F.col(column) >= minimum)


def with_value(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.filter(F.col(column) == value)


def between_dates(
    df: DataFrame, column: str, start: str = "2023-01-01", end: str = "2024-12-31"
) -> DataFrame:
    """Rows whose date lies in the closed range. The column is compared as it
    is stored, so the filter reaches the Parquet scan."""
    last = F.date_add(F.lit(end).cast("date"), 1)
    return df.filter((F.col(column) >= F.lit(start).cast("date")) & (F.col(column) < last))


def switchable(df: DataFrame, condition: Column, include_all: bool = False) -> DataFrame:
    return df if include_all else df.filter(condition)


def for_target(df: DataFrame, condition: Column, target: str = "dev") -> DataFrame:
    """The filter applies in production only."""
    return df.filter(condition) if target == "prod" else df


def most_recent(df: DataFrame, order: list[Column], limit_rows: int = 50) -> DataFrame:
    return df.orderBy(*order).limit(limit_rows)
