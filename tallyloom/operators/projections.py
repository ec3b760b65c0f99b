"""Staging projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import clean_name


def stage(
    df: DataFrame,
    rename: dict[str, str] | None = None,
    keep: list[str] | None = None,
    derive: dict[str, Column] | None = None,
) -> DataFrame:
    """Rename some columns, keep some, add derived ones, drop the rest."""
    return df.select(
        *[F.col(old).alias(new) for old, new in (rename or {}).items()],
        *[F.col(c) for c in (keep or [])],
        *[c.alias(name) for name, c in (derive or {}).items()],
    )


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.col(name).cast(kind) for name, kind in types.items()})


def surrogate_key(*natural: Column) -> Column:
    """A key that depends on the natural key only, not on partition or run."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in natural]
    return F.md5(F.concat_ws("|", *parts))


def with_load_stamp(df: DataFrame, as_of: str | None = None, name: str = "loaded_at") -> DataFrame:
    """Load time: the given moment, or the start of the query."""
    stamp = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    return df.withColumn(name, stamp)


def clean_columns(df: DataFrame, prefix: str = "") -> DataFrame:
    """Rename every column by :func:`clean_name`."""
    return df.toDF(*[clean_name(c, prefix) for c in df.columns])
