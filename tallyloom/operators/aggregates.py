"""Aggregates beyond a plain ``groupBy().agg()``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.conditions import flag_name
from tallyloom.operators.windows import (
    Bound,
    RowNumber,
    Running,
    by_group_size,
    first_rows,
    group_values,
    ordered_columns,
)

#: Values of a large group that one task joins into a piece of its list.
LIST_PIECE = 10_000


def mode_per_group(df: DataFrame, keys: list[str], value: str, alias: str, count: str) -> DataFrame:
    """Most frequent non-NULL value per group; the smallest one on a tie."""
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias(alias))
        .agg(F.count(F.lit(1)).alias(count))
    )
    return first_rows(counts, keys, [f"-{count}", alias])


def exact_median(
    df: DataFrame,
    keys: list[str],
    value: str,
    alias: str,
    rows_at_most: Bound = None,
) -> DataFrame:
    """Exact median per group; the mean of the two middle values if even.

    Works on the distinct values and their counts, and finds the middle by a
    running count. No task gathers the values of a group.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    run = ordered_columns(counts, keys, [value], [Running("__upto", "__n")], rows_at_most)
    run = group_values(run, keys, {"__rows": F.sum("__n")})
    low = F.expr("(__rows + 1) DIV 2")
    high = F.expr("(__rows + 2) DIV 2")

    def at(place: Column) -> Column:
        holds = (F.col("__upto") >= place) & (F.col("__upto") - F.col("__n") < place)
        return F.max(F.when(holds, F.col(value)))

    middle = (at(low) + at(high)) / 2.0
    return run.groupBy(*keys).agg(middle.alias(alias))


def share_of_total(
    df: DataFrame, keys: list[str], measure: Column, total: str, share: str
) -> DataFrame:
    """A group sum and its share of the overall sum, in percent.

    The overall sum is wider than a 64-bit integer; a group sum that does not
    fit one stops the query."""
    groups = df.groupBy(*keys).agg(measure.alias(total))
    whole = groups.agg(wide_sum(total)).scalar().cast("double")
    pct = F.col(total).cast("double") / F.nullif(whole, F.lit(0.0)) * 100.0
    return groups.withColumn(share, pct).withColumn(total, F.col(total).cast("bigint"))


def wide_sum(column: Column | str) -> Column:
    """Sum of integers that may outgrow 64 bits."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)"))


def guarded_avg(value: Column, at_least: int) -> Column:
    """Average, NULL when the group has fewer than ``at_least`` rows."""
    return F.when(F.count(F.lit(1)) >= at_least, F.avg(value))


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def any_true(condition: Column) -> Column:
    """Whether any row holds; NULL counts as false."""
    return F.coalesce(F.bool_or(condition), F.lit(False))


def sorted_list(value: Column, sep: str = ", ") -> Column:
    """Distinct values in order, joined; the set is built up map-side."""
    return F.array_join(F.array_sort(F.collect_set(value)), sep)


def list_per_group(
    df: DataFrame, keys: list[str], value: str, alias: str, sep: str = ", ", rows_at_most: Bound = None
) -> DataFrame:
    """:func:`sorted_list` for groups of any size, one row per group.

    Values are made distinct before they are gathered. The values of a large
    group are numbered in order and joined in pieces of ``LIST_PIECE``, and the
    pieces' texts last; only the finished text is in one place. NULLs are left
    out; a group of nothing else has a NULL list, an empty text is a value.
    """
    values = df.select(*keys, F.col(value).alias("__value")).distinct()

    def joined(part: DataFrame, by: list[str]) -> DataFrame:
        text = F.when(F.count("__value") > 0, F.array_join(F.array_sort(F.collect_list("__value")), sep))
        return part.groupBy(*by).agg(text.alias(alias))

    def in_pieces(part: DataFrame, rows: int) -> DataFrame:
        placed = ordered_columns(part, keys, ["__value"], [RowNumber("__row")], rows)
        piece = F.floor((F.col("__row") - 1) / LIST_PIECE).alias("__piece")
        pieces = joined(placed.select(*keys, "__value", piece), [*keys, "__piece"])
        known = F.when(F.col(alias).isNotNull(), F.struct("__piece", alias))
        texts = F.transform(F.array_sort(F.collect_list(known)), lambda p: p[alias])
        whole = F.when(F.count(alias) > 0, F.array_join(texts, sep))
        return pieces.groupBy(*keys).agg(whole.alias(alias))

    return by_group_size(values, keys, rows_at_most).each(lambda part: joined(part, keys), in_pieces)


def pivot_sums(
    df: DataFrame, keys: list[str], column: str, values: list[str], measure: Column, suffix: str
) -> DataFrame:
    """One summed column per listed value, 0 where there is nothing.

    The values are given, so Spark need not scan for them.
    """
    wide = [
        F.coalesce(F.sum(F.when(F.col(column) == v, measure)), F.lit(0)).alias(
            f"{flag_name(v)}_{suffix}"
        )
        for v in values
    ]
    return df.groupBy(*keys).agg(*wide)


def group_by_named(df: DataFrame, column: str, aggs: dict[str, Column]) -> DataFrame:
    """Group by a column named at run time, as ``group_key``."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r}; columns: {', '.join(df.columns)}")
    return df.groupBy(F.col(column).alias("group_key")).agg(
        *[a.alias(name) for name, a in aggs.items()]
    )


def distinct_bitmaps(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The distinct values of an integer column by group, as bitmaps that can be
    stored and merged: ``keys``, ``bucket``, ``bits``. NULL counts for nothing.

    A bitmap covers 32,768 consecutive values in 4 KB: for dense numbers.
    """
    known = df.filter(F.col(number).isNotNull())
    return known.groupBy(*keys, F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    )


def distinct_rollup(bitmaps: DataFrame, keys: dict[str, Column], alias: str) -> DataFrame:
    """Exact distinct counts of wider groups from stored bitmaps: values that
    several narrow groups have count once."""
    wide = [c.alias(name) for name, c in keys.items()]
    merged = bitmaps.groupBy(*wide, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(alias))


def value_sketches(df: DataFrame, keys: list[str], counted: str | None = None, measured: str | None = None,
                   lg_size: int = 12, k: int = 200) -> DataFrame:
    """Sketches of fixed size by group that can be stored and merged, where
    estimates will do: ``distinct`` of the values of ``counted`` and
    ``quantiles`` of the numbers in ``measured``. NULLs count for nothing.

    The standard error of a distinct count is about 1.04 / sqrt(2 ** lg_size)
    (1.6 percent), that of a rank about 1.33 percent for ``k`` = 200. The exact
    forms are :func:`distinct_bitmaps` and :func:`exact_median`.
    """
    made = []
    if counted:
        made.append(F.hll_sketch_agg(F.col(counted).cast("string"), F.lit(lg_size)).alias("distinct"))
    if measured:
        made.append(F.kll_sketch_agg_double(F.col(measured).cast("double"), F.lit(k)).alias("quantiles"))
    if not made:
        raise ValueError("name a column to count or to measure")
    return df.groupBy(*keys).agg(*made)


def merge_sketches(sketches: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Sketches of wider groups from stored ones of :func:`value_sketches`."""
    made = {"distinct": F.hll_union_agg("distinct"), "quantiles": F.kll_merge_agg_double("quantiles")}
    wide = [c.alias(name) for name, c in keys.items()]
    return sketches.groupBy(*wide).agg(*[c.alias(n) for n, c in made.items() if n in sketches.columns])


def estimated_distinct() -> Column:
    """The distinct count that a ``distinct`` sketch stands for."""
    return F.hll_sketch_estimate("distinct")


def estimated_quantile(share: float) -> Column:
    """The value at ``share`` (0 to 1) of a ``quantiles`` sketch; NULL without values."""
    held = F.kll_sketch_get_n_double("quantiles") > 0
    return F.when(held, F.kll_sketch_get_quantile_double("quantiles", F.lit(share)))
