"""Window columns that hold up when one group owns a large part of the rows.

Spark sorts a window group inside one task. That is right for groups of
ordinary size and is what happens to all groups here that stay under
``spark.tallyloom.maxGroupRows``. Groups beyond it (one customer with a third
of all orders, or a window without any partition key) are found by a summary
of frequent keys in the pass that stores the input; their rows, and only
theirs, are range-partitioned over ``(keys, order)`` instead. A chunk boundary
cuts at most one group, so the state handed from chunk to chunk has at most
two rows per chunk, whatever the size of the table.

Orderings are lists of column names; a leading ``-`` means descending. NULLs
sort last in both directions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import frozen, max_group_rows

CHUNK, POSITION, IS_LAST, SPAN = "__chunk", "__position", "__is_last", "__span"
MAX_CHUNKS = 20_000
#: Rows and days of a group that one task holds for moving frames.
BAND_ROWS, BAND_DAYS = 100_000, 1_024
#: Keys that the summary of large groups tracks (1 MB in a task and in the
#: driver). Every group with over 1/18,000 of all rows is found for certain.
TRACKED_KEYS = 65_536


def ordering(order: list[str]) -> list[Column]:
    return [
        F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_last()
        for o in order
    ]


def order_names(order: list[str]) -> list[str]:
    return [o.lstrip("-") for o in order]


# --- measures ---------------------------------------------------------------


@dataclass(frozen=True)
class RowNumber:
    """Position of the row in its group, from 1."""

    alias: str

    def over(self, w: WindowSpec) -> Column:
        return F.row_number().over(w).cast("bigint")

    def partial(self) -> Column:
        return F.count(F.lit(1))

    def carry(self, part: Column, prior: WindowSpec, step: WindowSpec) -> Column:
        return F.sum(part).over(prior)

    def merge(self, local: Column, carry: Column) -> Column:
        return local + F.coalesce(carry, F.lit(0))


@dataclass(frozen=True)
class Running:
    """Running ``sum``, ``count``, ``max`` or ``min`` up to the current row.

    ``wide`` sums integers beyond 64 bits, as ``decimal(38,0)``."""

    alias: str
    column: str
    how: str = "sum"
    wide: bool = False

    def _agg(self, col: Column) -> Column:
        col = col.cast("decimal(38,0)") if self.wide else col
        return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[self.how](col)

    def over(self, w: WindowSpec) -> Column:
        return self._agg(F.col(self.column)).over(w.rowsBetween(W.unboundedPreceding, 0))

    def partial(self) -> Column:
        return self._agg(F.col(self.column))

    def carry(self, part: Column, prior: WindowSpec, step: WindowSpec) -> Column:
        combine = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[self.how]
        total = combine(part).over(prior)
        return total.cast("decimal(38,0)") if self.wide else total

    def merge(self, local: Column, carry: Column) -> Column:
        if self.how == "max":
            return F.greatest(local, carry)
        if self.how == "min":
            return F.least(local, carry)
        total = F.coalesce(local + carry, local, carry)
        return total.cast("decimal(38,0)") if self.wide else total


@dataclass(frozen=True)
class Lag:
    """Value of the previous row of the group."""

    alias: str
    column: str

    def over(self, w: WindowSpec) -> Column:
        return F.lag(self.column).over(w)

    def partial(self) -> Column:
        return F.max_by(self.column, POSITION)

    def carry(self, part: Column, prior: WindowSpec, step: WindowSpec) -> Column:
        return F.lag(part).over(step)

    def merge(self, local: Column, carry: Column) -> Column:
        return F.when(F.col(POSITION) == 1, carry).otherwise(local)


@dataclass(frozen=True)
class Lead:
    """Value of the next row of the group."""

    alias: str
    column: str

    def over(self, w: WindowSpec) -> Column:
        return F.lead(self.column).over(w)

    def partial(self) -> Column:
        return F.min_by(self.column, POSITION)

    def carry(self, part: Column, prior: WindowSpec, step: WindowSpec) -> Column:
        return F.lead(part).over(step)

    def merge(self, local: Column, carry: Column) -> Column:
        return F.when(F.col(IS_LAST), carry).otherwise(local)


Measure = RowNumber | Running | Lag | Lead
Bound = DataFrame | int | None


# --- the two plans ----------------------------------------------------------


@dataclass(frozen=True)
class Groups:
    """The rows of groups that one task may sort, and those of larger groups
    with their number (at most a little too high). Either may be None."""

    plain: DataFrame | None
    large: DataFrame | None = None
    large_rows: int = 0

    def each(
        self,
        in_task: Callable[[DataFrame], DataFrame],
        split: Callable[[DataFrame, int], DataFrame],
    ) -> DataFrame:
        """One plan for either part, and the results of both."""
        if self.large is None:
            return in_task(self.plain)
        parted = split(self.large, self.large_rows)
        return parted if self.plain is None else in_task(self.plain).unionByName(parted)


def by_group_size(df: DataFrame, keys: list[str], rows_at_most: Bound = None) -> Groups:
    """``df`` parted into ordinary groups and those too large for one task.

    ``rows_at_most`` is an upper bound of the rows of ``df``: a number, or a
    frame that is cheap to count (a bare table: its row count comes from the
    file footers). A table that fits one task has no large group, and nothing
    is stored. Otherwise ``df`` is stored once, and the same pass counts its
    rows and merges the tasks' summaries of frequent keys in the driver (at most
    ``TRACKED_KEYS`` hashes and counts). A summary may count a key too high by
    its known error, never too low: a group it takes for large without need is
    merely split. Groups above the limit that it misses hold under 1/18,000 of
    the rows each; one task sorts such a group, on disk where it must.

    A NULL key is a group like any other.
    """
    limit = max_group_rows(df.sparkSession)
    if rows_at_most is not None:
        bound = rows_at_most if isinstance(rows_at_most, int) else rows_at_most.count()
        if bound <= limit:
            return Groups(df)
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows")]
    if keys:
        tracked = F.lit(TRACKED_KEYS)
        counts.append(F.call_function("approx_top_k", F.xxhash64(*keys), tracked, tracked).alias("frequent"))
    stored = frozen(df.observe(seen, *counts), "window-input")
    rows = seen.get["rows"]
    if rows <= limit:
        return Groups(stored)
    if not keys:
        return Groups(None, stored, rows)
    large = {r["item"]: r["count"] for r in seen.get["frequent"] or [] if r["count"] > limit}
    if not large:
        return Groups(stored)
    names = ", ".join(f"`{k}`" for k in keys)
    is_large = F.expr(f"xxhash64({names}) IN ({', '.join(f'{h}L' for h in sorted(large))})")
    return Groups(stored.filter(~is_large), stored.filter(is_large), sum(large.values()))


def join_beside(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False
) -> DataFrame:
    """Join ``right`` on equal keys, NULL being equal to NULL as in a window.

    ``small`` is for a side whose row count has a proven bound.
    """
    other = {k: f"__k_{k}" for k in keys}
    renamed = right.withColumnsRenamed(other)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()])
    joined = left.join(F.broadcast(renamed) if small else renamed, on, how)
    return joined.drop(*other.values())


def ordered_columns(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: list[Measure],
    rows_at_most: Bound = None,
) -> DataFrame:
    """Add one column per measure, computed along ``order`` inside each group.

    ``order`` should be total: add a unique column at its end.
    """
    w = W.partitionBy(*keys).orderBy(*ordering(order))
    return by_group_size(df, keys, rows_at_most).each(
        lambda part: part.select("*", *[m.over(w).alias(m.alias) for m in measures]),
        lambda part, rows: _split_ordered(part, keys, order, measures, rows),
    )


def _split_ordered(
    df: DataFrame, keys: list[str], order: list[str], measures: list[Measure], rows: int
) -> DataFrame:
    spark = df.sparkSession
    # About a quarter of the limit per chunk, so that an uneven sample of the
    # range bounds still leaves every chunk below it. The number of chunks, and
    # with it the broadcast state, is bounded; beyond that chunks grow.
    chunks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        min(4 * -(-rows // max_group_rows(spark)), MAX_CHUNKS),
    )
    key_order = [F.col(k).asc_nulls_last() for k in keys]
    ranged = df.repartitionByRange(chunks, *key_order, *ordering(order)).withColumn(
        CHUNK, F.spark_partition_id()
    )
    w = W.partitionBy(CHUNK, *keys).orderBy(*ordering(order))
    # Written once: the chunk of a row must be the same in both branches below.
    local = frozen(
        ranged.select(
            "*",
            F.row_number().over(w).alias(POSITION),
            F.lead(F.lit(True)).over(w).isNull().alias(IS_LAST),
            *[m.over(w).alias(f"__local_{i}") for i, m in enumerate(measures)],
        ),
        "ordered",
    )
    group = [CHUNK, *keys]
    # partial() reads the original column, except that a running value's last
    # local state is its chunk total as well.
    summary = local.groupBy(*group).agg(
        *[m.partial().alias(f"__part_{i}") for i, m in enumerate(measures)]
    )
    in_group = W.partitionBy(*keys)
    step = in_group.orderBy(CHUNK)
    prior = step.rowsBetween(W.unboundedPreceding, -1)
    # Only groups cut by a chunk boundary need state: at most two per chunk.
    carried = summary.select(
        *group,
        F.count(F.lit(1)).over(in_group).alias(SPAN),
        *[
            m.carry(F.col(f"__part_{i}"), prior, step).alias(f"__carry_{i}")
            for i, m in enumerate(measures)
        ],
    ).filter(F.col(SPAN) > 1)
    joined = join_beside(local, carried, group, "left", small=True)
    return joined.select(
        *df.columns,
        *[
            m.merge(F.col(f"__local_{i}"), F.col(f"__carry_{i}")).alias(m.alias)
            for i, m in enumerate(measures)
        ],
    )


# --- built on them ----------------------------------------------------------


def group_values(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Group aggregates beside each row.

    Aggregate and join instead of an unordered window: totals are combined
    before the exchange, and a hot key is split by the adaptive skew join.
    """
    columns = [a.alias(name) for name, a in aggs.items()]
    if not keys:
        one = df.agg(F.struct(*columns).alias("v"))
        wide = df.withColumn("__one", one.scalar())
        return wide.select(*df.columns, *[F.col(f"__one.{name}").alias(name) for name in aggs])
    totals = df.groupBy(*keys).agg(*columns)
    return join_beside(df, totals, keys).select(*df.columns, *aggs)


def rank_columns(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    rank: str | None = None,
    dense: str | None = None,
    percent: str | None = None,
    rows_at_most: Bound = None,
) -> DataFrame:
    """RANK, DENSE_RANK and PERCENT_RANK; ties share a rank.

    In groups beyond the limit the ranks are found on the distinct ordering
    values and their counts, so that any number of ties costs one row.
    """
    wanted = [a for a in (rank, dense, percent) if a]
    w = W.partitionBy(*keys).orderBy(*ordering(order))
    made = {
        rank: F.rank().over(w).cast("bigint"),
        dense: F.dense_rank().over(w).cast("bigint"),
        percent: F.percent_rank().over(w),
    }
    return by_group_size(df, keys, rows_at_most).each(
        lambda part: part.select("*", *[made[a].alias(a) for a in wanted]),
        lambda part, rows: _ranks_by_value(part, keys, order, rank, dense, percent, rows),
    )


def _ranks_by_value(
    df: DataFrame, keys: list[str], order: list[str],
    rank: str | None, dense: str | None, percent: str | None, rows: int,
) -> DataFrame:
    wanted = [a for a in (rank, dense, percent) if a]
    values = [*keys, *order_names(order)]
    counts = df.groupBy(*values).agg(F.count(F.lit(1)).alias("__ties"))
    run = ordered_columns(
        counts, keys, order, [Running("__upto", "__ties"), RowNumber("__dense")], rows
    )
    run = group_values(run, keys, {"__rows": F.sum("__ties")})
    at = F.col("__upto") - F.col("__ties") + 1
    share = F.when(F.col("__rows") > 1, (at - 1).cast("double") / (F.col("__rows") - 1))
    made = {rank: at, dense: F.col("__dense"), percent: F.coalesce(share, F.lit(0.0))}
    ranks = run.select(*values, *[made[a].alias(a) for a in wanted])
    return join_beside(df, ranks, values).select(*df.columns, *wanted)


def ntile_column(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    buckets: int,
    alias: str,
    rows_at_most: Bound = None,
) -> DataFrame:
    """NTILE: the first ``rows % buckets`` tiles hold one row more."""
    w = W.partitionBy(*keys).orderBy(*ordering(order))
    tile = F.ntile(buckets).over(w).cast("bigint").alias(alias)
    return by_group_size(df, keys, rows_at_most).each(
        lambda part: part.select("*", tile),
        lambda part, rows: _tiles_by_place(part, keys, order, buckets, alias, rows),
    )


def _tiles_by_place(
    df: DataFrame, keys: list[str], order: list[str], buckets: int, alias: str, rows: int
) -> DataFrame:
    placed = _split_ordered(df, keys, order, [RowNumber("__row")], rows)
    placed = group_values(placed, keys, {"__rows": F.count(F.lit(1))})
    tile = F.expr(
        f"""CASE WHEN __row <= (__rows % {buckets}) * (__rows DIV {buckets} + 1)
            THEN (__row - 1) DIV (__rows DIV {buckets} + 1) + 1
            ELSE (__rows % {buckets})
                 + (__row - 1 - (__rows % {buckets}) * (__rows DIV {buckets} + 1))
                   DIV greatest(__rows DIV {buckets}, 1) + 1 END"""
    )
    return placed.select(*[F.col(c) for c in df.columns], tile.cast("bigint").alias(alias))


def first_rows(
    df: DataFrame, keys: list[str], order: list[str], n: int = 1, alias: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each group.

    Spark cuts every group to ``n`` rows in the map tasks already, so a hot
    group costs ``n`` rows per task after the exchange.
    """
    name = alias or "__row"
    w = W.partitionBy(*keys).orderBy(*ordering(order))
    kept = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return kept.withColumn(name, F.col(name).cast("bigint")) if alias else kept.drop(name)


def top_ranked(df: DataFrame, keys: list[str], order: list[str], n: int, alias: str) -> DataFrame:
    """Rows whose RANK is at most ``n``: ties at the edge are all kept."""
    w = W.partitionBy(*keys).orderBy(*ordering(order))
    kept = df.withColumn(alias, F.rank().over(w)).filter(F.col(alias) <= n)
    return kept.withColumn(alias, F.col(alias).cast("bigint"))


def first_last(
    df: DataFrame, keys: list[str], order: list[str], value: str, first: str, last: str
) -> DataFrame:
    """First and last value along an ascending order, one row per group."""
    along = F.struct(*[x for o in order for x in (F.isnull(o), F.col(o))])
    return df.groupBy(*keys).agg(
        F.min_by(value, along).alias(first), F.max_by(value, along).alias(last)
    )


def _banded(rows: DataFrame, at: Column, band: int, before: int) -> DataFrame:
    """Rows with the band of ``at`` as ``CHUNK``, and copies of those that the
    frames of the next band reach back to (no longer the band's ``__own``)."""
    place, chunk = F.pmod(at, F.lit(band)), F.floor(at / F.lit(band)).cast("bigint")
    late = place >= band - before
    both = F.when(late, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    rows = rows.withColumn("__band", chunk).withColumn(CHUNK, F.explode(both))
    return rows.withColumn("__own", F.col(CHUNK).eqNullSafe(F.col("__band"))).drop("__band")


def moving_rows(
    df: DataFrame, keys: list[str], order: list[str], aggs: dict[str, Column], rows: int,
    rows_at_most: Bound = None, band: int = BAND_ROWS,
) -> DataFrame:
    """Aggregates over the current and the ``rows - 1`` previous rows of a group.

    Rows are numbered along ``order`` (total, in the plan for groups of any
    size) and cut into bands of numbers; each band also receives the rows
    before its edge, so that no task sorts more than a band of a group.
    """
    band = max(band, rows)
    placed = ordered_columns(df, keys, order, [RowNumber("__row")], rows_at_most)
    cut = _banded(placed, F.col("__row") - 1, band, rows - 1)
    w = W.partitionBy(*keys, CHUNK).orderBy("__row").rowsBetween(-(rows - 1), 0)
    cut = cut.select(*df.columns, "__own", *[a.over(w).alias(name) for name, a in aggs.items()])
    return cut.filter("__own").drop("__own")


def moving_days(
    df: DataFrame, keys: list[str], day: str, sums: dict[str, str], days: int, count: str | None = None,
    band: int = BAND_DAYS,
) -> DataFrame:
    """Sums of integer columns over the ``days`` calendar days that end with the
    row's day, all rows of that day included, beside each row; with ``count``
    the number of rows too. Rows without a day have only each other.

    Rows are added up by key and day first, so that a hot key or day is combined
    before the shuffle; a band of days also receives the days before its edge.
    ``sums`` maps result names to columns.
    """
    band = max(band, days)
    totals = {name: F.sum(column) for name, column in sums.items()}
    if count:
        totals[count] = F.count(F.lit(1))
    daily = df.groupBy(*keys, day).agg(*[t.alias(name) for name, t in totals.items()])
    daily = daily.withColumn("__day", F.datediff(F.col(day), F.lit("1970-01-01").cast("date")))
    cut = _banded(daily, F.col("__day"), band, days - 1)
    w = W.partitionBy(*keys, CHUNK).orderBy("__day").rangeBetween(-(days - 1), 0)
    moved = cut.select(*keys, day, "__own", *[F.sum(name).over(w).alias(name) for name in totals])
    moved = moved.filter("__own").drop("__own")
    return join_beside(df, moved, [*keys, day]).select(*df.columns, *totals)


def moving_average(
    series: DataFrame,
    order: str,
    value: str,
    alias: str,
    rows: int = 7,
    keys: list[str] | None = None,
) -> DataFrame:
    """Average of the current and the ``rows - 1`` previous rows of a series.

    The frame counts rows, not calendar days: see :func:`moving_days`.
    """
    return moving_rows(series, keys or [], [order], {alias: F.avg(value)}, rows)


def growth(
    series: DataFrame, period: str, value: str, previous: str, pct: str
) -> DataFrame:
    """Previous period's value and growth in percent, for one row per period."""
    w = W.orderBy(F.col(period).asc_nulls_last())
    out = series.withColumn(previous, F.lag(value).over(w))
    change = (F.col(value) - F.col(previous)) / F.nullif(F.col(previous), F.lit(0.0)) * 100.0
    return out.withColumn(pct, change)


def running_total(series: DataFrame, period: str, value: str, alias: str) -> DataFrame:
    """Running total over a series with one row per period."""
    w = W.orderBy(F.col(period).asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    return series.withColumn(alias, F.sum(value).over(w))
