"""Joins beyond a plain equi-join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.dates import as_date
from tallyloom.operators.windows import (
    Bound,
    Lag,
    Running,
    first_rows,
    ordered_columns,
)
from tallyloom.session import frozen

EPOCH = "1970-01-01"

#: Pairs of basket items that one task counts, and parts of cells dealt to it.
PAIRS_PER_TASK, PARTS = 1 << 20, 16


def agg_then_join(
    parent: DataFrame,
    key: str,
    children: list[tuple[DataFrame, str, dict[str, Column]]],
    defaults: dict[str, object] | None = None,
) -> DataFrame:
    """Left-join aggregates of several children to a parent.

    Every child is aggregated to its key first, so children cannot multiply
    each other's rows, the parent key stays unique and only one row per key
    and task goes through the exchange.
    """
    out = parent
    for child, child_key, aggs in children:
        part = child.groupBy(F.col(child_key).alias(key)).agg(
            *[a.alias(name) for name, a in aggs.items()]
        )
        out = out.join(part, key, "left")
    if defaults:
        out = out.withColumns(
            {name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()}
        )
    return out


def _keys_of(right: DataFrame, on: dict[str, str]) -> DataFrame:
    return right.select(*[F.col(r).alias(name) for name, r in on.items()]).distinct()


def having_match(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``left`` with a partner (EXISTS); ``on`` maps left to right
    columns.

    The right keys are made distinct first: map tasks reduce a hot key to one
    row each, which the planner does not do by itself.
    """
    return left.join(_keys_of(right, on), list(on), "left_semi")


def without_match(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``left`` without a partner (NOT EXISTS); a NULL key has none."""
    return left.join(_keys_of(right, on), list(on), "left_anti")


def outer_by_key(
    key: str, sources: list[tuple[DataFrame, Column, dict[str, Column]]], keep_null: bool = False
) -> DataFrame:
    """Summed metrics of several sources side by side on one key, 0 where a
    source has nothing (NULL with ``keep_null``).

    ``sources`` lists ``(frame, key column, {metric: summed column})``. A
    padded union and one aggregate replace a chain of full outer joins: every
    source is scanned once and one small row per key and task is exchanged.
    """
    names = [name for _, _, metrics in sources for name in metrics]
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [
            df.select(k.alias(key), *[v.alias(name) for name, v in metrics.items()])
            for df, k, metrics in sources
        ],
    )
    sums = rows.groupBy(key).agg(*[F.sum(n).alias(n) for n in names])
    return sums if keep_null else sums.fillna(0, names)


def pairs_within_days(df: DataFrame, key: str, row_id: str, day: str, days: int) -> DataFrame:
    """Other rows of the same key at most ``days`` days away.

    Days are cut into bands of that length; a partner lies in the same or a
    neighbouring band. The join key is (key, band), so the rows of a hot key
    meet in many small groups instead of one.
    """
    band = F.floor(F.datediff(F.col(day), F.lit(EPOCH).cast("date")) / days).cast("int")
    left = df.select(
        F.col(key), F.col(row_id), F.col(day), band.alias("__band")
    )
    right = df.select(
        F.col(key),
        F.col(row_id).alias(f"related_{row_id}"),
        F.col(day).alias(f"related_{day}"),
        F.explode(F.sequence(band - 1, band + 1)).alias("__band"),
    )
    near = F.abs(F.datediff(F.col(day), F.col(f"related_{day}"))) <= days
    other = F.col(row_id) != F.col(f"related_{row_id}")
    return left.join(right, [key, "__band"]).filter(near & other).drop("__band")


def basket_pairs(
    lines: DataFrame, basket: str, item: str, min_baskets: int = 1, width: int = 1_000
) -> DataFrame:
    """Pairs of items found together in at least ``min_baskets`` baskets
    (default: every pair).

    Each basket is cut into slices of about ``width`` items, and every two
    slices meet in a cell of their own: one cell for an ordinary basket, many
    small ones for a giant one. The plan is the same for both. Cells are dealt
    to as many tasks as their pairs need, ``PAIRS_PER_TASK`` each. A task counts
    the pairs of its cells before they are shuffled to as many tasks again, so
    neither count outgrows a task, and a pair of most baskets is a few rows.
    """
    known = F.col(basket).isNotNull() & F.col(item).isNotNull()
    items = lines.select(basket, item).filter(known).distinct()
    sizes = items.groupBy(basket).agg(F.count(F.lit(1)).alias("__size"))
    sized = frozen(items.join(sizes, basket).filter("__size > 1"), "baskets")
    pairs = (sized.agg(F.sum(F.col("__size") - 1)).first()[0] or 0) // 2
    tasks = max(lines.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS_PER_TASK))
    slices = F.ceil(F.col("__size") / width).cast("int")
    own = F.pmod(F.xxhash64(item), slices).cast("int")
    every = F.explode(F.sequence(F.lit(0), slices - 1))
    cell = [basket, "__row", "__column"]

    def dealt(name: str, row: Column, column: Column) -> DataFrame:
        rows = sized.select(basket, F.col(item).alias(name), row.alias("__row"), column.alias("__column"))
        part = F.pmod(F.xxhash64(*cell), F.lit(PARTS * tasks))
        return rows.withColumn("__part", part).repartition(tasks, "__part")

    left, right = dealt("item_a", own, every), dealt("item_b", every, own)
    met = left.join(right, ["__part", *cell]).filter(F.col("item_a") < F.col("item_b"))
    counted = met.groupBy("__part", "item_a", "item_b").agg(F.count(F.lit(1)).alias("__n"))
    counts = counted.repartition(tasks, "item_a", "item_b").groupBy("item_a", "item_b")
    counts = counts.agg(F.sum("__n").alias("pair_count"))
    return counts if min_baskets <= 1 else counts.filter(F.col("pair_count") >= min_baskets)


def last_before(
    events: DataFrame,
    earlier: DataFrame,
    key: str,
    at: str,
    alias: str,
    rows_at_most: Bound = None,
) -> DataFrame:
    """Beside each event: the time of the latest ``earlier`` row of the key
    that is not after it. Linear in both inputs, no pairs are formed."""
    return _nearest(events, earlier, key, at, alias, rows_at_most, backwards=True)


def next_after(
    events: DataFrame,
    later: DataFrame,
    key: str,
    at: str,
    alias: str,
    rows_at_most: Bound = None,
) -> DataFrame:
    """Beside each event: the time of the first ``later`` row of the key that
    is not before it."""
    return _nearest(events, later, key, at, alias, rows_at_most, backwards=False)


def _nearest(events, others, key, at, alias, rows_at_most, backwards):
    # A NULL key equals no other key: such events find nothing and are not
    # sorted, such marks are left out.
    unknown = events.filter(F.col(key).isNull())
    unknown = unknown.withColumn(alias, F.lit(None).cast(others.schema[at].dataType))
    events, others = (df.filter(F.col(key).isNotNull()) for df in (events, others))
    # At equal times the other side sorts first: "not after" includes "same".
    marks = others.select(
        F.col(key), F.col(at).alias("__at"), F.lit(0).alias("__side"), F.col(at).alias("__mark")
    )
    rows = events.select("*", F.col(at).alias("__at"), F.lit(1).alias("__side"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    order = ["__at" if backwards else "-__at", "__side"]
    how = "max" if backwards else "min"
    run = ordered_columns(both, [key], order, [Running(alias, "__mark", how)], rows_at_most)
    known = run.filter(F.col("__side") == 1).select(*events.columns, alias)
    return known.unionByName(unknown)


def merge_intervals(
    starts: DataFrame,
    keys: list[str],
    at: str,
    length: Column,
    rows_at_most: Bound = None,
) -> DataFrame:
    """Join overlapping intervals ``[at, at + length]`` of a key into disjoint
    ones with columns ``start`` and ``end``."""
    points = starts.select(*keys, at).distinct()
    gaps = ordered_columns(points, keys, [at], [Lag("__prev", at)], rows_at_most)
    fresh = F.col("__prev").isNull() | (F.col(at) > F.col("__prev") + length)
    gaps = gaps.withColumn("__fresh", fresh.cast("int"))
    islands = ordered_columns(gaps, keys, [at], [Running("__island", "__fresh")], rows_at_most)
    spans = islands.groupBy(*keys, "__island").agg(
        F.min(at).alias("start"), (F.max(at) + length).alias("end")
    )
    return spans.drop("__island")


def sum_in_intervals(
    intervals: DataFrame,
    points: DataFrame,
    key: str,
    at: str,
    sums: dict[str, str],
    rows_at_most: Bound = None,
) -> DataFrame:
    """Sum integer columns of the points inside each closed interval.

    ``intervals`` has ``key``, ``start``, ``end`` and any other columns;
    ``sums`` maps result names to columns of ``points``. Each interval reads
    the running totals at its two ends, so the cost does not grow with the
    number of points per interval, and overlaps are allowed. An interval holds
    nothing when its key or an end is NULL or its end lies before its start.
    """
    holds = F.coalesce(F.col(key).isNotNull() & (F.col("start") <= F.col("end")), F.lit(False))
    nothing = intervals.filter(~holds).select(
        "*", *[F.lit(0).cast("bigint").alias(name) for name in sums]
    )
    intervals, points = intervals.filter(holds), points.filter(F.col(key).isNotNull())
    totals = {f"__t_{name}": column for name, column in sums.items()}
    boundary = F.struct(*[F.col(c) for c in intervals.columns])
    # Order at one moment: interval start, points, interval end.
    opens = intervals.select(
        F.col(key), F.col("start").alias("__at"), F.lit(0).alias("__side"), boundary.alias("__iv")
    )
    closes = intervals.select(
        F.col(key), F.col("end").alias("__at"), F.lit(2).alias("__side"), boundary.alias("__iv")
    )
    inside = points.select(
        F.col(key),
        F.col(at).alias("__at"),
        F.lit(1).alias("__side"),
        *[F.col(column).cast("bigint").alias(t) for t, column in totals.items()],
    )
    both = opens.unionByName(closes).unionByName(inside, allowMissingColumns=True)
    run = ordered_columns(
        both,
        [key],
        ["__at", "__side"],
        [Running(f"__r{t}", t) for t in totals],
        rows_at_most,
    )
    ends = run.filter(F.col("__side") != 1)
    sign = F.when(F.col("__side") == 2, 1).otherwise(-1)
    held = (
        ends.groupBy("__iv")
        .agg(
            *[
                F.sum(sign * F.coalesce(F.col(f"__r__t_{name}"), F.lit(0))).alias(name)
                for name in sums
            ],
            # Equal intervals share one group; each of them gets its row back.
            F.count_if(F.col("__side") == 0).alias("__copies"),
        )
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
        .select(
            "__iv.*",
            *[F.expr(f"`{name}` DIV __copies").alias(name) for name in sums],
        )
    )
    return held.unionByName(nothing)


def same_day(
    events: DataFrame, orders: DataFrame, key: str, event_at: str, order_at: str, alias: str
) -> DataFrame:
    """Flag events whose key has an order on the same calendar day."""
    days = orders.select(F.col(key), as_date(F.col(order_at)).alias("__day")).distinct()
    days = days.withColumn("__hit", F.lit(True))
    dated = events.withColumn("__day", as_date(F.col(event_at)))
    joined = dated.join(days, [key, "__day"], "left")
    return joined.select(*events.columns, F.coalesce(F.col("__hit"), F.lit(False)).alias(alias))


def join_on_name(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Left join on names compared without case and outer blanks."""
    a = left.withColumn("__name", F.lower(F.trim(F.col(left_name))))
    b = right.withColumn("__name", F.lower(F.trim(F.col(right_name))))
    return a.join(b, "__name", "left").drop("__name")


def parent_levels(nodes: DataFrame, node: str, parent: str, name: str, levels: int) -> DataFrame:
    """Attach the names of up to ``levels`` ancestors, one left join each.

    Only nodes that are somebody's parent go into the joins as ancestors."""
    parents = nodes.select(F.col(parent).alias(node)).filter(F.col(node).isNotNull()).distinct()
    above = nodes.join(parents, node, "left_semi")
    out = nodes.select(node, name, F.col(parent).alias("__up"))
    for level in range(1, levels + 1):
        ancestor = above.select(
            F.col(node).alias("__up"),
            F.col(name).alias(f"level_{level}_name"),
            F.col(parent).alias("__next"),
        )
        out = out.join(ancestor, "__up", "left").drop("__up").withColumnRenamed("__next", "__up")
    return out.drop("__up")


def ancestor_paths(nodes: DataFrame, node: str, parent: str, name: str) -> DataFrame:
    """Root, depth and path of every node of a hierarchy of any depth.

    One row per node: ``node``, ``name``, ``root`` (the topmost ancestor),
    ``depth`` (0 for a root), ``path`` (names from the root down to the node)
    and ``in_cycle``. A node is a root when its parent is NULL or unknown. Nodes
    on a cycle or below one have no root: their root, depth and path are NULL.
    Of several rows of one node that of the smallest parent and name counts;
    rows without a node are left out.

    Pointer doubling: after k rounds a row knows its 2^k nearest ancestors, so
    a chain of a thousand takes ten rounds. Only rows that have not reached a
    root are joined. A round in which none does ends the search: what is left
    leads into a cycle. Each round is stored.
    """
    one = F.min(F.struct(F.col(parent).alias("up"), F.col(name).alias("name"))).alias("r")
    rows = nodes.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(one)
    rows = frozen(rows.select("node", "r.up", "r.name"), "nodes")
    known = rows.select(F.col("node").alias("up"), F.col("name").alias("__above"), F.lit(True).alias("__known"))
    below = F.coalesce("__known", F.lit(False))
    none = F.array().cast("array<string>")
    state = rows.join(known, "up", "left").select(
        "node", "name",
        F.when(below, F.col("up")).alias("up"),
        F.when(below, F.col("up")).otherwise(F.col("node")).alias("root"),
        below.cast("bigint").alias("depth"),
        F.when(below, F.array(F.col("__above").cast("string"))).otherwise(none).alias("above"),
    )
    state = frozen(state, "ancestors")
    left = state.filter("up IS NOT NULL").count()
    while left:
        higher = state.select(
            F.col("node").alias("up"), F.col("up").alias("__up"), F.col("root").alias("__root"),
            F.col("depth").alias("__depth"), F.col("above").alias("__above"),
        )
        moved = state.filter("up IS NOT NULL").join(higher, "up").select(
            "node", "name", F.col("__up").alias("up"), F.col("__root").alias("root"),
            (F.col("depth") + F.col("__depth")).alias("depth"), F.concat("above", "__above").alias("above"),
        )
        state = frozen(state.filter("up IS NULL").unionByName(moved), "ancestors")
        before, left = left, state.filter("up IS NOT NULL").count()
        if left == before:
            break
    ends = F.col("up").isNull()
    path = F.concat(F.reverse("above"), F.array(F.col("name").cast("string")))
    return state.select(
        "node", "name", F.when(ends, F.col("root")).alias("root"), F.when(ends, F.col("depth")).alias("depth"),
        F.when(ends, path).alias("path"), (~ends).alias("in_cycle"),
    )


def dyadic_blocks(low: Column, high: Column) -> Column:
    """The closed range of integers as disjoint blocks of 2^level numbers each:
    an array of (level, block), two at most for each level. Empty when the
    range is; ends lie below 2^62 in size."""
    block = "array<struct<level:int,block:bigint>>"
    nothing = F.array().cast(block)

    def step(state: Column, level: Column) -> Column:
        lo, hi = state["lo"], state["hi"]
        holds = lo <= hi
        left = F.coalesce(holds & (lo.bitwiseAND(F.lit(1)) == 1), F.lit(False))
        right = F.coalesce(holds & (hi.bitwiseAND(F.lit(1)) == 0), F.lit(False))

        def one(at: Column) -> Column:
            return F.array(F.struct(level.alias("level"), at.alias("block"))).cast(block)

        blocks = F.concat(
            state["blocks"], F.when(left, one(lo)).otherwise(nothing), F.when(right, one(hi)).otherwise(nothing)
        )
        lo, hi = lo + left.cast("bigint"), hi - right.cast("bigint")
        over = F.coalesce(lo > hi, F.lit(True))  # stays so when halved
        return F.struct(
            F.when(over, F.lit(2)).otherwise(F.shiftright(lo, 1)).cast("bigint").alias("lo"),
            F.when(over, F.lit(-2)).otherwise(F.shiftright(hi, 1)).cast("bigint").alias("hi"),
            blocks.alias("blocks"),
        )

    start = F.struct(low.cast("bigint").alias("lo"), high.cast("bigint").alias("hi"), nothing.alias("blocks"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), start, step, lambda state: state["blocks"])


def range_join(
    points: DataFrame,
    at: Column,
    ranges: DataFrame,
    low: Column,
    high: Column,
    per_block: list[Column] | None = None,
) -> DataFrame:
    """Each point beside every closed range of ``ranges`` that holds it, by an
    equi-join: all columns of both. Ranges may overlap; NULL ends, empty ranges
    and NULL points match nothing.

    A range is a few dyadic blocks; a point lies in one block of each level that
    the table of ranges uses (64 at most), and in one block of a range at most.
    Ends and points are integers below 2^62 in size; dates go as day numbers.

    With ``per_block``, aggregates over columns of ``ranges``, a point stands
    beside these aggregates of each block that holds it instead. A range holds
    it in one block, so sums of sums and minima of minima are those over all
    its ranges, and no point meets more rows than there are levels.
    """
    cut = ranges.withColumn("__cell", F.explode(dyadic_blocks(low, high)))
    cut = cut.select(*ranges.columns, F.col("__cell.level").alias("__level"), F.col("__cell.block").alias("__block"))
    levels = sorted(r[0] for r in cut.select("__level").distinct().collect())
    if per_block:
        cut = cut.groupBy("__level", "__block").agg(*per_block)
    marked = points.withColumn("__at", at.cast("bigint")).filter("__at IS NOT NULL")
    marked = marked.withColumn("__level", F.explode(F.lit(levels).cast("array<int>")))
    marked = marked.withColumn("__block", F.expr("shiftright(__at, __level)"))
    return marked.join(cut, ["__level", "__block"]).drop("__level", "__block", "__at")


def join_first(
    left: DataFrame, right: DataFrame, key: str, order: list[str], how: str = "inner"
) -> DataFrame:
    """Join only the first row per key of ``right`` along a total order."""
    return left.join(first_rows(right, [key], order), key, how)
