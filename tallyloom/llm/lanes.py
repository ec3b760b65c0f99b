"""Places of rows in seeded lanes, whatever share of the rows one key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import frozen

#: Rows of one key are numbered in so many pieces.
PIECES = 4096


def numbered(df: DataFrame, label: str, pieces: int = PIECES) -> DataFrame:
    """``df`` stored once with ``__piece`` and ``__row``, a number of the row.

    Both are stored, so a task that is run again gives the same numbers.
    """
    row = F.monotonically_increasing_id()
    stored = frozen(df.withColumn("__row", row), label)
    return stored.withColumn("__piece", F.pmod(F.xxhash64("__row"), F.lit(pieces)).cast("int"))


def placed(rows: DataFrame, lane: list[str], order: list[str], step: str, name: str) -> DataFrame:
    """:func:`numbered` rows with ``name``: the sum of ``step`` over the rows
    before it in its lane, by ``order`` (``step`` is the same for rows that are
    equal in lane and order; none of these columns is NULL).

    Rows equal in ``order`` are counted by piece before anything is sorted. A
    lane sorts these counts alone, and the rows of a piece are numbered on
    their own: a key of any size costs a lane PIECES entries for each order.
    """
    keys = [*lane, *order, "__piece"]
    within = f"PARTITION BY {', '.join(lane)} ORDER BY {', '.join([*order, '__piece'])}"
    begins = (
        rows.groupBy(*keys).agg(F.sum(F.expr(step)).alias("__sum"))
        .selectExpr(*keys, f"SUM(__sum) OVER ({within} ROWS UNBOUNDED PRECEDING) - __sum AS __begin")
    )
    own = rows.selectExpr("*", f"ROW_NUMBER() OVER (PARTITION BY {', '.join(keys)} ORDER BY __row) - 1 AS __nth")
    return own.join(begins, keys).withColumn(name, F.expr(f"__begin + __nth * ({step})"))
