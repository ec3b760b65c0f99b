"""Gates on result tables and the tiered score built from them.

Many tables are checked in one pass: a long frame ``(item, ...)`` takes the
place of a loop over tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.joins import without_match
from tallyloom.operators.windows import first_rows

MESSAGE_LENGTH = 200


def columns_ok(expected: Column, actual: Column) -> Column:
    """Every expected name is there, in any case; extra names are allowed.
    No expectation passes."""

    def lower(names: Column) -> Column:
        return F.transform(names, lambda n: F.lower(n))

    missing = F.array_except(lower(expected), lower(F.coalesce(actual, F.array().cast("array<string>"))))
    return F.coalesce(F.size(missing) == 0, F.lit(True)) | expected.isNull()


def missing_columns(table_columns: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected ``(table, column_name)`` rows that the tables lack; a NULL
    table key is a key like any other."""
    lowered = [
        df.withColumn("column_name", F.lower("column_name")) for df in (expected, table_columns)
    ]
    names = [*keys, "column_name"]
    present = lowered[1].select(*[F.col(n).alias(f"__{n}") for n in names]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names])
    return lowered[0].join(present, same, "left_anti")


def row_bounds(expected: Column, tolerance: float = 0.2) -> tuple[Column, Column]:
    """Inclusive bounds, cut down to whole rows."""
    low = (expected * F.lit(1 - tolerance)).cast("bigint")
    high = (expected * F.lit(1 + tolerance)).cast("bigint")
    return low, high


def row_count_ok(actual: Column, expected: Column, tolerance: float = 0.2) -> Column:
    """Row count within tolerance; no expectation passes."""
    low, high = row_bounds(expected, tolerance)
    return expected.isNull() | F.coalesce(actual.between(low, high), F.lit(False))


def no_duplicates(total: Column, distinct: Column) -> Column:
    """COUNT(*) equals COUNT(DISTINCT key), so a NULL key fails."""
    return F.coalesce(total == distinct, F.lit(False))


def key_counts(df: DataFrame, items: list[str], key: str) -> DataFrame:
    """Rows and distinct keys per item.

    Rows are combined per (item, key) first: an item with most of the rows is
    spread over its keys.
    """
    per_key = df.groupBy(*items, key).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.groupBy(*items).agg(
        F.sum("__n").alias("total_rows"), F.count(key).alias("distinct_keys")
    )


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def tiered_score(
    has_text: Column,
    compile_ok: Column,
    run_ok: Column,
    columns: Column,
    row_count: Column,
    unique: Column,
    has_tests: Column,
    tests_ok: Column,
) -> Column:
    """0 no text or not compiled; 0.3 compiled; 0.6 ran; 0.7 right columns but
    wrong rows or duplicates; 0.8 declared tests fail; 1.0 everything holds.
    Missing columns stay at 0.6."""
    return (
        F.when(~has_text | ~compile_ok, 0.0)
        .when(~run_ok, 0.3)
        .when(~columns, 0.6)
        .when(~(row_count & unique), 0.7)
        .when(has_tests & ~tests_ok, 0.8)
        .otherwise(1.0)
    )


def cut(message: Column, length: int = MESSAGE_LENGTH) -> Column:
    return F.substring(message, 1, length)


def score_items(items: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Score many items at once.

    ``items`` has one row per item: ``sql_text, compile_ok, run_ok,
    actual_columns, total_rows, distinct_keys`` and the optional expectations
    ``expected_columns, expected_row_count, unique_key, tests_ok`` (NULL where
    nothing is expected or declared).
    """
    optional = {
        "expected_columns": "array<string>",
        "expected_row_count": "bigint",
        "unique_key": "string",
        "tests_ok": "boolean",
        "compile_message": "string",
        "run_message": "string",
    }
    for name, kind in optional.items():
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast(kind))
    c = F.col

    def true(name: str) -> Column:
        return F.coalesce(c(name), F.lit(False))

    # One gate per step: each builds on the ones before it.
    no_key = c("unique_key").isNull() | (c("unique_key") == "")
    steps = {
        "__text": F.coalesce(F.length(F.trim(c("sql_text"))) > 0, F.lit(False)),
        "__compiled": c("__text") & true("compile_ok"),
        "__ran": c("__compiled") & true("run_ok"),
        "__columns": c("__ran") & columns_ok(c("expected_columns"), c("actual_columns")),
        "__rows": c("__columns")
        & row_count_ok(c("total_rows"), c("expected_row_count"), tolerance),
        "__unique": c("__columns")
        & (no_key | no_duplicates(c("total_rows"), c("distinct_keys"))),
        "__tests": c("__rows") & c("__unique") & true("tests_ok"),
    }
    low, high = row_bounds(c("expected_row_count"), tolerance)
    has_tests = c("tests_ok").isNotNull()

    def failed(lead: str, message: str) -> Column:
        return F.concat(F.lit(lead), cut(F.coalesce(c(message), F.lit(""))))

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    errors = F.array_compact(F.array(
        F.when(~c("__text"), F.lit("no SQL in the answer")),
        F.when(c("__text") & ~c("__compiled"), failed("not compiled: ", "compile_message")),
        F.when(c("__compiled") & ~c("__ran"), failed("not run: ", "run_message")),
        F.when(c("__ran") & ~c("__columns"), F.lit("columns are missing")),
        F.when(c("__columns") & ~c("__rows"), text(
            c("total_rows"), " rows, expected ", low, " to ", high)),
        F.when(c("__columns") & ~c("__unique"), text(
            c("unique_key"), " repeats: ", c("distinct_keys"), " values in ", c("total_rows"), " rows")),
        F.when(c("__rows") & c("__unique") & has_tests & ~c("__tests"), F.lit("own tests fail")),
    ))
    score = tiered_score(
        c("__text"), c("__compiled"), c("__ran"), c("__columns"), c("__rows"), c("__unique"),
        has_tests, c("__tests"),
    )
    gates = {
        "compile_ok": "__compiled",
        "run_ok": "__ran",
        "columns_ok": "__columns",
        "row_count_ok": "__rows",
        "no_duplicates": "__unique",
        "test_ok": "__tests",
    }
    kept = [n for n in items.columns if n not in gates]
    for name, gate in steps.items():
        items = items.withColumn(name, gate)
    return items.select(
        *kept,
        score.alias("score"),
        *[c(step).alias(name) for name, step in gates.items()],
        errors.alias("errors"),
    )


def declared_tests(df: DataFrame, tests: list[tuple]) -> DataFrame:
    """Run declared data tests; one row ``(test, failures)`` each.

    Tests are ``("not_null", col)``, ``("unique", col)``,
    ``("accepted_values", col, [values])`` and
    ``("relationships", col, other frame, other col)``. All row-level tests
    share one pass over the table.
    """
    labels, counts, frames = [], [], []
    for kind, column, *rest in tests:
        label = f"{kind}:{column}"
        col = F.col(column)
        if kind == "not_null":
            labels.append(label)
            counts.append(F.count_if(col.isNull()))
        elif kind == "accepted_values":
            labels.append(label)
            counts.append(F.count_if(~col.isin(*rest[0])))
        elif kind == "unique":
            twice = duplicate_keys(df.filter(col.isNotNull()), [column])
            frames.append(_failures(twice, label))
        elif kind == "relationships":
            other, other_col = rest
            lost = without_match(df.filter(col.isNotNull()), other, {column: other_col})
            frames.append(_failures(lost, label))
        else:
            raise ValueError(f"unknown test {kind!r}")
    if counts:
        one = df.agg(*[c.alias(n) for c, n in zip(counts, labels, strict=True)])
        frames.insert(0, one.unpivot([], labels, "test", "failures"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _failures(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(label).alias("test"), "failures")


class VolumeError(ValueError):
    """Too few rows for the next step."""


def volume_gate(df: DataFrame, minimums: dict[str, tuple[Column, int]]) -> DataFrame:
    """Each measured volume beside its minimum and the verdict."""
    one = df.agg(*[measure.alias(name) for name, (measure, _) in minimums.items()])
    long = one.unpivot([], list(minimums), "gate", "actual")
    least = F.create_map(
        *[F.lit(x) for name, (_, low) in minimums.items() for x in (name, low)]
    )
    minimum = least[F.col("gate")].cast("bigint")
    return long.select(
        "gate", "actual", minimum.alias("minimum"), (F.col("actual") >= minimum).alias("ok")
    )


def require_volume(df: DataFrame, minimums: dict[str, tuple[Column, int]]) -> DataFrame:
    """Stop before a write when a volume is below its minimum; ``df`` otherwise."""
    failed = volume_gate(df, minimums).filter(~F.col("ok")).collect() if minimums else []
    if failed:
        raise VolumeError("; ".join(f"{r.gate}: {r.actual} < {r.minimum}" for r in failed))
    return df


class DuplicateNameError(ValueError):
    """Names that should be unique occur more than once."""


def require_unique(df: DataFrame, name: str, shown: int = 20) -> DataFrame:
    """Stop when a name occurs more than once; ``df`` otherwise. The message
    says how many such names there are and lists the first ``shown``."""
    twice = duplicate_keys(df, [name])
    found = [r[name] for r in twice.orderBy(name).limit(shown).collect()]
    if found:
        listed = ", ".join(map(str, found))
        raise DuplicateNameError(f"{twice.count()} duplicate values of {name}: {listed}")
    return df


def merge_first_wins(
    existing: DataFrame, batch: DataFrame, name: str, order: list[str]
) -> DataFrame:
    """Add the specs of a batch whose name is new; inside the batch the first
    one along ``order`` wins. Specs without a name equal no other: all stay."""
    named = batch.filter(F.col(name).isNotNull())
    fresh = first_rows(without_match(named, existing, {name: name}), [name], [*order])
    return existing.unionByName(fresh).unionByName(batch.filter(F.col(name).isNull()))
