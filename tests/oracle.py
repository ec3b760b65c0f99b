"""Compare registered models with their SQL oracle in DuckDB.

``python -m tests.oracle FOLDER [name part ...]`` runs a comparison by hand.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pyarrow as pa

from tallyloom.session import DEFAULT_GROUP_ROWS, GROUP_ROWS_KEY
from tallyloom.sources.readers import TABLES


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"list<{kind(t.value_type)}>"
    return str(t)


def rows(table: pa.Table, names: list[str]) -> list[tuple]:
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(zip(*columns, strict=True), key=repr)


def compare(got: pa.Table, want: pa.Table) -> str | None:
    """None when equal, else what differs."""
    names = sorted(got.column_names)
    if names != sorted(want.column_names):
        return f"columns {names} / {sorted(want.column_names)}"
    for n in names:
        a, b = kind(got.schema.field(n).type), kind(want.schema.field(n).type)
        if a != b:
            return f"type of {n}: {a} / {b}"
    if got.num_rows != want.num_rows:
        return f"{got.num_rows} rows / {want.num_rows}"
    for a, b in zip(rows(got, names), rows(want, names), strict=True):
        if a != b:
            return f"{names}: {a} / {b}"
    return None


def check(spark, con, folder: str, model) -> str | None:
    got = model(spark, folder).toArrow()
    if model.sql is None:
        return None if got.num_rows else "no rows"
    return compare(got, con.sql(model.sql).to_arrow_table())


def main() -> None:
    from pyspark.sql import SparkSession

    import tallyloom.plans  # noqa: F401
    from tallyloom.plans.registry import MODELS

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config(GROUP_ROWS_KEY, os.environ.get("GROUP_ROWS", str(DEFAULT_GROUP_ROWS)))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, model in MODELS.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = check(spark, con, folder, model)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        took = time.time() - start
        print(f"{'ok ' if problem is None else 'BAD'} {name} {took:.2f}s {problem or ''}", flush=True)
    print(f"{bad} differ")
    spark.stop()


if __name__ == "__main__":
    main()
