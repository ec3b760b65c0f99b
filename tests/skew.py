"""Copies of the supplied tables in which one key holds a third of the rows."""

from __future__ import annotations

from pathlib import Path

import duckdb

from tallyloom.sources.readers import TABLES

# Which columns get one value in every third row.
HOT = {
    "customer": {"c_nationkey": "3"},
    "supplier": {"s_nationkey": "3"},
    "orders": {"o_custkey": "7", "o_orderdate": "TIMESTAMP '1998-03-04'"},
    "lineitem": {"l_orderkey": "11", "l_partkey": "5", "l_suppkey": "2"},
    "events": {"user_id": "9", "props": "'{\"k\": 4}'"},
    "documents": {"text": "'the same text'", "source": "'src1'"},
    "conversations": {"text": "'again and again'"},
}


def write_skewed(source: str, target: Path) -> str:
    con = duckdb.connect()
    for name in TABLES:
        hot = ", ".join(
            f"CASE WHEN row_no % 3 = 0 THEN {value} ELSE {column} END AS {column}"
            for column, value in HOT.get(name, {}).items()
        )
        replace = f"REPLACE ({hot})" if hot else ""
        con.execute(f"""
            COPY (SELECT * EXCLUDE (row_no) {replace}
                  FROM (SELECT *, row_number() OVER () AS row_no FROM '{source}/{name}.parquet'))
            TO '{target}/{name}.parquet' (FORMAT parquet)
        """)
    con.close()
    return str(target)
