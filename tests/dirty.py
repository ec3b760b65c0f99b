"""Copies of the supplied tables with what real tables hold as well: NULL keys
and measures, a category nobody listed, orphan lines, late and repeated rows."""

from __future__ import annotations

from pathlib import Path

import duckdb

from tallyloom.sources.readers import TABLES

# Column -> (every how many rows, value).
DIRT = {
    "customer": {"c_nationkey": (31, "NULL"), "c_acctbal": (17, "NULL"), "c_mktsegment": (13, "NULL")},
    "supplier": {"s_nationkey": (7, "NULL"), "s_acctbal": (5, "NULL")},
    "part": {"p_type": (19, "NULL"), "p_brand": (23, "NULL"), "p_retailprice": (29, "NULL"), "p_size": (11, "NULL")},
    "orders": {
        "o_custkey": (37, "NULL"), "o_orderdate": (41, "NULL"), "o_totalprice": (43, "NULL"),
        "o_orderstatus": (47, "'X'"), "o_orderpriority": (53, "NULL"),
    },
    "lineitem": {
        "l_partkey": (101, "NULL"), "l_suppkey": (103, "999999"), "l_orderkey": (107, "-5"),
        "l_shipdate": (109, "NULL"), "l_extendedprice": (113, "NULL"), "l_returnflag": (127, "NULL"),
    },
    "events": {
        "user_id": (13, "NULL"), "event_type": (17, "'refund'"), "value": (19, "NULL"),
        "ts": (23, "ts + INTERVAL 40 DAY"), "props": (29, "NULL"),
    },
    "documents": {"lang": (11, "NULL"), "text": (17, "NULL")},
    "labels": {"quality": (11, "NULL"), "toxic": (13, "NULL")},
    "conversations": {"text": (11, "NULL"), "role": (13, "NULL")},
}


def write_dirty(source: str, target: Path) -> str:
    con = duckdb.connect()
    for name in TABLES:
        changed = ", ".join(
            f"CASE WHEN row_no % {every} = 0 THEN {value} ELSE {column} END AS {column}"
            for column, (every, value) in DIRT.get(name, {}).items()
        )
        replace = f"REPLACE ({changed})" if changed else ""
        con.execute(f"""
            COPY (SELECT * EXCLUDE (row_no) {replace}
                  FROM (SELECT *, row_number() OVER () AS row_no FROM '{source}/{name}.parquet'))
            TO '{target}/{name}.parquet' (FORMAT parquet)
        """)
    con.close()
    return str(target)
