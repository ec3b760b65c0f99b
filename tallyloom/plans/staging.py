"""Sources, sinks, projections, filters, sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.money import margin_percent, to_major, to_major_if, to_minor
from tallyloom.operators.params import between_dates, most_recent
from tallyloom.operators.projections import (
    cast_columns,
    stage,
    surrogate_key,
    with_load_stamp,
)
from tallyloom.operators.windows import first_rows
from tallyloom.operators.incremental import bucket_count
from tallyloom.plans.registry import AS_OF, LINE_UNITS, MODELS, ORDER_DAY, cents, dollars, model
from tallyloom.plans.shop import amount_cents, day, line_units, staged_orders
from tallyloom.session import scratch_path
from tallyloom.sources.readers import read_csv, read_csv_parted, read_parquet, read_tasks
from tallyloom.sources.sinks import (
    bucketed_table,
    materialize,
    with_summary,
    write_json,
    write_splits,
)

ORDERS_SQL = f"""
SELECT o_orderkey AS order_id, o_custkey AS customer_id, {ORDER_DAY} AS order_date,
       o_orderstatus AS status, o_orderpriority AS priority, {cents('o_totalprice')} AS amount
FROM orders
"""


# --- sources ----------------------------------------------------------------


@model("src_01_csv_load", """
SELECT event_id, CAST(user_id AS INTEGER) AS user_id, ts, CAST(ts AS DATE) AS day, value, event_type = 'error' AS is_error,
       CASE WHEN event_type <> 'view' THEN props END AS notes FROM events
""")
def csv_load(t):
    """Every column type of the data model, with empty fields and quotes."""
    rows = t.events.select(
        "event_id", F.col("user_id").cast("int"), "ts", F.col("ts").cast("date").alias("day"),
        "value", (F.col("event_type") == "error").alias("is_error"),
        F.when(F.col("event_type") != "view", F.col("props")).alias("notes"),
    )
    path = scratch_path(t.spark, "csv")
    micros = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    rows.write.option("timestampNTZFormat", micros).csv(path, header=True, escape='"')
    return read_csv(t.spark, path, rows.schema)


@model("src_01_csv_rejects", f"""
SELECT o_orderkey AS order_id, o_orderpriority AS priority, {cents('o_totalprice')} AS amount, NULL AS line, NULL AS reason
FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P'
UNION ALL
SELECT NULL, NULL, NULL, COALESCE(CAST(o_orderkey AS VARCHAR), '') || ',' || COALESCE(o_orderpriority, '') || ',pending', 'amount is not bigint'
FROM orders WHERE o_orderstatus = 'P'
""")
def csv_rejects(t):
    """Orders as a file in which pending ones have a word for their amount: the
    rows that fit, and the lines that do not."""
    rows = staged_orders(t).select("order_id", "priority", "amount", "status")
    fits = rows.select("order_id", "priority", "amount").schema
    amount = F.when(F.col("status") == "P", "pending").otherwise(F.col("amount").cast("string"))
    path = scratch_path(t.spark, "orders-csv")
    rows.select("order_id", "priority", amount.alias("amount")).write.csv(path, header=True, escape='"')
    parsed = read_csv_parted(t.spark, path, fits)
    none = F.lit(None).cast("string")
    rejects = parsed.rejects.select(
        *[F.lit(None).cast(c.dataType).alias(c.name) for c in fits], "line", "reason"
    )
    return parsed.rows.select("*", none.alias("line"), none.alias("reason")).unionByName(rejects)


@model("src_02_named_source", "SELECT c_custkey AS customer_id, c_name AS name FROM customer")
def named_source(t):
    return stage(t.source("customer"), {"c_custkey": "customer_id", "c_name": "name"})


@model("src_03_parquet_read", """
SELECT p_brand, COUNT(*) AS parts, MAX(p_size) AS largest FROM part GROUP BY p_brand
""")
def parquet_read(t):
    part = read_parquet(t.spark, f"{t.folder}/part.parquet")
    return part.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("parts"), F.max("p_size").alias("largest")
    )


@model("src_04_json_lines_read", """
SELECT 'doc-' || doc_id AS instance_id, text AS instruction, lang AS first_table
FROM documents WHERE source <> 'src0'
""")
def json_lines_read(t):
    """Tasks written as JSON lines; source ``src0`` plays the demo tasks."""
    prefix = F.when(F.col("source") == "src0", "demo-").otherwise("doc-")
    tasks = t.documents.select(
        F.concat(prefix, F.col("doc_id").cast("string")).alias("instance_id"),
        F.col("text").alias("instruction"),
        F.create_map(
            "lang", F.struct(F.create_map(F.lit("doc_id"), F.lit("BIGINT")).alias("columns"))
        ).alias("output_schema"),
    )
    path = scratch_path(t.spark, "tasks")
    write_json(tasks, path)
    return read_tasks(t.spark, path).select(
        "instance_id", "instruction", F.map_keys("output_schema")[0].alias("first_table")
    )


# --- sinks ------------------------------------------------------------------


@model("snk_01_parquet_per_split", """
SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split FROM documents
""")
def parquet_per_split(t):
    split = F.when(F.col("lang") == "en", "train").otherwise("test")
    rows = t.documents.select("doc_id", "lang", split.alias("split"))
    path = scratch_path(t.spark, "splits")
    write_splits(rows, path)
    return t.spark.read.schema(rows.schema).parquet(path)


@model("snk_02_json_result", """
SELECT event_type, COUNT(*) AS events, CAST(SUM(CAST(ROUND(value*100) AS BIGINT)) AS BIGINT) AS cents
FROM events GROUP BY event_type
""")
def json_result(t):
    summary = with_summary(
        t.events, ["event_type"],
        {"events": F.count(F.lit(1)), "cents": F.sum(to_minor("value"))},
    )
    path = scratch_path(t.spark, "result")
    write_json(summary, path)
    return t.spark.read.json(path, schema=summary.schema)


@model("snk_03_json_lines_write", "SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user'")
def json_lines_write(t):
    rows = t.conversations.filter(F.col("role") == "user")
    path = scratch_path(t.spark, "lines")
    write_json(rows, path)
    return t.spark.read.json(path, schema=rows.schema)


@model("snk_04_table", """
SELECT p_partkey AS product_id, p_name AS name, p_type AS category FROM part WHERE p_size > 10
""")
def as_table(t):
    rows = stage(
        t.part.filter(F.col("p_size") > 10),
        {"p_partkey": "product_id", "p_name": "name", "p_type": "category"},
    )
    return materialize(rows, "table", "products", scratch_path(t.spark, "products"))


@model("snk_04_bucketed_tables", """
SELECT o_orderkey AS order_id, o_orderstatus AS status, COUNT(l_linenumber) AS lines
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
""")
def bucketed_tables(t, rows_per_bucket: int = 2_000_000):
    """Orders and lines stored in buckets of the order key: the join and the
    aggregate on that key need no exchange. Their number follows the lines."""
    buckets = bucket_count(t.row_count("lineitem"), rows_per_bucket)

    def stored(df, label):
        path = scratch_path(t.spark, label)
        name = "tallyloom_" + path.rsplit("/", 1)[1].replace("-", "_")
        return bucketed_table(df, name, path, ["order_id"], buckets)

    orders = stored(
        stage(t.orders, {"o_orderkey": "order_id", "o_orderstatus": "status"}), "orders"
    )
    lines = stored(stage(t.lineitem, {"l_orderkey": "order_id"}, ["l_linenumber"]), "lines")
    joined = orders.join(lines.hint("merge"), "order_id")
    return joined.groupBy("order_id", "status").agg(F.count("l_linenumber").alias("lines"))


@model("snk_05_view", "SELECT n_name, COUNT(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def as_view(t):
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    counts = joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"))
    return materialize(counts, "view", "tallyloom_nation_suppliers")


@model("snk_06_ephemeral", """
SELECT c_mktsegment, COUNT(*) AS customers FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment
""")
def as_ephemeral(t):
    base = materialize(t.customer.filter(F.col("c_acctbal") > 0), "ephemeral", "in_credit")
    return base.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))


@model("snk_07_chosen_kind", f"SELECT order_id, customer_id, amount FROM ({ORDERS_SQL})")
def chosen_kind(t, mat_type: str = "view"):
    rows = staged_orders(t).select("order_id", "customer_id", "amount")
    path = scratch_path(t.spark, "orders") if mat_type == "table" else None
    return materialize(rows, mat_type, "tallyloom_orders", path)


@model("snk_08_tags", f"""
SELECT p_partkey AS product_id, p_name AS name, {dollars(cents('p_retailprice'))} AS unit_price,
       'marts,products' AS tags
FROM part WHERE p_type <> 'SMALL'
""", tags=("marts", "products"))
def with_tags(t):
    own = [tag for tag in MODELS["snk_08_tags"].tags if tag != "snk"]
    return stage(
        t.part.filter(F.col("p_type") != "SMALL"),
        {"p_partkey": "product_id", "p_name": "name"},
        derive={
            "unit_price": to_major(to_minor("p_retailprice")),
            "tags": F.lit(",".join(own)),
        },
    )


# --- projections ------------------------------------------------------------


@model("prj_01_copy", "SELECT * FROM customer")
def copy_all(t):
    return t.customer.select("*")


@model("prj_02_rename_subset", """
SELECT s_suppkey AS supplier_id, s_name AS name, s_nationkey AS nation_id FROM supplier
""")
def rename_subset(t):
    return stage(
        t.supplier, {"s_suppkey": "supplier_id", "s_name": "name", "s_nationkey": "nation_id"}
    )


@model("prj_03_cast", """
SELECT event_id, CAST(ts AS DATE) AS event_date, ts AS event_time,
       CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS amount,
       CAST(FLOOR(value) AS BIGINT) AS whole
FROM events
""")
def casts(t):
    rows = t.events.select(
        "event_id", F.col("ts").alias("event_date"), F.col("ts").alias("event_time"),
        F.col("value").alias("amount"), F.floor("value").alias("whole"),
    )
    rows = cast_columns(rows, {"event_date": "date", "amount": "decimal(12,2)", "whole": "bigint"})
    return cast_columns(rows, {"amount": "double"})


@model("prj_04_minor_to_major", f"""
SELECT o_orderkey AS order_id, {dollars(cents('o_totalprice'))} AS amount_dollars FROM orders
""")
def minor_to_major(t):
    return staged_orders(t).select("order_id", to_major("amount").alias("amount_dollars"))


@model("prj_05_conditional_unit", f"""
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_returnflag AS kind,
       CASE WHEN l_returnflag = 'A' THEN {dollars(cents('l_extendedprice'))}
            ELSE CAST({cents('l_extendedprice')} AS DOUBLE) END AS value
FROM lineitem
""")
def conditional_unit(t):
    minor = to_minor("l_extendedprice")
    return stage(
        t.lineitem,
        {"l_orderkey": "order_id", "l_linenumber": "line_no", "l_returnflag": "kind"},
        derive={"value": to_major_if(minor, F.col("l_returnflag") == "A")},
    )


@model("prj_06_derived", f"""
SELECT l_orderkey AS order_id, l_linenumber AS line_no,
       CAST({LINE_UNITS} AS DOUBLE) / 10000.0 AS line_total,
       (CAST({cents('p_retailprice')} - {cents('p_size')} AS DOUBLE)
             / {cents('p_retailprice')} * 100.0) AS margin_pct
FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def derived(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return stage(
        joined,
        {"l_orderkey": "order_id", "l_linenumber": "line_no"},
        derive={
            "line_total": to_major(line_units(), 10_000),
            "margin_pct": margin_percent(to_minor("p_retailprice"), to_minor("p_size")),
        },
    )


@model("prj_07_flag", """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_quantity <= 10 AS needs_reorder,
       l_discount > 0 AS has_discount FROM lineitem
""")
def flags(t):
    return stage(
        t.lineitem, {"l_orderkey": "order_id", "l_linenumber": "line_no"},
        derive={
            "needs_reorder": F.col("l_quantity") <= 10,
            "has_discount": F.col("l_discount") > 0,
        },
    )


@model("prj_08_literal", "SELECT 'order' AS event_type, o_orderkey AS entity_id FROM orders")
def literal(t):
    return t.orders.select(F.lit("order").alias("event_type"), F.col("o_orderkey").alias("entity_id"))


@model("prj_09_surrogate_key", """
SELECT md5(CAST(c_custkey AS VARCHAR) || '|' || COALESCE(c_mktsegment, '')) AS customer_key,
       c_custkey AS customer_id, c_mktsegment AS segment FROM customer
""")
def surrogate(t):
    key = surrogate_key(F.col("c_custkey"), F.col("c_mktsegment"))
    return t.customer.select(
        key.alias("customer_key"), F.col("c_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("segment"),
    )


@model("prj_10_load_stamp", f"""
SELECT doc_id, quality, toxic, TIMESTAMP '{AS_OF} 00:00:00' AS loaded_at FROM labels
""")
def load_stamp(t):
    return with_load_stamp(t.labels, f"{AS_OF} 00:00:00")


# --- filters ----------------------------------------------------------------


@model("flt_01_equality", f"SELECT order_id, customer_id, amount FROM ({ORDERS_SQL}) WHERE status = 'F'")
def equality(t):
    return staged_orders(t).filter(F.col("status") == "F").select("order_id", "customer_id", "amount")


@model("flt_02_boolean", """
SELECT c_custkey AS customer_id, c_name AS name FROM customer WHERE c_acctbal > 0
""")
def boolean_filter(t):
    staged = stage(
        t.customer, {"c_custkey": "customer_id", "c_name": "name"},
        derive={"is_active": F.col("c_acctbal") > 0},
    )
    return staged.filter(F.col("is_active")).drop("is_active")


@model("flt_03_number_range", "SELECT * FROM part WHERE p_size >= 40 AND p_retailprice > 950")
def number_range(t):
    return t.part.filter((F.col("p_size") >= 40) & (F.col("p_retailprice") > 950))


@model("flt_04_date_range", f"""
SELECT o_orderkey, {ORDER_DAY} AS order_date FROM orders
WHERE {ORDER_DAY} BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'
""")
def date_range(t):
    rows = between_dates(t.orders, "o_orderdate", "1997-01-01", "1998-06-30")
    return rows.select("o_orderkey", day().alias("order_date"))


@model("flt_05_in_list", """
SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'purchase')
""")
def in_list(t):
    kept = t.events.filter(F.col("event_type").isin("click", "purchase"))
    return kept.select("event_id", "user_id", "event_type")


@model("flt_06_exclusion", """
SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'
""")
def exclusion(t):
    return t.events.filter(F.col("event_type") != "error").select("event_id", "event_type", "value")


@model("flt_07_not_null", """
SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL AND d.lang IS NOT NULL
""")
def not_null(t):
    joined = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality")
    return joined.dropna(subset=["quality", "lang"])


@model("flt_08_having", """
SELECT o_custkey AS customer_id, COUNT(*) AS order_count FROM orders
GROUP BY o_custkey HAVING COUNT(*) > 10
""")
def having(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.count(F.lit(1)).alias("order_count")
    )
    return counts.filter(F.col("order_count") > 10)


@model("flt_09_qualify", f"""
SELECT customer_id, order_id, order_date FROM ({ORDERS_SQL})
QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) = 1
""")
def qualify(t):
    firsts = first_rows(staged_orders(t), ["customer_id"], ["order_date", "order_id"])
    return firsts.select("customer_id", "order_id", "order_date")


@model("flt_10_pattern", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%gear%'")
def pattern(t):
    return t.part.filter(F.col("p_name").like("%gear%")).select("p_partkey", "p_name")


# --- sorts ------------------------------------------------------------------


@model("srt_01_full_sort", """
SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey
""")
def full_sort(t):
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    return rows.orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey")


@model("srt_02_top_k", f"""
SELECT o_custkey AS customer_id, {dollars(f"CAST(SUM({cents('o_totalprice')}) AS BIGINT)")} AS total_spend
FROM orders GROUP BY o_custkey ORDER BY total_spend DESC, customer_id LIMIT 10
""")
def top_k(t):
    spend = t.orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        to_major(F.sum(amount_cents())).alias("total_spend")
    )
    return spend.orderBy(F.col("total_spend").desc(), "customer_id").limit(10)


@model("srt_03_limit_parameter", f"""
SELECT order_id, order_date, amount FROM ({ORDERS_SQL}) ORDER BY order_date DESC, order_id LIMIT 50
""")
def limit_parameter(t, limit_rows: int = 50):
    rows = staged_orders(t).select("order_id", "order_date", "amount")
    return most_recent(rows, [F.col("order_date").desc(), F.col("order_id")], limit_rows)
