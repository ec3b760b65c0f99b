"""Incremental loads, each run at least twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.dates import period_start
from tallyloom.functions.money import to_major, to_minor
from tallyloom.operators.incremental import (
    BucketTable,
    append_to,
    combine_partitions,
    delete_insert,
    merge_rows,
    newer_rows,
    refresh_partitions,
    run_increment_in_place,
)
from tallyloom.operators.projections import with_load_stamp
from tallyloom.plans.registry import ORDER_DAY, cents, dollars, model
from tallyloom.plans.shop import n_rows, staged_orders
from tallyloom.session import scratch_path
from tallyloom.streaming.upsert import above_mark, into_buckets, into_partitions, load_arrived

CUT, LATER = "1998-01-01", "2000-01-01"
AMOUNT = cents("o_totalprice")
ORDERS = f"""o AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, {ORDER_DAY} AS order_date,
 o_orderstatus AS status, {AMOUNT} AS amount FROM orders)"""
# A second delivery: pending orders come again as fulfilled, 900 days later.
RESTATED = f"""{ORDERS},
 first_run AS (SELECT order_id, status, amount, order_date AS updated_on FROM o WHERE order_date < DATE '{CUT}'),
 again AS (SELECT order_id, CASE WHEN status = 'P' THEN 'F' ELSE status END AS status, amount,
                  CASE WHEN status = 'P' THEN order_date + 900 ELSE order_date END AS updated_on FROM o),
 batch AS (SELECT * FROM again WHERE updated_on > (SELECT MAX(updated_on) FROM first_run))"""


def date(text: str):
    return F.lit(text).cast("date")


def orders(t):
    return staged_orders(t).select("order_id", "customer_id", "order_date", "status", "amount")


def first_delivery(t):
    rows = orders(t).filter(F.col("order_date") < date(CUT))
    return rows.select("order_id", "status", "amount", F.col("order_date").alias("updated_on"))


def second_delivery(t, *more):
    pending = F.col("status") == "P"
    return orders(t).select(
        "order_id",
        F.when(pending, "F").otherwise(F.col("status")).alias("status"),
        "amount",
        F.when(pending, F.date_add("order_date", 900))
        .otherwise(F.col("order_date"))
        .alias("updated_on"),
        *more,
    )


def merge_on(*keys):
    return lambda target, batch: merge_rows(target, batch, list(keys), ["-updated_on"])


@model("inc_01_high_water", f"""
WITH {ORDERS} SELECT order_id, order_date, amount FROM o
WHERE order_date > (SELECT MAX(order_date) FROM o WHERE order_date < DATE '{CUT}')
""")
def high_water(t):
    rows = orders(t).select("order_id", "order_date", "amount")
    return newer_rows(rows, rows.filter(F.col("order_date") < date(CUT)), "order_date")


@model("inc_02_append", f"""
WITH {ORDERS}, seen AS (SELECT * FROM o WHERE order_date < DATE '{CUT}' AND status <> 'P')
SELECT order_id, order_date, status FROM seen UNION ALL
SELECT order_id, order_date, status FROM o WHERE order_date > (SELECT MAX(order_date) FROM seen)
""")
def append(t):
    """Pending orders are missing from the first run; by the second run they
    are older than the mark and stay out."""
    path = scratch_path(t.spark, "appended")
    rows = orders(t).select("order_id", "order_date", "status")
    early = rows.filter((F.col("order_date") < date(CUT)) & (F.col("status") != "P"))
    append_to(path, early, "order_date", first_run=True)
    return append_to(path, rows, "order_date", first_run=False)


@model("inc_03_merge", f"""
WITH {RESTATED}
SELECT * FROM first_run f WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.order_id = f.order_id) UNION ALL SELECT * FROM batch
""")
def merge(t):
    path = scratch_path(t.spark, "merged")
    run_increment_in_place(path, first_delivery(t), "updated_on", merge_on("order_id"), ["order_id"])
    return run_increment_in_place(
        path, second_delivery(t), "updated_on", merge_on("order_id"), ["order_id"]
    )


@model("inc_03_merge_partitions", f"""
WITH {RESTATED.replace("order_date AS updated_on FROM o WHERE", "order_date AS updated_on, year(order_date) AS order_year FROM o WHERE")
      .replace("END AS updated_on FROM o)", "END AS updated_on, year(order_date) AS order_year FROM o)")}
SELECT order_id, status, amount, updated_on, CAST(order_year AS INTEGER) AS order_year FROM (
SELECT * FROM first_run f WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.order_id = f.order_id) UNION ALL SELECT * FROM batch)
""")
def merge_by_partition(t):
    """The same upsert into yearly partitions; untouched years stay as they are."""
    path = scratch_path(t.spark, "yearly")
    year = F.year("order_date").alias("order_year")
    first = first_delivery(t).withColumn("order_year", F.year("updated_on"))
    state = combine_partitions(path, first, merge_on("order_id"), "order_year")
    fresh = newer_rows(second_delivery(t, year), state, "updated_on")
    return combine_partitions(path, fresh, merge_on("order_id"), "order_year")


@model("inc_04_merge_composite", f"""
WITH l AS (SELECT l_partkey AS product_id, l_suppkey AS warehouse_id, CAST(l_shipdate AS DATE) AS d,
                  CAST(l_quantity AS BIGINT) AS q FROM lineitem),
 a AS (SELECT product_id, warehouse_id, MAX(d) AS updated_on, CAST(SUM(q) AS BIGINT) AS quantity FROM l WHERE d < DATE '{LATER}' GROUP BY 1, 2),
 b AS (SELECT product_id, warehouse_id, MAX(d) AS updated_on, CAST(SUM(q) AS BIGINT) AS quantity FROM l WHERE d >= DATE '{LATER}' GROUP BY 1, 2)
SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.product_id = a.product_id AND b.warehouse_id = a.warehouse_id)
UNION ALL SELECT * FROM b
""")
def merge_composite(t):
    lines = t.lineitem.select(
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("warehouse_id"),
        F.col("l_shipdate").cast("date").alias("d"), F.col("l_quantity").cast("bigint").alias("q"),
    )

    def snapshot(condition):
        kept = lines.filter(condition).groupBy("product_id", "warehouse_id")
        return kept.agg(F.max("d").alias("updated_on"), F.sum("q").alias("quantity"))

    path, keys = scratch_path(t.spark, "snapshot"), ["product_id", "warehouse_id"]
    combine = merge_on(*keys)
    run_increment_in_place(path, snapshot(F.col("d") < date(LATER)), "updated_on", combine, keys)
    return run_increment_in_place(path, snapshot(F.col("d") >= date(LATER)), "updated_on", combine, keys)


def order_lines(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_shipdate").cast("date").alias("shipped"), to_minor("l_extendedprice").alias("price"),
    )


@model("inc_05_delete_insert", f"""
WITH l AS (SELECT l_orderkey AS order_id, l_linenumber AS line_no, CAST(l_shipdate AS DATE) AS shipped,
                  {cents('l_extendedprice')} AS price FROM lineitem),
 seen AS (SELECT * FROM l WHERE shipped < DATE '{LATER}'),
 batch AS (SELECT * FROM l WHERE shipped > (SELECT MAX(shipped) FROM seen))
SELECT * FROM seen s WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.order_id = s.order_id) UNION ALL SELECT * FROM batch
""")
def replace_orders(t):
    """The key repeats inside the batch: every batch row is inserted."""
    path, lines = scratch_path(t.spark, "replaced"), order_lines(t)

    def combine(target, batch):
        return delete_insert(target, batch, ["order_id"])

    early = lines.filter(F.col("shipped") < date(LATER))
    run_increment_in_place(path, early, "shipped", combine, ["order_id"])
    return run_increment_in_place(path, lines, "shipped", combine, ["order_id"])


@model("inc_05_delete_insert_partitions", f"""
WITH l AS (SELECT l_orderkey AS order_id, l_linenumber AS line_no, CAST(l_shipdate AS DATE) AS shipped,
                  {cents('l_extendedprice')} AS price FROM lineitem),
 seen AS (SELECT * FROM l WHERE shipped < DATE '{LATER}'),
 batch AS (SELECT * FROM l WHERE shipped > (SELECT MAX(shipped) FROM seen))
SELECT * FROM seen s WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.order_id = s.order_id) UNION ALL SELECT * FROM batch
""")
def replace_orders_by_bucket(t):
    """The same replacement in small buckets: the second run splits some of
    them, and leaves those it neither touches nor splits as they are."""
    path, lines = scratch_path(t.spark, "buckets"), order_lines(t)

    def combine(target, batch):
        return delete_insert(target, batch, ["order_id"])

    early = lines.filter(F.col("shipped") < date(LATER))
    run_increment_in_place(path, early, "shipped", combine, ["order_id"], rows_per_bucket=5_000)
    return run_increment_in_place(path, lines, "shipped", combine, ["order_id"], rows_per_bucket=5_000)


@model("inc_06_incremental_aggregate", f"""
WITH {ORDERS}
SELECT order_date, CAST(SUM(amount) AS BIGINT) AS daily_revenue, COUNT(*) AS order_count,
       date_trunc('month', order_date)::DATE AS order_month FROM o GROUP BY 1, 4
""")
def incremental_aggregate(t):
    """The first run ends inside a month; the second recomputes that month
    and the later ones."""
    path = scratch_path(t.spark, "daily")
    rows = orders(t).withColumn("order_month", period_start(F.col("order_date"), "month"))

    def by_day(df):
        return df.groupBy("order_month", "order_date").agg(
            F.sum("amount").alias("daily_revenue"), n_rows().alias("order_count")
        )

    refresh_partitions(path, rows.filter(F.col("order_date") < date("1998-01-15")), "order_month", by_day)
    return refresh_partitions(path, rows, "order_month", by_day)


@model("inc_07_transform_and_stamp", f"""
WITH {RESTATED},
 a AS (SELECT order_id, status, {dollars('amount')} AS amount_dollars, updated_on, TIMESTAMP '2001-01-01 00:00:00' AS loaded_at FROM first_run),
 b AS (SELECT order_id, status, {dollars('amount')} AS amount_dollars, updated_on, TIMESTAMP '2001-01-02 00:00:00' AS loaded_at FROM batch)
SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.order_id = a.order_id) UNION ALL SELECT * FROM b
""")
def transform_and_stamp(t):
    path = scratch_path(t.spark, "stamped")

    def transform(day):
        def apply(df):
            staged = df.select(
                "order_id", "status", to_major("amount").alias("amount_dollars"), "updated_on"
            )
            return with_load_stamp(staged, f"{day} 00:00:00")

        return apply

    combine = merge_on("order_id")
    keys = ["order_id"]
    run_increment_in_place(path, first_delivery(t), "updated_on", combine, keys, transform("2001-01-01"))
    return run_increment_in_place(
        path, second_delivery(t), "updated_on", combine, keys, transform("2001-01-02")
    )


STREAMED = f"""
WITH {ORDERS}
SELECT order_id, CASE WHEN status = 'P' AND COALESCE(order_date < DATE '{LATER}', true) THEN 'F' ELSE status END AS status,
       amount, CASE WHEN status = 'P' AND order_date < DATE '{LATER}' THEN order_date + 900 ELSE order_date END AS updated_on
FROM o UNION ALL
-- nothing tells which row without a number the second delivery restates
SELECT order_id, status, amount, order_date FROM o WHERE order_id IS NULL AND status = 'P' AND COALESCE(order_date < DATE '{LATER}', true)
"""


def deliver(t, folder, apply):
    """Three deliveries of files; each brings new orders and, as fulfilled,
    the pending ones of the delivery before. The stream runs after each."""
    checkpoint = scratch_path(t.spark, "progress")
    rows = orders(t)
    limits = ["0001-01-01", CUT, LATER, "9999-12-31"]
    previous = None
    for low, high in zip(limits, limits[1:], strict=False):
        inside = (F.col("order_date") >= date(low)) & (F.col("order_date") < date(high))
        # Orders without a date come with the first delivery.
        fresh = rows.filter(F.coalesce(inside, F.lit(previous is None)))
        year = F.year("order_date").alias("year")
        delivery = fresh.select(
            "order_id", "status", "amount", F.col("order_date").alias("updated_on"), year
        )
        if previous is not None:
            done = previous.filter(F.col("status") == "P").select(
                "order_id", F.lit("F").alias("status"), "amount",
                F.date_add("order_date", 900).alias("updated_on"), year,
            )
            delivery = delivery.unionByName(done)
        delivery.write.mode("append").parquet(folder)
        load_arrived(t.spark, folder, delivery.schema, checkpoint, apply)
        previous = fresh


@model("inc_08_stream_upsert", STREAMED)
def stream_upsert(t):
    table = BucketTable(t.spark, scratch_path(t.spark, "kept"), ["order_id"])
    deliver(t, scratch_path(t.spark, "inbox"), into_buckets(table, merge_on("order_id")))
    return table.current().drop("year")


@model("inc_08_stream_partitions", STREAMED)
def stream_partitions(t):
    """Into natural partitions: the year of an order, which is fixed for its key."""
    path = scratch_path(t.spark, "kept")
    apply = into_partitions(path, merge_on("order_id"), "year")
    deliver(t, scratch_path(t.spark, "inbox"), apply)
    return t.spark.read.parquet(path).drop("year")


@model("inc_08_stream_late_rows", """
WITH e AS (SELECT event_id, user_id, event_type, ts,
   CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 1 WHEN ts < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS period
   FROM events WHERE ts IS NOT NULL),
 d AS (SELECT e.*, n FROM e JOIN (SELECT unnest([1, 2, 3, 4]) AS n) ON
   (period = n AND event_type IS DISTINCT FROM 'purchase') OR (period = n - 1 AND event_type IN ('purchase', 'signup'))),
 h AS (SELECT n, (SELECT MAX(ts) FROM d WHERE d.n < k.n) AS high FROM (SELECT unnest([1, 2, 3, 4]) AS n) k)
SELECT DISTINCT event_id, user_id, event_type, ts FROM d JOIN h USING (n) WHERE high IS NULL OR ts > high - INTERVAL 3 DAY
""")
def stream_late_rows(t):
    """Four deliveries of events: purchases come with the delivery after their
    own, signups come again with it. Those up to three days late are taken,
    every row once; the stream is started anew for each delivery."""
    at = F.col("seen_at")
    events = t.events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("seen_at"))
    period = F.when(at < F.lit("2024-01-11"), 1).when(at < F.lit("2024-01-21"), 2).otherwise(3)
    inbox, progress, marks, kept = (
        scratch_path(t.spark, label) for label in ("inbox", "progress", "marks", "kept")
    )
    table = BucketTable(t.spark, kept, ["event_id"])
    upsert = into_buckets(table, lambda old, batch: merge_rows(old, batch, ["event_id"], ["-seen_at"]))
    apply = above_mark(marks, "seen_at", upsert, "3 days")
    late = F.col("event_type").eqNullSafe("purchase")
    for n in (1, 2, 3, 4):
        own = (period == n) & ~late
        delayed = (period == n - 1) & (late | F.col("event_type").eqNullSafe("signup"))
        events.filter(at.isNotNull() & (own | delayed)).write.mode("append").parquet(inbox)
        load_arrived(t.spark, inbox, events.schema, progress, apply, once=("seen_at", "3 days"))
    kept_rows = table.current()
    return kept_rows.select("event_id", "user_id", "event_type", at.cast("timestamp_ntz").alias("ts"))
