"""Windows and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.dates import as_date, days_between, month_label, period_start
from tallyloom.functions.money import ratio, to_major, to_minor
from tallyloom.operators.aggregates import wide_sum
from tallyloom.operators.sets import (
    first_dates,
    tagged,
    union_distinct,
    union_padded,
    union_rows,
    union_sources,
    union_strict,
)
from tallyloom.operators.windows import (
    Lag,
    Lead,
    RowNumber,
    Running,
    first_last,
    first_rows,
    group_values,
    growth,
    moving_average,
    moving_days,
    moving_rows,
    ntile_column,
    ordered_columns,
    rank_columns,
    running_total,
    top_ranked,
)
from tallyloom.plans.registry import LINE_UNITS, ORDER_DAY, cents, dollars, model
from tallyloom.plans.shop import (
    amount_cents,
    day,
    line_units,
    n_rows,
    staged_orders,
)
from tallyloom.sources.readers import TABLES

AMOUNT = cents("o_totalprice")
ORDERS = f"""(SELECT o_orderkey AS order_id, o_custkey AS customer_id, {ORDER_DAY} AS order_date,
 o_orderstatus AS status, {AMOUNT} AS amount FROM orders)"""
DAILY = f"""(SELECT {ORDER_DAY} AS order_date, COUNT(*) AS order_count,
 CAST(SUM({AMOUNT}) AS BIGINT) AS revenue FROM orders GROUP BY 1)"""
MONTHLY = f"""(SELECT date_trunc('month', {ORDER_DAY})::DATE AS order_month,
 CAST(SUM({AMOUNT}) AS BIGINT) AS revenue FROM orders GROUP BY 1)"""
SPEND = f"(SELECT o_custkey AS customer_id, CAST(SUM({AMOUNT}) AS BIGINT) AS spend FROM orders GROUP BY 1)"
PART_UNITS = f"(SELECT l_partkey, CAST(SUM({LINE_UNITS}) AS BIGINT) AS units FROM lineitem GROUP BY 1)"
BY_DATE = ["order_date", "order_id"]


def daily(t):
    return staged_orders(t).groupBy("order_date").agg(
        n_rows().alias("order_count"), F.sum("amount").alias("revenue")
    )


def monthly(t):
    start = period_start(F.col("order_date"), "month").alias("order_month")
    return staged_orders(t).groupBy(start).agg(F.sum("amount").alias("revenue"))


def spend(t):
    return staged_orders(t).groupBy("customer_id").agg(F.sum("amount").alias("spend"))


# --- windows ----------------------------------------------------------------


@model("win_01_row_number", f"""
SELECT order_id, customer_id, order_date,
       ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS order_rank
FROM {ORDERS}
""")
def row_number(t):
    rows = staged_orders(t).select("order_id", "customer_id", "order_date")
    return ordered_columns(rows, ["customer_id"], BY_DATE, [RowNumber("order_rank")], t.row_count("orders"))


@model("win_02_rank", f"""
SELECT p_partkey AS product_id, p_type AS category, units,
       RANK() OVER (PARTITION BY p_type ORDER BY units DESC) AS category_rank
FROM {PART_UNITS} JOIN part ON l_partkey = p_partkey
""")
def rank(t):
    units = t.lineitem.groupBy("l_partkey").agg(F.sum(line_units()).alias("units"))
    rows = units.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"), "units"
    )
    return rank_columns(
        rows, ["category"], ["-units"], rank="category_rank", rows_at_most=t.row_count("part")
    )


@model("win_03_dense_rank", """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, CAST(l_quantity AS BIGINT) AS quantity,
       DENSE_RANK() OVER (ORDER BY CAST(l_quantity AS BIGINT) DESC) AS quantity_rank FROM lineitem
""")
def dense_rank(t):
    """One global ranking of all lines: many ties, no partition key."""
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
    )
    return rank_columns(rows, [], ["-quantity"], dense="quantity_rank", rows_at_most=t.row_count("lineitem"))


@model("win_04_ntile", f"""
SELECT order_id, customer_id, amount,
       NTILE(4) OVER (PARTITION BY customer_id ORDER BY amount, order_id) AS spend_quartile FROM {ORDERS}
""")
def ntile(t):
    rows = staged_orders(t).select("order_id", "customer_id", "amount")
    return ntile_column(rows, ["customer_id"], ["amount", "order_id"], 4, "spend_quartile", t.row_count("orders"))


@model("win_05_percent_rank", f"""
SELECT customer_id, spend, PERCENT_RANK() OVER (ORDER BY spend) AS spend_percentile FROM {SPEND}
""")
def percent_rank(t):
    ranked = rank_columns(spend(t), [], ["spend"], percent="p", rows_at_most=t.row_count("orders"))
    return ranked.select("customer_id", "spend", F.col("p").alias("spend_percentile"))


@model("win_06_lag", f"""
SELECT order_id, customer_id, order_date,
       LAG(order_date) OVER w AS prev_order_date,
       date_diff('day', LAG(order_date) OVER w, order_date) AS gap_days
FROM {ORDERS} WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)
""")
def lag(t):
    rows = staged_orders(t).select("order_id", "customer_id", "order_date")
    steps = ordered_columns(
        rows, ["customer_id"], BY_DATE, [Lag("prev_order_date", "order_date")], t.row_count("orders")
    )
    gap = days_between(F.col("prev_order_date"), F.col("order_date"))
    return steps.withColumn("gap_days", gap)


@model("win_07_lead", f"""
SELECT order_id, customer_id, order_date, amount, LEAD(order_date) OVER w AS next_order_date,
       LEAD(amount) OVER w AS next_amount
FROM {ORDERS} WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id)
""")
def lead(t):
    rows = staged_orders(t).select("order_id", "customer_id", "order_date", "amount")
    ahead = [Lead("next_order_date", "order_date"), Lead("next_amount", "amount")]
    return ordered_columns(rows, ["customer_id"], BY_DATE, ahead, t.row_count("orders"))


@model("win_08_first_last_value", f"""
SELECT DISTINCT customer_id, FIRST_VALUE(amount) OVER w AS first_amount, LAST_VALUE(amount) OVER w AS last_amount
FROM {ORDERS} WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def first_last_value(t):
    return first_last(
        staged_orders(t), ["customer_id"], BY_DATE, "amount", "first_amount", "last_amount"
    )


@model("win_09_running_group", f"""
SELECT order_id, customer_id, SUM(amount) OVER w::BIGINT AS running_total, COUNT(*) OVER w AS running_count,
       (CAST(SUM(amount) OVER w AS DOUBLE) / COUNT(*) OVER w) AS running_avg
FROM {ORDERS} WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""".replace("SUM(amount) OVER w::BIGINT", "CAST(SUM(amount) OVER w AS BIGINT)"))
def running_group(t):
    measures = [Running("running_total", "amount"), RowNumber("running_count")]
    run = ordered_columns(staged_orders(t), ["customer_id"], BY_DATE, measures, t.row_count("orders"))
    mean = ratio(F.col("running_total"), F.col("running_count"))
    return run.select(
        "order_id", "customer_id", "running_total", "running_count",
        mean.alias("running_avg"),
    )


@model("win_10_running_global", f"""
SELECT order_id, order_date, amount,
       CAST(SUM(amount) OVER (ORDER BY order_date, order_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total
FROM {ORDERS}
""")
def running_global(t):
    rows = staged_orders(t).select("order_id", "order_date", "amount")
    total = Running("running_total", "amount", wide=True)
    run = ordered_columns(rows, [], BY_DATE, [total], t.row_count("orders"))
    return run.withColumn("running_total", F.col("running_total").cast("bigint"))


@model("win_11_moving_average", f"""
SELECT order_date, revenue, AVG(revenue) OVER (ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS moving_avg_7d
FROM {DAILY}
""")
def moving(t):
    series = moving_average(daily(t), "order_date", "revenue", "m")
    return series.select("order_date", "revenue", F.col("m").alias("moving_avg_7d"))


@model("win_11_moving_average_months", f"""
SELECT order_month, revenue, AVG(revenue) OVER (ORDER BY order_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving_avg_3m
FROM {MONTHLY}
""")
def moving_months(t):
    return moving_average(monthly(t), "order_month", "revenue", "moving_avg_3m", rows=3)


@model("win_11_moving_days", f"""
SELECT order_id, customer_id, order_date, amount,
       CAST(SUM(amount) OVER w AS BIGINT) AS spend_90d, COUNT(*) OVER w AS orders_90d
FROM {ORDERS}
WINDOW w AS (PARTITION BY customer_id ORDER BY order_date RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW)
""")
def moving_spend(t):
    """Calendar days on raw rows: what a customer ordered in the last 90 days."""
    rows = staged_orders(t).select("order_id", "customer_id", "order_date", "amount")
    return moving_days(rows, ["customer_id"], "order_date", {"spend_90d": "amount"}, 90, "orders_90d")


@model("win_11_moving_raw_rows", f"""
SELECT order_id, order_date, amount, AVG(amount) OVER (ORDER BY order_date, order_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS avg_10
FROM {ORDERS}
""")
def moving_orders(t):
    """Rows of the whole table in one order, without a partition key."""
    rows = staged_orders(t).select("order_id", "order_date", "amount")
    return moving_rows(rows, [], BY_DATE, {"avg_10": F.avg("amount")}, 10, t.row_count("orders"))


@model("win_12_group_total_beside", f"""
SELECT order_id, customer_id, amount, CAST(SUM(amount) OVER w AS BIGINT) AS customer_total,
       (CAST(amount AS DOUBLE) / CAST(SUM(amount) OVER w AS DOUBLE) * 100.0) AS pct_of_total
FROM {ORDERS} WINDOW w AS (PARTITION BY customer_id)
""")
def group_total(t):
    rows = staged_orders(t).select("order_id", "customer_id", "amount")
    beside = group_values(rows, ["customer_id"], {"customer_total": F.sum("amount")})
    pct = ratio(F.col("amount"), F.col("customer_total")) * 100.0
    return beside.withColumn("pct_of_total", pct)


@model("win_13_growth", f"""
WITH m AS (SELECT order_month, CAST(revenue AS DOUBLE) / 100.0 AS revenue FROM {MONTHLY}),
     p AS (SELECT *, LAG(revenue) OVER (ORDER BY order_month) AS prev_month_revenue FROM m)
SELECT *, (revenue - prev_month_revenue) / NULLIF(prev_month_revenue, 0) * 100.0 AS growth_pct FROM p
""")
def month_growth(t):
    series = monthly(t).withColumn("revenue", to_major("revenue"))
    return growth(series, "order_month", "revenue", "prev_month_revenue", "growth_pct")


@model("win_14_top_n", f"""
SELECT p_type AS category, p_partkey AS product_id, sold,
       RANK() OVER (PARTITION BY p_type ORDER BY sold DESC) AS category_rank
FROM (SELECT l_partkey, CAST(SUM(l_quantity) AS BIGINT) AS sold FROM lineitem GROUP BY 1)
JOIN part ON l_partkey = p_partkey QUALIFY category_rank <= 3
""")
def top_n(t):
    sold = t.lineitem.groupBy("l_partkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("sold")
    )
    rows = sold.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_type").alias("category"), F.col("p_partkey").alias("product_id"), "sold"
    )
    return top_ranked(rows, ["category"], ["-sold"], 3, "category_rank")


@model("win_15_latest_row", f"""
SELECT customer_id, order_id, order_date, amount FROM {ORDERS}
QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY amount DESC, order_id) = 1
""")
def largest_order(t):
    rows = staged_orders(t).select("customer_id", "order_id", "order_date", "amount")
    return first_rows(rows, ["customer_id"], ["-amount", "order_id"])


@model("win_16_rank_in_subset", f"""
SELECT l_orderkey AS order_id, l_suppkey AS carrier, date_diff('day', {ORDER_DAY}, CAST(l_shipdate AS DATE)) AS ship_days,
       RANK() OVER (PARTITION BY l_suppkey ORDER BY date_diff('day', {ORDER_DAY}, CAST(l_shipdate AS DATE))) AS speed_rank
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F'
""")
def rank_in_subset(t):
    done = t.lineitem.filter(F.col("l_linestatus") == "F")
    joined = done.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = joined.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("carrier"),
        days_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("ship_days"),
    )
    return rank_columns(
        rows, ["carrier"], ["ship_days"], rank="speed_rank", rows_at_most=t.row_count("lineitem")
    )


@model("win_17_average_gap", f"""
WITH g AS (SELECT customer_id, date_diff('day', LAG(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id), order_date) AS gap FROM {ORDERS})
SELECT customer_id, COUNT(*) AS order_count, (CAST(SUM(gap) AS DOUBLE) / NULLIF(COUNT(gap), 0)) AS avg_days_between
FROM g GROUP BY 1
""")
def average_gap(t):
    """The gaps of a customer add up to last minus first date, so one
    aggregate without any ordering gives their average."""
    dates = staged_orders(t).groupBy("customer_id").agg(
        n_rows().alias("order_count"),
        days_between(F.min("order_date"), F.max("order_date")).alias("span"),
        (F.count("order_date") - 1).alias("gaps"),
    )
    mean = ratio(F.col("span"), F.col("gaps"))
    return dates.select("customer_id", "order_count", mean.alias("avg_days_between"))


@model("win_18_cumulative_share", f"""
SELECT customer_id, spend,
       (CAST(SUM(spend) OVER (ORDER BY spend DESC, customer_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)
             / CAST(SUM(spend) OVER () AS DOUBLE) * 100.0) AS cumulative_pct,
       ROW_NUMBER() OVER (ORDER BY spend DESC, customer_id) * 5 <= COUNT(*) OVER () AS is_top_20_pct
FROM {SPEND}
""")
def cumulative_share(t):
    run = ordered_columns(
        spend(t), [], ["-spend", "customer_id"],
        [Running("upto", "spend", wide=True), RowNumber("place")], rows_at_most=t.row_count("orders"),
    )
    run = group_values(run, [], {"whole": wide_sum("spend"), "n": n_rows()})
    return run.select(
        "customer_id", "spend",
        (ratio(F.col("upto"), F.col("whole")) * 100.0).alias("cumulative_pct"),
        (F.col("place") * 5 <= F.col("n")).alias("is_top_20_pct"),
    )


@model("win_19_top_percent", f"""
SELECT customer_id, spend FROM {SPEND} QUALIFY PERCENT_RANK() OVER (ORDER BY spend DESC) <= 0.1
""")
def top_percent(t):
    ranked = rank_columns(spend(t), [], ["-spend"], percent="p", rows_at_most=t.row_count("orders"))
    return ranked.filter(F.col("p") <= 0.1).select("customer_id", "spend")


@model("win_20_cumulative_new", f"""
WITH f AS (SELECT o_custkey, MIN({ORDER_DAY}) AS d FROM orders GROUP BY 1),
     m AS (SELECT strftime(d, '%Y-%m') AS first_month, COUNT(*) AS new_customers FROM f GROUP BY 1)
SELECT *, CAST(SUM(new_customers) OVER (ORDER BY first_month) AS BIGINT) AS cumulative_customers FROM m
""")
def cumulative_new(t):
    first = staged_orders(t).groupBy("customer_id").agg(F.min("order_date").alias("d"))
    months = first.groupBy(month_label(F.col("d")).alias("first_month")).agg(
        n_rows().alias("new_customers")
    )
    return running_total(months, "first_month", "new_customers", "cumulative_customers")


@model("win_21_first_or_returning", f"""
SELECT CASE WHEN ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) = 1
            THEN 'new' ELSE 'returning' END AS customer_type, order_id, customer_id, order_date
FROM {ORDERS}
""")
def first_or_returning(t):
    rows = staged_orders(t).select("order_id", "customer_id", "order_date")
    first = F.min(F.struct(F.isnull("order_date"), "order_date", "order_id"))
    beside = group_values(rows, ["customer_id"], {"first": first})
    is_first = F.col("first.order_id") == F.col("order_id")
    return beside.select(
        F.when(is_first, "new").otherwise("returning").alias("customer_type"),
        "order_id", "customer_id", "order_date",
    )


# --- unions -----------------------------------------------------------------


def order_events(t):
    return tagged(t.orders, "order", event_date=day(), entity_id=F.col("o_orderkey"))


def shipments(t):
    return tagged(
        t.lineitem, "shipment", event_date=as_date(F.col("l_shipdate")), entity_id=F.col("l_orderkey")
    )


def web_events(t):
    return tagged(
        t.events, "web", event_date=as_date(F.col("ts")), entity_id=F.col("event_id")
    )


ORDER_EVENTS = f"SELECT 'order' AS event_type, {ORDER_DAY} AS event_date, o_orderkey AS entity_id FROM orders"
SHIPMENTS = "SELECT 'shipment' AS event_type, CAST(l_shipdate AS DATE) AS event_date, l_orderkey AS entity_id FROM lineitem"
WEB = "SELECT 'web' AS event_type, CAST(ts AS DATE) AS event_date, event_id AS entity_id FROM events"


@model("set_01_union_two", f"{ORDER_EVENTS} UNION ALL {WEB}")
def union_two(t):
    return union_rows([order_events(t), web_events(t)])


@model("set_02_timeline", f"{ORDER_EVENTS} UNION ALL {SHIPMENTS} UNION ALL {WEB}")
def timeline(t):
    return union_rows([order_events(t), shipments(t), web_events(t)])


@model("set_03_union_distinct", f"""
SELECT {ORDER_DAY} AS date_value FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem
UNION SELECT CAST(ts AS DATE) FROM events
""")
def all_dates(t):
    return union_distinct([
        t.orders.select(day().alias("date_value")),
        t.lineitem.select(as_date(F.col("l_shipdate")).alias("date_value")),
        t.events.select(as_date(F.col("ts")).alias("date_value")),
    ])


# The id column of every supplied table.
IDS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey",
    "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id",
    "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
    "labels": "doc_id", "conversations": "conv_id",
}


@model("set_04_id_registry", " UNION ALL ".join(
    f"SELECT '{name}' AS source_table, CAST({IDS[name]} AS BIGINT) AS id_value FROM {name}"
    for name in TABLES
))
def id_registry(t):
    return union_rows([
        t.source(name).select(
            F.lit(name).alias("source_table"), F.col(IDS[name]).cast("bigint").alias("id_value")
        )
        for name in t.names
    ])


@model("set_05_generated_union", """
SELECT c_custkey AS source_id, 'customer' AS source_name FROM customer UNION ALL
SELECT o_orderkey, 'orders' FROM orders UNION ALL SELECT s_suppkey, 'supplier' FROM supplier
""")
def generated_union(t):
    def mapper(name, df):
        return df.select(F.col(IDS[name]).alias("source_id"), F.lit(name).alias("source_name"))

    return union_sources({n: t.source(n) for n in ("customer", "orders", "supplier")}, mapper)


@model("set_06_signed_ledger", f"""
SELECT {ORDER_DAY} AS movement_date, 'sale' AS movement_type, {dollars(AMOUNT)} AS amount, o_orderkey AS reference_id FROM orders
UNION ALL
SELECT CAST(l_shipdate AS DATE), 'refund', {dollars(f"(-{cents('l_extendedprice')})")}, l_orderkey FROM lineitem WHERE l_returnflag = 'R'
""")
def signed_ledger(t):
    def moved(df, kind, date, minor, ref):
        return df.select(
            date.alias("movement_date"), F.lit(kind).alias("movement_type"),
            to_major(minor).alias("amount"), F.col(ref).alias("reference_id"),
        )

    back = t.lineitem.filter(F.col("l_returnflag") == "R")
    return union_rows([
        moved(t.orders, "sale", day(), amount_cents(), "o_orderkey"),
        moved(back, "refund", as_date(F.col("l_shipdate")), -to_minor("l_extendedprice"), "l_orderkey"),
    ])


@model("set_07_null_padded", """
SELECT doc_id, 'label' AS feedback_type, CAST(quality AS BIGINT) AS score, NULL AS feedback FROM labels
UNION ALL SELECT doc_id, 'text', NULL, lang FROM documents
""")
def null_padded(t):
    return union_padded([
        t.labels.select(
            "doc_id", F.lit("label").alias("feedback_type"), F.col("quality").cast("bigint").alias("score")
        ),
        t.documents.select(
            "doc_id", F.lit("text").alias("feedback_type"), F.col("lang").alias("feedback")
        ),
    ])


@model("set_08_union_then_aggregate", f"""
SELECT event_date, event_type, COUNT(*) AS event_count
FROM ({ORDER_EVENTS} UNION ALL {SHIPMENTS} UNION ALL {WEB}) GROUP BY 1, 2
""")
def union_then_aggregate(t):
    return timeline(t).groupBy("event_date", "event_type").agg(n_rows().alias("event_count"))


@model("set_09_milestones", f"""
SELECT o_custkey AS customer_id, MIN({ORDER_DAY}) AS event_date, 'first_order' AS event_type FROM orders GROUP BY 1
UNION ALL
SELECT o_custkey, MIN({ORDER_DAY}), 'first_urgent_order' FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1
UNION ALL
SELECT user_id, MIN(CAST(ts AS DATE)), 'first_click' FROM events WHERE event_type = 'click' GROUP BY 1
""")
def milestones(t):
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    clicks = t.events.filter(F.col("event_type") == "click")
    return first_dates(
        {
            "first_order": (t.orders, "o_custkey", day()),
            "first_urgent_order": (urgent, "o_custkey", day()),
            "first_click": (clicks, "user_id", as_date(F.col("ts"))),
        },
        "customer_id",
    )


@model("set_10_strict_union", f"{ORDER_EVENTS} UNION ALL {SHIPMENTS}")
def strict_union(t):
    return union_strict([order_events(t), shipments(t)])
