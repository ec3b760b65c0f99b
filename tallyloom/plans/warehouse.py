"""Dimension and fact tables over the supplied tables in like roles: suppliers
as vendors and as staff, event campaigns, order lines as items and shipments,
orders as payments, labels as reviews, conversations as tickets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import conditions as cond
from tallyloom.functions import dates
from tallyloom.functions.money import ratio, to_major, to_minor
from tallyloom.operators.aggregates import count_where
from tallyloom.operators.joins import agg_then_join
from tallyloom.operators.projections import surrogate_key
from tallyloom.plans.registry import AS_OF, LINE_UNITS, ORDER_DAY, cents, dollars, model
from tallyloom.plans.shop import line_units, n_rows, staged_events, staged_orders, units_to_dollars

PRICE = cents("l_extendedprice")
SHIP = "CAST(l_shipdate AS DATE)"


@model("cmp_26_dim_supplier", """
WITH s AS (SELECT l_suppkey, COUNT(*) AS n, COUNT(DISTINCT l_partkey) AS p FROM lineitem GROUP BY 1)
SELECT md5(CAST(s_suppkey AS VARCHAR)) AS supplier_key, s_suppkey AS supplier_id, s_name AS name, n_name AS nation, r_name AS region,
  COALESCE(p, 0) AS products_supplied, COALESCE(n, 0) AS lines_supplied,
  CASE WHEN s_acctbal IS NULL THEN 'unknown' WHEN s_acctbal < 0 THEN 'in_debt' WHEN s_acctbal < 5000 THEN 'regular' ELSE 'strong' END AS standing
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN s ON s_suppkey = l_suppkey
""", tags=("marts",))
def dim_supplier(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    suppliers = t.supplier.withColumnRenamed("s_suppkey", "supplier_id")
    per_part = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(n_rows().alias("n"))
    counts = {"lines_supplied": F.sum("n"), "products_supplied": F.count("l_partkey")}
    rows = agg_then_join(
        suppliers, "supplier_id", [(per_part, "l_suppkey", counts)], dict.fromkeys(counts, 0)
    ).join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    standing = cond.tiers(F.col("s_acctbal"), [(0, "in_debt"), (5000, "regular")], "strong", missing="unknown")
    return rows.select(
        surrogate_key(F.col("supplier_id")).alias("supplier_key"), "supplier_id",
        F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
        *counts, standing.alias("standing"),
    )


@model("cmp_26_dim_date", f"""
WITH s AS (SELECT CAST(unnest(generate_series(MIN({ORDER_DAY}), MAX({ORDER_DAY}), INTERVAL 1 DAY)) AS DATE) AS d FROM orders)
SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, d AS date_day, year(d) AS year, quarter(d) AS quarter, month(d) AS month,
  strftime(d, '%Y-%m') AS month_label, isodow(d) AS day_of_week, isodow(d) >= 6 AS is_weekend,
  date_trunc('month', d)::DATE AS month_start, d = last_day(d) AS is_month_end FROM s
""", tags=("marts",))
def dim_date(t):
    d = F.col("date_day")
    return dates.spine_of(staged_orders(t), "order_date").select(
        F.date_format(d, "yyyyMMdd").cast("bigint").alias("date_key"), "date_day",
        F.year(d).cast("bigint").alias("year"), F.quarter(d).cast("bigint").alias("quarter"),
        F.month(d).cast("bigint").alias("month"), dates.month_label(d).alias("month_label"),
        dates.iso_day(d).alias("day_of_week"), (dates.iso_day(d) >= 6).alias("is_weekend"),
        dates.period_start(d, "month").alias("month_start"), (d == F.last_day(d)).alias("is_month_end"),
    )


@model("cmp_26_dim_employee", f"""
WITH h AS (SELECT l_suppkey, MIN({SHIP}) AS hired, MAX({SHIP}) AS last_active, COUNT(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
SELECT md5('e|' || CAST(s_suppkey AS VARCHAR)) AS employee_key, s_suppkey AS employee_id, s_name AS full_name, n_name AS department,
  hired AS hire_date, date_diff('day', hired, DATE '{AS_OF}') AS tenure_days,
  CASE WHEN hired IS NULL THEN 'new' WHEN date_diff('day', hired, DATE '{AS_OF}') < 1500 THEN 'junior' ELSE 'senior' END AS seniority,
  COALESCE(n, 0) AS orders_handled
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN h ON s_suppkey = l_suppkey
""", tags=("marts",))
def dim_employee(t, as_of: str = AS_OF):
    """Suppliers as staff: the first shipment is the hire, nations are departments."""
    per_order = t.lineitem.groupBy("l_suppkey", "l_orderkey").agg(
        F.min("l_shipdate").alias("first")
    )
    staff = agg_then_join(
        t.supplier.withColumnRenamed("s_suppkey", "employee_id"), "employee_id",
        [(per_order, "l_suppkey", {"hire_date": dates.as_date(F.min("first")), "orders_handled": F.count("l_orderkey")})],
    ).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    tenure = dates.age_days(F.col("hire_date"), as_of)
    return staff.select(
        surrogate_key(F.lit("e"), F.col("employee_id")).alias("employee_key"), "employee_id",
        F.col("s_name").alias("full_name"), F.col("n_name").alias("department"), "hire_date",
        tenure.alias("tenure_days"),
        cond.tiers(tenure, [(1500, "junior")], "senior", missing="new").alias("seniority"),
        F.coalesce("orders_handled", F.lit(0)).alias("orders_handled"),
    )


@model("cmp_26_dim_campaign", """
WITH e AS (SELECT event_type, CAST(ts AS DATE) AS d, CAST(ROUND(value * 100) AS BIGINT) AS v,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS c FROM events)
SELECT md5(CAST(c AS VARCHAR)) AS campaign_key, c AS campaign_id, MIN(d) AS start_date, MAX(d) AS end_date,
  date_diff('day', MIN(d), MAX(d)) + 1 AS duration_days, CAST(COALESCE(SUM(v) FILTER (event_type = 'view'), 0) AS DOUBLE) / 100.0 AS budget,
  COUNT(*) FILTER (event_type = 'click') AS clicks
FROM e WHERE c IS NOT NULL GROUP BY c
""", tags=("marts",))
def dim_campaign(t):
    kind = F.col("event_type")
    events = staged_events(t).filter(F.col("campaign_id").isNotNull())
    spent = F.coalesce(F.sum(F.when(kind == "view", F.col("value_cents"))), F.lit(0))
    rows = events.groupBy("campaign_id").agg(
        dates.as_date(F.min("ts")).alias("start_date"), dates.as_date(F.max("ts")).alias("end_date"),
        to_major(spent).alias("budget"), count_where(kind == "click").alias("clicks"),
    )
    length = dates.days_between(F.col("start_date"), F.col("end_date")) + 1
    return rows.select(
        surrogate_key(F.col("campaign_id")).alias("campaign_key"), "campaign_id", "start_date", "end_date",
        length.alias("duration_days"), "budget", "clicks",
    )


@model("cmp_27_fct_item", f"""
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, o_custkey AS customer_id, {ORDER_DAY} AS order_date,
  p_type AS category, CAST(l_quantity AS BIGINT) AS quantity, {dollars(PRICE)} AS gross_amount,
  CAST({LINE_UNITS} AS DOUBLE) / 10000.0 AS net_amount, CAST({PRICE} * 100 - {LINE_UNITS} AS DOUBLE) / 10000.0 AS discount_amount
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
""", tags=("marts",))
def fct_item(t):
    orders = staged_orders(t).select("order_id", "customer_id", "order_date")
    products = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("category"))
    gross = to_minor("l_extendedprice")
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("bigint").alias("quantity"),
        to_major(gross).alias("gross_amount"), units_to_dollars(line_units()).alias("net_amount"),
        units_to_dollars(gross * 100 - line_units()).alias("discount_amount"),
    )
    return lines.join(orders, "order_id", "left").join(products, "product_id", "left")


@model("cmp_27_fct_shipping", f"""
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_suppkey AS carrier_id, {SHIP} AS shipped_date,
  date_diff('day', {ORDER_DAY}, {SHIP}) AS days_to_ship, l_linestatus = 'F' AS is_delivered,
  CASE WHEN {SHIP} IS NULL OR o_orderdate IS NULL THEN 'unknown' WHEN date_diff('day', {ORDER_DAY}, {SHIP}) < 30 THEN 'fast'
       WHEN date_diff('day', {ORDER_DAY}, {SHIP}) < 90 THEN 'normal' ELSE 'slow' END AS speed
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
""", tags=("marts",))
def fct_shipping(t):
    orders = staged_orders(t).select("order_id", "order_date")
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("carrier_id"), dates.as_date(F.col("l_shipdate")).alias("shipped_date"),
        (F.col("l_linestatus") == "F").alias("is_delivered"),
    )
    days = dates.days_between(F.col("order_date"), F.col("shipped_date"))
    speed = cond.tiers(days, [(30, "fast"), (90, "normal")], "slow", missing="unknown")
    rows = lines.join(orders, "order_id", "left")
    return rows.select(
        "order_id", "line_no", "carrier_id", "shipped_date", days.alias("days_to_ship"), "is_delivered",
        speed.alias("speed"),
    )


@model("cmp_27_fct_payment", f"""
WITH l AS (SELECT l_orderkey, CAST(SUM(CASE WHEN l_returnflag = 'R' THEN {PRICE} END) AS BIGINT) AS back FROM lineitem GROUP BY 1)
SELECT o_orderkey AS payment_id, o_custkey AS customer_id, {ORDER_DAY} AS paid_on, o_orderpriority AS method, {dollars(cents('o_totalprice'))} AS amount,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'other' END AS payment_status,
  CAST(COALESCE(back, 0) AS DOUBLE) / 100.0 AS refunded, c_mktsegment AS segment
FROM orders LEFT JOIN l ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey
""", tags=("marts",))
def fct_payment(t):
    back = F.sum(F.when(F.col("l_returnflag") == "R", to_minor("l_extendedprice")))
    rows = agg_then_join(
        staged_orders(t), "order_id", [(t.lineitem, "l_orderkey", {"back": back})], {"back": 0}
    )
    buyers = t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    state = cond.first_match(
        [(F.col("status") == "F", "completed"), (F.col("status") == "O", "pending")], "other"
    )
    return rows.join(buyers, "customer_id", "left").select(
        F.col("order_id").alias("payment_id"), "customer_id", F.col("order_date").alias("paid_on"),
        F.col("priority").alias("method"), to_major("amount").alias("amount"), state.alias("payment_status"),
        to_major("back").alias("refunded"), "segment",
    )


@model("cmp_27_fct_review", """
SELECT l.doc_id AS review_id, source AS product, lang, COALESCE(n_chars, 0) AS review_length, quality = 1 AS is_positive, toxic = 1 AS is_flagged,
  CASE WHEN quality IS NULL THEN 'unrated' WHEN quality = 1 AND COALESCE(toxic, 0) = 0 THEN 'promoter'
       WHEN toxic = 1 THEN 'detractor' ELSE 'neutral' END AS review_class
FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id
""", tags=("marts",))
def fct_review(t):
    good, flagged = F.col("quality") == 1, F.coalesce(F.col("toxic") == 1, F.lit(False))
    kind = cond.first_match(
        [(F.col("quality").isNull(), "unrated"), (good & ~flagged, "promoter"), (flagged, "detractor")],
        "neutral",
    )
    documents = t.documents.select("doc_id", F.col("source").alias("product"), "lang", "n_chars")
    return t.labels.join(documents, "doc_id", "left").select(
        F.col("doc_id").alias("review_id"), "product", "lang",
        F.coalesce("n_chars", F.lit(0)).alias("review_length"), good.alias("is_positive"),
        (F.col("toxic") == 1).alias("is_flagged"), kind.alias("review_class"),
    )


@model("cmp_27_fct_ticket", """
SELECT conv_id AS ticket_id, COUNT(*) AS messages, COUNT(*) FILTER (role = 'user') AS customer_messages,
  COUNT(*) FILTER (role = 'assistant') AS agent_messages, CAST(SUM(length(text)) AS BIGINT) AS characters,
  CAST(COUNT(*) FILTER (role = 'assistant') AS DOUBLE) / NULLIF(COUNT(*) FILTER (role = 'user'), 0) AS replies_per_question,
  CASE WHEN COUNT(*) FILTER (role = 'assistant') = 0 THEN 'open' ELSE 'answered' END AS ticket_status
FROM conversations GROUP BY 1
""", tags=("marts",))
def fct_ticket(t):
    asked, answered = (count_where(F.col("role") == r) for r in ("user", "assistant"))
    return t.conversations.groupBy(F.col("conv_id").alias("ticket_id")).agg(
        n_rows().alias("messages"), asked.alias("customer_messages"), answered.alias("agent_messages"),
        F.sum(F.length("text").cast("bigint")).alias("characters"),
        ratio(answered, asked).alias("replies_per_question"),
        F.when(answered == 0, "open").otherwise("answered").alias("ticket_status"),
    )
