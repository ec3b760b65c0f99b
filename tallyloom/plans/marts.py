"""Composite models: profiles, cohorts, funnels, attribution, inventory, KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import conditions as cond
from tallyloom.functions import dates
from tallyloom.functions.money import percent, ratio, to_major, to_minor, weighted_score
from tallyloom.operators.aggregates import any_true, count_where, sorted_list, wide_sum
from tallyloom.operators.joins import (
    agg_then_join,
    basket_pairs,
    merge_intervals,
    outer_by_key,
    sum_in_intervals,
)
from tallyloom.operators.projections import surrogate_key
from tallyloom.operators.windows import (
    Lead,
    RowNumber,
    Running,
    group_values,
    ntile_column,
    ordered_columns,
    rank_columns,
    running_total,
)
from tallyloom.plans.registry import (
    AS_OF,
    EVENTS_AS_OF,
    LINE_UNITS,
    ORDER_DAY,
    cents,
    dollars,
    model,
)
from tallyloom.plans.shop import (
    UNITS,
    amount_cents,
    day,
    line_units,
    n_rows,
    staged_events,
    staged_orders,
    units_to_dollars,
)

AMOUNT = cents("o_totalprice")
SHIP = "CAST(l_shipdate AS DATE)"
ORDERS = f"""o AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, {ORDER_DAY} AS order_date,
 o_orderstatus AS status, o_orderpriority AS priority, {AMOUNT} AS amount FROM orders)"""
EVENTS = """e AS (SELECT event_id, user_id, ts, event_type, CAST(ROUND(value * 100) AS BIGINT) AS value_cents,
 CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS campaign_id FROM events)"""
SESSION_KEY = "user_id, CAST(ts AS DATE)"


def customers(t):
    return t.customer.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("segment"),
    )


def lines_per_order(t, **aggs):
    """Line aggregates per order: the fact table shrinks before any join."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        *[a.alias(n) for n, a in aggs.items()]
    )


def returned():
    return F.col("l_returnflag") == "R"


# --- customers --------------------------------------------------------------


@model("cmp_01_customer_360", f"""
WITH {ORDERS}, l AS (SELECT l_orderkey AS order_id, COUNT(*) AS items, COUNT(*) FILTER (l_returnflag = 'R') AS back FROM lineitem GROUP BY 1),
 p AS (SELECT customer_id, COUNT(*) AS total_orders, CAST(SUM(amount) AS BIGINT) AS spend, MIN(order_date) AS first_order_date,
              MAX(order_date) AS last_order_date, CAST(SUM(items) AS BIGINT) AS total_items, CAST(SUM(back) AS BIGINT) AS returned_items
       FROM o LEFT JOIN l USING (order_id) GROUP BY 1),
 v AS (SELECT user_id, COUNT(*) AS total_events FROM events GROUP BY 1)
SELECT c_custkey AS customer_id, c_name AS name, n_name AS nation, r_name AS region, c_mktsegment AS segment,
       COALESCE(total_orders, 0) AS total_orders, {dollars('COALESCE(spend, 0)')} AS total_spend, first_order_date, last_order_date,
       COALESCE(total_items, 0) AS total_items, COALESCE(returned_items, 0) AS returned_items, COALESCE(total_events, 0) AS total_events
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN p ON c_custkey = p.customer_id LEFT JOIN v ON c_custkey = v.user_id
""", tags=("marts",))
def customer_360(t):
    items = lines_per_order(t, items=n_rows(), back=count_where(returned()))
    orders = staged_orders(t).join(items, "order_id", "left")
    profile = agg_then_join(
        customers(t),
        "customer_id",
        [
            (orders, "customer_id", {
                "total_orders": n_rows(), "spend": F.sum("amount"),
                "first_order_date": F.min("order_date"), "last_order_date": F.max("order_date"),
                "total_items": F.sum("items"), "returned_items": F.sum("back"),
            }),
            (t.events, "user_id", {"total_events": n_rows()}),
        ],
        {"total_orders": 0, "spend": 0, "total_items": 0, "returned_items": 0, "total_events": 0},
    )
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
    )
    return profile.join(places, "nation_id").select(
        "customer_id", "name", "nation", "region", "segment", "total_orders",
        to_major("spend").alias("total_spend"), "first_order_date", "last_order_date",
        "total_items", "returned_items", "total_events",
    )


@model("cmp_02_lifetime_value", f"""
WITH {ORDERS}, v AS (SELECT customer_id, MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date,
  COUNT(*) AS order_count, CAST(SUM(amount) AS BIGINT) AS spend_cents FROM o GROUP BY 1)
SELECT *, date_diff('day', first_order_date, last_order_date) AS days_as_customer,
       RANK() OVER (ORDER BY spend_cents DESC) AS value_rank FROM v
""", tags=("marts",))
def lifetime_value(t):
    value = staged_orders(t).groupBy("customer_id").agg(
        F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"),
        n_rows().alias("order_count"), F.sum("amount").alias("spend_cents"),
    )
    span = dates.days_between(F.col("first_order_date"), F.col("last_order_date"))
    value = value.withColumn("days_as_customer", span)
    return rank_columns(value, [], ["-spend_cents"], rank="value_rank", rows_at_most=t.row_count("orders"))


@model("cmp_03_rfm", f"""
WITH {ORDERS}, v AS (SELECT customer_id, date_diff('day', MAX(order_date), DATE '{AS_OF}') AS recency_days,
  COUNT(*) AS frequency, CAST(SUM(amount) AS BIGINT) AS monetary FROM o GROUP BY 1),
 s AS (SELECT *, NTILE(4) OVER (ORDER BY recency_days DESC, customer_id) AS r_score,
  NTILE(4) OVER (ORDER BY frequency, customer_id) AS f_score, NTILE(4) OVER (ORDER BY monetary, customer_id) AS m_score FROM v)
SELECT *, CASE WHEN r_score + f_score + m_score >= 10 THEN 'champion' WHEN r_score + f_score + m_score >= 7 THEN 'loyal'
  WHEN r_score >= 3 THEN 'recent' ELSE 'at_risk' END AS rfm_segment FROM s
""", tags=("marts",))
def rfm(t, as_of: str = AS_OF):
    value = staged_orders(t).groupBy("customer_id").agg(
        dates.age_days(F.max("order_date"), as_of).alias("recency_days"),
        n_rows().alias("frequency"), F.sum("amount").alias("monetary"),
    )
    orders = {"r_score": "-recency_days", "f_score": "frequency", "m_score": "monetary"}
    for name, by in orders.items():
        value = ntile_column(value, [], [by, "customer_id"], 4, name, rows_at_most=t.row_count("orders"))
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    segment = cond.first_match(
        [(total >= 10, "champion"), (total >= 7, "loyal"), (F.col("r_score") >= 3, "recent")],
        "at_risk",
    )
    return value.withColumn("rfm_segment", segment)


@model("cmp_04_cohort", f"""
WITH {ORDERS}, f AS (SELECT customer_id, MIN(order_date) AS first FROM o GROUP BY 1)
SELECT strftime(first, '%Y-%m') AS cohort_month, date_diff('month', first, order_date) AS months_since,
       COUNT(DISTINCT customer_id) AS active_customers, CAST(SUM(amount) AS BIGINT) AS revenue_cents
FROM o JOIN f USING (customer_id) GROUP BY 1, 2
""", tags=("marts",))
def cohort(t):
    orders = staged_orders(t).filter(F.col("customer_id").isNotNull())
    months = orders.groupBy(
        "customer_id", dates.period_start(F.col("order_date"), "month").alias("month")
    ).agg(F.sum("amount").alias("cents"))
    placed = group_values(months, ["customer_id"], {"first": F.min("month")})
    return placed.groupBy(
        dates.month_label(F.col("first")).alias("cohort_month"),
        dates.whole_months_between(F.col("first"), F.col("month")).alias("months_since"),
    ).agg(n_rows().alias("active_customers"), F.sum("cents").alias("revenue_cents"))


@model("cmp_05_retention", f"""
WITH {ORDERS}, f AS (SELECT customer_id, MIN(order_date) AS first FROM o GROUP BY 1),
 g AS (SELECT customer_id, first, MIN(date_diff('day', first, order_date)) FILTER (order_date > first) AS gap
       FROM o JOIN f USING (customer_id) GROUP BY 1, 2)
SELECT strftime(first, '%Y-%m') AS cohort, COUNT(*) AS cohort_size, COUNT(*) FILTER (gap <= 30) AS ordered_within_30d,
       COUNT(*) FILTER (gap <= 60) AS ordered_within_60d, COUNT(*) FILTER (gap <= 90) AS ordered_within_90d FROM g GROUP BY 1
""", tags=("marts",))
def retention(t):
    known = staged_orders(t).filter(F.col("customer_id").isNotNull())
    days = known.select("customer_id", "order_date").distinct()
    placed = group_values(days, ["customer_id"], {"first": F.min("order_date")})
    gap = dates.days_between(F.col("first"), F.col("order_date"))
    per = placed.groupBy("customer_id").agg(
        F.min("first").alias("first"), F.min(F.when(gap > 0, gap)).alias("gap")
    )
    within = [
        count_where(F.col("gap") <= d).alias(f"ordered_within_{d}d") for d in (30, 60, 90)
    ]
    return per.groupBy(dates.month_label(F.col("first")).alias("cohort")).agg(
        n_rows().alias("cohort_size"), *within
    )


@model("cmp_06_churn", f"""
WITH {ORDERS}, l AS (SELECT customer_id, date_diff('day', MAX(order_date), DATE '{AS_OF}') AS d FROM o GROUP BY 1)
SELECT c_custkey AS customer_id, d AS days_since_last_order, CASE WHEN d IS NULL THEN 'no_orders' WHEN d < 200 THEN 'low_risk'
  WHEN d < 400 THEN 'medium_risk' ELSE 'high_risk' END AS churn_risk
FROM customer LEFT JOIN l ON c_custkey = customer_id
""", tags=("marts",))
def churn(t, as_of: str = AS_OF):
    rows = agg_then_join(
        customers(t).select("customer_id"), "customer_id",
        [(staged_orders(t), "customer_id", {"last": F.max("order_date")})],
    )
    age = dates.age_days(F.col("last"), as_of)
    bands = [(200, "low_risk"), (400, "medium_risk")]
    return rows.select(
        "customer_id", age.alias("days_since_last_order"),
        cond.tiers(age, bands, "high_risk", missing="no_orders").alias("churn_risk"),
    )


# --- campaigns and sessions -------------------------------------------------


def attributed(t, interval: str):
    """Purchases of users in the given time after a click, per campaign."""
    spans = merge_intervals(
        staged_events(t, "click").filter(F.col("user_id").isNotNull()), ["campaign_id", "user_id"], "ts",
        F.expr(f"INTERVAL {interval}"), rows_at_most=t.row_count("events"),
    )
    bought = staged_events(t, "purchase").withColumn("one", F.lit(1))
    hits = sum_in_intervals(
        spans, bought, "user_id", "ts", {"orders": "one", "revenue": "value_cents"},
        rows_at_most=2 * t.row_count("events"),
    )
    return hits.groupBy("campaign_id").agg(
        F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue")
    )


def attributed_sql(interval: str) -> str:
    return f"""(SELECT campaign_id, COUNT(*) AS orders, CAST(SUM(value_cents) AS BIGINT) AS revenue FROM (
  SELECT DISTINCT c.campaign_id, p.event_id, p.value_cents FROM e c JOIN e p ON c.user_id = p.user_id
  AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL {interval}) GROUP BY 1)"""


@model("cmp_07_funnel", f"""
WITH {EVENTS}, k AS (SELECT campaign_id, COUNT(*) FILTER (event_type = 'view') AS viewed, COUNT(*) FILTER (event_type = 'click') AS clicked,
  COUNT(*) FILTER (event_type = 'signup') AS signed_up FROM e GROUP BY 1)
SELECT k.*, COALESCE(orders, 0) AS orders_within_1d, (CAST(COALESCE(orders, 0) AS DOUBLE) / NULLIF(clicked, 0)) AS conversion_rate
FROM k LEFT JOIN {attributed_sql('1 DAY')} a ON a.campaign_id = k.campaign_id
""", tags=("marts",))
def funnel(t):
    events = staged_events(t)
    steps = {"viewed": "view", "clicked": "click", "signed_up": "signup"}
    counts = events.groupBy("campaign_id").agg(
        *[count_where(F.col("event_type") == kind).alias(n) for n, kind in steps.items()]
    )
    joined = counts.join(attributed(t, "1 DAY").drop("revenue"), "campaign_id", "left")
    orders = F.coalesce("orders", F.lit(0))
    return joined.select(
        "campaign_id", *steps, orders.alias("orders_within_1d"),
        ratio(orders, F.col("clicked")).alias("conversion_rate"),
    )


@model("cmp_08_attribution_roi", f"""
WITH {EVENTS}, k AS (SELECT campaign_id, CAST(SUM(value_cents) FILTER (event_type = 'view') AS BIGINT) AS cost_cents FROM e GROUP BY 1)
SELECT k.campaign_id, COALESCE(cost_cents, 0) AS cost_cents, COALESCE(orders, 0) AS attributed_orders,
  COALESCE(revenue, 0) AS revenue_cents, (CAST(COALESCE(revenue, 0) - cost_cents AS DOUBLE) / NULLIF(cost_cents, 0)) AS roi,
  CASE WHEN cost_cents IS NULL OR cost_cents = 0 THEN NULL WHEN COALESCE(revenue, 0) < cost_cents THEN 'low_roi'
       WHEN COALESCE(revenue, 0) < 5 * cost_cents THEN 'medium_roi' ELSE 'high_roi' END AS roi_category
FROM k LEFT JOIN {attributed_sql('7 DAYS')} a ON a.campaign_id = k.campaign_id
""", tags=("marts",))
def attribution_roi(t):
    events = staged_events(t)
    viewed = F.when(F.col("event_type") == "view", F.col("value_cents"))
    cost = events.groupBy("campaign_id").agg(F.sum(viewed).alias("cost"))
    joined = cost.join(attributed(t, "7 DAYS"), "campaign_id", "left")
    revenue, spent = F.coalesce("revenue", F.lit(0)), F.col("cost")
    category = cond.first_match(
        [(spent.isNull() | (spent == 0), None), (revenue < spent, "low_roi"),
         (revenue < 5 * spent, "medium_roi")],
        "high_roi",
    )
    return joined.select(
        "campaign_id", F.coalesce("cost", F.lit(0)).alias("cost_cents"),
        F.coalesce("orders", F.lit(0)).alias("attributed_orders"), revenue.alias("revenue_cents"),
        ratio(revenue - spent, spent).alias("roi"), category.alias("roi_category"),
    )


def sessions(t):
    """A user's day is a session."""
    kind = F.col("event_type")
    return t.events.groupBy("user_id", dates.as_date(F.col("ts")).alias("day")).agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"),
        count_where(kind == "view").alias("pages"), any_true(kind == "purchase").alias("converted"),
    )


SESSIONS = f"""s AS (SELECT user_id, CAST(ts AS DATE) AS day, MIN(ts) AS started, MAX(ts) AS ended,
  COUNT(*) FILTER (event_type = 'view') AS pages, bool_or(event_type = 'purchase') AS converted FROM events GROUP BY {SESSION_KEY})"""


@model("cmp_09_session_conversion", f"""
WITH {SESSIONS}
SELECT CASE WHEN hour(started) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(started) BETWEEN 12 AND 17 THEN 'afternoon'
  WHEN hour(started) BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS time_of_day, COUNT(*) AS total_sessions,
  COUNT(*) FILTER (converted) AS converted_sessions, (CAST(COUNT(*) FILTER (converted) AS DOUBLE) / COUNT(*)) AS conversion_rate
FROM s GROUP BY 1
""", tags=("marts",))
def session_conversion(t):
    hit = count_where(F.col("converted"))
    return sessions(t).groupBy(dates.time_band(F.col("started")).alias("time_of_day")).agg(
        n_rows().alias("total_sessions"), hit.alias("converted_sessions"),
        ratio(hit, n_rows()).alias("conversion_rate"),
    )


@model("cmp_10_session_engagement", f"""
WITH {SESSIONS}, d AS (SELECT *, (epoch_us(ended) - epoch_us(started)) / 60000000.0::DOUBLE AS m FROM s)
SELECT user_id, day, pages AS page_count, m AS duration_minutes,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY day) AS session_rank,
  CASE WHEN m < 2 THEN 'bounce' WHEN m < 60 THEN 'light' WHEN m < 480 THEN 'engaged' ELSE 'deep' END AS engagement FROM d
""", tags=("marts",))
def session_engagement(t):
    minutes = dates.minutes_between(F.col("started"), F.col("ended"))
    bands = [(2, "bounce"), (60, "light"), (480, "engaged")]
    rows = sessions(t).select(
        "user_id", "day", F.col("pages").alias("page_count"),
        minutes.alias("duration_minutes"),
        cond.tiers(minutes, bands, "deep").alias("engagement"),
    )
    return ordered_columns(rows, ["user_id"], ["day"], [RowNumber("session_rank")], t.row_count("events"))


@model("cmp_11_journey", """
WITH f AS (SELECT user_id, MIN(ts) AS first_touch, MIN(ts) FILTER (event_type = 'purchase') AS first_order FROM events GROUP BY 1)
SELECT user_id, CAST(first_touch AS DATE) AS first_touch_date, CAST(first_order AS DATE) AS first_order_date,
  date_diff('day', CAST(first_touch AS DATE), CAST(first_order AS DATE)) AS days_to_convert,
  COUNT(*) FILTER (ts < first_order) AS touches_before_order, COUNT(DISTINCT CAST(ts AS DATE)) FILTER (ts < first_order) AS days_before_order
FROM events JOIN f USING (user_id) GROUP BY user_id, first_touch, first_order
""", tags=("marts",))
def journey(t):
    bought = F.when(F.col("event_type") == "purchase", F.col("ts"))
    events = t.events.select("user_id", "ts", "event_type").filter(F.col("user_id").isNotNull())
    beside = group_values(
        events, ["user_id"], {"first_touch": F.min("ts"), "first_order": F.min(bought)}
    )
    before = F.col("ts") < F.col("first_order")
    # One row per user and day first; the day count needs no distinct then.
    per_day = beside.groupBy("user_id", dates.as_date(F.col("ts")).alias("day")).agg(
        F.min("first_touch").alias("first_touch"), F.min("first_order").alias("first_order"),
        count_where(before).alias("n"),
    )
    touch, order = F.min("first_touch"), F.min("first_order")
    return per_day.groupBy("user_id").agg(
        dates.as_date(touch).alias("first_touch_date"), dates.as_date(order).alias("first_order_date"),
        dates.days_between(touch, order).alias("days_to_convert"),
        F.sum("n").alias("touches_before_order"),
        count_where(F.col("n") > 0).alias("days_before_order"),
    )


# --- baskets and products ---------------------------------------------------


@model("cmp_12_cross_sell", """
WITH i AS (SELECT DISTINCT l_orderkey AS o, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT x.b AS brand_a, y.b AS brand_b, COUNT(*) AS pair_count,
       (CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(DISTINCT o) FROM i) * 100.0) AS pct_of_orders
FROM i x JOIN i y ON x.o = y.o AND x.b < y.b GROUP BY 1, 2
""", tags=("marts",))
def cross_sell(t):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    pairs = basket_pairs(lines, "l_orderkey", "p_brand")
    orders = lines.agg(F.countDistinct("l_orderkey")).scalar()
    return pairs.select(
        F.col("item_a").alias("brand_a"), F.col("item_b").alias("brand_b"), "pair_count",
        (ratio(F.col("pair_count"), orders) * 100.0).alias("pct_of_orders"),
    )


@model("cmp_13_affinity", """
SELECT o_custkey AS customer_id, l_partkey AS product_id, COUNT(*) AS times_purchased,
       CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
""", tags=("marts",))
def affinity(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(
        F.col("o_custkey").alias("customer_id"), F.col("l_partkey").alias("product_id")
    ).agg(
        n_rows().alias("times_purchased"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("total_quantity"),
    )


@model("cmp_14_pareto", f"""
WITH p AS (SELECT l_partkey AS product_id, CAST(SUM({LINE_UNITS}) AS BIGINT) AS units FROM lineitem GROUP BY 1)
SELECT product_id, units, (CAST(SUM(units) OVER (ORDER BY units DESC, product_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)
  / CAST(SUM(units) OVER () AS DOUBLE) * 100.0) AS cumulative_pct,
  ROW_NUMBER() OVER (ORDER BY units DESC, product_id) * 5 <= COUNT(*) OVER () AS is_top_20_pct FROM p
""", tags=("marts",))
def pareto(t):
    sales = t.lineitem.groupBy(F.col("l_partkey").alias("product_id")).agg(
        F.sum(line_units()).alias("units")
    )
    run = ordered_columns(
        sales, [], ["-units", "product_id"], [Running("upto", "units", wide=True), RowNumber("place")],
        rows_at_most=t.row_count("lineitem"),
    )
    run = group_values(run, [], {"whole": wide_sum("units"), "n": n_rows()})
    return run.select(
        "product_id", "units",
        (ratio(F.col("upto"), F.col("whole")) * 100.0).alias("cumulative_pct"),
        (F.col("place") * 5 <= F.col("n")).alias("is_top_20_pct"),
    )


@model("cmp_15_nps", """
SELECT COUNT(*) AS total_reviews, (CAST(COUNT(*) FILTER (quality = 1) AS DOUBLE) / COUNT(*) * 100.0) AS promoters_pct,
  (CAST(COUNT(*) FILTER (toxic = 1) AS DOUBLE) / COUNT(*) * 100.0) AS detractors_pct,
  (CAST(COUNT(*) FILTER (quality = 1) - COUNT(*) FILTER (toxic = 1) AS DOUBLE) / COUNT(*) * 100.0) AS nps_score FROM labels
""", tags=("marts",))
def nps(t):
    good, bad = count_where(F.col("quality") == 1), count_where(F.col("toxic") == 1)
    return t.labels.agg(
        n_rows().alias("total_reviews"), percent(good, n_rows()).alias("promoters_pct"),
        percent(bad, n_rows()).alias("detractors_pct"),
        percent(good - bad, n_rows()).alias("nps_score"),
    )


@model("cmp_16_repeat_buyers", f"""
WITH b AS (SELECT p_type AS category, o_custkey AS c, COUNT(DISTINCT o_orderkey) AS n, CAST(SUM({LINE_UNITS}) AS BIGINT) AS units
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT category, COUNT(*) AS unique_customers, COUNT(*) FILTER (n > 1) AS repeat_customers,
  (CAST(COUNT(*) FILTER (n > 1) AS DOUBLE) / COUNT(*) * 100.0) AS repeat_rate_pct,
  (CAST(SUM(units) AS DOUBLE) / COUNT(*) / 10000.0) AS avg_spend FROM b GROUP BY 1
""", tags=("marts",))
def repeat_buyers(t):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    per_order = lines.groupBy("l_orderkey", F.col("p_type").alias("category")).agg(
        F.sum(line_units()).alias("units")
    )
    joined = per_order.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    per_buyer = joined.groupBy("category", "o_custkey").agg(
        n_rows().alias("n"), F.sum("units").alias("units")
    )
    again = count_where(F.col("n") > 1)
    mean = ratio(F.sum("units"), n_rows()) / float(UNITS)
    return per_buyer.groupBy("category").agg(
        n_rows().alias("unique_customers"), again.alias("repeat_customers"),
        percent(again, n_rows()).alias("repeat_rate_pct"), mean.alias("avg_spend"),
    )


# --- inventory and shipping -------------------------------------------------


@model("cmp_17_days_of_supply", f"""
WITH s AS (SELECT l_partkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sold FROM lineitem
  WHERE {SHIP} > (SELECT MAX({SHIP}) FROM lineitem) - 360 GROUP BY 1)
SELECT p_partkey AS product_id, CAST(p_size * 10 AS BIGINT) AS current_stock, COALESCE(sold, 0) AS units_sold,
  (CAST(COALESCE(sold, 0) AS DOUBLE) / NULLIF(p_size * 10, 0)) AS turnover_rate,
  (CAST(p_size * 10 AS DOUBLE) / NULLIF(CAST(sold AS DOUBLE) / 360.0, 0)) AS days_of_supply
FROM part LEFT JOIN s ON p_partkey = l_partkey
""", tags=("marts",))
def days_of_supply(t, days: int = 360):
    shipped = dates.as_date(F.col("l_shipdate"))
    newest = t.lineitem.agg(F.max("l_shipdate")).scalar()
    recent = t.lineitem.filter(shipped > F.date_sub(newest, days))
    rows = agg_then_join(
        t.part.select(F.col("p_partkey").alias("product_id"), (F.col("p_size") * 10).cast("bigint").alias("current_stock")),
        "product_id",
        [(recent, "l_partkey", {"sold": F.sum(F.col("l_quantity").cast("bigint"))})],
    )
    sold, stock = F.coalesce("sold", F.lit(0)), F.col("current_stock")
    daily = F.col("sold").cast("double") / float(days)
    return rows.select(
        "product_id", "current_stock", sold.alias("units_sold"),
        ratio(sold, stock).alias("turnover_rate"),
        ratio(stock, daily).alias("days_of_supply"),
    )


@model("cmp_18_reorder_report", """
WITH s AS (SELECT l_partkey, l_suppkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sold FROM lineitem GROUP BY 1, 2)
SELECT p_partkey AS product_id, p_name AS product_name, s_name AS supplier_name, CAST(p_size AS BIGINT) AS quantity_on_hand,
  sold AS reorder_point, sold - p_size AS shortage
FROM s JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size < sold
""", tags=("marts",))
def reorder_report(t):
    """What was sold of a product by a supplier is the level to keep."""
    sold = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("sold")
    )
    joined = sold.join(t.part, F.col("l_partkey") == F.col("p_partkey")).filter(
        F.col("p_size") < F.col("sold")
    )
    return joined.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("s_name").alias("supplier_name"), F.col("p_size").cast("bigint").alias("quantity_on_hand"),
        F.col("sold").alias("reorder_point"), (F.col("sold") - F.col("p_size")).alias("shortage"),
    )


@model("cmp_19_warehouse_utilisation", f"""
WITH w AS (SELECT l_suppkey, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS stock, CAST(SUM({cents('l_extendedprice')}) AS BIGINT) AS value_cents,
  COUNT(*) FILTER (l_quantity < 5) AS low FROM lineitem GROUP BY 1)
SELECT s_suppkey AS warehouse_id, s_name AS name, COALESCE(stock, 0) AS total_stock, {dollars('COALESCE(value_cents, 0)')} AS stock_value,
  (CAST(COALESCE(stock, 0) AS DOUBLE) / 20000 * 100.0) AS utilization_pct, COALESCE(low, 0) AS items_below_reorder
FROM supplier LEFT JOIN w ON s_suppkey = l_suppkey
""", tags=("marts",))
def warehouse_utilisation(t, capacity: int = 20_000):
    rows = agg_then_join(
        t.supplier.select(F.col("s_suppkey").alias("warehouse_id"), F.col("s_name").alias("name")),
        "warehouse_id",
        [(t.lineitem, "l_suppkey", {
            "total_stock": F.sum(F.col("l_quantity").cast("bigint")),
            "value": F.sum(to_minor("l_extendedprice")),
            "items_below_reorder": count_where(F.col("l_quantity") < 5),
        })],
        {"total_stock": 0, "value": 0, "items_below_reorder": 0},
    )
    return rows.select(
        "warehouse_id", "name", "total_stock", to_major("value").alias("stock_value"),
        percent(F.col("total_stock"), F.lit(capacity)).alias("utilization_pct"), "items_below_reorder",
    )


DELIVERY = f"""d AS (SELECT l_suppkey AS carrier_id, date_diff('day', {ORDER_DAY}, {SHIP}) AS days, {cents('l_extendedprice')} AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@model("cmp_20_carrier_performance", f"""
WITH {DELIVERY}
SELECT carrier_id, COUNT(*) AS total_shipments, (CAST(SUM(days) AS DOUBLE) / COUNT(*)) AS avg_delivery_days,
  (CAST(COUNT(*) FILTER (days <= 30) AS DOUBLE) / COUNT(*) * 100.0) AS on_time_pct,
  COUNT(*) FILTER (days > 30 AND days <= 60) AS late, COUNT(*) FILTER (days > 60) AS sla_breaches FROM d GROUP BY 1
""", tags=("marts",))
def carrier_performance(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = joined.select(
        F.col("l_suppkey").alias("carrier_id"),
        dates.days_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("days"),
    )
    sla = cond.tiers(F.col("days"), [(30, "on_time"), (60, "late")], "breach", inclusive=True)
    rows = rows.withColumn("sla", sla)

    def of(label):
        return count_where(F.col("sla") == label)

    return rows.groupBy("carrier_id").agg(
        n_rows().alias("total_shipments"),
        ratio(F.sum("days"), n_rows()).alias("avg_delivery_days"),
        percent(of("on_time"), n_rows()).alias("on_time_pct"),
        of("late").alias("late"), of("breach").alias("sla_breaches"),
    )


@model("cmp_21_order_profitability", f"""
WITH l AS (SELECT l_orderkey, CAST(SUM({LINE_UNITS}) AS BIGINT) AS gross, CAST(COALESCE(SUM({LINE_UNITS}) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS refunds,
  MIN({SHIP}) AS first_ship FROM lineitem GROUP BY 1)
SELECT o_orderkey AS order_id, first_ship IS NOT NULL AS has_shipment, date_diff('day', {ORDER_DAY}, first_ship) AS days_to_ship,
  CAST(COALESCE(gross, 0) AS DOUBLE) / 10000.0 AS gross_revenue, CAST(COALESCE(refunds, 0) AS DOUBLE) / 10000.0 AS refund_amount,
  CAST(COALESCE(gross, 0) - COALESCE(refunds, 0) AS DOUBLE) / 10000.0 AS net_revenue,
  (CAST(gross - refunds AS DOUBLE) / NULLIF(gross, 0) * 100.0) AS net_margin_pct
FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
""", tags=("marts",))
def order_profitability(t):
    lines = lines_per_order(
        t, gross=F.sum(line_units()),
        refunds=F.coalesce(F.sum(F.when(returned(), line_units())), F.lit(0)),
        first_ship=F.min("l_shipdate"),
    )
    rows = staged_orders(t).select("order_id", "order_date").join(lines, "order_id", "left")
    gross, refunds = F.coalesce("gross", F.lit(0)), F.coalesce("refunds", F.lit(0))
    return rows.select(
        "order_id", F.col("first_ship").isNotNull().alias("has_shipment"),
        dates.days_between(F.col("order_date"), F.col("first_ship")).alias("days_to_ship"),
        units_to_dollars(gross).alias("gross_revenue"),
        units_to_dollars(refunds).alias("refund_amount"),
        units_to_dollars(gross - refunds).alias("net_revenue"),
        percent(F.col("gross") - F.col("refunds"), F.col("gross")).alias("net_margin_pct"),
    )


@model("cmp_22_return_analysis", """
WITH l AS (SELECT l_suppkey AS supplier_id, p_type, COUNT(*) AS n, COUNT(*) FILTER (l_returnflag = 'R') AS back
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT supplier_id, CAST(SUM(n) AS BIGINT) AS units_sold, CAST(SUM(back) AS BIGINT) AS return_count,
  (CAST(SUM(back) AS DOUBLE) / SUM(n)) AS return_rate,
  string_agg(DISTINCT p_type, ', ' ORDER BY p_type) FILTER (back > 0) AS returned_categories FROM l GROUP BY 1
""", tags=("marts",))
def return_analysis(t):
    per_part = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(
        n_rows().alias("n"), count_where(returned()).alias("back")
    )
    joined = per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    kinds = joined.groupBy(F.col("l_suppkey").alias("supplier_id"), "p_type").agg(
        F.sum("n").alias("n"), F.sum("back").alias("back")
    )
    listed = sorted_list(F.when(F.col("back") > 0, F.col("p_type")))
    return kinds.groupBy("supplier_id").agg(
        F.sum("n").alias("units_sold"), F.sum("back").alias("return_count"),
        ratio(F.sum("back"), F.sum("n")).alias("return_rate"),
        F.nullif(listed, F.lit("")).alias("returned_categories"),
    )


# --- time and place ---------------------------------------------------------


@model("cmp_23_mrr_trend", f"""
WITH {EVENTS}, s AS (SELECT user_id, value_cents, CAST(ts AS DATE) AS a,
   CAST(LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DATE) AS b FROM e WHERE event_type = 'signup' AND user_id IS NOT NULL),
 d AS (SELECT CAST(unnest(generate_series(MIN(a), DATE '{EVENTS_AS_OF}', INTERVAL 1 DAY)) AS DATE) AS day FROM s)
SELECT day, COUNT(s.user_id) AS subscribers, CAST(COALESCE(SUM(value_cents), 0) AS BIGINT) AS mrr_cents,
  (SELECT COUNT(*) FROM s x WHERE x.b = d.day AND x.b > x.a) AS ended
FROM d LEFT JOIN s ON s.a <= d.day AND (s.b IS NULL OR s.b > d.day) GROUP BY 1
""", tags=("marts",))
def mrr_trend(t, as_of: str = EVENTS_AS_OF):
    """Active subscriptions per day up to ``as_of`` from their starts and ends:
    a running total over the calendar instead of a join of days and periods."""
    signups = staged_events(t, "signup").select("user_id", "event_id", "ts", "value_cents")
    signups = signups.filter(F.col("user_id").isNotNull())
    periods = ordered_columns(signups, ["user_id"], ["ts", "event_id"], [Lead("next", "ts")], t.row_count("events"))
    start, end = dates.as_date(F.col("ts")), dates.as_date(F.col("next"))
    periods = periods.select(start.alias("a"), end.alias("b"), "value_cents").filter(
        F.col("b").isNull() | (F.col("b") > F.col("a"))
    )
    opened = periods.select(
        F.col("a").alias("day"), F.lit(1).alias("n"), "value_cents", F.lit(0).alias("ended")
    )
    closed = periods.filter(F.col("b").isNotNull()).select(
        F.col("b").alias("day"), F.lit(-1).alias("n"), (-F.col("value_cents")).alias("value_cents"),
        F.lit(1).alias("ended"),
    )
    changes = opened.unionByName(closed).groupBy("day").agg(
        F.sum("n").alias("n"), F.sum("value_cents").alias("v"), F.sum("ended").alias("ended")
    )
    first = signups.agg(dates.as_date(F.min("ts")).alias("first"))
    spine = first.select(
        F.explode(F.sequence("first", F.lit(as_of).cast("date"))).alias("day")
    )
    series = spine.join(changes, "day", "left").fillna(0)
    series = running_total(series, "day", "n", "subscribers")
    return running_total(series, "day", "v", "mrr_cents").select(
        "day", "subscribers", "mrr_cents", "ended"
    )


def period_kpis(t, unit: str):
    def start(moment):
        return dates.as_date(moment) if unit == "day" else dates.period_start(moment, unit)

    one = F.lit(1).cast("bigint")
    known = staged_orders(t).filter(F.col("customer_id").isNotNull())  # nobody is no customer
    first = known.groupBy("customer_id").agg(F.min("order_date").alias("d"))
    kpis = outer_by_key(
        "period_start",
        [
            (t.orders, start(day()), {"orders": one, "revenue_cents": amount_cents()}),
            (t.lineitem, start(F.col("l_shipdate")), {"lines_shipped": one}),
            (first, start(F.col("d")), {"new_customers": one}),
        ],
        keep_null=True,
    )
    mean = ratio(F.col("revenue_cents"), F.col("orders")) / 100.0
    sums = ["orders", "revenue_cents", "lines_shipped", "new_customers"]
    return kpis.withColumn("avg_order_value", mean).fillna(0, sums)


def period_kpis_sql(unit: str) -> str:
    return f"""
WITH {ORDERS}, a AS (SELECT date_trunc('{unit}', order_date)::DATE AS k, COUNT(*) AS n, CAST(SUM(amount) AS BIGINT) AS v FROM o GROUP BY 1),
 b AS (SELECT date_trunc('{unit}', {SHIP})::DATE AS k, COUNT(*) AS n FROM lineitem GROUP BY 1),
 f AS (SELECT customer_id, MIN(order_date) AS d FROM o WHERE customer_id IS NOT NULL GROUP BY 1),
 c AS (SELECT date_trunc('{unit}', d)::DATE AS k, COUNT(*) AS n FROM f GROUP BY 1)
SELECT COALESCE(a.k, b.k, c.k) AS period_start, COALESCE(a.n, 0) AS orders, COALESCE(a.v, 0) AS revenue_cents,
  COALESCE(b.n, 0) AS lines_shipped, COALESCE(c.n, 0) AS new_customers, (CAST(a.v AS DOUBLE) / a.n / 100.0) AS avg_order_value
FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k FULL JOIN c ON COALESCE(a.k, b.k) IS NOT DISTINCT FROM c.k
"""


@model("cmp_24_daily_kpis", period_kpis_sql("day"), tags=("marts",))
def daily_kpis(t):
    return period_kpis(t, "day")


@model("cmp_24_weekly_kpis", period_kpis_sql("week"), tags=("marts",))
def weekly_kpis(t):
    return period_kpis(t, "week")


@model("cmp_24_monthly_kpis", period_kpis_sql("month"), tags=("marts",))
def monthly_kpis(t):
    return period_kpis(t, "month")


@model("cmp_24_quarterly_kpis", period_kpis_sql("quarter"), tags=("marts",))
def quarterly_kpis(t):
    return period_kpis(t, "quarter")


@model("cmp_24_annual_kpis", period_kpis_sql("year"), tags=("marts",))
def annual_kpis(t):
    return period_kpis(t, "year")


@model("cmp_25_geographic_revenue", f"""
WITH {ORDERS}, p AS (SELECT customer_id, COUNT(*) AS n, CAST(SUM(amount) AS BIGINT) AS v FROM o GROUP BY 1),
 g AS (SELECT n_name, r_name, c_mktsegment, COUNT(*) AS c, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n, CAST(COALESCE(SUM(v), 0) AS BIGINT) AS v
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN p ON c_custkey = customer_id GROUP BY 1, 2, 3)
SELECT n_name AS nation, r_name AS region, CAST(SUM(c) AS BIGINT) AS customer_count, CAST(SUM(n) AS BIGINT) AS total_orders,
  {dollars('SUM(v)')} AS total_revenue, first(c_mktsegment ORDER BY v DESC, c_mktsegment) AS top_segment FROM g GROUP BY 1, 2
""", tags=("marts",))
def geographic_revenue(t):
    buyers = agg_then_join(
        customers(t), "customer_id",
        [(staged_orders(t), "customer_id", {"n": n_rows(), "v": F.sum("amount")})],
        {"n": 0, "v": 0},
    )
    per_segment = buyers.groupBy("nation_id", "segment").agg(
        n_rows().alias("c"), F.sum("n").alias("n"), F.sum("v").alias("v")
    )
    # Largest value first, then the smaller name.
    best = F.min_by("segment", F.struct(-F.col("v"), F.col("segment")))
    per_nation = per_segment.groupBy("nation_id").agg(
        F.sum("c").alias("customer_count"), F.sum("n").alias("total_orders"),
        to_major(F.sum("v")).alias("total_revenue"), best.alias("top_segment"),
    )
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return per_nation.join(places, F.col("nation_id") == F.col("n_nationkey")).select(
        F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "customer_count",
        "total_orders", "total_revenue", "top_segment",
    )


# --- dimensions, facts, comparisons -----------------------------------------


@model("cmp_26_dim_product", f"""
WITH s AS (SELECT l_partkey, COUNT(*) AS n, CAST(SUM({LINE_UNITS}) AS BIGINT) AS units FROM lineitem GROUP BY 1)
SELECT md5(CAST(p_partkey AS VARCHAR)) AS product_key, p_partkey AS product_id, p_name AS name, p_type AS category, p_brand AS brand,
  {dollars(cents('p_retailprice'))} AS price, CASE WHEN p_retailprice IS NULL THEN NULL WHEN p_retailprice < 925 THEN 'budget' WHEN p_retailprice < 975 THEN 'mid_range' ELSE 'premium' END AS price_tier,
  COALESCE(n, 0) AS times_ordered, CAST(COALESCE(units, 0) AS DOUBLE) / 10000.0 AS total_revenue
FROM part LEFT JOIN s ON p_partkey = l_partkey
""", tags=("marts",))
def dim_product(t):
    products = t.part.withColumnRenamed("p_partkey", "product_id")
    rows = agg_then_join(
        products, "product_id",
        [(t.lineitem, "l_partkey", {"times_ordered": n_rows(), "units": F.sum(line_units())})],
        {"times_ordered": 0, "units": 0},
    )
    bands = [(925, "budget"), (975, "mid_range")]
    return rows.select(
        surrogate_key(F.col("product_id")).alias("product_key"), "product_id",
        F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        to_major(to_minor("p_retailprice")).alias("price"),
        cond.tiers(F.col("p_retailprice"), bands, "premium").alias("price_tier"),
        "times_ordered", units_to_dollars("units").alias("total_revenue"),
    )


@model("cmp_27_fct_order", f"""
WITH l AS (SELECT l_orderkey, COUNT(*) AS item_count, CAST(SUM({cents('l_extendedprice')}) AS BIGINT) AS gross, CAST(SUM({LINE_UNITS}) AS BIGINT) AS net,
  bool_and(l_linestatus = 'F') AS all_shipped FROM lineitem GROUP BY 1)
SELECT o_orderkey AS order_id, o_custkey AS customer_id, {ORDER_DAY} AS order_date, o_orderstatus AS status, COALESCE(item_count, 0) AS item_count,
  {dollars('COALESCE(gross, 0)')} AS gross_amount, CAST(COALESCE(gross * 100 - net, 0) AS DOUBLE) / 10000.0 AS discount_amount,
  CAST(COALESCE(net, 0) AS DOUBLE) / 10000.0 AS net_amount,
  CASE WHEN all_shipped IS NULL THEN 'no_items' WHEN all_shipped THEN 'shipped' ELSE 'partial' END AS shipping_status
FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
""", tags=("marts",))
def fct_order(t):
    lines = lines_per_order(
        t, item_count=n_rows(), gross=F.sum(to_minor("l_extendedprice")), net=F.sum(line_units()),
        all_shipped=F.bool_and(F.col("l_linestatus") == "F"),
    )
    rows = staged_orders(t).join(lines, "order_id", "left")
    gross, net = F.col("gross"), F.col("net")
    state = cond.first_match(
        [(F.col("all_shipped").isNull(), "no_items"), (F.col("all_shipped"), "shipped")], "partial"
    )
    return rows.select(
        "order_id", "customer_id", "order_date", "status",
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
        to_major(F.coalesce(gross, F.lit(0))).alias("gross_amount"),
        units_to_dollars(F.coalesce(gross * 100 - net, F.lit(0))).alias("discount_amount"),
        units_to_dollars(F.coalesce(net, F.lit(0))).alias("net_amount"),
        state.alias("shipping_status"),
    )


@model("cmp_28_group_comparison", f"""
WITH {ORDERS}, p AS (SELECT customer_id, COUNT(*) AS n, CAST(SUM(amount) AS BIGINT) AS v FROM o GROUP BY 1),
 x AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT x.user_id IS NOT NULL AS has_errors, COUNT(*) AS customer_count, (CAST(SUM(COALESCE(n, 0)) AS DOUBLE) / COUNT(*)) AS avg_orders,
  (CAST(SUM(COALESCE(v, 0)) AS DOUBLE) / COUNT(*) / 100.0) AS avg_spend
FROM customer LEFT JOIN p ON c_custkey = customer_id LEFT JOIN x ON c_custkey = user_id GROUP BY 1
""", tags=("marts",))
def group_comparison(t):
    errors = t.events.filter(F.col("event_type") == "error")
    rows = agg_then_join(
        customers(t).select("customer_id"), "customer_id",
        [
            (staged_orders(t), "customer_id", {"n": n_rows(), "v": F.sum("amount")}),
            (errors, "user_id", {"errors": n_rows()}),
        ],
        {"n": 0, "v": 0},
    )
    return rows.groupBy(F.col("errors").isNotNull().alias("has_errors")).agg(
        n_rows().alias("customer_count"),
        ratio(F.sum("n"), n_rows()).alias("avg_orders"),
        (ratio(F.sum("v"), n_rows()) / 100.0).alias("avg_spend"),
    )


@model("cmp_29_workload", f"""
WITH w AS (SELECT l_suppkey, COUNT(*) AS assigned, COUNT(*) FILTER (l_linestatus = 'F') AS resolved,
   CAST(SUM(date_diff('day', {ORDER_DAY}, {SHIP})) FILTER (l_linestatus = 'F') AS BIGINT) AS days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT s_suppkey AS employee_id, s_name AS employee_name, n_name AS department, COALESCE(assigned, 0) AS tickets_assigned,
  COALESCE(resolved, 0) AS tickets_resolved, (CAST(days AS DOUBLE) / NULLIF(resolved, 0)) AS avg_resolution_days
FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN w ON s_suppkey = l_suppkey
""", tags=("marts",))
def workload(t):
    """Suppliers work on lines; a finished line is resolved at its ship date."""
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    done = F.col("l_linestatus") == "F"
    took = dates.days_between(F.col("o_orderdate"), F.col("l_shipdate"))
    staff = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("employee_id"), F.col("s_name").alias("employee_name"),
        F.col("n_name").alias("department"),
    )
    rows = agg_then_join(
        staff, "employee_id",
        [(joined, "l_suppkey", {
            "tickets_assigned": n_rows(), "tickets_resolved": count_where(done),
            "days": F.sum(F.when(done, took)),
        })],
        {"tickets_assigned": 0, "tickets_resolved": 0},
    )
    mean = ratio(F.col("days"), F.col("tickets_resolved"))
    return rows.select(
        "employee_id", "employee_name", "department", "tickets_assigned", "tickets_resolved",
        mean.alias("avg_resolution_days"),
    )


@model("cmp_30_risk", f"""
WITH {ORDERS}, l AS (SELECT l_orderkey AS order_id, COUNT(*) FILTER (l_returnflag = 'R') AS back FROM lineitem GROUP BY 1),
 r AS (SELECT customer_id, CAST(COALESCE(SUM(back), 0) AS BIGINT) AS refunds, COUNT(*) FILTER (priority = '1-URGENT') AS urgent,
   COUNT(*) FILTER (status = 'F') AS done, COUNT(*) FILTER (amount > 45000000) AS large FROM o LEFT JOIN l USING (order_id) GROUP BY 1)
SELECT c_custkey AS customer_id, CAST(COALESCE(refunds, 0) + COALESCE(urgent, 0) - COALESCE(done, 0) AS DOUBLE) AS risk_score,
  CASE WHEN COALESCE(refunds, 0) + COALESCE(urgent, 0) - COALESCE(done, 0) > 10 THEN 'high_risk'
       WHEN COALESCE(refunds, 0) + COALESCE(urgent, 0) - COALESCE(done, 0) > 3 THEN 'medium_risk' ELSE 'low_risk' END AS risk_category,
  COALESCE(large, 0) > 1 OR (COALESCE(large, 0) > 0 AND c_acctbal < 0) AS suspicious
FROM customer LEFT JOIN r ON c_custkey = customer_id
""", tags=("marts",))
def risk(t):
    back = lines_per_order(t, back=count_where(returned()))
    orders = staged_orders(t).join(back, "order_id", "left")
    rows = agg_then_join(
        t.customer.select(F.col("c_custkey").alias("customer_id"), "c_acctbal"), "customer_id",
        [(orders, "customer_id", {
            "refunds": F.sum("back"), "urgent": count_where(F.col("priority") == "1-URGENT"),
            "done": count_where(F.col("status") == "F"),
            "large": count_where(F.col("amount") > 45_000_000),
        })],
        {"large": 0},
    )
    score = weighted_score([(F.col("refunds"), 1), (F.col("urgent"), 1), (F.col("done"), -1)])
    large = F.col("large")
    category = cond.tiers(score, [(3, "low_risk"), (10, "medium_risk")], "high_risk", inclusive=True)
    return rows.select(
        "customer_id", score.alias("risk_score"), category.alias("risk_category"),
        ((large > 1) | ((large > 0) & (F.col("c_acctbal") < 0))).alias("suspicious"),
    )
