"""Joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tallyloom.functions.conditions import range_map
from tallyloom.functions.dates import as_date, month_label, period_start
from tallyloom.functions.money import ratio, to_major, to_minor
from tallyloom.operators.aggregates import (
    any_true,
    count_where,
    distinct_bitmaps,
    distinct_rollup,
    exact_median,
    group_by_named,
    guarded_avg,
    list_per_group,
    mode_per_group,
    pivot_sums,
    share_of_total,
    wide_sum,
)
from tallyloom.operators.joins import (
    agg_then_join,
    ancestor_paths,
    basket_pairs,
    having_match,
    join_first,
    join_on_name,
    last_before,
    merge_intervals,
    next_after,
    outer_by_key,
    pairs_within_days,
    parent_levels,
    range_join,
    same_day,
    sum_in_intervals,
    without_match,
)
from tallyloom.operators.windows import Lead, group_values, ordered_columns
from tallyloom.plans.registry import (
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
)
from tallyloom.session import frozen

ROLLUP_UNITS = ("day", "week", "month", "quarter", "year")
SHIP_DAY = "CAST(l_shipdate AS DATE)"
EVENT_SQL = """
SELECT event_id, user_id, ts, event_type, CAST(ROUND(value * 100) AS BIGINT) AS value_cents,
       CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS campaign_id
FROM events
"""


def total(minor: str) -> str:
    return dollars(f"CAST(SUM({minor}) AS BIGINT)")


# --- joins ------------------------------------------------------------------


@model("jon_01_inner", f"""
SELECT l_orderkey AS order_id, l_linenumber AS line_no, p_name AS product_name, p_type AS category,
       CAST(l_quantity AS BIGINT) AS quantity, CAST({LINE_UNITS} AS DOUBLE) / 10000.0 AS line_total
FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def inner(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("p_name").alias("product_name"), F.col("p_type").alias("category"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        to_major(line_units(), UNITS).alias("line_total"),
    )


@model("jon_02_left", """
SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def left(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    return joined.select("doc_id", "lang", "source", "quality", "toxic")


@model("jon_03_aggregate_then_join", f"""
WITH o AS (SELECT o_custkey AS k, COUNT(*) AS order_count, CAST(SUM({cents('o_totalprice')}) AS BIGINT) AS spend
           FROM orders GROUP BY 1),
     e AS (SELECT user_id AS k, COUNT(*) AS event_count FROM events GROUP BY 1)
SELECT c_custkey AS customer_id, c_name AS name, COALESCE(order_count, 0) AS order_count,
       COALESCE(spend, 0) AS spend_cents, COALESCE(event_count, 0) AS event_count
FROM customer LEFT JOIN o ON c_custkey = o.k LEFT JOIN e ON c_custkey = e.k
""")
def aggregate_then_join(t):
    customers = t.customer.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name")
    )
    return agg_then_join(
        customers,
        "customer_id",
        [
            (t.orders, "o_custkey", {"order_count": n_rows(), "spend_cents": F.sum(amount_cents())}),
            (t.events, "user_id", {"event_count": n_rows()}),
        ],
        {"order_count": 0, "spend_cents": 0, "event_count": 0},
    )


@model("jon_04_three_tables", f"""
SELECT l_orderkey AS order_id, l_linenumber AS line_no, {ORDER_DAY} AS order_date,
       p_name AS product_name, {cents('l_extendedprice')} AS price_cents
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE l_returnflag = 'R'
""")
def three_tables(t):
    lines = t.lineitem.filter(F.col("l_returnflag") == "R")
    joined = lines.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(
        t.orders, F.col("l_orderkey") == F.col("o_orderkey")
    )
    return joined.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        day().alias("order_date"), F.col("p_name").alias("product_name"),
        to_minor("l_extendedprice").alias("price_cents"),
    )


@model("jon_05_many_tables", f"""
SELECT o_orderkey AS order_id, c_name AS customer, n_name AS nation, r_name AS region,
       p_brand AS brand, s_name AS supplier, {cents('l_extendedprice')} AS price_cents
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
""")
def many_tables(t):
    buyers = (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_name", "n_name", "r_name")
    )
    return (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("order_id"), F.col("c_name").alias("customer"),
            F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
            F.col("p_brand").alias("brand"), F.col("s_name").alias("supplier"),
            to_minor("l_extendedprice").alias("price_cents"),
        )
    )


@model("jon_06_full_outer_dates", f"""
WITH o AS (SELECT {ORDER_DAY} AS d, COUNT(*) AS n, CAST(SUM({cents('o_totalprice')}) AS BIGINT) AS v FROM orders GROUP BY 1),
     s AS (SELECT {SHIP_DAY} AS d, COUNT(*) AS n FROM lineitem GROUP BY 1),
     r AS (SELECT {SHIP_DAY} AS d, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT COALESCE(o.d, s.d, r.d) AS metric_date, COALESCE(o.n, 0) AS orders_count,
       COALESCE(o.v, 0) AS revenue_cents, COALESCE(s.n, 0) AS lines_shipped,
       COALESCE(r.n, 0) AS lines_returned
FROM o FULL JOIN s ON o.d IS NOT DISTINCT FROM s.d FULL JOIN r ON COALESCE(o.d, s.d) IS NOT DISTINCT FROM r.d
""")
def full_outer_dates(t):
    one = F.lit(1).cast("bigint")
    back = (F.col("l_returnflag") == "R").cast("bigint")
    return outer_by_key(
        "metric_date",
        [
            (t.orders, day(), {"orders_count": one, "revenue_cents": amount_cents()}),
            (t.lineitem, as_date(F.col("l_shipdate")), {"lines_shipped": one, "lines_returned": back}),
        ],
    )


@model("jon_07_pairs_within_days", f"""
WITH o AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, {ORDER_DAY} AS order_date FROM orders)
SELECT a.customer_id, a.order_id, a.order_date, b.order_id AS related_order_id,
       b.order_date AS related_order_date
FROM o a JOIN o b ON a.customer_id = b.customer_id AND a.order_id <> b.order_id
 AND ABS(date_diff('day', a.order_date, b.order_date)) <= 30
""")
def related_orders(t):
    return pairs_within_days(staged_orders(t), "customer_id", "order_id", "order_date", 30)


@model("jon_08_basket_pairs", """
WITH i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)
SELECT a.p AS item_a, b.p AS item_b, COUNT(*) AS pair_count
FROM i a JOIN i b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2
""")
def co_purchase(t):
    return basket_pairs(t.lineitem, "l_orderkey", "l_partkey")


@model("jon_09_event_window", f"""
WITH e AS ({EVENT_SQL}),
     hit AS (SELECT DISTINCT c.campaign_id, p.event_id, p.value_cents
             FROM e c JOIN e p ON c.user_id = p.user_id AND c.event_type = 'click'
              AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 DAY),
     k AS (SELECT DISTINCT campaign_id FROM e WHERE event_type = 'click')
SELECT k.campaign_id, COUNT(hit.event_id) AS attributed_orders,
       CAST(COALESCE(SUM(value_cents), 0) AS BIGINT) AS revenue_cents
FROM k LEFT JOIN hit ON k.campaign_id IS NOT DISTINCT FROM hit.campaign_id GROUP BY 1
""")
def event_window(t):
    """Purchases within a day of any click of a campaign, each counted once."""
    clicks = staged_events(t, "click")
    bought = staged_events(t, "purchase").withColumn("one", F.lit(1))
    known = clicks.filter(F.col("user_id").isNotNull())
    spans = merge_intervals(
        known, ["campaign_id", "user_id"], "ts", F.expr("INTERVAL 1 DAY"), rows_at_most=t.row_count("events")
    )
    # Clicks of nobody keep their campaign in the result; they hold nothing.
    nobody = clicks.filter(F.col("user_id").isNull()).select("campaign_id").distinct()
    spans = spans.unionByName(nobody, allowMissingColumns=True)
    sums = {"attributed_orders": "one", "revenue_cents": "value_cents"}
    # Two ends per interval and one row per purchase.
    bound = 2 * t.row_count("events")
    hits = sum_in_intervals(spans, bought, "user_id", "ts", sums, bound)
    return hits.groupBy("campaign_id").agg(*[F.sum(c).alias(c) for c in sums])


@model("jon_09_next_event", f"""
WITH e AS ({EVENT_SQL})
SELECT c.campaign_id, COUNT(*) AS total_clicks, COUNT(*) FILTER (hit) AS purchases_within_3d,
       CAST(COUNT(*) FILTER (hit) AS DOUBLE) / COUNT(*) AS click_to_purchase_rate
FROM (SELECT campaign_id, EXISTS (SELECT 1 FROM e p WHERE p.event_type = 'purchase' AND p.user_id = k.user_id
        AND p.ts >= k.ts AND p.ts <= k.ts + INTERVAL 3 DAYS) AS hit
      FROM e k WHERE event_type = 'click') c GROUP BY 1
""")
def next_event(t):
    """Clicks followed by a purchase of the user within three days."""
    clicks = staged_events(t, "click").select("campaign_id", "user_id", "ts")
    bought = staged_events(t, "purchase")
    seen = next_after(clicks, bought, "user_id", "ts", "bought_at", rows_at_most=t.row_count("events"))
    hit = count_where(F.col("bought_at") <= F.col("ts") + F.expr("INTERVAL 3 DAYS"))
    return seen.groupBy("campaign_id").agg(
        n_rows().alias("total_clicks"), hit.alias("purchases_within_3d"),
        ratio(hit, n_rows()).alias("click_to_purchase_rate"),
    )


@model("jon_09_last_touch", f"""
WITH e AS ({EVENT_SQL})
SELECT p.event_id, p.user_id, (SELECT MAX(c.ts) FROM e c WHERE c.event_type = 'click' AND c.user_id = p.user_id
  AND c.ts <= p.ts) AS last_click FROM e p WHERE p.event_type = 'purchase'
""")
def last_touch(t):
    """Each purchase with the user's latest click before it."""
    bought = staged_events(t, "purchase").select("event_id", "user_id", "ts")
    clicks = staged_events(t, "click")
    seen = last_before(bought, clicks, "user_id", "ts", "last_click", rows_at_most=t.row_count("events"))
    return seen.drop("ts")


@model("jon_10_validity_period", f"""
WITH e AS ({EVENT_SQL}),
     s AS (SELECT event_id AS period_id, user_id, ts AS "start",
                  COALESCE(LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id),
                           TIMESTAMP '{EVENTS_AS_OF} 00:00:00') AS "end"
           FROM e WHERE event_type = 'signup')
SELECT s.period_id, s.user_id, COUNT(p.event_id) AS orders_in_period,
       CAST(COALESCE(SUM(p.value_cents), 0) AS BIGINT) AS value_cents
FROM s LEFT JOIN e p ON p.user_id = s.user_id AND p.event_type = 'purchase'
 AND p.ts BETWEEN s."start" AND s."end"
GROUP BY 1, 2
""")
def validity_period(t, as_of: str = EVENTS_AS_OF):
    """A signup is valid until the next one; the last one until ``as_of``."""
    signups = staged_events(t, "signup").select(
        F.col("event_id").alias("period_id"), "user_id", F.col("ts").alias("start")
    )
    periods = ordered_columns(
        signups, ["user_id"], ["start", "period_id"], [Lead("next", "start")], t.row_count("events")
    )
    open_end = F.lit(f"{as_of} 00:00:00").cast("timestamp_ntz")
    periods = periods.select(
        "period_id", "user_id", "start", F.coalesce("next", open_end).alias("end")
    )
    bought = staged_events(t, "purchase").withColumn("one", F.lit(1))
    sums = {"orders_in_period": "one", "value_cents": "value_cents"}
    inside = sum_in_intervals(periods, bought, "user_id", "ts", sums, 2 * t.row_count("events"))
    return inside.select("period_id", "user_id", *sums)


@model("jon_11_same_day", """
SELECT e.event_id, e.user_id,
       EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id
               AND CAST(p.ts AS DATE) = CAST(e.ts AS DATE)) AS has_order_same_day
FROM events e WHERE e.event_type = 'view'
""")
def same_day_orders(t):
    views = t.events.filter(F.col("event_type") == "view").select("event_id", "user_id", "ts")
    bought = t.events.filter(F.col("event_type") == "purchase")
    return same_day(views, bought, "user_id", "ts", "ts", "has_order_same_day").drop("ts")


@model("jon_12_semi", """
SELECT c_custkey AS customer_id, c_name AS name FROM customer
WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey
              WHERE o_custkey = c_custkey AND l_returnflag = 'R')
""")
def semi(t):
    returned = t.lineitem.filter(F.col("l_returnflag") == "R")
    orders = having_match(t.orders, returned, {"o_orderkey": "l_orderkey"})
    kept = having_match(t.customer, orders, {"c_custkey": "o_custkey"})
    return kept.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"))


@model("jon_13_anti", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def anti(t):
    kept = without_match(t.orders, t.lineitem, {"o_orderkey": "l_orderkey"})
    return kept.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))


@model("jon_14_anti_with_predicate", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')
""")
def anti_with_predicate(t):
    done = t.lineitem.filter(F.col("l_linestatus") == "F")
    kept = without_match(t.orders, done, {"o_orderkey": "l_orderkey"})
    return kept.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))


@model("jon_15_scalar_beside_rows", f"""
WITH o AS (SELECT o_orderkey AS order_id, {cents('o_totalprice')} AS amount FROM orders),
     a AS (SELECT CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS m FROM o)
SELECT order_id, amount, (m / 100.0) AS avg_amount_dollars FROM o, a WHERE amount > m
""")
def scalar_beside_rows(t):
    orders = staged_orders(t).select("order_id", "amount")
    mean = orders.agg(F.sum("amount").cast("double") / n_rows()).scalar()
    above = orders.withColumn("mean", mean).filter(F.col("amount") > F.col("mean"))
    return above.select(
        "order_id", "amount", (F.col("mean") / 100.0).alias("avg_amount_dollars")
    )


@model("jon_16_bridge", """
SELECT l_suppkey AS supplier_id, COUNT(DISTINCT o_custkey) AS customers,
       COUNT(DISTINCT o_orderkey) AS orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
""")
def bridge(t):
    links = t.lineitem.select("l_suppkey", "l_orderkey").distinct()
    joined = links.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    per_buyer = joined.groupBy("l_suppkey", "o_custkey").agg(n_rows().alias("n"))
    return per_buyer.groupBy(F.col("l_suppkey").alias("supplier_id")).agg(
        F.count("o_custkey").alias("customers"), F.sum("n").alias("orders")
    )


@model("jon_17_range_mapping", """
SELECT p_partkey AS product_id, p_size, r_name AS region
FROM part JOIN region ON r_regionkey = CASE WHEN p_size BETWEEN 1 AND 10 THEN 0
 WHEN p_size BETWEEN 11 AND 20 THEN 1 WHEN p_size BETWEEN 21 AND 30 THEN 2
 WHEN p_size BETWEEN 31 AND 40 THEN 3 WHEN p_size BETWEEN 41 AND 50 THEN 4 END
""")
def range_mapping(t):
    ranges = [(1, 10, 0), (11, 20, 1), (21, 30, 2), (31, 40, 3), (41, 50, 4)]
    mapped = t.part.withColumn("r_regionkey", range_map(F.col("p_size"), ranges))
    joined = mapped.join(t.region, "r_regionkey")
    return joined.select(
        F.col("p_partkey").alias("product_id"), "p_size", F.col("r_name").alias("region")
    )


@model("jon_17_range_table", """
WITH m AS (SELECT s_suppkey, s_suppkey % 40 - 3 AS low, s_suppkey % 40 - 3 + s_suppkey % 11 AS high FROM supplier)
SELECT p_partkey AS product_id, COUNT(*) AS suppliers, MIN(s_suppkey) AS first_supplier, MAX(high - low) AS widest
FROM part JOIN m ON p_size BETWEEN low AND high GROUP BY 1
""")
def range_table(t):
    """Which suppliers deliver a size stands in a table of overlapping ranges."""
    low = F.col("s_suppkey") % 40 - 3
    mapping = t.supplier.select("s_suppkey", low.alias("low"), (low + F.col("s_suppkey") % 11).alias("high"))
    parts = t.part.select(F.col("p_partkey").alias("product_id"), "p_size")
    held = range_join(
        parts, F.col("p_size"), mapping, F.col("low"), F.col("high"),
        per_block=[
            n_rows().alias("n"), F.min("s_suppkey").alias("first"), F.max(F.col("high") - F.col("low")).alias("width"),
        ],
    )
    return held.groupBy("product_id").agg(
        F.sum("n").alias("suppliers"), F.min("first").alias("first_supplier"), F.max("width").alias("widest"),
    )


@model("jon_18_name_join", """
WITH c AS (SELECT DISTINCT ' ' || lower(p_type) || ' ' AS category FROM part),
     p AS (SELECT p_type, COUNT(*) AS n FROM part WHERE p_size > 5 GROUP BY 1)
SELECT c.category AS category_name, p.n AS product_count
FROM c LEFT JOIN p ON lower(trim(c.category)) = lower(trim(p.p_type))
""")
def name_join(t):
    blank = F.lit(" ")
    categories = t.part.select(
        F.concat(blank, F.lower("p_type"), blank).alias("category_name")
    ).distinct()
    counts = t.part.filter(F.col("p_size") > 5).groupBy("p_type").agg(
        n_rows().alias("product_count")
    )
    return join_on_name(categories, counts, "category_name", "p_type").drop("p_type")


@model("jon_19_hierarchy", """
SELECT 's' || s_suppkey AS node, s_name AS name, n_name AS level_1_name, r_name AS level_2_name
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'n' || n_nationkey, n_name, r_name, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT 'r' || r_regionkey, r_name, NULL, NULL FROM region
""")
def hierarchy(t):
    def node(letter, column):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    none = F.lit(None).cast("string")
    nodes = (
        t.supplier.select(
            node("s", "s_suppkey").alias("node"), F.col("s_name").alias("name"),
            node("n", "s_nationkey").alias("parent"),
        )
        .unionByName(t.nation.select(
            node("n", "n_nationkey").alias("node"), F.col("n_name").alias("name"),
            node("r", "n_regionkey").alias("parent"),
        ))
        .unionByName(t.region.select(
            node("r", "r_regionkey").alias("node"), F.col("r_name").alias("name"),
            none.alias("parent"),
        ))
    )
    return parent_levels(nodes, "node", "parent", "name", 2)


@model("jon_19_category_tree", """
WITH RECURSIVE h AS (
 SELECT p_partkey AS k, p_name AS name, p_partkey AS root, 0 AS depth, p_name AS path FROM part
 WHERE CAST(floor((p_partkey - 1) / 3) AS BIGINT) NOT IN (SELECT p_partkey FROM part)
 UNION ALL
 SELECT p.p_partkey, p.p_name, h.root, h.depth + 1, h.path || '/' || p.p_name FROM part p JOIN h ON CAST(floor((p.p_partkey - 1) / 3) AS BIGINT) = h.k)
SELECT k AS category_id, name, root AS root_id, CAST(depth AS BIGINT) AS depth, path FROM h
""")
def category_tree(t):
    """A tree of unknown depth: each part as a category under another part."""
    parts = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.floor((F.col("p_partkey") - 1) / F.lit(3)).cast("bigint").alias("parent"),
    )
    paths = ancestor_paths(parts, "id", "parent", "name")
    return paths.select(
        F.col("node").alias("category_id"), "name", F.col("root").alias("root_id"), "depth",
        F.array_join("path", "/").alias("path"),
    )


@model("jon_20_first_row_join", f"""
WITH f AS (SELECT o_custkey, o_orderkey, {ORDER_DAY} AS d, {cents('o_totalprice')} AS amount FROM orders
           QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY {ORDER_DAY}, o_orderkey) = 1)
SELECT c_custkey AS customer_id, c_name AS name, o_orderkey AS first_order_id,
       d AS first_order_date, amount AS first_amount
FROM customer LEFT JOIN f ON c_custkey = o_custkey
""")
def first_row_join(t):
    customers = t.customer.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name")
    )
    orders = staged_orders(t).select(
        "customer_id",
        F.col("order_id").alias("first_order_id"),
        F.col("order_date").alias("first_order_date"),
        F.col("amount").alias("first_amount"),
    )
    order = ["first_order_date", "first_order_id"]
    return join_first(customers, orders, "customer_id", order, "left")


# --- aggregates -------------------------------------------------------------


@model("agg_01_group", f"""
SELECT o_orderstatus AS status, COUNT(*) AS order_count, {total(cents('o_totalprice'))} AS total_amount,
       (CAST(SUM({cents('o_totalprice')}) AS DOUBLE) / COUNT(*) / 100.0) AS avg_amount
FROM orders GROUP BY 1
""")
def group(t):
    cents_sum = F.sum("amount").cast("double")
    return staged_orders(t).groupBy("status").agg(
        n_rows().alias("order_count"),
        (cents_sum / 100.0).alias("total_amount"),
        (cents_sum / n_rows() / 100.0).alias("avg_amount"),
    )


@model("agg_02_min_max", f"""
SELECT o_custkey AS customer_id, MIN({ORDER_DAY}) AS first_order_date, MAX({ORDER_DAY}) AS last_order_date,
       MIN({cents('o_totalprice')}) AS smallest, MAX({cents('o_totalprice')}) AS largest
FROM orders GROUP BY 1
""")
def min_max(t):
    return staged_orders(t).groupBy("customer_id").agg(
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.min("amount").alias("smallest"),
        F.max("amount").alias("largest"),
    )


@model("agg_03_conditional_count", """
SELECT user_id, COUNT(*) AS events, COUNT(*) FILTER (event_type = 'click') AS clicks,
       COUNT(*) FILTER (event_type = 'purchase') AS purchases,
       COUNT(*) FILTER (event_type = 'error') AS errors
FROM events GROUP BY 1
""")
def conditional_count(t):
    def of(kind):
        return count_where(F.col("event_type") == kind)

    return t.events.groupBy("user_id").agg(
        n_rows().alias("events"), of("click").alias("clicks"),
        of("purchase").alias("purchases"), of("error").alias("errors"),
    )


@model("agg_04_distinct", f"""
SELECT strftime({ORDER_DAY}, '%Y-%m') AS order_month, COUNT(DISTINCT o_custkey) AS active_customers,
       COUNT(*) AS orders FROM orders GROUP BY 1
""")
def distinct_count(t):
    """Distinct by two plain aggregates: the first combines map-side."""
    month = month_label(F.col("order_date")).alias("order_month")
    per_buyer = staged_orders(t).groupBy(month, "customer_id").agg(n_rows().alias("n"))
    return per_buyer.groupBy("order_month").agg(
        F.count("customer_id").alias("active_customers"), F.sum("n").alias("orders")
    )


@model("agg_04_distinct_rollup", " UNION ALL ".join(f"""
SELECT '{unit}' AS unit, date_trunc('{unit}', {ORDER_DAY})::DATE AS period_start,
       CAST(COUNT(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders WHERE o_custkey IS NOT NULL GROUP BY ALL
""" for unit in ROLLUP_UNITS))
def distinct_periods(t):
    """Exact distinct buyers of five period lengths from one scan: bitmaps by
    day are stored, wider periods merge them."""
    daily = frozen(distinct_bitmaps(staged_orders(t), ["order_date"], "customer_id"), "buyers")

    def of(unit):
        start = F.col("order_date") if unit == "day" else period_start(F.col("order_date"), unit)
        counts = distinct_rollup(daily, {"period_start": start}, "customers")
        return counts.select(F.lit(unit).alias("unit"), "period_start", "customers")

    return reduce(lambda a, b: a.unionAll(b), map(of, ROLLUP_UNITS))


@model("agg_05_global", """
WITH c AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT COUNT(*) AS customers, COUNT(*) FILTER (n > 1) AS repeat_customers, MAX(n) AS most_orders FROM c
""")
def global_row(t):
    counts = t.orders.groupBy("o_custkey").agg(n_rows().alias("n"))
    return counts.agg(
        n_rows().alias("customers"), count_where(F.col("n") > 1).alias("repeat_customers"),
        F.max("n").alias("most_orders"),
    )


@model("agg_06_many_keys", f"""
SELECT p_type AS category, p_brand AS brand, COUNT(*) AS lines,
       CAST(SUM({LINE_UNITS}) AS DOUBLE) / 10000.0 AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
""")
def many_keys(t):
    per_part = t.lineitem.groupBy("l_partkey").agg(
        n_rows().alias("n"), F.sum(line_units()).alias("units")
    )
    joined = per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("p_type").alias("category"), F.col("p_brand").alias("brand")).agg(
        F.sum("n").alias("lines"), to_major(wide_sum("units"), UNITS).alias("revenue")
    )


@model("agg_07_rate", """
SELECT l_partkey AS product_id, COUNT(*) AS sold, COUNT(*) FILTER (l_returnflag = 'R') AS returned,
       (CAST(COUNT(*) FILTER (l_returnflag = 'R') AS DOUBLE)
             / NULLIF(COUNT(*) FILTER (l_returnflag <> 'R'), 0)) AS return_rate
FROM lineitem GROUP BY 1
""")
def rate(t):
    back = count_where(F.col("l_returnflag") == "R")
    kept = count_where(F.col("l_returnflag") != "R")
    return t.lineitem.groupBy(F.col("l_partkey").alias("product_id")).agg(
        n_rows().alias("sold"), back.alias("returned"),
        ratio(back, kept).alias("return_rate"),
    )


@model("agg_08_share", f"""
WITH g AS (SELECT p_type AS category, CAST(SUM({LINE_UNITS}) AS BIGINT) AS revenue_units
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT category, revenue_units,
       (CAST(revenue_units AS DOUBLE) / CAST(SUM(revenue_units) OVER () AS DOUBLE) * 100.0) AS share_pct
FROM g
""")
def share(t):
    per_part = t.lineitem.groupBy("l_partkey").agg(F.sum(line_units()).alias("units"))
    joined = per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed(
        "p_type", "category"
    )
    return share_of_total(joined, ["category"], wide_sum("units"), "revenue_units", "share_pct")


@model("agg_09_mode", """
SELECT user_id, event_type AS usual_event, COUNT(*) AS times FROM events GROUP BY 1, 2
QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, event_type) = 1
""")
def mode(t):
    return mode_per_group(t.events, ["user_id"], "event_type", "usual_event", "times")


@model("agg_10_median", f"""
WITH e AS ({EVENT_SQL}),
     r AS (SELECT campaign_id,
                  (CAST(COUNT(*) FILTER (event_type = 'click') AS DOUBLE) / COUNT(*)) AS click_rate
           FROM e GROUP BY 1),
     m AS (SELECT median(click_rate) AS median_click_rate FROM r)
SELECT campaign_id, click_rate, median_click_rate AS median_click_rate
FROM r, m WHERE click_rate > median_click_rate
""")
def median(t):
    events = staged_events(t)
    clicked = count_where(F.col("event_type") == "click")
    rates = events.groupBy("campaign_id").agg(
        (clicked.cast("double") / n_rows()).alias("click_rate")
    )
    middle = exact_median(rates, [], "click_rate", "m", rows_at_most=t.row_count("events")).scalar()
    return (
        rates.withColumn("m", middle)
        .filter(F.col("click_rate") > F.col("m"))
        .select("campaign_id", "click_rate", F.col("m").alias("median_click_rate"))
    )


@model("agg_11_any", """
SELECT l_orderkey AS order_id, bool_or(l_returnflag = 'R') AS any_returned,
       bool_and(l_linestatus = 'F') AS all_finished FROM lineitem GROUP BY 1
""")
def any_every(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        any_true(F.col("l_returnflag") == "R").alias("any_returned"),
        F.bool_and(F.col("l_linestatus") == "F").alias("all_finished"),
    )


@model("agg_12_list", """
SELECT l_orderkey AS order_id, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS categories
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def text_list(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    kinds = joined.select(F.col("l_orderkey").alias("order_id"), "p_type")
    return list_per_group(kinds, ["order_id"], "p_type", "categories", rows_at_most=t.row_count("lineitem"))


@model("agg_13_guarded", f"""
SELECT o_custkey AS customer_id, COUNT(*) AS order_count,
       CASE WHEN COUNT(*) >= 8 THEN (CAST(SUM({cents('o_totalprice')}) AS DOUBLE) / COUNT(o_totalprice)) END AS avg_cents
FROM orders GROUP BY 1
""")
def guarded(t):
    return staged_orders(t).groupBy("customer_id").agg(
        n_rows().alias("order_count"),
        guarded_avg(F.col("amount"), 8).alias("avg_cents"),
    )


@model("agg_14_pivot", """
SELECT user_id,
       CAST(COALESCE(SUM(CASE WHEN event_type = 'click' THEN CAST(ROUND(value*100) AS BIGINT) END), 0) AS BIGINT) AS click_cents,
       CAST(COALESCE(SUM(CASE WHEN event_type = 'view' THEN CAST(ROUND(value*100) AS BIGINT) END), 0) AS BIGINT) AS view_cents,
       CAST(COALESCE(SUM(CASE WHEN event_type = 'purchase' THEN CAST(ROUND(value*100) AS BIGINT) END), 0) AS BIGINT) AS purchase_cents
FROM events GROUP BY 1
""")
def pivot(t):
    kinds = ["click", "view", "purchase"]
    return pivot_sums(t.events, ["user_id"], "event_type", kinds, to_minor("value"), "cents")


@model("agg_15_two_levels", f"""
WITH o AS (SELECT l_orderkey, COUNT(*) AS items FROM lineitem GROUP BY 1)
SELECT strftime({ORDER_DAY}, '%Y-%m') AS order_month, COUNT(*) AS orders,
       (CAST(SUM(items) AS DOUBLE) / COUNT(*)) AS avg_items
FROM orders JOIN o ON o_orderkey = l_orderkey GROUP BY 1
""")
def two_levels(t):
    items = t.lineitem.groupBy("l_orderkey").agg(n_rows().alias("items"))
    joined = staged_orders(t).join(items, F.col("order_id") == F.col("l_orderkey"))
    return joined.groupBy(month_label(F.col("order_date")).alias("order_month")).agg(
        n_rows().alias("orders"),
        (F.sum("items").cast("double") / n_rows()).alias("avg_items"),
    )


@model("agg_16_peers", """
WITH s AS (SELECT l_suppkey, COUNT(*) AS lines FROM lineitem GROUP BY 1),
     p AS (SELECT s_suppkey AS supplier_id, n_name AS nation, lines,
                  CAST(SUM(lines) OVER w AS DOUBLE) / COUNT(*) OVER w AS mean
           FROM s JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
           WINDOW w AS (PARTITION BY n_name))
SELECT supplier_id, nation, lines, mean AS nation_avg_lines FROM p WHERE lines > mean
""")
def peers(t):
    per_supplier = t.lineitem.groupBy("l_suppkey").agg(n_rows().alias("lines"))
    rows = (
        per_supplier.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("supplier_id"), F.col("n_name").alias("nation"), "lines")
    )
    mean = F.sum("lines").cast("double") / n_rows()
    beside = group_values(rows, ["nation"], {"mean": mean})
    return beside.filter(F.col("lines") > F.col("mean")).select(
        "supplier_id", "nation", "lines", F.col("mean").alias("nation_avg_lines")
    )


@model("agg_17_computed_key", f"""
SELECT date_trunc('month', {ORDER_DAY})::DATE AS month_start, COUNT(*) AS order_count,
       {total(cents('o_totalprice'))} AS total_amount FROM orders GROUP BY 1
""")
def computed_key(t):
    start = period_start(F.col("order_date"), "month").alias("month_start")
    return staged_orders(t).groupBy(start).agg(
        n_rows().alias("order_count"), to_major(F.sum("amount")).alias("total_amount")
    )


@model("agg_18_named_key", f"""
SELECT o_orderpriority AS group_key, COUNT(*) AS order_count, {total(cents('o_totalprice'))} AS total_amount
FROM orders GROUP BY 1
""")
def named_key(t, group_by_col: str = "priority"):
    aggs = {"order_count": n_rows(), "total_amount": to_major(F.sum("amount"))}
    return group_by_named(staged_orders(t), group_by_col, aggs)
