"""Scalar functions and parametrised models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import conditions as cond
from tallyloom.functions import dates, text
from tallyloom.functions.money import (
    ratio,
    ratio_or,
    to_major,
    to_minor,
    weighted_score,
)
from tallyloom.operators.aggregates import count_where, pivot_sums
from tallyloom.operators.joins import agg_then_join
from tallyloom.operators.params import (
    at_least,
    between_dates,
    for_target,
    switchable,
    with_value,
)
from tallyloom.operators.projections import clean_columns
from tallyloom.operators.windows import group_values
from tallyloom.plans.registry import AS_OF, ORDER_DAY, cents, dollars, model
from tallyloom.plans.shop import amount_cents, day, n_rows, staged_orders

AMOUNT = cents("o_totalprice")
SHIP = "CAST(l_shipdate AS DATE)"
LINE_SQL = "l_orderkey AS order_id, l_linenumber AS line_no"


def line_keys() -> list:
    return [F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no")]


# --- text -------------------------------------------------------------------


@model("str_01_concatenate", """
SELECT s_suppkey AS supplier_id, s_name || ', ' || n_name AS label,
       concat_ws(' / ', r_name, n_name, s_name) AS location
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def concatenate(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    s, n, r = F.col("s_name"), F.col("n_name"), F.col("r_name")
    return rows.select(
        F.col("s_suppkey").alias("supplier_id"),
        text.joined(s, n, sep=", ").alias("label"),
        text.joined_present(r, n, s, sep=" / ").alias("location"),
    )


@model("str_02_upper", "SELECT p_partkey AS product_id, upper(p_name) AS name FROM part")
def upper_case(t):
    return t.part.select(F.col("p_partkey").alias("product_id"), F.upper("p_name").alias("name"))


@model("str_03_nth_part", """
SELECT o_orderkey AS order_id, split_part(o_orderpriority, '-', 1) AS level,
       split_part(o_orderpriority, '-', 2) AS label, split_part(o_orderpriority, '-', 3) AS rest FROM orders
""")
def nth_parts(t):
    p = F.col("o_orderpriority")
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"), text.nth_part(p, "-", 1).alias("level"),
        text.nth_part(p, "-", 2).alias("label"), text.nth_part(p, "-", 3).alias("rest"),
    )


@model("str_04_around_mark", """
SELECT page_id, split_part(url, '//', 1) AS scheme,
       CASE WHEN instr(url, '//') > 0 THEN substr(url, instr(url, '//') + 2) END AS address FROM pages
""")
def around_mark(t):
    url = F.col("url")
    return t.pages.select(
        "page_id", text.before(url, "//").alias("scheme"), text.after(url, "//").alias("address")
    )


@model("str_05_prefix_initials", """
SELECT p_partkey AS product_id, left(p_brand, 2) AS brand_code, substr(p_brand, 7) AS brand_digits,
       upper(left(split_part(p_name, ' ', 1), 1) || left(split_part(p_name, ' ', 2), 1)) AS initials FROM part
""")
def prefix_initials(t):
    name = F.col("p_name")
    return t.part.select(
        F.col("p_partkey").alias("product_id"),
        F.left("p_brand", F.lit(2)).alias("brand_code"),
        F.substr("p_brand", F.lit(7)).alias("brand_digits"),
        text.initials(text.nth_part(name, " ", 1), text.nth_part(name, " ", 2)).alias("initials"),
    )


@model("str_06_length", """
SELECT d.doc_id, COALESCE(length(d.text), 0) AS text_length, COALESCE(length(b.text), 0) AS other_length
FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id
""")
def lengths(t):
    other = t.benchmark.select(F.col("item_id").alias("doc_id"), F.col("text").alias("other"))
    rows = t.documents.join(other, "doc_id", "left")
    return rows.select(
        "doc_id", text.length_or_zero(F.col("text")).alias("text_length"),
        text.length_or_zero(F.col("other")).alias("other_length"),
    )


@model("str_07_trim", """
SELECT c_custkey AS customer_id, trim('  ' || c_mktsegment || ' ') AS segment FROM customer
""")
def trimmed(t):
    padded = F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))
    return t.customer.select(F.col("c_custkey").alias("customer_id"), F.trim(padded).alias("segment"))


@model("str_08_repeat", """
SELECT doc_id, quality, repeat('*', 1 + quality * 4) AS star_display FROM labels
""")
def star_display(t):
    return t.labels.select(
        "doc_id", "quality", text.stars(1 + F.col("quality") * 4).alias("star_display")
    )


@model("str_09_contains", """
SELECT page_id, url LIKE '%?%' AS has_query, html LIKE '%<table%' AS has_table FROM pages
""")
def contains(t):
    return t.pages.select(
        "page_id", text.contains_text(F.col("url"), "?").alias("has_query"),
        F.col("html").like("%<table%").alias("has_table"),
    )


@model("str_10_period_label", f"""
SELECT o_orderkey AS order_id, year({ORDER_DAY}) || '-Q' || quarter({ORDER_DAY}) AS order_quarter,
       strftime({ORDER_DAY}, '%Y-%m') AS order_month,
       isoyear({ORDER_DAY}) || '-W' || lpad(CAST(week({ORDER_DAY}) AS VARCHAR), 2, '0') AS order_week FROM orders
""")
def period_labels(t):
    d = F.col("order_date")
    return staged_orders(t).select(
        "order_id", dates.quarter_label(d).alias("order_quarter"),
        dates.month_label(d).alias("order_month"), dates.week_label(d).alias("order_week"),
    )


# --- dates ------------------------------------------------------------------


@model("dat_01_parts", """
SELECT event_id, year(ts) AS event_year, quarter(ts) AS event_quarter, month(ts) AS event_month,
       day(ts) AS event_day, hour(ts) AS event_hour FROM events
""")
def parts(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", *dates.date_parts(ts, "event"), dates.hour_of(ts).alias("event_hour")
    )


@model("dat_02_truncate", """
SELECT event_id, date_trunc('hour', ts) AS hour_start, date_trunc('week', ts)::DATE AS week_start,
       date_trunc('month', ts)::DATE AS month_start, date_trunc('quarter', ts)::DATE AS quarter_start FROM events
""")
def truncate(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", dates.hour_start(ts).alias("hour_start"),
        *[dates.period_start(ts, u).alias(f"{u}_start") for u in ("week", "month", "quarter")],
    )


@model("dat_03_day_difference", f"""
SELECT l_orderkey AS order_id, l_linenumber AS line_no, date_diff('day', {ORDER_DAY}, {SHIP}) AS transit_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def day_difference(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    gap = dates.days_between(F.col("o_orderdate"), F.col("l_shipdate"))
    return joined.select(*line_keys(), gap.alias("transit_days"))


@model("dat_04_time_difference", """
WITH s AS (SELECT user_id, MIN(ts) AS a, MAX(ts) AS b FROM events GROUP BY 1)
SELECT user_id, (epoch_us(b) - epoch_us(a)) / 1000000.0::DOUBLE AS seconds,
       (epoch_us(b) - epoch_us(a)) / 60000000.0::DOUBLE AS minutes,
       (epoch_us(b) - epoch_us(a)) / 3600000000.0::DOUBLE AS hours FROM s
""")
def time_difference(t):
    spans = t.events.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    a, b = F.col("a"), F.col("b")
    return spans.select(
        "user_id", dates.seconds_between(a, b).alias("seconds"),
        dates.minutes_between(a, b).alias("minutes"),
        dates.hours_between(a, b).alias("hours"),
    )


@model("dat_05_day_of_week", f"""
SELECT isodow({ORDER_DAY}) AS day_of_week, dayname({ORDER_DAY}) AS day_name, COUNT(*) AS order_count
FROM orders GROUP BY 1, 2
""")
def day_of_week(t):
    d = F.col("order_date")
    return staged_orders(t).groupBy(
        dates.iso_day(d).alias("day_of_week"), dates.day_name(d).alias("day_name")
    ).agg(n_rows().alias("order_count"))


@model("dat_06_iso_week", f"""
SELECT o_orderkey AS order_id, isoyear({ORDER_DAY}) AS week_year, week({ORDER_DAY}) AS week_number FROM orders
""")
def iso_weeks(t):
    d = F.col("order_date")
    return staged_orders(t).select(
        "order_id", dates.iso_year(d).alias("week_year"), dates.iso_week(d).alias("week_number")
    )


@model("dat_07_fiscal", f"""
SELECT o_orderkey AS order_id, year({ORDER_DAY} - INTERVAL 3 MONTH) AS fiscal_year,
       quarter({ORDER_DAY} - INTERVAL 3 MONTH) AS fiscal_quarter FROM orders
""")
def fiscal(t):
    d = F.col("order_date")
    return staged_orders(t).select(
        "order_id", dates.fiscal_year(d).alias("fiscal_year"),
        dates.fiscal_quarter(d).alias("fiscal_quarter"),
    )


@model("dat_08_tenure", f"""
WITH c AS (SELECT o_custkey AS customer_id, date_diff('day', MIN({ORDER_DAY}), DATE '{AS_OF}') AS tenure_days FROM orders GROUP BY 1)
SELECT *, (tenure_days / 30.0::DOUBLE) AS tenure_months, (tenure_days / 365.25::DOUBLE) AS tenure_years FROM c
""")
def tenure(t, as_of: str = AS_OF):
    first = staged_orders(t).groupBy("customer_id").agg(F.min("order_date").alias("d"))
    days = F.col("tenure_days").cast("double")
    return first.select(
        "customer_id", dates.age_days(F.col("d"), as_of).alias("tenure_days")
    ).withColumns({
        "tenure_months": (days / 30.0), "tenure_years": (days / 365.25),
    })


@model("dat_09_recency", f"""
SELECT o_orderkey AS order_id, date_diff('day', {ORDER_DAY}, (SELECT MAX({ORDER_DAY}) FROM orders)) AS days_ago FROM orders
""")
def recency(t):
    orders = staged_orders(t).select("order_id", "order_date")
    newest = orders.agg(F.max("order_date")).scalar()
    return orders.select("order_id", dates.days_between(F.col("order_date"), newest).alias("days_ago"))


@model("dat_10_whole_months", f"""
SELECT o_custkey AS customer_id, date_diff('month', MIN({ORDER_DAY}), MAX({ORDER_DAY})) AS months_active
FROM orders GROUP BY 1
""")
def whole_months(t):
    return staged_orders(t).groupBy("customer_id").agg(
        dates.whole_months_between(F.min("order_date"), F.max("order_date")).alias("months_active")
    )


@model("dat_11_date_spine", f"""
WITH s AS (SELECT CAST(unnest(generate_series(MIN({ORDER_DAY}), MAX({ORDER_DAY}), INTERVAL 1 DAY)) AS DATE) AS date_day FROM orders),
     o AS (SELECT {ORDER_DAY} AS d, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT date_day, isodow(date_day) AS day_of_week, month(date_day) AS month_number, year(date_day) AS year,
       isodow(date_day) >= 6 AS is_weekend, COALESCE(n, 0) AS orders FROM s LEFT JOIN o ON date_day = d
""")
def spine(t):
    orders = staged_orders(t)
    counts = orders.groupBy(F.col("order_date").alias("date_day")).agg(n_rows().alias("orders"))
    d = F.col("date_day")
    return dates.spine_of(orders, "order_date").join(counts, "date_day", "left").select(
        "date_day", dates.iso_day(d).alias("day_of_week"),
        F.month(d).cast("bigint").alias("month_number"), F.year(d).cast("bigint").alias("year"),
        (dates.iso_day(d) >= 6).alias("is_weekend"),
        F.coalesce("orders", F.lit(0)).alias("orders"),
    )


@model("dat_12_validity", f"""
SELECT o_orderkey AS order_id, {ORDER_DAY} + 900 < DATE '{AS_OF}' AS is_expired,
       CASE WHEN {ORDER_DAY} + 900 >= DATE '{AS_OF}' THEN date_diff('day', DATE '{AS_OF}', {ORDER_DAY} + 900) END AS days_remaining
FROM orders
""")
def validity(t, as_of: str = AS_OF):
    end = F.date_add("order_date", 900)
    return staged_orders(t).select(
        "order_id", dates.is_expired(end, as_of).alias("is_expired"),
        dates.days_left(end, as_of).alias("days_remaining"),
    )


@model("dat_13_time_band", """
SELECT event_id, CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon'
  WHEN hour(ts) BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS time_of_day FROM events
""")
def time_of_day(t):
    return t.events.select("event_id", dates.time_band(F.col("ts")).alias("time_of_day"))


# --- numbers ----------------------------------------------------------------


@model("mth_01_round", f"""
SELECT p_partkey AS product_id, ROUND(p_size / p_retailprice * 100, 2) AS size_pct,
       ROUND(CAST({cents('p_retailprice')} AS DOUBLE) / 700.0, 2) AS weekly FROM part
""")
def rounding(t):
    return t.part.select(
        F.col("p_partkey").alias("product_id"),
        F.round(F.col("p_size") / F.col("p_retailprice") * 100, 2).alias("size_pct"),
        F.round(to_minor("p_retailprice").cast("double") / 700.0, 2).alias("weekly"),
    )


@model("mth_02_safe_division", f"""
SELECT {LINE_SQL}, (l_tax / NULLIF(l_discount, 0)) AS tax_per_discount,
       COALESCE((l_discount / NULLIF(l_tax, 0)), 0) AS discount_per_tax FROM lineitem
""")
def safe_division(t):
    tax, discount = F.col("l_tax"), F.col("l_discount")
    return t.lineitem.select(
        *line_keys(), ratio(tax, discount).alias("tax_per_discount"),
        ratio_or(discount, tax).alias("discount_per_tax"),
    )


@model("mth_03_weighted_score", """
WITH o AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY 1),
     e AS (SELECT user_id AS k, COUNT(*) FILTER (event_type = 'click') AS clicks,
                  COUNT(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
SELECT c_custkey AS customer_id,
       CAST(COALESCE(o.n, 0) * 10 + COALESCE(clicks, 0) * 5 - COALESCE(errors, 0) * 3
            + CASE WHEN c_acctbal > 0 THEN 20 ELSE 0 END AS DOUBLE) AS health_score
FROM customer LEFT JOIN o ON c_custkey = o.k LEFT JOIN e ON c_custkey = e.k
""")
def health_score(t):
    rows = agg_then_join(
        t.customer.select(F.col("c_custkey").alias("customer_id"), "c_acctbal"),
        "customer_id",
        [
            (t.orders, "o_custkey", {"orders": n_rows()}),
            (t.events, "user_id", {
                "clicks": count_where(F.col("event_type") == "click"),
                "errors": count_where(F.col("event_type") == "error"),
            }),
        ],
    )
    in_credit = (F.col("c_acctbal") > 0).cast("int")
    score = weighted_score([
        (F.col("orders"), 10), (F.col("clicks"), 5), (F.col("errors"), -3), (in_credit, 20),
    ])
    return rows.select("customer_id", score.alias("health_score"))


# --- conditions -------------------------------------------------------------


@model("cnd_01_tiers", f"""
SELECT o_orderkey AS order_id, CASE WHEN {AMOUNT} IS NULL THEN NULL WHEN {AMOUNT} < 10000000 THEN 'low_value' WHEN {AMOUNT} < 25000000 THEN 'medium_value'
 ELSE 'high_value' END AS value_tier FROM orders
""")
def value_tiers(t):
    bands = [(10_000_000, "low_value"), (25_000_000, "medium_value")]
    return staged_orders(t).select(
        "order_id", cond.tiers(F.col("amount"), bands, "high_value").alias("value_tier")
    )


@model("cnd_02_code_groups", """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'browse'
 WHEN event_type IN ('purchase', 'signup') THEN 'convert' ELSE 'other' END AS event_group FROM events
""")
def code_groups(t):
    groups = {"browse": ["click", "view"], "convert": ["purchase", "signup"]}
    return t.events.select(
        "event_id", cond.map_codes(F.col("event_type"), groups, "other").alias("event_group")
    )


@model("cnd_03_value_flags", """
SELECT o_orderkey AS order_id, o_orderstatus = 'F' AS is_f, o_orderstatus = 'O' AS is_o,
       o_orderstatus = 'P' AS is_p FROM orders
""")
def value_flags(t):
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        *cond.value_flags(F.col("o_orderstatus"), ["F", "O", "P"]),
    )


@model("cnd_04_first_match", f"""
SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'P' AND {ORDER_DAY} < DATE '1998-01-01' THEN 'overdue'
 WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority = '1-URGENT' THEN 'rush'
 WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS health FROM orders
""")
def first_match(t):
    status, d = F.col("status"), F.col("order_date")
    health = cond.first_match(
        [
            ((status == "P") & (d < F.lit("1998-01-01").cast("date")), "overdue"),
            (status == "P", "pending"),
            (F.col("priority") == "1-URGENT", "rush"),
            (status == "F", "done"),
        ],
        "open",
    )
    return staged_orders(t).select("order_id", health.alias("health"))


@model("cnd_05_completeness", """
SELECT c_custkey AS customer_id, o.k IS NOT NULL AS has_orders, e.k IS NOT NULL AS has_events,
       c_acctbal > 0 AS in_credit,
       CAST((o.k IS NOT NULL)::INT + (e.k IS NOT NULL)::INT + COALESCE((c_acctbal > 0)::INT, 0) AS BIGINT) AS completeness_score
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c_custkey = o.k
LEFT JOIN (SELECT DISTINCT user_id AS k FROM events) e ON c_custkey = e.k
""")
def completeness(t):
    rows = agg_then_join(
        t.customer.select(F.col("c_custkey").alias("customer_id"), "c_acctbal"),
        "customer_id",
        [(t.orders, "o_custkey", {"o": n_rows()}), (t.events, "user_id", {"e": n_rows()})],
    )
    checks = {
        "has_orders": F.col("o").isNotNull(), "has_events": F.col("e").isNotNull(),
        "in_credit": F.col("c_acctbal") > 0,
    }
    return rows.select(
        "customer_id", *[c.alias(n) for n, c in checks.items()],
        cond.completeness(list(checks.values())).alias("completeness_score"),
    )


# --- NULL handling ----------------------------------------------------------

LABELLED = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def labelled(t):
    labels = t.labels.withColumn("labelled", F.lit(True))
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")


@model("nul_01_default", f"""
SELECT d.doc_id, COALESCE(l.quality, 0) AS quality, COALESCE(l.toxic, 0) AS toxic FROM {LABELLED}
""")
def defaults(t):
    return labelled(t).fillna({"quality": 0, "toxic": 0}).select("doc_id", "quality", "toxic")


@model("nul_02_default_text", f"""
SELECT o_orderkey AS order_id, COALESCE(CAST(MAX({SHIP}) AS VARCHAR), 'not_shipped') AS shipped
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
""")
def default_text(t):
    rows = agg_then_join(
        t.orders.select(F.col("o_orderkey").alias("order_id")), "order_id",
        [(t.lineitem, "l_orderkey", {"last": F.max(F.col("l_shipdate").cast("date"))})],
    )
    return rows.select("order_id", cond.text_or(F.col("last"), "not_shipped").alias("shipped"))


NOTES_SQL = "CASE o_orderstatus WHEN 'P' THEN '   ' WHEN 'O' THEN '' WHEN 'F' THEN ' ' || o_orderpriority END"


def notes():
    return cond.first_match([
        (F.col("o_orderstatus") == "P", "   "), (F.col("o_orderstatus") == "O", ""),
        (F.col("o_orderstatus") == "F", F.concat(F.lit(" "), F.col("o_orderpriority"))),
    ])


@model("nul_03_blank_as_null", f"""
SELECT o_orderkey AS order_id, COALESCE(NULLIF(trim({NOTES_SQL}), ''), 'No notes') AS notes,
       COALESCE(trim({NOTES_SQL}) <> '', false) AS has_notes FROM orders
""")
def blank_as_null(t):
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.coalesce(text.blank_to_null(notes()), F.lit("No notes")).alias("notes"),
        text.has_text(notes()).alias("has_notes"),
    )


@model("nul_04_fallback_chain", f"""
SELECT o_orderkey AS order_id, COALESCE(NULLIF(trim({NOTES_SQL}), ''), s.name, 'no_contact') AS primary_contact
FROM orders LEFT JOIN (SELECT c_custkey, c_name AS name FROM customer WHERE c_acctbal > 0) s ON o_custkey = s.c_custkey
""")
def fallback_chain(t):
    named = t.customer.filter(F.col("c_acctbal") > 0).select("c_custkey", "c_name")
    rows = t.orders.join(named, F.col("o_custkey") == F.col("c_custkey"), "left")
    contact = cond.first_present(notes(), F.col("c_name"), default="no_contact")
    return rows.select(F.col("o_orderkey").alias("order_id"), contact.alias("primary_contact"))


@model("nul_05_impute_mean", f"""
WITH r AS (SELECT d.doc_id, l.quality FROM {LABELLED})
SELECT doc_id, quality IS NULL AS is_imputed,
       COALESCE(CAST(quality AS DOUBLE), (SELECT AVG(quality) FROM r)) AS quality FROM r
""")
def impute_mean(t):
    rows = labelled(t).select("doc_id", "quality")
    filled = group_values(rows, [], {"mean": F.avg("quality")})
    value = F.coalesce(F.col("quality").cast("double"), F.col("mean"))
    return filled.select(
        "doc_id", F.col("quality").isNull().alias("is_imputed"), value.alias("quality")
    )


@model("nul_06_sentinel", f"""
SELECT d.doc_id, COALESCE(l.quality, -1) AS quality_safe, l.doc_id IS NULL AS is_unlabelled,
       COALESCE(CASE WHEN l.toxic = 0 THEN DATE '2024-01-01' END, DATE '9999-12-31') AS end_date FROM {LABELLED}
""")
def sentinels(t):
    end = F.when(F.col("toxic") == 0, F.lit("2024-01-01").cast("date"))
    far = F.lit("9999-12-31").cast("date")
    return labelled(t).select(
        "doc_id", cond.sentinel(F.col("quality"), -1).alias("quality_safe"),
        F.col("labelled").isNull().alias("is_unlabelled"), F.coalesce(end, far).alias("end_date"),
    )


# --- parametrised models ----------------------------------------------------


@model("par_01_threshold", f"SELECT o_orderkey AS order_id, {AMOUNT} AS amount FROM orders WHERE {AMOUNT} >= 5000000")
def threshold(t, min_amount: float = 50_000):
    """The stored column is compared, so the filter reaches the scan."""
    kept = at_least(t.orders, "o_totalprice", min_amount)
    return kept.select(F.col("o_orderkey").alias("order_id"), amount_cents().alias("amount"))


@model("par_02_value", "SELECT c_custkey AS customer_id, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'")
def value_filter(t, segment: str = "MACHINERY"):
    rows = with_value(t.customer, "c_mktsegment", segment)
    return rows.select(F.col("c_custkey").alias("customer_id"), "c_mktsegment")


@model("par_03_date_window", f"""
SELECT date_trunc('month', {ORDER_DAY})::DATE AS revenue_month, COUNT(*) AS order_count FROM orders
WHERE {ORDER_DAY} BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1
""")
def date_window(t, start_date: str = "1996-01-01", end_date: str = "1997-12-31"):
    rows = between_dates(t.orders, "o_orderdate", start_date, end_date)
    month = dates.period_start(day(), "month").alias("revenue_month")
    return rows.groupBy(month).agg(n_rows().alias("order_count"))


@model("par_04_switch", "SELECT p_partkey AS product_id, p_type FROM part WHERE p_size > 20")
def switch(t, include_inactive: bool = False):
    rows = switchable(t.part, F.col("p_size") > 20, include_inactive)
    return rows.select(F.col("p_partkey").alias("product_id"), "p_type")


@model("par_05_target", "SELECT o_orderkey AS order_id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F'")
def target_aware(t, target: str = "prod"):
    rows = for_target(t.orders, F.col("o_orderstatus") == "F", target)
    return rows.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"))


@model("par_06_column_macro", f"""
SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nationkey, {dollars(cents('c_acctbal'))} AS acctbal,
       c_mktsegment AS mktsegment FROM customer
""")
def column_macro(t):
    rows = t.customer.withColumn("c_acctbal", to_major(to_minor("c_acctbal")))
    return clean_columns(rows, prefix="c_")


@model("par_07_generated_columns", f"""
SELECT o_custkey AS customer_id,
       CAST(COALESCE(SUM(CASE WHEN o_orderstatus = 'F' THEN {AMOUNT} END), 0) AS BIGINT) AS f_amount,
       CAST(COALESCE(SUM(CASE WHEN o_orderstatus = 'O' THEN {AMOUNT} END), 0) AS BIGINT) AS o_amount
FROM orders GROUP BY 1
""")
def generated_columns(t, statuses: tuple = ("F", "O")):
    return pivot_sums(
        t.orders, ["o_custkey"], "o_orderstatus", list(statuses), amount_cents(), "amount"
    ).withColumnRenamed("o_custkey", "customer_id")
