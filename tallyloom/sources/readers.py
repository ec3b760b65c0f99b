"""Typed table and record readers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from tallyloom.session import frozen

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def _table(*columns: tuple[str, object]) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns])


INT, TXT, NUM = IntegerType(), StringType(), DoubleType()
BOOL, DAY, TS = BooleanType(), DateType(), TimestampType()

# Column names and types of the 22 shop tables.
SHOP_SCHEMAS: dict[str, StructType] = {
    "addresses": _table(
        ("id", INT), ("customer_id", INT), ("address_type", TXT), ("street", TXT),
        ("city", TXT), ("state", TXT), ("zip_code", TXT), ("country", TXT),
        ("is_default", BOOL), ("created_at", TS), ("updated_at", TS)),
    "campaigns": _table(
        ("id", INT), ("name", TXT), ("channel", TXT), ("start_date", DAY),
        ("end_date", DAY), ("budget", INT), ("status", TXT)),
    "categories": _table(("id", INT), ("name", TXT), ("parent_category_id", INT)),
    "customers": _table(
        ("id", INT), ("first_name", TXT), ("last_name", TXT), ("email", TXT),
        ("phone", TXT), ("created_at", TS), ("updated_at", TS), ("is_active", BOOL),
        ("customer_type", TXT), ("referral_source", TXT)),
    "email_events": _table(
        ("id", INT), ("customer_id", INT), ("campaign_id", INT), ("event_type", TXT),
        ("event_timestamp", TS)),
    "employees": _table(
        ("id", INT), ("first_name", TXT), ("last_name", TXT), ("role", TXT),
        ("department", TXT), ("hire_date", DAY)),
    "inventory": _table(
        ("id", INT), ("product_id", INT), ("warehouse_id", INT),
        ("quantity_on_hand", INT), ("reorder_point", INT),
        ("last_restock_date", DAY), ("updated_at", TS)),
    "order_items": _table(
        ("id", INT), ("order_id", INT), ("product_id", INT), ("quantity", INT),
        ("unit_price", INT), ("discount_pct", INT), ("created_at", TS)),
    "orders": _table(
        ("id", INT), ("customer_id", INT), ("order_date", DAY), ("status", TXT),
        ("amount", INT), ("shipping_method", TXT), ("discount_amount", INT),
        ("tax_amount", INT), ("currency", TXT), ("channel", TXT), ("notes", TXT)),
    "page_views": _table(
        ("id", INT), ("session_id", INT), ("page_url", TXT), ("viewed_at", TS),
        ("duration_seconds", INT)),
    "payments": _table(
        ("id", INT), ("order_id", INT), ("payment_method", TXT), ("amount", INT),
        ("status", TXT), ("created_at", TS), ("updated_at", TS),
        ("processor_id", TXT), ("is_refund", BOOL)),
    "products": _table(
        ("id", INT), ("name", TXT), ("category", TXT), ("subcategory", TXT),
        ("unit_price", INT), ("cost", INT), ("is_active", BOOL), ("created_at", TS),
        ("updated_at", TS), ("weight_kg", NUM), ("sku", TXT)),
    "promotions": _table(
        ("id", INT), ("code", TXT), ("promotion_type", TXT), ("discount_value", INT),
        ("start_date", DAY), ("end_date", DAY), ("max_uses", INT), ("times_used", INT),
        ("min_order_amount", INT), ("is_active", BOOL)),
    "refunds": _table(
        ("id", INT), ("order_id", INT), ("reason", TXT), ("refund_amount", INT),
        ("status", TXT), ("requested_at", TS), ("processed_at", TS),
        ("processed_by", TXT)),
    "returns": _table(
        ("id", INT), ("order_item_id", INT), ("reason", TXT), ("condition", TXT),
        ("refund_amount", INT), ("status", TXT), ("requested_at", TS),
        ("processed_at", TS)),
    "reviews": _table(
        ("id", INT), ("customer_id", INT), ("product_id", INT), ("rating", INT),
        ("review_text", TXT), ("created_at", TS), ("is_verified_purchase", BOOL)),
    "sessions": _table(
        ("id", INT), ("customer_id", INT), ("session_start", TS), ("session_end", TS),
        ("device_type", TXT), ("channel", TXT)),
    "shipping": _table(
        ("id", INT), ("order_id", INT), ("carrier", TXT), ("tracking_number", TXT),
        ("shipped_date", DAY), ("delivered_date", DAY), ("status", TXT),
        ("weight_kg", NUM), ("shipping_cost", INT)),
    "subscriptions": _table(
        ("id", INT), ("customer_id", INT), ("plan", TXT), ("start_date", DAY),
        ("end_date", DAY), ("mrr", INT), ("status", TXT)),
    "suppliers": _table(
        ("id", INT), ("name", TXT), ("contact_email", TXT), ("country", TXT),
        ("lead_time_days", INT)),
    "support_tickets": _table(
        ("id", INT), ("customer_id", INT), ("order_id", INT), ("category", TXT),
        ("priority", TXT), ("status", TXT), ("created_at", TS), ("resolved_at", TS),
        ("assigned_employee_id", INT)),
    "warehouses": _table(
        ("id", INT), ("name", TXT), ("city", TXT), ("state", TXT), ("capacity", INT)),
}

#: One evaluation task per line of a JSON-lines file.
TASK_SCHEMA = StructType([
    StructField("instance_id", TXT),
    StructField("instruction", TXT),
    StructField(
        "output_schema",
        MapType(TXT, StructType([StructField("columns", MapType(TXT, TXT))])),
    ),
])


# How the shop's CSV files mark empty fields and quotes.
CSV_OPTIONS = {"header": "true", "nullValue": "", "emptyValue": "", "escape": '"'}
LINE, FILE = "__line", "__file"


@dataclass(frozen=True)
class Parsed:
    """The rows that fit the schema, and the lines that do not: ``file``,
    ``line`` (its whole text) and ``reason``."""

    rows: DataFrame
    rejects: DataFrame

    def counts(self) -> DataFrame:
        """Rejected lines by file and reason."""
        return self.rejects.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("lines"))


def _parsed(raw: DataFrame, schema: StructType, reason: Column) -> Parsed:
    # Written once with all columns: which lines fail must not depend on the
    # columns a later query reads, and no line is parsed twice.
    raw = frozen(raw.select("*", F.col("_metadata.file_path").alias(FILE)), "parsed")
    bad = F.col(LINE).isNotNull()
    rejects = raw.filter(bad).select(
        F.col(FILE).alias("file"), F.col(LINE).alias("line"), reason.alias("reason")
    )
    return Parsed(raw.filter(~bad).select(*[F.col(f"`{c}`") for c in schema.names]), rejects)


def _with_line(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(LINE, StringType(), True)])


def read_csv_parted(spark: SparkSession, path: str, schema: StructType) -> Parsed:
    """:func:`read_csv` that goes on past rows that do not fit the schema.

    The reason names the columns whose field is not of their type, or says that
    the line has too many or too few fields. A file without lines gives no
    rows and no rejects.
    """
    raw = spark.read.csv(
        path, schema=_with_line(schema), mode="PERMISSIVE", columnNameOfCorruptRecord=LINE, **CSV_OPTIONS
    )
    # The fields of a rejected line as texts, beside what became of them.
    texts = ", ".join(f"f{i} STRING" for i in range(len(schema) + 1))
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"}
    fields = F.from_csv(F.col(LINE), F.lit(texts), options)
    wrong = [
        F.when(fields[f"f{i}"].isNotNull() & F.col(f"`{c.name}`").isNull(),
               F.lit(f"{c.name} is not {c.dataType.simpleString()}"))
        for i, c in enumerate(schema.fields)
        if not isinstance(c.dataType, StringType)
    ]
    types = F.nullif(F.concat_ws(", ", *wrong), F.lit(""))
    many = F.when(fields[f"f{len(schema)}"].isNotNull(), F.lit("too many fields"))
    return _parsed(raw, schema, F.coalesce(many, types, F.lit("wrong number of fields")))


def read_json_parted(spark: SparkSession, path: str, schema: StructType) -> Parsed:
    """JSON lines that fit the schema, and those that are not JSON or do not.
    Blank lines are skipped."""
    raw = spark.read.json(
        path, schema=_with_line(schema), mode="PERMISSIVE", columnNameOfCorruptRecord=LINE
    )
    is_json = F.try_parse_json(F.col(LINE)).isNotNull()
    reason = F.when(is_json, F.lit("does not fit the schema")).otherwise(F.lit("not JSON"))
    return _parsed(raw, schema, reason)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header row and doubled quotes; an empty field is NULL.

    A row that does not fit the schema stops the read; :func:`read_csv_parted`
    sets it aside instead."""
    return spark.read.csv(path, schema=schema, mode="FAILFAST", **CSV_OPTIONS)


def read_shop_table(spark: SparkSession, folder: str, name: str, prefix: str = "raw_") -> DataFrame:
    """One of the 22 shop tables from ``<folder>/<prefix><name>.csv``."""
    return read_csv(spark, f"{folder}/{prefix}{name}.csv", SHOP_SCHEMAS[name])


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet; with a schema given no footer is read at planning time."""
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def read_tasks(
    spark: SparkSession,
    path: str,
    schema: StructType = TASK_SCHEMA,
    max_tasks: int | None = None,
) -> DataFrame:
    """JSON lines without blank lines and without ids that start with ``demo``.

    A line that is not JSON stops the read; :func:`read_tasks_parted` sets it
    aside instead."""
    return _tasks(spark.read.json(path, schema=schema, mode="FAILFAST"), max_tasks)


def read_tasks_parted(
    spark: SparkSession, path: str, schema: StructType = TASK_SCHEMA, max_tasks: int | None = None
) -> Parsed:
    """:func:`read_tasks` beside the lines that are no tasks."""
    parsed = read_json_parted(spark, path, schema)
    return Parsed(_tasks(parsed.rows, max_tasks), parsed.rejects)


def _tasks(tasks: DataFrame, max_tasks: int | None) -> DataFrame:
    tasks = tasks.filter(~F.coalesce(F.col("instance_id"), F.lit("")).startswith("demo"))
    return tasks if max_tasks is None else tasks.orderBy("instance_id").limit(max_tasks)


class Tables:
    """Named source lookup: ``Tables(spark, folder).orders``.

    A table's schema is read from its file footer once per process and folder;
    later lookups start no job.
    """

    _schemas: dict[str, StructType] = {}

    def __init__(self, spark: SparkSession, folder: str, names: list[str] | None = None):
        self.spark = spark
        self.folder = folder
        self.names = list(names or TABLES)
        self._rows: dict[str, int] = {}

    def row_count(self, name: str) -> int:
        """Rows of a table, counted from the file footers once per query."""
        if name not in self._rows:
            self._rows[name] = self.source(name).count()
        return self._rows[name]

    def source(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(f"unknown source {name!r}; known: {', '.join(self.names)}")
        path = f"{self.folder}/{name}.parquet"
        if path not in self._schemas:
            self._schemas[path] = read_parquet(self.spark, path).schema
        return read_parquet(self.spark, path, self._schemas[path])

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.source(name)


class ShopTables(Tables):
    """Named source lookup over the CSV files of the shop tables:
    ``ShopTables(spark, folder).customers`` reads ``<folder>/raw_customers.csv``."""

    def __init__(self, spark: SparkSession, folder: str, prefix: str = "raw_"):
        super().__init__(spark, folder, list(SHOP_SCHEMAS))
        self.prefix = prefix

    def source(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(f"unknown source {name!r}; known: {', '.join(self.names)}")
        return read_shop_table(self.spark, self.folder, name, self.prefix)


def named_source(spark: SparkSession, groups: dict[str, str], group: str, table: str) -> DataFrame:
    """``source(group, table)``: ``groups`` maps a group to its folder, of CSV
    files when the group is called ``raw``, of Parquet files otherwise."""
    if group not in groups:
        raise KeyError(f"unknown group {group!r}; known: {', '.join(groups)}")
    kind = ShopTables if group == "raw" else Tables
    return kind(spark, groups[group]).source(table)
