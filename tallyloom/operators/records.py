"""Text extraction, task classification, prompt and chat records, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.text import WHITESPACE, strip
from tallyloom.operators.quality import require_unique, require_volume
from tallyloom.operators.windows import first_rows, running_total
from tallyloom.sources.sinks import write_splits

# The marks of answers and fenced blocks.
SQL_FENCE = rf"(?s)```sql{WHITESPACE}*\n(.*?)```"
PLAIN_FENCE = rf"(?s)```{WHITESPACE}*\n(.*?)```"
ANY_FENCE = rf"(?s)```(?:sql)?{WHITESPACE}*\n(.*?)```"
ANSWER = r"(?s)<answer>(.*?)</answer>"

# The headings of task prompts.
SCHEMA_HEADING = "## REQUIRED OUTPUT SCHEMA"
COLUMN_HEADER = "| Column | Type |\n|--------|------|\n"
EXPECTED_HEADING = "Expected output schema:"
TABLES_HEADING = "Available tables:"
NOT_KNOWN = "None"

# The keyword lists that decide the class of a task, first list
# that hits wins.
DEBUG_WORDS = ["fix", "debug", "error", "broken", "failing", "incorrect"]
CONFIG_WORDS = [
    "schema.yml", "dbt_project.yml", "sources.yml", "properties",
    "add a test", "configure", "set up",
]
MULTI_FILE_WORDS = ["multiple models", "create two", "refactor", "split"]
SQL_WORDS = [
    "create a model", "write a model", "build a model", "add a model",
    "create a staging", "write a query", "build a query",
    "select", "join", "aggregate", "calculate",
]
TASK_CLASSES = [
    ("debug", DEBUG_WORDS),
    ("config", CONFIG_WORDS),
    ("multi_file", MULTI_FILE_WORDS),
    ("sql_generation", SQL_WORDS),
]


def _first(text: Column, pattern: str) -> Column:
    """The first captured block, NULL when the pattern does not occur."""
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def fenced_block(text: Column) -> Column:
    """The first sql fence, else the first plain fence, else the whole text.

    An empty sql fence still wins over a plain one.
    """
    return F.coalesce(_first(text, SQL_FENCE), _first(text, PLAIN_FENCE), strip(text))


def answer(text: Column, mode: str = "strict") -> Column:
    """The text of an ``<answer>`` block without its inner fence.

    ``strict`` wants exactly one block and gives NULL otherwise or when it is
    empty; ``first`` takes the first block and gives NULL when there is none
    or it is empty; ``fallback`` takes the first block, else the first fence
    of the whole text, else an empty text.
    """
    blocks = F.regexp_extract_all(text, F.lit(ANSWER), F.lit(1))
    body = strip(F.try_element_at(blocks, F.lit(1)))
    body = F.coalesce(_first(body, ANY_FENCE), body)
    if mode == "strict":
        return F.when(F.size(blocks) == 1, F.nullif(body, F.lit("")))
    if mode == "first":
        return F.nullif(body, F.lit(""))
    if mode == "fallback":
        return F.coalesce(body, _first(text, ANY_FENCE), F.lit(""))
    raise ValueError(f"unknown mode {mode!r}")


def task_class(instruction: Column) -> Column:
    """Class of a task by the first keyword list with a hit."""


    def classify(text: Column) -> Column:
        label = None
        for name, words in TASK_CLASSES:
            hit = text.contains(words[0])
            for word in words[1:]:
                hit = hit | text.contains(word)
            label = F.when(hit, name) if label is None else label.when(hit, name)
        return label.otherwise("other")

    # A one-element array binds the lowered text: it is lowered once, not
    # once per keyword.
    lowered = F.array(F.lower(F.coalesce(instruction, F.lit(""))))
    return F.transform(lowered, classify)[0]


def tasks_of_class(tasks: DataFrame, instruction: str, wanted: str = "sql_generation") -> DataFrame:
    """The tasks of one class."""
    return tasks.filter(task_class(F.col(instruction)) == wanted)


def class_report(
    tasks: DataFrame, task_id: str, instruction: str, samples: int = 3, width: int = 80
) -> DataFrame:
    """Count per class and its first sample tasks."""
    classed = tasks.withColumn("category", task_class(F.col(instruction)))
    counts = classed.groupBy("category").agg(F.count(F.lit(1)).alias("task_count"))
    shown = first_rows(classed, ["category"], [task_id], samples, "sample_no")
    return shown.join(counts, "category").select(
        "category", "task_count", "sample_no", task_id,
        F.substring(F.col(instruction), 1, width).alias("sample"),
    )


def schema_prompt(
    instruction: Column,
    schema: Column,
    closing: str,
    heading: str = SCHEMA_HEADING,
    lead: str = "The result must match this exact schema:",
) -> Column:
    """Task text with one markdown table per table of the schema map.

    ``schema`` is ``map<table, struct<columns: map<column, type>>>``; an empty
    or NULL map leaves the section out.
    """

    def table(entry: Column) -> Column:
        lines = F.transform(
            F.map_entries(entry["value"]["columns"]),
            lambda c: F.concat(
                F.lit("| "), c["key"], F.lit(" | "), F.coalesce(c["value"], F.lit(NOT_KNOWN)), F.lit(" |\n")
            ),
        )
        return F.concat(
            F.lit("### "), entry["key"], F.lit(f"\n{COLUMN_HEADER}"),
            F.array_join(lines, ""), F.lit("\n"),
        )

    section = F.concat(
        F.lit(f"{heading}\n\n{lead}\n\n"),
        F.array_join(F.transform(F.map_entries(schema), table), ""),
    )
    return F.concat(
        F.lit("Task: "), instruction, F.lit("\n\n"),
        F.coalesce(F.when(F.size(schema) > 0, section), F.lit("")),
        F.lit(closing),
    )


def metadata_prompt(instruction: Column, output_schema: Column, tables: Column) -> Column:
    """Task text followed by the expected schema and a list of the tables.

    ``tables`` is ``map<table, array<column>>`` or
    ``array<struct<name, columns>>``; see :func:`metadata_lines`.
    """
    shown = F.when(
        F.length(output_schema) > 0,
        F.concat(F.lit(f"\n\n{EXPECTED_HEADING}\n"), output_schema),
    )
    listed = F.when(
        F.size(tables) > 0,
        F.concat(F.lit(f"\n\n{TABLES_HEADING}\n"), F.array_join(tables, "\n")),
    )
    return F.concat(instruction, F.coalesce(shown, F.lit("")), F.coalesce(listed, F.lit("")))


def metadata_lines(tables: Column, form: str = "map") -> Column:
    """One line ``  - table: columns`` per table, from either input form."""
    if form == "map":
        return F.transform(
            F.map_entries(tables),
            lambda e: F.concat(
                F.lit("  - "), e["key"], F.lit(": "),
                F.coalesce(F.array_join(e["value"], ", ", NOT_KNOWN), F.lit(NOT_KNOWN)),
            ),
        )
    return F.transform(
        tables,
        lambda t: F.concat(
            F.lit("  - "), F.coalesce(t["name"], F.lit(NOT_KNOWN)), F.lit(": "),
            F.coalesce(t["columns"], F.lit(NOT_KNOWN)),
        ),
    )


def target_of(schema: Column, limit: int = 5, default: str = "generated_model") -> Column:
    """First table of a schema map and its first lower-cased columns."""
    first = F.try_element_at(F.map_entries(schema), F.lit(1))
    names = F.transform(F.map_keys(first["value"]["columns"]), lambda c: F.lower(c))
    return F.struct(
        F.coalesce(first["key"], F.lit(default)).alias("model_name"),
        F.coalesce(F.slice(names, 1, limit), F.array().cast("array<string>")).alias(
            "expected_columns"
        ),
    )


def chat_record(
    system: Column,
    user: Column,
    data_source: str,
    ability: str,
    extra: dict[str, Column],
) -> list[Column]:
    """Columns of a training record: two messages, the reward rule, metadata."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return [
        F.lit(data_source).alias("data_source"),
        F.array(message("system", system), message("user", user)).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.lit(0.0).alias("ground_truth")).alias(
            "reward_model"
        ),
        F.struct(*[c.alias(n) for n, c in extra.items()]).alias("extra_info"),
    ]


def exact_split(
    df: DataFrame, key: str, test_ratio: float = 0.15, seed: int = 42, digits: int = 4
) -> DataFrame:
    """Seeded shuffle and exact cut at ``int(rows * (1 - test_ratio))``.

    Rows are ordered by a seeded hash of their key, so the order is the same
    on every run and layout; a NULL key is a key like any other. The first
    ``digits`` hash digits cut them into equal bands;
    band offsets come from a small count table, and each band is numbered on
    its own, so no task sorts the whole table. Adds ``split`` and ``index``
    (the position inside the split, from 0).
    """
    named = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), named))
    hashed = df.withColumn("__hash", mixed).withColumn("__band", F.substring("__hash", 1, digits))
    bands = hashed.groupBy("__band").agg(F.count(F.lit(1)).alias("__n"))
    offsets = running_total(bands, "__band", "__n", "__upto").select(
        "__band", (F.col("__upto") - F.col("__n")).alias("__offset")
    )
    rows = bands.agg(F.sum("__n")).scalar()
    cut = (rows.cast("double") * F.lit(1 - test_ratio)).cast("bigint")
    in_band = W.partitionBy("__band").orderBy("__hash", key)
    placed = (
        hashed.withColumn("__row", F.row_number().over(in_band))
        .join(F.broadcast(offsets), "__band")
        .withColumn("__place", F.col("__offset") + F.col("__row") - 1)
        .withColumn("__cut", cut)
    )
    train = F.col("__place") < F.col("__cut")
    return placed.select(
        *df.columns,
        F.when(train, "train").otherwise("test").alias("split"),
        F.when(train, F.col("__place")).otherwise(F.col("__place") - F.col("__cut")).alias("index"),
    )


def prepare_splits(
    specs: DataFrame,
    path: str,
    system: str,
    data_source: str,
    ability: str,
    minimums: dict[str, tuple[Column, int]] | None = None,
    test_ratio: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """From checked specs to stored training and test records.

    ``specs`` has ``prompt, model_name, expected_columns,
    expected_row_count, unique_key`` and optionally ``schema_yml``. Names must
    be unique and the volume sufficient before anything is written.
    """
    require_volume(require_unique(specs, "model_name"), minimums or {})
    if "schema_yml" not in specs.columns:
        specs = specs.withColumn("schema_yml", F.lit(""))
    placed = exact_split(specs, "model_name", test_ratio, seed)
    extra = {
        name: F.col(name)
        for name in (
            "split", "index", "model_name", "expected_columns", "expected_row_count",
            "unique_key", "schema_yml",
        )
    }
    record = chat_record(F.lit(system), F.col("prompt"), data_source, ability, extra)
    records = placed.select(*record, "split")
    write_splits(records, path)
    return specs.sparkSession.read.schema(records.schema).parquet(path)
