"""Exact dedup by a tree-merge of sorted digest runs, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import frozen

SPACES = r"[\x20\x09-\x0D]+"
KEY = ["lane", "run", "digest", "length", "second"]


def normalised(text: str) -> F.Column:
    """The text with every run of white space replaced by one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def digest_table(df: DataFrame, id_col: str, text_col: str, lanes: int, row_col: str | None) -> DataFrame:
    """One small row per document: SHA-256, length and a second hash of its
    normalised text, a row number, the run (the partition that read it) and a
    lane (a share of the digests). Stored, so numbers and runs stay fixed."""
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    text = df.select(
        row.alias("row"), F.col(id_col).alias("id"),
        normalised(text_col).alias("text"),
    )
    rows = text.select(
        "row", "id",
        F.shiftright("row", 33).cast("int").alias("run"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").alias("length"),
        F.xxhash64("text").alias("second"),
    )
    return frozen(rows.withColumn("lane", F.pmod(F.col("second"), F.lit(lanes)).cast("int")), "digests")


def merge_runs(runs: DataFrame, fan_bits: int, last_run: int) -> DataFrame:
    """Merge sorted runs until each lane holds one.

    In round r the run p goes to the run p without its lowest ``fan_bits``
    bits: a binomial tree that merges ``2 ** fan_bits`` runs at a time. Runs
    arrive sorted by digest, and the streaming aggregate over that order is
    the multiway merge; it keeps the smallest (id, row) and the row count of
    every digest. Length and a second hash belong to the key, so texts that
    only share a digest stay apart.
    """
    while last_run > 0:
        last_run >>= fan_bits
        received = runs.withColumn("run", F.shiftright("run", fan_bits))
        runs = (
            received.repartition("lane", "run")
            .sortWithinPartitions(*KEY)
            .groupBy(*KEY)
            .agg(F.min("keep").alias("keep"), F.sum("size").alias("size"))
        )
    return runs


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
    lanes: int = 4096, fan_bits: int = 4,
) -> DataFrame:
    """Groups of equal texts, one row per input row.

    Texts are equal when they agree after each run of white space has become
    one space; NULL counts as empty. Returns ``row`` (number of the input
    row), the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. Of a
    group the row with the smallest id stays; a NULL id comes last; of rows
    that repeat an id exactly one stays. An empty table gives no rows; other
    columns are not looked at. ``row_col`` names stored row numbers as
    ``monotonically_increasing_id`` gives them, if there are any.

    Every partition first makes one row of each of its digests, so a group
    that holds a third of the table sends one row per partition. The way back
    goes through (run, digest), of which one partition's rows are the most
    that can meet.
    """
    rows = digest_table(df, id_col, text_col, lanes, row_col)
    last_run = rows.agg(F.max("run")).first()[0] or 0
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    runs = rows.groupBy(*KEY).agg(F.min(order).alias("keep"), F.count("*").alias("size"))
    runs = frozen(runs, "runs")
    groups = merge_runs(runs, fan_bits, last_run)
    text = ["lane", "digest", "length", "second"]
    answers = runs.select(*KEY).join(groups.select(*text, "keep", "size"), text)
    return rows.join(answers, KEY).select(
        "row",
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts, all columns as they
    came. The table is stored with row numbers, so repeated ids are told apart."""
    doc = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")
    stored = frozen(df.select(F.monotonically_increasing_id().alias("row"), doc), "numbered")
    texts = stored.select("row", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"))
    kept = exact_groups(texts, "id", "text", "row").filter("kept").select("row")
    return stored.join(kept, "row", "left_semi").select("doc.*")
