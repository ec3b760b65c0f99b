"""Stream form of the incremental loads: files arrive, a table is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.operators.incremental import (
    BucketTable,
    Combine,
    combine_partitions,
    forget_marks,
    mark_before,
    store_mark,
)
from tallyloom.session import frozen
from tallyloom.sources.sinks import VersionedTable

#: What a micro-batch does: ``(rows, batch number)``.
Apply = Callable[[DataFrame, int], None]


def into_versions(target: VersionedTable, combine: Combine) -> Apply:
    """Micro-batch ``n`` is stored as version ``n``, built from the newest
    older version: a batch replayed after a failure writes the same state."""

    def apply(batch: DataFrame, number: int) -> None:
        target.commit(combine(target.before(number), batch), version=number)

    return apply


def into_partitions(path: str, combine: Combine, partition: str) -> Apply:
    """A micro-batch replaces only the partitions it touches; for tables too
    large to be rewritten per batch. ``combine`` must give the same state when
    a batch comes twice, as an upsert does."""

    def apply(batch: DataFrame, number: int) -> None:
        combine_partitions(path, batch, combine, partition)

    return apply


def into_buckets(table: BucketTable, combine: Combine) -> Apply:
    """A micro-batch touches only its own key buckets, which split as the table
    grows. ``combine`` must give the same state when a batch comes twice."""

    def apply(batch: DataFrame, number: int) -> None:
        table.apply(batch, combine)

    return apply


def above_mark(marks: str, mark: str, apply: Apply, look_back: str | None = None) -> Apply:
    """``apply`` to the rows above the highest mark of the micro-batches before,
    moved back by ``look_back``: the rule of the batch form (``newer_rows``).

    The first micro-batch is taken whole. The mark is kept in the folder
    ``marks`` by batch number, so that it is not looked up in a growing table,
    and a batch that is replayed, even one stored in part, is cut at the same
    mark. Rows without a mark are taken by the first micro-batch only.
    """

    def cut(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        high = mark_before(spark, marks, number)
        rows = batch
        if high is not None:
            limit = F.lit(high).cast(batch.schema[mark].dataType)
            if look_back:
                limit = limit - F.expr(f"INTERVAL {look_back}")
            rows = batch.filter(F.col(mark) > limit)
        apply(rows, number)
        seen = batch.agg(F.max(mark).alias("high")).first()["high"]
        known = [h for h in (high, seen) if h is not None]
        if known:
            store_mark(spark, marks, number, max(known), batch.schema[mark].dataType)
            forget_marks(spark, marks, number)

    return cut


def _on_stored(apply: Apply) -> Apply:
    return lambda batch, number: apply(frozen(batch, "arrived"), number)


def load_arrived(
    spark: SparkSession,
    source: str,
    schema: StructType,
    checkpoint: str,
    apply: Apply,
    files_per_batch: int | None = None,
    once: tuple[str, str] | None = None,
) -> None:
    """Process all files that have arrived since the last call, then stop.

    ``once`` = (timestamp column, delay) lets a row that is delivered again,
    equal in all columns, through only once: rows are remembered in keyed state
    until they are older than the newest one by twice the delay. With
    :func:`above_mark` and a look-back of the same length a repetition that is
    no longer remembered is too late to be taken. Rows without that timestamp
    are left out.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(source)
    if once:
        at, delay = once
        rows = rows.filter(F.col(at).isNotNull()).withWatermark(at, delay)
        rows = rows.dropDuplicatesWithinWatermark(rows.columns)
        # Stored, as a second read would run the state's batch again.
        apply = _on_stored(apply)
    query = (
        rows.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
