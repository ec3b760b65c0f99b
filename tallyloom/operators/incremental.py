"""Incremental loads: high-water select, append, merge, delete and insert."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators.joins import without_match
from tallyloom.operators.windows import first_rows
from tallyloom.session import frozen
from tallyloom.sources.sinks import VersionedTable

#: ``(target or None, batch) -> new target``
Combine = Callable[[DataFrame | None, DataFrame], DataFrame]


def newer_rows(
    source: DataFrame, target: DataFrame | None, mark: str, look_back: str | None = None
) -> DataFrame:
    """Source rows above the target's highest mark; all rows on the first run.

    The comparison is strict: a row equal to the mark that arrives later is
    not taken, unless ``look_back`` (an interval such as ``3 days``) moves the
    mark back. The mark is read as one value, so the filter reaches the scan.
    """
    if target is None:
        return source
    high = target.agg(F.max(mark).alias("high")).first()["high"]
    if high is None:
        return source
    limit = F.lit(high).cast(source.schema[mark].dataType)
    if look_back:
        limit = limit - F.expr(f"INTERVAL {look_back}")
    return source.filter(F.col(mark) > limit)


def merge_rows(
    target: DataFrame | None, batch: DataFrame, keys: list[str], newest: list[str]
) -> DataFrame:
    """Upsert: matched keys are replaced, new keys are added.

    Of several batch rows with one key the first along ``newest`` counts. The
    target is only probed with the batch's keys; a small batch is broadcast by
    the planner and the target is not shuffled. Rows with a NULL in their key
    have no identity: see :func:`unkeyed_rows`.
    """
    keyed = _keyed(keys)
    latest = first_rows(batch.filter(keyed), keys, newest)
    loose = unkeyed_rows(target, batch, keys)
    if target is None:
        return latest.unionByName(loose)
    return without_match(target, latest, {k: k for k in keys}).unionByName(latest).unionByName(loose)


def delete_insert(target: DataFrame | None, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Drop target rows whose key is in the batch, then add the whole batch.
    Rows with a NULL in their key: see :func:`unkeyed_rows`."""
    if target is None:
        return batch
    known = batch.filter(_keyed(keys))
    kept = without_match(target, known, {k: k for k in keys})
    return kept.unionByName(known).unionByName(unkeyed_rows(target, batch, keys))


def _keyed(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def unkeyed_rows(target: DataFrame | None, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's rows with a NULL in their key that the target lacks.

    Such rows match no key, so all of them are kept. A row counts as stored
    when the target holds an equal one (all columns, NULL equal to NULL), as
    often as it does: a batch that comes again adds nothing, and equal rows of
    one batch stay as many as they are.
    """
    loose = batch.filter(~_keyed(keys))
    if target is None:
        return loose
    # Numbered among equal rows: the n-th of the batch meets the n-th stored.
    equal = W.partitionBy(*batch.columns).orderBy(F.lit(0))
    number = F.row_number().over(equal).alias("__nth")
    stored = target.filter(~_keyed(keys)).select(*batch.columns, number)
    stored = stored.withColumnsRenamed({c: f"__old_{c}" for c in stored.columns})
    same = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__old_{c}")) for c in [*batch.columns, "__nth"]]
    )
    return loose.select("*", number).join(stored, same, "left_anti").drop("__nth")


def key_bucket(keys: list[str], buckets: int) -> Column:
    """The bucket of a key among ``buckets``, by linear hashing: going from n
    to n + 1 buckets moves keys of one bucket only, all into the new one."""
    fine = 1 << buckets.bit_length()
    place = F.pmod(F.xxhash64(*keys), F.lit(fine)).cast("int")
    return F.when(place < buckets, place).otherwise(place % F.lit(fine // 2)).cast("int")


def split_from(bucket: int, buckets: int) -> int:
    """The bucket below ``buckets`` whose keys go to ``bucket`` as the table grows."""
    while bucket >= buckets:
        bucket -= 1 << (bucket.bit_length() - 1)
    return bucket


def combine_partitions(
    path: str, batch: DataFrame, combine: Combine, partition: str | list[str]
) -> DataFrame:
    """Merge a batch into a partitioned Parquet folder.

    The last of the partition columns must be fixed for a key. Only partitions that occur
    in the batch are read, combined and replaced, so the cost follows the
    batch and not the table; a rerun of the same batch gives the same state.
    """
    spark = batch.sparkSession
    columns = [partition] if isinstance(partition, str) else partition
    partition = columns[-1]
    if _exists(spark, path):
        # One value per partition folder, not per row.
        touched = [r[0] for r in batch.select(partition).distinct().collect()]
        is_touched = F.col(partition).isin([v for v in touched if v is not None])
        if None in touched:
            is_touched = is_touched | F.col(partition).isNull()
        old = spark.read.parquet(path).filter(is_touched)
        # Written first: a folder cannot be replaced while it is being read.
        combined = frozen(combine(old, batch), "combined")
    else:
        combined = combine(None, batch)
    (
        # One partition's rows together, a large one over several tasks.
        combined.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*columns)
        .parquet(path)
    )
    return spark.read.parquet(path)


def bucket_count(rows: int, rows_per_bucket: int) -> int:
    """A power of two, for tables that are joined bucket by bucket."""
    return 1 << max(0, -(-rows // rows_per_bucket) - 1).bit_length()


class BucketTable:
    """A Parquet folder of key buckets whose number grows with the table.

    A run reads and writes the buckets its batch touches, and those that are
    split because the table has outgrown ``rows_per_bucket``; all others keep
    their files. Buckets split in turn (linear hashing), so growth by a bucket
    rewrites one bucket.

    The number of buckets is the largest name in ``_buckets``. New buckets are
    written before that name appears and count for nothing until then; buckets
    they were split from are rewritten afterwards, and rows that have moved are
    not read from them any more. A run that fails at any point is repeated with
    the same batch.
    """

    def __init__(self, spark, path: str, keys: list[str], rows_per_bucket: int = 2_000_000):
        self.spark, self.path, self.keys, self.rows_per_bucket = spark, path, keys, rows_per_bucket

    def buckets(self) -> int:
        """The number of buckets; 0 before the first run."""
        return max((int(n) for n in _names(self.spark, f"{self.path}/_buckets")), default=0)

    def _stored(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/_schema").schema
        return self.spark.read.schema(schema.add("bucket", "integer")).parquet(self.path)

    def current(self) -> DataFrame | None:
        """The table, or None before the first run."""
        buckets = self.buckets()
        if not buckets:
            return None
        rows = self._stored().filter(F.col("bucket") < buckets)
        return rows.filter(F.col("bucket") == key_bucket(self.keys, buckets)).drop("bucket")

    def apply(self, batch: DataFrame, combine: Combine) -> DataFrame:
        """Combine ``batch`` with the rows of the buckets it touches.

        ``combine`` must give the same state when a batch comes twice, and may
        look at rows of the batch's keys only. A batch without rows changes
        nothing; the first one leaves an empty table.
        """
        batch = frozen(batch, "batch")
        arrived, before = batch.count(), self.buckets()
        if not before:
            batch.limit(0).write.mode("overwrite").parquet(f"{self.path}/_schema")
        if before and not arrived:
            return self.current()
        rows = self._stored().filter(F.col("bucket") < before).count() if before else 0
        after = max(before, 1, -(-(rows + arrived) // self.rows_per_bucket))
        if before:
            # One number per touched or split bucket comes to the driver.
            touched = {r[0] for r in batch.select(key_bucket(self.keys, before)).distinct().collect()}
            touched |= {split_from(n, before) for n in range(before, after)}
            old = self._stored().filter(F.col("bucket").isin(*touched))
            old = old.filter(F.col("bucket") == key_bucket(self.keys, before)).drop("bucket")
            combined = combine(old, batch)
        else:
            touched, combined = set(), combine(None, batch)
        # Written first: a folder cannot be replaced while it is being read.
        combined = frozen(combined.withColumn("bucket", key_bucket(self.keys, after)), "combined")
        self._replace(combined.filter(F.col("bucket") >= before))
        _touch(self.spark, f"{self.path}/_buckets", f"{after:012d}")
        if before:
            self._replace(combined.filter(F.col("bucket") < before))
            for gone in touched - {r[0] for r in combined.select("bucket").distinct().collect()}:
                _delete(self.spark, f"{self.path}/bucket={gone}")
        return self.current()

    def _replace(self, rows: DataFrame) -> None:
        (
            # One bucket's rows together, a large one over several tasks.
            rows.hint("rebalance", "bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket")
            .parquet(self.path)
        )


def combine_buckets(
    path: str, batch: DataFrame, combine: Combine, keys: list[str], rows_per_bucket: int = 2_000_000
) -> DataFrame:
    """:func:`combine_partitions` for a table without a natural partition: one
    batch into a :class:`BucketTable`."""
    return BucketTable(batch.sparkSession, path, keys, rows_per_bucket).apply(batch, combine)


def append_rows(target: DataFrame | None, batch: DataFrame) -> DataFrame:
    return batch if target is None else target.unionByName(batch)


def run_increment(
    table: VersionedTable,
    source: DataFrame,
    mark: str,
    combine: Combine,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    target_mark: str | None = None,
    look_back: str | None = None,
) -> DataFrame:
    """One run of an incremental model: select, transform, combine, commit.

    With ``look_back`` rows that arrive late by less than that are loaded too;
    ``combine`` must then give the same state when a row comes twice.
    """
    target = table.current()
    seen = None
    if target is not None:
        seen = target.select(F.col(target_mark or mark).alias(mark))
    batch = newer_rows(source, seen, mark, look_back)
    if transform is not None:
        batch = transform(batch)
    return table.commit(combine(target, batch))


def run_increment_in_place(
    path: str,
    source: DataFrame,
    mark: str,
    combine: Combine,
    keys: list[str],
    transform: Callable[[DataFrame], DataFrame] | None = None,
    look_back: str | None = None,
    rows_per_bucket: int = 2_000_000,
) -> DataFrame:
    """:func:`run_increment` on a bucketed folder: a run costs what its batch
    touches, not what the table holds."""
    table = BucketTable(source.sparkSession, path, keys, rows_per_bucket)
    batch = newer_rows(source, table.current(), mark, look_back)
    if transform is not None:
        batch = transform(batch)
    return table.apply(batch, combine)


def append_to(
    path: str,
    source: DataFrame,
    mark: str,
    first_run: bool,
    look_back: str | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Append newer rows to a Parquet folder; earlier files are not touched.

    With ``look_back`` late rows are appended too, those whose ``keys`` are
    stored already left out.
    """
    if look_back and not keys:
        raise ValueError("a look-back needs keys, or rows would be appended twice")
    spark = source.sparkSession
    target = None if first_run else spark.read.parquet(path)
    fresh = newer_rows(source, target, mark, look_back)
    if look_back and target is not None:
        fresh = without_match(fresh, newer_rows(target, target, mark, look_back), {k: k for k in keys})
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def refresh_partitions(
    path: str, source: DataFrame, day: str, aggregate: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Incremental aggregate: recompute the newest known date and all later
    ones, and replace only their partitions.

    The folder is partitioned by ``day``, so its highest date comes from the
    partition values and older partitions are neither read nor written.
    """
    spark = source.sparkSession
    known = spark.read.parquet(path) if _exists(spark, path) else None
    rows = source
    if known is not None:
        high = known.agg(F.max(day).alias("high")).first()["high"]
        if high is not None:
            # Rows without a date belong to a partition that is never final.
            rows = source.filter((F.col(day) >= F.lit(high)) | F.col(day).isNull())
    (
        aggregate(rows)
        .repartition(day)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(day)
        .parquet(path)
    )
    return spark.read.parquet(path)


def mark_before(spark, path: str, number: int):
    """The highest mark stored under a number below ``number``, or None."""
    older = [n for n in _names(spark, path) if n.isdigit() and int(n) < number]
    return spark.read.parquet(f"{path}/{max(older)}").first()["high"] if older else None


def store_mark(spark, path: str, number: int, high, kind) -> None:
    row = spark.range(1).select(F.lit(high).cast(kind).alias("high"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/{number:012d}")


def forget_marks(spark, path: str, number: int) -> None:
    """Delete marks that no replay needs: only the newest batch is replayed."""
    older = sorted(n for n in _names(spark, path) if n.isdigit() and int(n) < number)
    for name in older[:-1]:
        _delete(spark, f"{path}/{name}")


def _file_system(spark, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _exists(spark, path: str) -> bool:
    files, root = _file_system(spark, path)
    return files.exists(root)


def _names(spark, path: str) -> list[str]:
    files, root = _file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []


def _touch(spark, path: str, name: str) -> None:
    files, file = _file_system(spark, f"{path}/{name}")
    files.create(file, True).close()


def _delete(spark, path: str) -> None:
    files, root = _file_system(spark, path)
    files.delete(root, True)
