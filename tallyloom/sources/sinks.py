"""Writers and materialisation kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("table", "view", "ephemeral")


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One Parquet folder per split value."""
    df.write.partitionBy(split_col).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; NULL fields are kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def with_summary(df: DataFrame, keys: list[str], measures: dict[str, F.Column]) -> DataFrame:
    """The summary that is written beside a JSON result."""
    return df.groupBy(*keys).agg(*[m.alias(name) for name, m in measures.items()])


def materialize(
    df: DataFrame,
    kind: str,
    name: str,
    path: str | None = None,
    partition_by: tuple[str, ...] = (),
) -> DataFrame:
    """Materialise as stored ``table``, named ``view`` or inlined ``ephemeral``.

    A table goes to ``path`` as Parquet and is read back; a view is registered
    in the session; an ephemeral model stays a lazy DataFrame.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, got {kind!r}")
    spark = df.sparkSession
    if kind == "table":
        if path is None:
            raise ValueError("a table needs a path")
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if kind == "view":
        df.createOrReplaceTempView(name)
        return spark.table(name)
    return df


def bucketed_table(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Materialise as a catalogue table bucketed by ``keys``.

    Two tables with the same keys and bucket count join and aggregate on those
    keys without an exchange: worth the write when a large pair of tables is
    joined again and again. A hot key stays in one bucket, so bucket by a
    column that spreads.
    """
    (
        df.repartition(buckets, *keys)
        .write.mode("overwrite")
        .option("path", path)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .saveAsTable(name)
    )
    return df.sparkSession.table(name)


class VersionedTable:
    """A Parquet table whose every state is a folder of its own.

    A write goes to the next free version and counts once its ``_SUCCESS``
    marker is there, so a reader never meets a half-written state and a path
    is never overwritten while a plan still reads it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def _versions(self, complete: bool = True) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v=") and (
                not complete
                or fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
            ):
                found.append(int(name[2:]))
        return sorted(found)

    def version_path(self, version: int) -> str:
        return f"{self.path}/v={version:06d}"

    def current(self) -> DataFrame | None:
        """The newest complete state, or None before the first write."""
        versions = self._versions()
        return self.spark.read.parquet(self.version_path(versions[-1])) if versions else None

    def before(self, version: int) -> DataFrame | None:
        """The newest complete state older than ``version``."""
        versions = [v for v in self._versions() if v < version]
        return self.spark.read.parquet(self.version_path(versions[-1])) if versions else None

    def commit(self, df: DataFrame, version: int | None = None) -> DataFrame:
        """Write ``df`` as the given or next version and read it back.

        Writing the same version again replaces it: a replayed batch leaves
        the table as it was.
        """
        if version is None:
            taken = self._versions(complete=False)
            version = taken[-1] + 1 if taken else 0
        df.write.mode("overwrite").parquet(self.version_path(version))
        return self.spark.read.parquet(self.version_path(version))
