"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: SQL settings the operators rely on. All of them can be changed at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split over several tasks, even when that costs one
    # more exchange above the join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Texts travel to Python workers in batches of bytes, not of rows only.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

#: Rows one task may sort for one window group before the work is split.
GROUP_ROWS_KEY = "spark.tallyloom.maxGroupRows"
DEFAULT_GROUP_ROWS = 2_000_000


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to ``spark`` and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_KEY, str(DEFAULT_GROUP_ROWS)))


_local_scratch: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Only a local master without a checkpoint folder gets one of its own; on a
    cluster every executor must reach the path, so the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if not _local_scratch:
            _local_scratch.append(tempfile.mkdtemp(prefix="tallyloom-"))
        base = _local_scratch[0]
    return f"{base.rstrip('/')}/tallyloom/{label}-{uuid.uuid4().hex}"


def frozen(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Later branches then see the same rows in the same chunks, read only the
    columns they need, and do not repeat the work after a lost executor.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
