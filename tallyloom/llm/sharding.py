"""Sharding by rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.lanes import numbered, placed


def uniform(text: F.Column) -> F.Column:
    """A number in (0, 1] from the first 52 bits of the MD5 of ``text``."""
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + 1).cast("double") / F.lit(float(2**52))


def rendezvous(key: F.Column, weights: dict[int, float]) -> F.Column:
    """The shard that wins ``key``.

    Every shard draws an exponential time with its weight as the rate, from
    the key and its own number alone, and the smallest time wins. A further
    shard, or a larger weight, therefore takes keys only into itself, and each
    shard gets its weight's share. Equal times go to the smaller number.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must name at least one shard and be positive")
    times = [
        F.struct(
            (-F.log(uniform(F.concat(key, F.lit(f":{shard}")))) / F.lit(float(weight))).alias("time"),
            F.lit(int(shard)).alias("shard"),
        )
        for shard, weight in sorted(weights.items())
    ]
    return (F.least(*times) if len(times) > 1 else times[0])["shard"]


def with_shard(
    df: DataFrame, id_col: str = "doc_id", weights: dict[int, float] | None = None, name: str = "shard"
) -> DataFrame:
    """``df`` with the shard of each row (default: 16 equal shards).

    The key is the id as text; a NULL id is a key of its own, repeated ids go
    together, and nothing else of a row or of the table matters. No shuffle.
    """
    weights = weights or dict.fromkeys(range(16), 1.0)
    return df.withColumn(name, rendezvous(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), weights))


def with_slot(df: DataFrame, id_col: str, shard_col: str = "shard", lane_digits: int = 3) -> DataFrame:
    """``df`` with ``slot``, the row's place in its shard, from 0 without gaps.

    Rows of a shard are ordered by the MD5 of the id. Its
    first ``lane_digits`` digits cut the shard into lanes; lanes are put after
    each other by their counts, a table
    of ``shards * 16 ** lane_digits`` rows whatever the input. Copies of one id
    (a NULL id counts as the id ``null``) get neighbouring slots in any order;
    they are numbered in pieces, so any number of rows may share an id. ``df``
    is written once to the scratch folder.
    """
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary"))
    rows = df.withColumn("__order", order).withColumn("__lane", F.substring("__order", 1, lane_digits))
    rows = numbered(rows, "slots")
    sizes = rows.groupBy(shard_col, "__lane").agg(F.count("*").alias("__n"))
    starts = sizes.selectExpr(
        shard_col, "__lane",
        f"SUM(__n) OVER (PARTITION BY {shard_col} ORDER BY __lane) - __n AS __start",
    )
    return (
        placed(rows, [shard_col, "__lane"], ["__order"], "1L", "__place")
        .join(starts, [shard_col, "__lane"])
        .select(*df.columns, (F.col("__start") + F.col("__place")).alias("slot"))
    )


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> DataFrame:
    """Per document: id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, the
    ``law`` in force (``key``), ``shard``, ``slot`` and ``grown_shard`` (its
    shard if there were one more). NULL text counts as empty; an empty table
    gives no rows; other columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = df.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    equal = dict.fromkeys(range(shards + 1), 1.0)
    digest = with_shard(digest, id_col, {k: equal[k] for k in range(shards)})
    digest = with_shard(digest, id_col, equal, "grown_shard")
    return with_slot(digest, id_col)
