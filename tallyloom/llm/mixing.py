"""Mixing sources to target weights by Sainte-Lague apportionment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.lanes import numbered, placed
from tallyloom.session import frozen

WORD = r"[^\x20\x09-\x0D]+"
#: The target of every source, and of every shard, holds at least so many blocks.
SOURCE_BLOCKS, RING_BLOCKS = 64, 16


def words_in(text: str) -> F.Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, limit: float, cycle: int) -> DataFrame:
    """Target words of each source: its weight's share of all words, at most
    ``limit`` times its own, the excess shared again by weight.

    ``sizes`` has ``source`` and ``source_size``, a row per source, and may have
    more columns, which stay. Weights
    run 1..cycle, repeating, in code point order with NULL last. Water is
    poured over the sources: sorted by limit / weight, the first source that
    its share does not fill, and all behind it, get ``level * weight``.
    """
    ranked = sizes.selectExpr(
        "*", "SUM(source_size) OVER () AS total",
        f"CAST((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % {cycle} + 1 AS DOUBLE) AS weight",
    ).selectExpr("*", f"{limit} * source_size AS top", f"{limit} * source_size / weight AS fill")
    before = "OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    poured = ranked.selectExpr(
        "*",
        f"(total - COALESCE(SUM(top) {before}, 0D)) / (SUM(weight) OVER () - COALESCE(SUM(weight) {before}, 0D))"
        " AS share",
    )
    level = poured.selectExpr("*", "MIN(IF(share <= fill, struct(fill, share), NULL)) OVER () AS stop")
    return level.selectExpr(
        *sizes.columns, "total",
        "CASE WHEN stop IS NULL THEN top ELSE LEAST(top, stop.share * weight) END AS target",
    )


def apportion(claims: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Seats by highest quotients ``claim / (2 k + 1)``, at most ``most`` each.

    ``claims`` has ``claim``, ``most`` and, the same in a group, ``seats`` and
    ``sum_claim``. A claimant's k-th quotient comes at time ``(2 k + 1) /
    claim``. With c claimants all seats before time ``(2 seats - c) /
    sum_claim`` are certain and none after ``(2 seats + 3 c) / sum_claim`` is
    given, so only the few quotients between are written out and ranked.
    """
    by = f"PARTITION BY {', '.join(group)}" if group else ""
    bounds = claims.selectExpr(
        "*", f"COUNT(*) OVER ({by}) AS claimants",
    ).selectExpr(
        "*",
        "LEAST(most, CAST(FLOOR((GREATEST(2 * seats - claimants, 0) * claim / NULLIF(sum_claim, 0) + 1) / 2) AS BIGINT)) AS sure_",
        "LEAST(most, CAST(FLOOR(((2 * seats + 3 * claimants) * claim / NULLIF(sum_claim, 0) + 1) / 2) AS BIGINT)) AS high_",
    ).selectExpr(
        "*", "COALESCE(GREATEST(sure_ - 1, 0), 0) AS sure", "COALESCE(GREATEST(high_, 0), 0) AS high",
    ).selectExpr("*", f"SUM(sure) OVER ({by}) AS given")
    keys = [*group, *order]
    quotients = bounds.filter("high > sure").selectExpr(
        *keys, "claim", "seats - given AS open", "EXPLODE(SEQUENCE(sure, high - 1)) AS k"
    ).selectExpr("*", "claim / (2 * k + 1) AS quotient")
    tie = ", ".join([f"{c} NULLS LAST" for c in order])
    ranked = quotients.selectExpr("*", f"ROW_NUMBER() OVER ({by} ORDER BY quotient DESC, k, {tie}) AS place")
    won = ranked.filter("place <= open").groupBy(*keys).agg(F.count("*").alias("won"))
    quota = (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota")
    return bounds.join(won, keys, "left").select(*claims.columns, quota)


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: list[str] | None = None,
    limit: int = 3,
    cycle: int = 3,
    seed: str = "mix",
    shard_words: int = 1 << 20,
    shard_rows: int = 1 << 20,
    block_words: int = 4096,
) -> DataFrame:
    """Per row: ``doc`` (a struct of the columns ``keep``, default all) with
    ``size``, ``source_size``, ``target``, ``taken``, ``copies``.

    Sizes are words; NULL text has none; a NULL source is a source. The words
    of a source are dealt by a seeded hash into shards of about
    ``shard_words`` and ``shard_rows`` at most; blocks of equal size (at most ``block_words``, smaller on
    small inputs and where a source or a shard is small, down to a word) are
    apportioned to sources by target and then to each
    source's shards by size, which gives every shard an integer quota. A shard
    lays its documents out in seeded order as a ring and takes the quota's
    blocks one after another from a seeded block start, going round again
    where the quota is larger than the ring.

    ``taken`` counts the words of a document under those blocks, repeats
    included: at most ``limit`` times its size, up to one block's rounding
    equal to the target in sum. ``copies`` is how often its first word is
    taken: whole documents for those who do not cut them. The same input gives
    the same result. Rows that repeat an id count one by one, and any number of
    them may (a NULL id counts as the id ``null``); of rows equal in id and size
    either may get the other's share. An empty table gives no rows; a document
    without words takes 0 and has 0 copies. The columns ``keep`` are written
    once to the scratch folder, with the sizes.
    """

    def key(*parts):
        return F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))

    def number(digest: str) -> F.Column:
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")

    doc = F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)])
    sized = df.select(
        doc.alias("doc"), F.col(f"`{source_col}`").alias("_own"), words_in(text_col).alias("size"),
        key(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))).alias("_key"),
    )
    sized = numbered(sized, "sized")
    sizes = sized.groupBy(F.col("_own").alias("source")).agg(
        F.sum("size").alias("source_size"), F.count("*").alias("_rows")
    )
    aims = targets(sizes, limit, cycle).selectExpr(
        "*", f"CAST(GREATEST(1, CEIL(source_size / {shard_words}), CEIL(_rows / {shard_rows})) AS BIGINT) AS _shards",
        "ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS _s",
    )
    aims = frozen(aims, "aims")  # a row per source

    of_source = aims.select(F.col("source").alias("_source"), "_s", "_shards", "source_size", "target")
    rows = sized.join(of_source, F.col("_own").eqNullSafe(F.col("_source"))).withColumn(
        "_shard", F.pmod(number("_key"), F.col("_shards"))
    )
    rings = frozen(rows.groupBy("_s", "_shard").agg(F.sum("size").alias("_ring")), "ring-sizes")
    least = rings.filter("_ring > 0").groupBy("_s").agg(F.min("_ring").alias("_least"))
    quotas = aims.join(least, "_s", "left").selectExpr(
        "*", f"GREATEST(1, LEAST({block_words}, total DIV 65536,"
        f" CAST(MIN(NULLIF(target, 0)) OVER () AS BIGINT) DIV {SOURCE_BLOCKS},"
        f" CAST(MIN(target * _least / NULLIF(source_size, 0)) OVER () AS BIGINT) DIV {RING_BLOCKS})) AS _block",
    ).selectExpr(
        "*", "target AS claim", f"{limit} * source_size DIV _block AS most",
        "total DIV _block AS seats", "total AS sum_claim",
    )
    quotas = frozen(apportion(quotas, [], ["_s"]), "quotas")  # a row per source
    rings = rings.join(quotas.select("_s", "source_size", "_block", F.col("quota").alias("seats")), "_s").selectExpr(
        "*", "CAST(_ring AS DOUBLE) AS claim", f"{limit} * _ring DIV _block AS most", "source_size AS sum_claim"
    )
    begin = number("_draw") % F.expr("NULLIF(_ring, 0)")
    rings = (
        apportion(rings, ["_s"], ["_shard"])
        .withColumn("_draw", key(F.col("_s"), F.col("_shard")))
        .withColumn("_begin", begin)
        .selectExpr(
            "_s", "_shard", "_ring", "_begin",
            "COALESCE(quota * _block DIV NULLIF(_ring, 0), 0) AS _rounds",
            "COALESCE(quota * _block % NULLIF(_ring, 0), 0) AS _rest",
        )
    )
    laid = placed(rows, ["_s", "_shard"], ["_key", "size"], "size", "_at").join(frozen(rings, "rings"), ["_s", "_shard"])

    def under(shift: str) -> str:
        return f"GREATEST(0, LEAST(_at + size, _begin + _rest - {shift}) - GREATEST(_at, _begin - {shift}))"

    return laid.selectExpr(
        "doc", "size", "source_size", "target",
        f"COALESCE(_rounds * size + {under('0')} + {under('_ring')}, 0) AS taken",
        "IF(size = 0, 0, _rounds + IF(PMOD(_at - _begin, _ring) < _rest, 1, 0)) AS copies",
    )
