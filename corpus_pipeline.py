"""From raw documents to encoded training text, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. Its rows
are written as Parquet to the shared scratch folder and read again as the next
stage's ``docs``, so a lost executor never costs an earlier stage. All stages
but the last return the columns of ``documents``, further columns of any name
included.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.bpe import encode_texts
from tallyloom.llm.exact_dedup import drop_copies
from tallyloom.llm.mixing import mix
from tallyloom.llm.near_dedup import drop_near_copies
from tallyloom.llm.quality import drop_poor, fit
from tallyloom.llm.shipping import ship
from tallyloom.session import configure, frozen


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    NULL text is scored as empty text; rows that repeat an id are scored one by
    one; a score equal to the threshold stays.
    """
    ship(configure(spark))
    return drop_poor(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id.

    NULL text counts as empty, so one such document stays. An id that other
    texts repeat does not matter: rows are told apart by number.
    """
    configure(spark)
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), the one with
    the smallest id.

    Documents without words are near copies of nothing and stay, and so do rows
    without an id; rows that repeat the id that stays all stay.
    """
    ship(configure(spark))
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; none is cut.

    A NULL source is a source; documents without words are not taken; a document
    that is taken several times is as many equal rows.
    """
    configure(spark)
    taken = mix(docs).filter("copies > 0")
    again = taken.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select("doc.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and digests of ids and decoded text.

    NULL and empty texts have no ids; rows that repeat an id are encoded one by
    one; columns other than the id are not returned.
    """
    ship(configure(spark))
    coded = encode_texts(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", "n_tokens", "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources", mixed),
    ("BPE encoding", encoded),
]

#: The classifier cannot be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
