"""Token counts of whole texts from pre-token frequencies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import frozen

#: Pre-tokens that every task gets at once: the most frequent ones, of at most
#: HEAD_BYTES bytes each, so the broadcast is bounded whatever the corpus.
HEAD_SIZE = 200_000
HEAD_BYTES = 48

MARK = "▁"
RUN = re.compile(f"\n[^{MARK}\n]*|{MARK}+[^{MARK}\n]*")


def pre_tokens(text: str) -> list[str]:
    """Pieces of ``text`` that the tokenizer treats independently.

    No piece of the vocabulary has a space mark after another character, and
    none holds a line feed, so no merge crosses the start of a space run or
    touches a line feed. A pre-token is a line feed with the bare characters
    behind it, or a run of spaces with the word behind it, written without the
    first space. The tokenizer puts one space before the text.
    """
    if not text:
        return []
    if MARK in text or "  " in text or " \n" in text or text[0] == " " or text[-1] == " ":
        return [
            run if run[0] == "\n" else run[1:] for run in RUN.findall(MARK + text.replace(" ", MARK))
        ]
    return text.replace("\n", " \n").split(" ")


class Pieces:
    """Piece counts by a sentencepiece model that is given exact input."""

    _loaded: dict[str, Pieces] = {}

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as formats

        model = formats.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        crossing = re.compile(f"[^{MARK}]{MARK}|\n")
        plain = spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
        if not plain or any(crossing.search(p.piece) and p.type != p.BYTE for p in model.pieces):
            raise ValueError(f"{path}: its pieces do not fall apart at spaces and line feeds")
        spec.add_dummy_prefix = False  # each pre-token brings its own space
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def count(self, pre_token: str) -> int:
        if pre_token[:1] == "\n":
            bare = pre_token[1:]
            return 1 + (len(self.model.encode(bare)) if bare else 0)
        return len(self.model.encode(MARK + pre_token))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            seen.update(pre_tokens(text))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["piece", "n"]
        )


def _counted(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    count = Pieces.load(model).count
    for batch in batches:
        tokens = [count(p) for p in batch.column("piece").to_pylist()]
        yield batch.append_column("tokens", pa.array(tokens, pa.int64()))


KNOWN = "n_bytes long, head_tokens long, rest array<struct<piece: string, n: long>>"


def _per_document(
    batches: Iterator[pa.RecordBatch], head: Callable[[], dict[str, int]], names: list[str]
) -> Iterator[pa.RecordBatch]:
    """Tokens of frequent pre-tokens, and the other pre-tokens with their
    frequencies."""
    known = head()
    kind = pa.list_(pa.struct([("piece", pa.string()), ("n", pa.int64())]))
    for batch in batches:
        n_bytes, sums, rest = [], [], []
        for text in batch.column("text").to_pylist():
            seen = Counter(pre_tokens(text))
            total, other = 0, []
            for piece, n in seen.items():
                tokens = known.get(piece)
                if tokens is None:
                    other.append({"piece": piece, "n": n})
                else:
                    total += tokens * n
            n_bytes.append(len(text.encode()))
            sums.append(total)
            rest.append(other)
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(n) for n in names], pa.array(n_bytes, pa.int64()),
                pa.array(sums, pa.int64()), pa.array(rest, kind),
            ],
            names=[*names, "n_bytes", "head_tokens", "rest"],
        )


def token_counts(
    df: DataFrame,
    model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    head_size: int = HEAD_SIZE,
) -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens`` as the sentencepiece
    model at ``model`` gives them, ``over_limit`` (more than ``limit``).

    The model file must be at the same path on every worker. NULL and empty
    texts have no bytes and no tokens; strings that look like special tokens
    are ordinary text; rows that repeat an id are counted one by one; an empty
    table gives no rows; other columns are ignored.

    Every distinct pre-token of the corpus is counted once, in a table. The
    ``head_size`` most frequent ones reach the tasks as a bounded broadcast;
    all others are joined to the documents' pre-token frequencies by a shuffle.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = texts.select("text").mapInArrow(_frequencies, "piece string, n long")
    distinct = seen.groupBy("piece").agg(F.sum("n").alias("n"))
    table = frozen(distinct.mapInArrow(partial(_counted, model=model), "piece string, n long, tokens long"), "pieces")
    top = table.filter(F.octet_length("piece") <= HEAD_BYTES).orderBy(F.desc("n"), "piece").limit(head_size)
    head = spark.sparkContext.broadcast({r.piece: r.tokens for r in top.select("piece", "tokens").toLocalIterator()})
    kind = df.schema[id_col].dataType.simpleString()
    rows = texts.mapInArrow(
        partial(_per_document, head=lambda: head.value, names=[id_col]), f"`{id_col}` {kind}, {KNOWN}"
    )
    rows = frozen(rows.withColumn("_row", F.monotonically_increasing_id()), "documents")
    rest = rows.select("_row", F.explode("rest").alias("r")).select("_row", "r.piece", "r.n")
    tail = rest.join(table.select("piece", "tokens"), "piece").groupBy("_row").agg(
        F.sum(F.col("n") * F.col("tokens")).alias("tail_tokens")
    )
    n_tokens = F.col("head_tokens") + F.coalesce("tail_tokens", F.lit(0))
    return rows.join(tail, "_row", "left").select(
        id_col, "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
