"""Quality scores from supervised subword embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import BASE, BASE_INVERSE, BYTE, SPACE, Words, mix, powers, slices, text_bytes

#: Rows of the embedding table, and the size of one vector.
TABLE_BITS, DIMENSION = 18, 16
#: Lengths in bytes of the character n-grams; they may cross word ends.
GRAMS = (3, 4)
#: Feature values of a word that repeats the one before it, and of three words
#: that stand earlier in the same text.
AGAIN = np.array([1, 2], np.uint64) * np.uint64(0x9FB21C651E98DF25)
#: Most labelled documents of each class that one model is fitted on.
SAMPLE_PER_CLASS = 1_500
EPOCHS, RATE, DECAY = 12, 4.0, 1e-4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all word unigrams, word bigrams and character n-grams of
    consecutive texts, of words and word trigrams said again, and the text
    each belongs to."""
    base = offsets[0]
    chars, ends = data[base : offsets[-1]], offsets - base
    words = Words(data, offsets)
    pair, at = words.windows(2)
    triple, place = words.windows(3)
    order = np.lexsort((triple, words.row[place]))
    seen = order[1:][(triple[order][1:] == triple[order][:-1]) & (words.row[place[order]][1:] == words.row[place[order]][:-1])]
    said = at[words.hash[at] == words.hash[at + 1]]
    value = [words.hash, pair, np.full(len(said), AGAIN[0]), np.full(len(seen), AGAIN[1])]
    row = [words.row, words.row[at], words.row[said], words.row[place[seen]]]
    owner = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
    shape = np.where(SPACE[chars], BYTE[32], BYTE[chars])
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(shape * powers(BASE, len(chars)), out=sums[1:])
    inverse = powers(BASE_INVERSE, len(chars))
    for size in GRAMS:
        n = max(len(chars) - size + 1, 0)
        inside = owner[:n] == owner[size - 1 :]
        gram = (sums[size:] - sums[: n]) * inverse[:n] if n else np.zeros(0, np.uint64)
        value.append(mix(gram[inside] + np.uint64(size)))
        row.append(owner[:n][inside])
    value, row = np.concatenate(value), np.concatenate(row)
    return (value >> np.uint64(64 - TABLE_BITS)).astype(np.int32), row


@dataclass
class Model:
    """What scoring needs of a trained model. The output layer is linear in
    the mean vector, so each embedding is put through it beforehand: ``gain``
    holds its contribution to the difference of the two logits."""

    gain: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Softmax probability of label 1 of each text; without features it is
        the share of the class in all labels."""
        rows, owner = features(data, offsets)
        n = len(offsets) - 1
        count = np.bincount(owner, minlength=n)
        mean = np.bincount(owner, self.gain[rows], minlength=n) / np.maximum(count, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(mean + self.bias, -500, 500)))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, log_prior: float, seed: int = 7) -> Model:
    """Stochastic gradient descent on softmax cross entropy.

    A bag is the distinct table rows of a text and their shares. The embedding
    step is not divided by the length of the text beyond these shares.
    ``log_prior`` is added to the bias afterwards: the sample is balanced, the
    corpus is not.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (1 << TABLE_BITS, DIMENSION)).astype(np.float32)
    out = np.zeros((2, DIMENSION), np.float32)
    bias = np.zeros(2, np.float32)
    steps, step = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)):
            rows, share = bags[k]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(rows):
                continue
            vectors = table[rows]
            mean = share @ vectors
            logits = out @ mean + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[labels[k]] -= 1  # gradient of the loss in the logits
            pull = chance @ out
            out -= rate * 0.1 * (np.outer(chance, mean) + DECAY * out)
            bias -= rate * 0.01 * chance
            table[rows] -= rate * 10 * share[:, None] * pull
    return Model(table @ (out[1] - out[0]), float(bias[1] - bias[0] + log_prior))


def held_out(id_col: str) -> F.Column:
    """Whether a row is kept from training: CRC-32 of its id as text, mod 4, is 2."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(name.cast("binary")), F.lit(4)) == 2


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct table rows of each text and their shares."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        rows, shares = [], []
        for k in range(len(batch)):
            found, count = np.unique(features(data, offsets[k : k + 2])[0], return_counts=True)
            rows.append(found.astype(np.int32).tobytes())
            shares.append((count / max(count.sum(), 1)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(rows, pa.binary()), pa.array(shares, pa.binary())],
            names=["id", "label", "rows", "shares"],
        )


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    per_class: int = SAMPLE_PER_CLASS,
) -> Model:
    """A model learnt from labelled rows that are not held out.

    At most ``per_class`` rows of each label are used, those whose hashed id is
    smallest; one task learns from their feature bags, the class shares are
    counted over all labels. Labels other than 0 and 1, NULL labels and labels
    of unknown documents teach nothing. Without any label the score is 0.5.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")
    )
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [
        known.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class) for label in (0, 1)
    ]
    sample = parts[0].union(parts[1])  # at most 2 * per_class rows: broadcast
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).join(F.broadcast(sample), "id")
    found = texts.mapInArrow(_bags, "id long, label int, rows binary, shares binary")

    def learn(sample: pa.Table) -> pa.Table:
        model = _learnt(sample, counts)
        return pa.table({"gain": [model.gain.tobytes()], "bias": [model.bias]})

    # The bounded sample meets in one task; only the finished model comes back.
    made = found.withColumn("sample", F.lit(0)).groupBy("sample").applyInArrow(learn, "gain binary, bias double").collect()
    if not made:
        return _learnt(None, counts)
    return Model(np.frombuffer(bytes(made[0].gain), np.float32), made[0].bias)


def _learnt(sample: pa.Table | None, counts: dict[int, int]) -> Model:
    """The model of a sample of bags; ``counts`` are the labels of all classes."""
    found = sample.to_pylist() if sample is not None else []
    found.sort(key=lambda r: (r["id"], r["label"], r["rows"]))
    y = np.array([r["label"] for r in found], np.int64)
    bags = [(np.frombuffer(r["rows"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in found]

    def odds(positive: float, negative: float) -> float:
        return float(np.log((positive + 0.5) / (negative + 0.5)))

    prior = odds(counts.get(1, 0), counts.get(0, 0)) - odds((y == 1).sum(), (y == 0).sum())
    return train(bags, y, prior)


def _scored(batches: Iterator[pa.RecordBatch], model, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        found = [model.value.scores(data, offsets[a : b + 1]) for a, b in slices(offsets)]
        yield batch, np.concatenate(found) if found else np.zeros(0)


def quality_scores(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7
) -> DataFrame:
    """Per row: id, ``held_out``, ``score`` and ``predicted`` (1 from
    ``threshold`` on). Whole texts are scored, one by one; NULL and empty
    texts get the score of a text without features; a NULL id is not held
    out; other columns are ignored; an empty table gives no rows."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, scores in _scored(batches, sent, "_text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def drop_poor(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``df`` that score ``threshold`` or more, all columns as they came."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, scores in _scored(batches, sent, text_col):
            yield batch.filter(pa.array(scores >= threshold))

    return df.mapInArrow(run, df.schema)
