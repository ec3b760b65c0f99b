"""Substring dedup: removal of word windows that an earlier document holds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import Words, binary_array, slices, text_bytes

#: Bytes of text whose windows one bucket is meant to hold.
BUCKET_BYTES = 16 << 20
#: Bytes of text whose windows are combined before they are sent.
SENT_BYTES = 2 << 20
#: A NULL id counts as larger than all others.
LAST_ID = 2**63 - 1
LOW = np.uint64((1 << 56) - 1)


def _pack(hashes: np.ndarray) -> np.ndarray:
    """The low seven bytes of each hash."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :7].ravel()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 7, 8), np.uint8)
    wide[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return wide.view(np.uint64).ravel()


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _send(bits: int, hashes: np.ndarray, ids: np.ndarray, known: int | None = None) -> pa.RecordBatch | None:
    """One row per bucket: its hashes in id order, the ids as differences and
    how many hashes each has. ``known`` is the bucket of known repeats, which
    need no comparison: a negative one, dealt by slice and not by hash."""
    if not len(hashes):
        return None
    if known is None:
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int32)
    else:
        bucket = np.full(len(hashes), known, np.int32)
    order = np.lexsort((ids, bucket))
    hashes, ids, bucket = hashes[order], ids[order], bucket[order]
    at = _runs(bucket, ids)
    counts = np.diff(np.append(at, len(ids))).astype(np.uint32)
    first = _runs(bucket[at])  # among the (bucket, id) runs
    owner = ids[at]
    steps = np.diff(owner, prepend=0)
    steps[first] = owner[first]
    per_row = np.diff(np.append(first, len(at)))
    sizes = np.diff(np.append(at[first], len(ids)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[at[first]], pa.int32()),
            binary_array(_pack(hashes), sizes * 7),
            binary_array(steps.astype(np.int64).view(np.uint8), per_row * 8),
            binary_array(counts.view(np.uint8), per_row * 4),
        ],
        names=["bucket", "hashes", "ids", "counts"],
    )


SENT = "bucket int, hashes binary, ids binary, counts binary"


def _windows(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Window hashes of whole texts, combined per slice: each distinct window
    goes on once, with its smallest id; larger ids are known to be repeats."""
    turn = TaskContext.get().partitionId()  # slices of all tasks are spread evenly
    for batch in batches:
        data, offsets = text_bytes(batch.column("_text"))
        ids = batch.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in slices(offsets, SENT_BYTES):
            words = Words(data, offsets[a : b + 1])
            hashes, at = words.windows(size)
            owner = ids[a:b][words.row[at]]
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            own = _runs(hashes, owner)
            hashes, owner = hashes[own], owner[own]
            fresh = np.zeros(len(hashes), bool)
            fresh[_runs(hashes)] = True
            turn += 1
            for some, known in ((fresh, None), (~fresh, -1 - turn % (1 << bits))):
                sent = _send(bits, hashes[some], owner[some], known)
                if sent is not None:
                    yield sent


def _judge(group: pa.Table) -> pa.Table:
    """The repeats of one bucket: windows whose id is not their smallest, and
    all windows of a bucket of known repeats."""
    hashes, ids = [], []
    for row in group.select(["hashes", "ids", "counts"]).to_pylist():
        hashes.append(_unpack(row["hashes"]))
        owner = np.cumsum(np.frombuffer(row["ids"], np.int64))
        ids.append(np.repeat(owner, np.frombuffer(row["counts"], np.uint32)))
    value, owner = np.concatenate(hashes), np.concatenate(ids)
    del hashes, ids
    if group.column("bucket")[0].as_py() >= 0:
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        first = _runs(value)
        repeat = owner > np.repeat(owner[first], np.diff(np.append(first, len(value))))
        value, owner = value[repeat], owner[repeat]
    order = np.argsort(owner, kind="stable")
    value, owner = value[order], owner[order]
    at = _runs(owner)
    return pa.table(
        {
            "id": pa.array(owner[at], pa.int64()),
            "marks": binary_array(_pack(value), np.diff(np.append(at, len(owner))) * 7),
        }
    )


OUT = (
    "n_words long, n_removed long, removed array<struct<first: int, last: int>>, kept_text string"
)


def _remove(batches: Iterator[pa.RecordBatch], size: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Removal intervals and what is left of each text."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    for batch in batches:
        data, offsets = text_bytes(batch.column("_text"))
        marks = batch.column("_marks")
        for a, b in slices(offsets):
            words = Words(data, offsets[a : b + 1])
            hashes, at = words.windows(size)
            hashes &= LOW
            edges = np.searchsorted(words.row[at], np.arange(b - a + 1))
            begins = np.append(0, np.cumsum(words.count))
            n_removed, removed, kept = [], [], []
            for k in range(b - a):
                text = data[offsets[a + k] : offsets[a + k + 1]].tobytes().split()
                spans = []
                seen = marks[a + k].as_py()
                if seen:
                    own = slice(edges[k], edges[k + 1])
                    hit = at[own][np.isin(hashes[own], _unpack(b"".join(seen)))] - begins[k]
                    if len(hit):
                        new = np.append(True, hit[1:] > hit[:-1] + size)
                        last = np.append(hit[:-1][new[1:]], hit[-1]) + size - 1
                        spans = list(zip(hit[new].tolist(), last.tolist(), strict=True))
                keep = np.ones(len(text), bool)
                for first, last in spans:
                    keep[first : last + 1] = False
                n_removed.append(len(text) - int(keep.sum()))
                removed.append([{"first": f, "last": t} for f, t in spans])
                kept.append(b" ".join(compress(text, keep.tolist()) if spans else text))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n).slice(a, b - a) for n in names],
                    pa.array(words.count, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(removed, kind),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=[*names, "n_words", "n_removed", "removed", "kept_text"],
            )


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13
) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``removed`` (maximal intervals
    of word numbers, both ends in) and ``kept_text`` (kept words, one space
    between).

    A window is ``window`` consecutive words of one document; all words of a
    window go whose word sequence also starts in a row with a smaller id. Ids
    are integers; a NULL id counts as larger than any other; rows with one id
    do not repeat each other. NULL text has no words; texts shorter than a
    window stay whole; an empty table gives no rows; other columns are
    ignored.

    Windows are compared by 62 or more bits of their Rabin-Karp hash. Each
    slice of a task sends a distinct window once to the bucket of its hash, so a
    passage that a third of the documents share costs that bucket one entry per
    slice; the slice's other documents are known repeats, which go to buckets
    dealt by slice and are compared with nothing. The number of buckets grows
    with the bytes of text, so one bucket always fits a task. What comes back
    to a document are the hashes of its repeated windows.
    """
    rows = df.select(
        F.col(id_col), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    total = rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    bits = max(6, (total // BUCKET_BYTES).bit_length())
    sent = rows.select("_id", "_text").mapInArrow(partial(_windows, size=window, bits=bits), SENT)
    marks = sent.groupBy("bucket").applyInArrow(_judge, "id long, marks binary")
    marks = marks.groupBy(F.col("id").alias("_id")).agg(F.collect_list("marks").alias("_marks"))
    kind = df.schema[id_col].dataType.simpleString()
    joined = rows.join(marks, "_id", "left").select(F.col(id_col), "_text", "_marks")
    return joined.mapInArrow(
        partial(_remove, size=window, names=[id_col]), f"`{id_col}` {kind}, {OUT}"
    )
