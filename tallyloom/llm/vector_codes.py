"""Vector code compression: product codes trained by member-resident Lloyd rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import binary_array
from tallyloom.session import frozen

#: Steps per unit of a component.
SCALE = 256
#: Scaled components lie below this; the float64 sums of products are exact.
LARGEST = 1 << 20
#: Members one salt of an entry holds at most, on average.
SALT_ROWS = 1 << 16
#: Parts whose entries share one 64-bit word while a code is put together.
WORD_PARTS = 7
#: Parts compared with all entries in one numpy pass.
PASS_PARTS = 1 << 14

BLOCK = "pos int, entry int, salt int, n long, sums array<long>, members binary, parts binary"
BLOCK_ARROW = pa.schema(
    [("pos", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("n", pa.int64()),
     ("sums", pa.list_(pa.int64())), ("members", pa.binary()), ("parts", pa.binary())]
)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of ``book`` (the lower index of equals) and the squared
    distance for each row of ``parts``, in exact arithmetic."""
    entries, errors = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    points = book.astype(np.float64)
    norms = (points * points).sum(1)
    for a in range(0, len(parts), PASS_PARTS):
        some = parts[a : a + PASS_PARTS].astype(np.float64)
        scores = norms - 2.0 * (some @ points.T)
        best = scores.argmin(1)
        entries.append(best)
        errors.append(((some * some).sum(1) + scores[np.arange(len(some)), best]).astype(np.int64))
    return np.concatenate(entries), np.concatenate(errors)


def _blocks(pos: int, entry: np.ndarray, salt: np.ndarray, members: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    """One row per (entry, salt) with the members it receives."""
    order = np.lexsort((members, salt, entry))
    entry, salt, members, parts = entry[order], salt[order], members[order], parts[order]
    new = np.ones(len(entry), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (salt[1:] != salt[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(entry)))
    sums = np.add.reduceat(parts.astype(np.int64), at, axis=0) if len(at) else np.zeros((0, parts.shape[1]), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(at), pos), pa.int32()), pa.array(entry[at], pa.int32()),
            pa.array(salt[at], pa.int32()), pa.array(n, pa.int64()), pa.array(list(sums), pa.list_(pa.int64())),
            binary_array(members.astype(np.int64).view(np.uint8), n * 8),
            binary_array(parts.astype(np.int32).ravel().view(np.uint8), n * 4 * parts.shape[1]),
        ],
        schema=BLOCK_ARROW,
    )


def _members(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.frombuffer(row["members"], np.int64),
        np.frombuffer(row["parts"], np.int32).reshape(-1, width),
    )


def _settle(batches: Iterator[pa.RecordBatch], book: np.ndarray, salts: int) -> Iterator[pa.RecordBatch]:
    """The first assignment: parts on their way to the owners of their entries."""
    positions, _, width = book.shape
    for batch in batches:
        members = batch.column("member").to_numpy()
        whole = batch.column("ints").flatten().to_numpy().reshape(-1, positions, width)
        for pos in range(positions):
            entry, _ = nearest(whole[:, pos], book[pos])
            yield _blocks(pos, entry, members % salts, members, whole[:, pos])


def _own(group: pa.Table) -> pa.Table:
    """What one owner (position, entry, salt) received, as one resident block."""
    rows = group.select(["pos", "entry", "salt", "sums", "members", "parts"]).to_pylist()
    width = len(rows[0]["sums"])
    members, parts = (np.concatenate(x) for x in zip(*(_members(r, width) for r in rows), strict=True))
    same = np.full(len(members), 0)
    block = _blocks(rows[0]["pos"], same + rows[0]["entry"], same + rows[0]["salt"], members, parts)
    return pa.Table.from_batches([block])


def _resident(row: dict, books: list[np.ndarray], born: int) -> tuple[np.ndarray, np.ndarray]:
    """The members of a block that have stayed through all books since its own."""
    members, parts = _members(row, books[0].shape[2])
    for book in books[born + 1 :]:
        stays = nearest(parts, book[row["pos"]])[0] == row["entry"]
        members, parts = members[stays], parts[stays]
    return members, parts


def _review(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], born: int) -> Iterator[pa.RecordBatch]:
    """Owners hold their residents against the newest book. Of members that
    stay only the sums go on (``parts`` is NULL); the others set out."""
    for batch in batches:
        for row in batch.to_pylist():
            members, parts = _resident(row, books[:-1], born)
            entry, _ = nearest(parts, books[-1][row["pos"]])
            stays = entry == row["entry"]
            yield pa.RecordBatch.from_pylist(
                [{**row, "n": int(stays.sum()), "sums": parts[stays].sum(0, dtype=np.int64).tolist(),
                  "members": None, "parts": None}],
                BLOCK_ARROW,
            )
            if not stays.all():
                gone = ~stays
                yield _blocks(row["pos"], entry[gone], np.full(gone.sum(), row["salt"]), members[gone], parts[gone])


def _report(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], born: int) -> Iterator[pa.RecordBatch]:
    """Final entries of resident members, each as its share of the code."""
    words = -(-len(books[0]) // WORD_PARTS)
    for batch in batches:
        for row in batch.to_pylist():
            members, parts = _resident(row, books[:-1], born)
            entry, error = nearest(parts, books[-1][row["pos"]])
            word, place = divmod(row["pos"], WORD_PARTS)
            share = entry << (8 * (WORD_PARTS - 1 - place))
            empty = np.zeros(len(members), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(members), pa.array(error), *[pa.array(share if w == word else empty) for w in range(words)]],
                names=["member", "error", *[f"w{w}" for w in range(words)]],
            )


def _updated(book: np.ndarray, blocks: DataFrame) -> np.ndarray:
    """Means of the members, rounded down; entries without members stay. The
    sums of at most positions x entries owners come to the driver."""
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(book.shape[2])]
    new = book.copy()
    for row in blocks.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        if row.n:
            new[row.pos, row.entry] = [row[f"s{i}"] // row.n for i in range(book.shape[2])]
    return new


def vector_codes(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = 16, entries: int = 64, rounds: int = 2,
) -> DataFrame:
    """Per kept row: id, label, ``code`` (two hex digits a part), ``error``
    (squared distance of the integer vector to its code), ``label_error``
    (errors summed over rows of one label, NULL labels together) and
    ``codebooks_sha256``.

    A component x counts as ``floor(256 * x)``. Kept are vectors without NULL
    or non-finite components whose length is that of the smallest id's vector
    and a multiple of ``parts``; all other rows are dropped. Codebooks start
    from the ``entries`` smallest ids (NULL last, rows of one id by their
    components; fewer rows make fewer entries). Repeated rows are rows of their
    own; an empty table gives no rows; other columns are ignored. A component
    of 4,096 or more stops the query instead of giving rounded results.

    Parts live with their owner (position, entry, salt), in stored blocks. An
    owner reports the sum of its residents; after an update it holds them
    against the new entries, and only parts whose entry changed are shuffled,
    to blocks of their own. A hot entry has as many salts as the table needs.
    Only the codebooks (parts x entries) pass the driver.
    """
    numbers = F.col(vector_col).cast("array<double>")
    scaled = df.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), numbers.alias("x"),
    ).filter(
        (F.size("x") > 0) & (F.size("x") % parts == 0)
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    )
    small = F.forall("x", lambda v: F.abs(v * SCALE) < LARGEST)
    ints = F.transform("x", lambda v: F.floor(v * SCALE).cast("int"))
    scaled = scaled.select(
        F.monotonically_increasing_id().alias("member"), "id", "label",
        F.when(small, ints).otherwise(F.raise_error(F.lit("a component is too large for exact codes"))).alias("ints"),
    )
    rows = frozen(scaled, "vectors")
    order = [F.col("id").asc_nulls_last(), F.col("ints")]
    first = rows.orderBy(*order).limit(entries).collect()
    if first and any(len(r.ints) != len(first[0].ints) for r in first):
        first = rows.filter(F.size("ints") == len(first[0].ints)).orderBy(*order).limit(entries).collect()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    if not first:
        empty = f"`{id_col}` {kinds['id']}, `{label_col}` {kinds['label']}, code string, error long, label_error long, codebooks_sha256 string"
        return df.sparkSession.createDataFrame([], empty)
    rows = rows.filter(F.size("ints") == len(first[0].ints))
    start = np.array([r.ints for r in first], np.int64)
    books = [start.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()]

    salts = max(1, -(-rows.count() // SALT_ROWS))
    owner = ["pos", "entry", "salt"]
    sent = rows.select("member", "ints").mapInArrow(partial(_settle, book=books[0], salts=salts), BLOCK)
    homes = [frozen(sent.groupBy(*owner).applyInArrow(_own, BLOCK), "residents")]
    books.append(_updated(books[0], homes[0]))
    for _ in range(rounds - 1):
        reviewed = [
            home.mapInArrow(partial(_review, books=list(books), born=born), BLOCK) for born, home in enumerate(homes)
        ]
        seen = reviewed[0]
        for more in reviewed[1:]:
            seen = seen.unionAll(more)
        seen = frozen(seen, "reviewed")
        arrived = seen.filter("parts IS NOT NULL").groupBy(*owner).applyInArrow(_own, BLOCK)
        homes.append(frozen(arrived, "residents"))
        books.append(_updated(books[-1], seen.filter("parts IS NULL").unionAll(homes[-1])))

    words = [f"w{w}" for w in range(-(-parts // WORD_PARTS))]
    shape = ", ".join(["member long", "error long", *[f"{w} long" for w in words]])
    shares = homes[0].mapInArrow(partial(_report, books=list(books), born=0), shape)
    for born, home in enumerate(homes[1:], 1):
        shares = shares.unionAll(home.mapInArrow(partial(_report, books=list(books), born=born), shape))
    codes = shares.groupBy("member").agg(F.sum("error").alias("error"), *[F.sum(w).alias(w) for w in words])
    digits = F.concat(*[F.lower(F.lpad(F.hex(w), 2 * WORD_PARTS, "0")) for w in words])
    coded = frozen(
        rows.select("member", "id", "label").join(codes, "member")
        .select("id", "label", F.substring(digits, 1, 2 * parts).alias("code"), "error"), "codes",
    )
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    text = ",".join(map(str, books[-1].ravel().tolist()))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error",
        F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"),
    )
