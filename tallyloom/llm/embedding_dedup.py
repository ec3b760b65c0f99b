"""Near-duplicate embeddings by counting collisions of sorted projections."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.words import mix, text_bytes
from tallyloom.session import frozen

#: Width of a cell on one projection, and half the width of the window that is
#: centred on a query; projections of unit vectors have variance 1.
CELL, WINDOW = 2.0, 0.6
#: Projections on which collisions of a pair are counted.
COUNTED = 48
#: Chance that a pair at the threshold passes the count, and meets in a cell.
COUNT_RECALL, MEET_RECALL = 0.999, 0.98
#: Unrelated vectors a cell should hold, and members compared in one block.
OCCUPANCY, BLOCK = 32, 1024
#: Candidate pairs of one numpy pass.
PAIRS = 1 << 16


def cell_chance(distance: float) -> float:
    """Chance that two vectors at ``distance`` share a cell of one projection."""
    x = CELL / distance
    return erf(x / sqrt(2)) - 2 / (sqrt(2 * pi) * x) * (1 - exp(-x * x / 2))


@dataclass(frozen=True)
class Plan:
    """Cells: ``tables`` of ``width`` projections each; ``count``: collisions
    out of COUNTED that a pair needs."""

    least: float
    width: int
    tables: int
    count: int

    @classmethod
    def of(cls, least: float, vectors: int) -> Plan:
        near, far = sqrt(2 - 2 * least), sqrt(2)
        width = max(1, ceil(log(max(vectors, 2) / OCCUPANCY) / -log(cell_chance(far)))) if vectors > OCCUPANCY else 1
        tables = ceil(log(1 - MEET_RECALL) / log(1 - cell_chance(near) ** width))
        hit = erf(WINDOW / near / sqrt(2))
        tail, count = 0.0, COUNTED
        while count > 0:
            tail += comb(COUNTED, count) * hit**count * (1 - hit) ** (COUNTED - count)
            if tail >= COUNT_RECALL:
                break
            count -= 1
        return cls(least, width, tables, count)


@lru_cache(maxsize=8)
def directions(dimension: int, tables: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random directions of the cells, their offsets, and those counted on."""
    rng = np.random.default_rng([dimension, tables, width])
    return (
        rng.standard_normal((dimension, tables * width)),
        rng.uniform(0, CELL, tables * width),
        rng.standard_normal((dimension, COUNTED)),
    )


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cells(unit: np.ndarray, plan: Plan) -> np.ndarray:
    """The cell of each vector in every table, as a hash (vectors, tables)."""
    cell, offset, _ = directions(unit.shape[1], plan.tables, plan.width)
    place = np.floor((unit @ cell + offset) / CELL).astype(np.int64).astype(np.uint64)
    place = mix(place.reshape(len(unit), plan.tables, plan.width))
    out = np.full((len(unit), plan.tables), unit.shape[1], np.uint64)
    for k in range(plan.width):
        out = mix(out * np.uint64(31) + place[:, :, k])
    return mix(out + np.arange(plan.tables, dtype=np.uint64)).view(np.int64)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal dimension and their vectors (float64)."""
    data, offsets = text_bytes(column)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        spans = offsets[rows][:, None] + np.arange(size)
        yield rows, data[spans].view(np.float64)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes; NULL where a vector cannot link."""
    for batch in batches:
        out = []
        for vector in batch.column("vector"):
            value = None
            if vector.is_valid and len(vector):
                flat = vector.values
                value = flat.to_numpy(zero_copy_only=False).astype(np.float64) if not flat.null_count else None
                if value is not None:
                    with np.errstate(over="ignore"):
                        norm = np.linalg.norm(value / max(np.abs(value).max(), 5e-324)) if np.isfinite(value).all() else 0
                    value = (value / np.abs(value).max()) if norm > 0 and np.abs(value).max() > 0 else None
            out.append(None if value is None else value.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "vector"])


def _spread(batches: Iterator[pa.RecordBatch], plan: Plan, payload: bool) -> Iterator[pa.RecordBatch]:
    """One row per vector and table: its cell, and with ``payload`` the vector."""
    for batch in batches:
        for start in range(0, len(batch), 1024):
            part = batch.slice(start, 1024)
            found = np.zeros((len(part), plan.tables), np.int64)
            for rows, vectors in _matrices(part.column("vector")):
                found[rows] = cells(units(vectors), plan)
            cell = pa.array(found.ravel())
            if not payload:
                yield pa.RecordBatch.from_arrays([cell], names=["cell"])
                continue
            again = pa.array(np.repeat(np.arange(len(part)), plan.tables))
            table = pa.array(np.tile(np.arange(plan.tables, dtype=np.int32), len(part)))
            yield pa.RecordBatch.from_arrays(
                [cell, table, *[part.column(c).take(again) for c in ("id", "size", "vector")]],
                names=["cell", "table", "id", "size", "vector"],
            )


def _pairs(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside runs of equal ``group``, lag by lag, in bounded
    batches; in a block pair only those from different blocks."""
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(group)) - 1
    at = np.arange(len(group))
    kept, total, lag = [], 0, 1
    while True:
        at = at[left[at] >= lag]
        if not len(at):
            break
        i = at[(side[at] == 0) | (side[at] != side[at + lag])]
        kept.append((i, i + lag))
        total += len(i)
        lag += 1
        if total >= PAIRS:
            yield np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
            kept, total = [], 0
    if total:
        yield np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def _root(up: np.ndarray, k: int) -> int:
    while up[k] != k:
        up[k] = up[up[k]]
        k = up[k]
    return k


def _linked(batch: pa.Table, plan: Plan) -> pa.RecordBatch | None:
    """Links among the rows of whole cells: per vector its root there and the
    number of vectors it links to."""
    ids, sizes, table, side = (batch.column(c).to_numpy() for c in ("id", "size", "table", "side"))
    cell, low, high = (batch.column(c).to_numpy() for c in ("cell", "low", "high"))
    new = np.append(False, (cell[1:] != cell[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
    group = np.cumsum(new)
    up, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for rows, vectors in _matrices(batch.column("vector").combine_chunks()):
        unit = units(vectors)
        counted = (unit @ directions(unit.shape[1], plan.tables, plan.width)[2]).astype(np.float32)
        own = None
        for i, j in _pairs(group[rows], side[rows]):
            hits = (np.abs(counted[i] - counted[j]) <= WINDOW).sum(1)
            near = hits >= plan.count
            i, j = i[near], j[near]
            cosine = np.einsum("ij,ij->i", unit[i], unit[j])
            near = cosine >= plan.least
            i, j = i[near], j[near]
            if not len(i):
                continue
            own = cells(unit, plan) if own is None else own
            first = (own[i] == own[j]).argmax(1) == table[rows[i]]
            i, j = rows[i[first]], rows[j[first]]
            np.add.at(links, i, sizes[j])
            np.add.at(links, j, sizes[i])
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                a, b = _root(up, a), _root(up, b)
                up[max(a, b)] = min(a, b)
    at = np.flatnonzero(links)
    if not len(at):
        return None
    roots = ids[[_root(up, k) for k in at.tolist()]]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[at]), pa.array(roots), pa.array(links[at])], names=["a", "b", "links"]
    )


def _compare(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Compare the members of each cell. Rows come sorted by (cell, low,
    high); the last cell of a batch waits for its rest."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        keys = [rows.column(c).to_numpy() for c in ("cell", "low", "high")]
        last = np.logical_and.reduce([k == k[-1] for k in keys])
        begin = len(last) - int(last.sum())
        held = rows.slice(begin)
        if begin and (found := _linked(rows.slice(0, begin), plan)) is not None:
            yield found
    if held is not None and (found := _linked(held, plan)) is not None:
        yield found


def embedding_groups(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9
) -> DataFrame:
    """Per row: id, ``n_links``, ``component_id``, ``kept``.

    Vectors are linked when their cosine, in double precision, is ``least`` or
    more. A vector that is NULL, empty, zero or holds a NULL or non-finite
    component links with nothing, and vectors of different length do not link.
    Ids are integers; rows that repeat an id are vectors of their own and share
    no component unless they link. An empty table gives no rows; other columns
    are ignored.

    Equal vectors are one class with a size. Classes meet where all of
    ``width`` random projections fall into the same cell, in one of ``tables``
    such combinations; width grows with the logarithm of the number of vectors,
    so a cell stays small, and the number of tables keeps the chance to meet at
    MEET_RECALL for a pair right at the threshold. Members of a cell count the
    projections, of COUNTED others, on which one falls into the window centred
    on the other; pairs that reach the calibrated count are verified. A pair
    counts in the first table where it meets. Cells with more than BLOCK
    members are compared block by block. A task reports per vector one root and
    one number of links, never the pairs.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    cleaned = source.mapInArrow(_clean, "id long, vector binary").select(
        "id", "vector", F.monotonically_increasing_id().alias("node"), F.unhex(F.md5("vector")).alias("class")
    )
    rows = frozen(cleaned, "vectors")
    first = F.min(F.struct(F.col("id").isNull(), F.col("id").alias("smallest"), F.col("node").alias("id"), "vector"))
    found = rows.filter("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("size"), first.alias("f"))
    classes = frozen(found.select("class", "size", "f.smallest", "f.id", "f.vector"), "classes")
    plan = Plan.of(least, classes.count())
    members = classes.select("id", "size", "vector")
    width = F.lit(BLOCK)
    large = (
        members.select("vector").mapInArrow(partial(_spread, plan=plan, payload=False), "cell long")
        .groupBy("cell").agg(F.ceil(F.count("*") / width).cast("int").alias("blocks"))
        .filter("blocks > 1")
    )
    spread = members.mapInArrow(
        partial(_spread, plan=plan, payload=True), "cell long, table int, id long, size long, vector binary"
    )
    blocks = (
        spread.join(frozen(large, "cells"), "cell", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        .withColumn("side", F.signum(F.col("block") - F.col("other")).cast("int"))
        .select("cell", "low", "high", "side", "table", "id", "size", "vector")
    )
    sorted_cells = blocks.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high", "id")
    links = frozen(
        sorted_cells.mapInArrow(partial(_compare, plan=plan), "a long, b long, links long"), "links"
    )
    counts = links.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    parts = components(links, "a", "b").toDF("id", "part")
    named = classes.drop("vector").join(counts, "id", "left").join(parts, "id", "left")
    named = named.withColumn("part", F.coalesce("part", "id"))
    smallest = named.groupBy("part").agg(F.min("smallest").alias("component"))
    of_class = named.join(smallest, "part").select(
        "class", "component", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    )
    component = F.coalesce("component", "id")
    return rows.select("id", "class").join(of_class, "class", "left").select(
        F.col("id").cast(df.schema[id_col].dataType).alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
