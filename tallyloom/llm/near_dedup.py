"""Near-duplicate documents: HyperMinHash sketches, banded candidates, links
confirmed on full shingle sets, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.words import Words, binary_array, slices, text_bytes
from tallyloom.session import frozen

#: Two sketches of a set, each as (index bits, leading zeros at most, mantissa
#: bits): wide registers for the bands, where unrelated sets must not agree,
#: and more but narrower ones where many pairs of one bucket are compared.
WIDE, FINE = (7, 57, 10), (9, 14, 4)
REGISTERS = 1 << WIDE[0]
#: Registers of one band; 32 bands of 4 find a pair of similarity 0.8 with
#: probability 1 - (1 - 0.8 ** 4) ** 32, over 0.9999999.
BAND = 4
#: Seeds of the orders in which a bucket's hubs are chosen, beside the member
#: that meets most others and the smallest one.
HUB_SEEDS = (11, 12)
#: Bands of the first round of pairs.
FIRST_BANDS = 4
#: Members of one block of a bucket that is compared pair by pair.
BLOCK = 1024
#: Pairs that one numpy pass compares.
PAIRS = 1 << 14
#: Texts are fetched for a small part of the documents; from this size on a
#: Bloom filter of the wanted ids, of bounded size, goes to the scan first.
FILTER_FROM = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1MB"}
#: Members that are confirmed against one copy of a hub's shingle set.
FAN = 256


def registers(value: np.ndarray, row: np.ndarray, rows: int, shape: tuple[int, int, int] = WIDE) -> np.ndarray:
    """HyperMinHash registers of sorted distinct shingles, a row per text.

    A register holds, of the smallest hash of its bucket, the count of leading
    zeros plus one and the mantissa bits after the leading one; 0 is empty.
    """
    bits, most, mantissa = shape
    out = np.zeros((rows, 1 << bits), np.uint16 if mantissa > 4 else np.uint8)
    if not len(value):
        return out
    cell = row * (1 << bits) + (value >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))  # sorted: the smallest
    rest = (value[first] << np.uint64(bits)) | np.uint64(1 << (bits - 1))
    exponent = np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
    zeros = np.clip(53 - exponent, 0, most)
    after = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - mantissa)
    out.ravel()[cell[first]] = ((zeros + 1) << mantissa) | after.astype(np.int64)
    return out


def estimate(
    a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, shape: tuple[int, int, int] = WIDE
) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates from registers, less the expected chance collisions,
    and the registers they rest on."""
    bits, _, mantissa = shape
    used = ((a > 0) | (b > 0)).sum(1)
    equal = ((a == b) & (a > 0)).sum(1)
    ratio = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    chance = 0.169919487159739 * 2.0 ** (bits - mantissa) * 4 * ratio / (1 + ratio) ** 2
    share = np.maximum(1 - equal / np.maximum(used, 1), 0)  # equal ones are no chance
    return np.maximum(equal - chance * share * used / (1 << bits), 0) / np.maximum(used, 1), used


def plausible(a, b, n_a, n_b, least: float, shape: tuple[int, int, int] = WIDE) -> np.ndarray:
    """Pairs whose estimate is within five standard errors of ``least`` and
    whose set sizes allow it. The registers are a sample, without repetition,
    of the union; the error vanishes as they cover it."""
    value, used = estimate(a, b, n_a, n_b, shape)
    union = (n_a + n_b) / (1 + least)
    used = np.maximum(used, 1)
    slack = 5 * np.sqrt(least * (1 - least) / used * np.clip(1 - used / union, 0, 1)) + 1 / used
    return (value >= least - slack) & (np.minimum(n_a, n_b) >= least * np.maximum(n_a, n_b) - 1e-9)


NAMED = "id long, n_shingles long, class binary"
SKETCH = f"{NAMED}, registers binary, fine binary"


def _sketch(batches: Iterator[pa.RecordBatch], size: int, sketched: bool) -> Iterator[pa.RecordBatch]:
    """Size and class (a digest of the set) of each text; with ``sketched``
    its registers too."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for a, b in slices(offsets):
            value, row = Words(data, offsets[a : b + 1], lower=True).shingles(size)
            ends = np.searchsorted(row, np.arange(b - a + 1))
            classes = [
                _class(value[s:e]) if e > s else None
                for s, e in zip(ends[:-1], ends[1:], strict=True)
            ]
            columns = [
                batch.column("id").slice(a, b - a), pa.array(np.diff(ends), pa.int64()),
                pa.array(classes, pa.binary()),
            ]
            for shape in (WIDE, FINE) if sketched else ():
                sketch = registers(value, row, b - a, shape).view(np.uint8)
                columns.append(binary_array(sketch.ravel(), np.full(b - a, sketch.shape[1])))
            names = ["id", "n_shingles", "class", "registers", "fine"][: len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _class(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted shingle sets of the wanted classes, as 64-bit hashes."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        wanted = batch.column("class")
        for a, b in slices(offsets):
            value, row = Words(data, offsets[a : b + 1], lower=True).shingles(size)
            lengths = np.bincount(row, minlength=b - a) * 8
            ends = np.searchsorted(row, np.arange(b - a + 1))
            own = [_class(value[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            same = pa.array([x == w.as_py() for x, w in zip(own, wanted[a:b], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(a, b - a), binary_array(value.view(np.uint8), lengths)],
                names=["id", "shingles"],
            ).filter(same)


def _matrix(column: pa.Array, shape: tuple[int, int, int] = WIDE) -> np.ndarray:
    data, offsets = text_bytes(column)
    data = data[offsets[0] : offsets[-1]]
    return (data.view(np.uint16) if shape is WIDE else data).reshape(-1, 1 << shape[0])


def _promising(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        good = plausible(_matrix(batch.column("reg_a")), _matrix(batch.column("reg_b")), n_a, n_b, least)
        yield batch.select(["a", "b"]).filter(pa.array(good))


def _across(group: pa.Table, least: float) -> pa.Table:
    """Plausible pairs of one block pair of a bucket that lie in different
    components, each reported in the first band that brings it together."""
    ids, part, n, side, key = (
        group.column(c).to_numpy() for c in ("id", "component", "n_shingles", "side", "key")
    )
    sketch, fine = _matrix(group.column("registers")), _matrix(group.column("fine"), FINE)
    band = int(key[0]) % (REGISTERS // BAND)
    filled = sketch.reshape(len(ids), REGISTERS // BAND, BAND).any(2)
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    found = []
    step = max(1, PAIRS // max(len(right), 1))
    for start in range(0, len(left), step):
        some = left[start : start + step]
        fits = part[some][:, None] != part[right][None, :]
        fits &= (side[some] != 0)[:, None] | (ids[right][None, :] > ids[some][:, None])
        i, j = np.nonzero(fits)
        i, j = some[i], right[j]
        enough = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9
        i, j = i[enough], j[enough]
        bands = (sketch[i] == sketch[j]).reshape(len(i), REGISTERS // BAND, BAND).all(2)
        bands &= filled[i]
        first = bands.argmax(1) == band
        i, j = i[first], j[first]
        near = plausible(fine[i], fine[j], n[i], n[j], least, FINE)
        i, j = ids[i[near]], ids[j[near]]
        found.append(np.stack([np.minimum(i, j), np.maximum(i, j)], 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows (hub, part, member): the hub's set comes first."""
    hub, hub_set = None, None
    for batch in batches:
        a, b = [], []
        for row in batch.to_pylist():
            shingles = np.frombuffer(row["shingles"], np.uint64)
            if row["b"] is None:
                hub, hub_set = row["a"], shingles
                continue
            assert hub == row["a"], "a hub's set must come before its members"
            both = len(np.intersect1d(hub_set, shingles, assume_unique=True))
            if 100 * both >= percent * (len(hub_set) + len(shingles) - both):
                a.append(row["a"])
                b.append(row["b"])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach ``percent``.

    A hub's set is sent once per ``FAN`` members or so, and each member's set
    once per pair; a task streams over them and holds two sets at a time.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(FAN)).cast("int").alias("parts"))
    split = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = split.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "shingles")
    hubs = parts.join(sets.withColumnRenamed("id", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(None).cast("long").alias("b"), "shingles",
    )
    rows = members.union(hubs).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "shingles").mapInArrow(partial(_confirm, percent=percent), "a long, b long")


def _bands(classes: DataFrame) -> DataFrame:
    """One row per class and band that is not empty: a key that ends in the
    number of the band."""
    width, count = 2 * BAND, REGISTERS // BAND
    empty = F.lit(bytearray(width))
    keys = [
        F.when(part != empty, F.shiftleft(F.xxhash64(F.lit(k), part), 5).bitwiseOR(F.lit(k).cast("long")))
        for k in range(count)
        for part in [F.substring("registers", k * width + 1, width)]
    ]
    return classes.select("id", F.explode(F.array_compact(F.array(*keys))).alias("key"))


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 80
) -> DataFrame:
    """Components of near copies, one row per input row: id, ``n_shingles``,
    ``component_id`` (smallest id that links reach), ``kept``.

    Words are compared with A-Z in lower case. A document's set is its
    distinct ``shingle``-word runs, or all its words as one run when it has
    fewer. Two documents are linked when 100 * intersection >= ``percent`` *
    union. NULL or empty texts link with nothing. Ids are integers; rows with
    a NULL id link with nothing and are kept; rows that repeat an id share its
    component. An empty table gives no rows; other columns are ignored.

    1. Equal sets are one class from here on, its smallest id stands for it.
    2. Classes that agree in a band of registers share a bucket, which has a
       few hubs, first the member whose buckets are largest. Members are paired
       with hubs in rounds: with the first hub in a few bands, in all bands,
       then with the other hubs.
    3. After each round pairs that pass the estimate are confirmed on full sets
       and components are contracted; the next round pairs only members and
       hubs that still lie in different ones.
    4. Members of a bucket that are still in different components are compared
       with each other, block by block, so no link between them is lost. Pairs
       inside a component cannot change it and are left out.
    """
    least = percent / 100
    for key, value in FILTER_FROM.items():
        df.sparkSession.conf.set(key, value)
    texts = df.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    # Two readings of the texts: only classes keep registers, rows their names.
    named = frozen(texts.mapInArrow(partial(_sketch, size=shingle, sketched=False), NAMED), "named")
    first = F.min(F.struct(F.col("id").alias("smallest"), "registers", "fine"))
    found = (
        texts.filter("id IS NOT NULL")
        .mapInArrow(partial(_sketch, size=shingle, sketched=True), SKETCH)
        .filter("class IS NOT NULL")
        .groupBy("class", "n_shingles").agg(first.alias("f"))
        .select("class", "n_shingles", F.monotonically_increasing_id().alias("id"), "f.*")
    )
    classes = frozen(found, "classes")  # from here on id is the number of a class
    bands = _bands(classes)
    several = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = frozen(bands.join(several, "key"), "buckets")
    # The first hub is the member that meets most others: the middle of a group.
    weights = shared.groupBy("id").agg(F.sum("n").alias("weight"))
    shared = shared.join(weights, "id").select("key", "id", "weight")
    orders = [F.max(F.struct("weight", -F.col("id"), "id"))["id"], F.min("id")]
    orders += [F.min(F.struct(F.xxhash64(F.lit(s), "id"), "id"))["id"] for s in HUB_SEEDS]
    hubs = shared.groupBy("key").agg(F.array_distinct(F.array(*orders)).alias("hubs"))
    shared = shared.drop("weight")
    members = frozen(shared.join(hubs, "key"), "members")
    side = classes.select("id", "n_shingles", "registers")
    band = F.col("key").bitwiseAND(F.lit(REGISTERS // BAND - 1))
    repeated = not named.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").isEmpty()

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = frozen(classes.select("smallest", "id", "class", "n_shingles").join(nodes, "id", "left_semi"), "wanted")
        wanted = wanted.filter("n_shingles > 0").select(
            F.col("smallest").alias("id"), F.col("id").alias("node"), "class"
        )
        made = texts.join(wanted, "id").select("node", "class", "text").mapInArrow(
            partial(_sets, size=shingle), "id long, shingles binary"
        )
        return frozen(made.dropDuplicates(["id"]) if repeated else made, "sets")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()

    def linked(pairs: DataFrame, sets: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Links among ``pairs``, and the shingle sets fetched so far."""
        unseen = ends(pairs) if sets is None else ends(pairs).join(sets, "id", "left_anti")
        if sets is None or not unseen.isEmpty():
            fetched = sets_of(unseen)
            sets = fetched if sets is None else sets.union(fetched)
        return frozen(confirmed(pairs, sets, percent), "near"), sets

    sets = links = parts = tried = None
    first_hub = F.slice("hubs", 1, 1)
    for some, hubs_now in (
        (members.filter(band < FIRST_BANDS), first_hub), (members, first_hub), (members, F.slice("hubs", 2, len(orders))),
    ):
        stars = some.select("id", F.explode(hubs_now).alias("hub")).filter("id <> hub")
        stars = stars.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        if parts is not None:
            apart = stars.join(parts.toDF("a", "part_a"), "a", "left").join(parts.toDF("b", "part_b"), "b", "left")
            apart = apart.filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")
            stars = apart.join(tried, ["a", "b"], "left_anti")
        stars = frozen(stars, "stars")
        tried = stars if tried is None else tried.union(stars)
        pairs = (
            stars.join(side.toDF("a", "n_a", "reg_a"), "a").join(side.toDF("b", "n_b", "reg_b"), "b")
            .mapInArrow(partial(_promising, least=least), "a long, b long")
        )
        pairs = frozen(pairs, "pairs")
        if parts is not None and pairs.isEmpty():
            continue
        found, sets = linked(pairs, sets)
        links = found if links is None else links.union(found)
        parts = frozen(components(links, "a", "b"), "parts")

    # Hubs have met all of their bucket. Of buckets with the same other members
    # the one of the first band is compared; a pair's first band is among them.
    rest = members.filter(~F.array_contains("hubs", F.col("id"))).select("key", "id")
    labelled = rest.join(parts.withColumnRenamed("node", "id"), "id", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"),
    ).filter("low <> high")
    mixed = mixed.groupBy("n", "low", "high", "x", "y").agg(F.min(F.struct(band, "key"))["key"].alias("key"))
    mixed = mixed.select("key", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    blocks = (
        labelled.join(mixed, "key").join(classes.select("id", "n_shingles", "registers", "fine"), "id")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        .withColumn("side", F.signum(F.col("block") - F.col("other")).cast("int"))
    )
    more = blocks.groupBy("key", "low", "high").applyInArrow(
        lambda group: _across(group, least), "a long, b long"
    )
    more = frozen(more.distinct(), "pairs")
    links = links.union(linked(more, sets)[0])
    parts = components(links, "a", "b").toDF("id", "part")
    placed = classes.select("class", "n_shingles", "id", "smallest").join(parts, "id", "left")
    placed = placed.withColumn("part", F.coalesce("part", "id"))
    smallest = placed.groupBy("part").agg(F.min("smallest").alias("component"))
    of_class = placed.join(smallest, "part").select("class", "n_shingles", "component")
    rows = named.join(of_class, ["class", "n_shingles"], "left")
    rows = rows.withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    return rows.select(
        F.col("id").cast(df.schema[id_col].dataType).alias(id_col),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def drop_near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """``df`` with the row of the smallest id of each component, all columns as
    they came. Rows that repeat the id that stays all stay."""
    kept = near_groups(df, id_col, text_col, shingle, percent).filter(f"kept AND {id_col} IS NOT NULL")
    staying = kept.select(F.col(id_col).alias("_kept_id")).distinct()
    known = df.join(staying, F.col(id_col) == F.col("_kept_id"), "left_semi")
    return known.union(df.filter(F.col(id_col).isNull()))
