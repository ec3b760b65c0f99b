"""Source divergence audit: how the term distributions of sources differ."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.words import binary_array, text_bytes
from tallyloom.session import frozen

#: Memory that the postings of one block take, by the estimate of ``Block``.
BLOCK_BYTES = 48 << 20
#: What one posting takes beside the bytes of its term.
POSTING_BYTES = 200
#: Bytes of one text that are cut into words at once.
PIECE_BYTES = 1 << 20
#: Bytes of text whose runs one shard merges, and runs one merge reads.
SHARD_BYTES, FAN_IN = 24 << 20, 512
#: Sources whose pairs one correction task holds.
TILE = 256
#: Postings of a shard whose corrections one task streams, for all languages.
CORRECTED = 50_000
#: Cells of the term by source matrix of one pass.
CELLS = 1 << 20
#: The unit of a probability and what is added to a count.
UNIT, PRIOR = 1_000_000_000, 5

#: Upper-case letters lower-cased; every other ASCII byte but letters a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: The entry that counts the documents of a group; no term is empty.
GROUP = b""

RUN = "shard int, lane int, langs array<string>, sources array<string>, terms binary, sizes binary, owners binary, counts binary, docs binary"


class Block:
    """Postings in memory: for each group the occurrences and documents of terms."""

    def __init__(self):
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.held = 0

    def add(self, group: tuple[str, str], text: bytes) -> None:
        counts, docs = self.groups.setdefault(group, (Counter(), Counter()))
        known = len(counts)
        text = text.translate(FOLD)
        seen: set[bytes] = set()
        start = 0
        while start < len(text):
            end = text.find(b" ", start + PIECE_BYTES)
            words = text[start : end if end >= 0 else len(text)].split()
            counts.update(words)
            seen.update(words)
            start = end if end >= 0 else len(text)
        docs.update(seen)
        docs[GROUP] += 1
        fresh = len(counts) - known
        if fresh:
            self.held += fresh * POSTING_BYTES + min(len(text), fresh * max(map(len, seen)))

    def run(self, shards: int, lane: int) -> Iterator[pa.RecordBatch]:
        """The block as one term-sorted run, a row for each shard."""
        names = list(self.groups)
        postings = sorted(
            (zlib.crc32(term) % shards, term, owner, self.groups[name][0][term], n)
            for owner, name in enumerate(names)
            for term, n in self.groups[name][1].items()
        )
        yield from _rows(postings, names, lane)
        self.groups, self.held = {}, 0


def _rows(postings: list[tuple], names: list[tuple[str, str]], lane: int) -> Iterator[pa.RecordBatch]:
    """Sorted (shard, term, owner, count, docs) as one row for each shard."""
    at = 0
    while at < len(postings):
        shard, terms, sizes, owners, counts, docs = postings[at][0], [], [], [], [], []
        local: dict[int, int] = {}
        while at < len(postings) and postings[at][0] == shard:
            _, term, owner, n, d = postings[at]
            if not terms or terms[-1] != term:
                terms.append(term)
                sizes.append(0)
            sizes[-1] += 1
            owners.append(local.setdefault(owner, len(local)))
            counts.append(n)
            docs.append(d)
            at += 1
        yield pa.RecordBatch.from_pylist(
            [{
                "shard": shard, "lane": lane, "langs": [names[o][0] for o in local], "sources": [names[o][1] for o in local],
                "terms": b" ".join(terms), "sizes": struct.pack(f"={len(sizes)}i", *sizes),
                "owners": np.array(owners, np.int32).tobytes(), "counts": np.array(counts, np.int64).tobytes(),
                "docs": np.array(docs, np.int64).tobytes(),
            }],
            pa.schema([
                ("shard", pa.int32()), ("lane", pa.int32()), ("langs", pa.list_(pa.string())),
                ("sources", pa.list_(pa.string())),
                *[(n, pa.binary()) for n in ("terms", "sizes", "owners", "counts", "docs")],
            ]),
        )


def _index(batches: Iterator[pa.RecordBatch], shards: int, lanes: int) -> Iterator[pa.RecordBatch]:
    """Block postings of whole texts; a full block leaves as a sorted run."""
    from pyspark import TaskContext

    context = TaskContext.get()
    block, made = Block(), context.partitionId() if context else 0
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for k, group in enumerate(groups):
            block.add(group, data[offsets[k] : offsets[k + 1]].tobytes())
            if block.held >= BLOCK_BYTES:
                yield from block.run(shards, made % lanes)
                made += 1
    if block.groups:
        yield from block.run(shards, made % lanes)


def _heap_merged(runs: list[dict]) -> tuple[list[bytes], list[tuple[str, str]], np.ndarray]:
    """Term-sorted runs merged by a heap: the distinct terms in order, the
    groups, and rows (term, group, count, docs), one for each term and group."""
    numbers = [np.zeros(len(r["sizes"]) // 4, np.int64) for r in runs]

    def stream(k: int) -> Iterator[tuple[bytes, int, int]]:
        return ((term, k, i) for i, term in enumerate(runs[k]["terms"].split(b" ")))

    terms: list[bytes] = []
    for term, k, i in heapq.merge(*map(stream, range(len(runs)))):
        if not terms or terms[-1] != term:
            terms.append(term)
        numbers[k][i] = len(terms) - 1
    names: dict[tuple[str, str], int] = {}
    parts = []
    for number, run in zip(numbers, runs, strict=True):
        own = [names.setdefault(g, len(names)) for g in zip(run["langs"], run["sources"], strict=True)]
        parts.append((
            np.repeat(number, np.frombuffer(run["sizes"], np.int32)),
            np.array(own, np.int64)[np.frombuffer(run["owners"], np.int32)],
            np.frombuffer(run["counts"], np.int64), np.frombuffer(run["docs"], np.int64),
        ))
    term, owner, count, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
    key = term * len(names) + owner
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    merged = np.stack([
        key[at] // len(names), key[at] % len(names), np.add.reduceat(count[order], at), np.add.reduceat(docs[order], at)
    ])
    return terms, list(names), merged


def _merge(group: pa.Table, fewer: int) -> pa.Table:
    """Several runs of one shard as one run, in one of ``fewer`` lanes."""
    runs = group.to_pylist()
    terms, names, (term, owner, count, docs) = _heap_merged(runs)
    postings = [
        (runs[0]["shard"], terms[t], o, n, d)
        for t, o, n, d in zip(term.tolist(), owner.tolist(), count.tolist(), docs.tolist(), strict=True)
    ]
    return pa.Table.from_batches(list(_rows(postings, names, runs[0]["lane"] % fewer)))


def _merging(fewer: int) -> Callable[[pa.Table], pa.Table]:
    """:func:`_merge` with one parameter: Spark gives one with two the key first."""
    return lambda group: _merge(group, fewer)


FREQUENCIES = "lang string, source string, term string, n long, n_lang long, lead boolean"


def _frequencies(group: pa.Table, least: int) -> pa.Table:
    """Frequencies of one shard: terms in ``least`` documents of a language or
    more, one row a group that holds them (the first of a language leads), and
    the groups themselves under the empty term."""
    terms, names, (term, owner, count, docs) = _heap_merged(group.to_pylist())
    langs: dict[str, int] = {}
    lang_of = np.array([langs.setdefault(lang, len(langs)) for lang, _ in names], np.int64)
    key = term * len(langs) + lang_of[owner]
    order = np.argsort(key, kind="stable")
    key, term, owner, count, docs = key[order], term[order], owner[order], count[order], docs[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(at, len(key)))
    known = np.repeat(np.add.reduceat(docs, at) >= least, sizes)
    total = np.repeat(np.add.reduceat(count, at), sizes)
    lead = np.zeros(len(key), bool)
    lead[at] = True
    is_group = np.array([t == GROUP for t in terms])[term]
    keep = known | is_group
    lead &= ~is_group
    spelt = pa.array(terms, pa.binary()).cast(pa.string())
    named = [pa.array([n[i] for n in names], pa.string()) for i in (0, 1)]
    return pa.table({
        "lang": named[0].take(pa.array(owner[keep])), "source": named[1].take(pa.array(owner[keep])),
        "term": spelt.take(pa.array(term[keep])), "n": count[keep], "n_lang": total[keep], "lead": lead[keep],
    })


def term_frequencies(
    df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30
) -> DataFrame:
    """Kept terms of each language and their occurrences in each source:
    ``lang``, ``source``, ``term``, ``n``, ``n_lang`` (of the language) and
    ``lead`` (one row of each language and term). The empty term stands for the
    group itself, so that groups without terms have a row."""
    rows = df.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
        for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))
    ])
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(4, -(-total // SHARD_BYTES))
    lanes = max(1, -(-total // (FAN_IN * (BLOCK_BYTES // 4))))
    runs = rows.mapInArrow(partial(_index, shards=shards, lanes=lanes), RUN)
    while lanes > 1:
        lanes = -(-lanes // FAN_IN)
        runs = runs.groupBy("shard", (F.col("lane") % F.lit(lanes * FAN_IN)).alias("_lane"))
        runs = runs.applyInArrow(_merging(lanes), RUN)
    return runs.groupBy("shard").applyInArrow(lambda group: _frequencies(group, least_docs), FREQUENCIES)


def _p(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * terms))``, exact."""
    wide = "decimal(20,0)"
    above = (n.cast(wide) + F.lit(PRIOR).cast(wide)) * F.lit(UNIT).cast("decimal(10,0)")
    below = total.cast(wide) + F.lit(PRIOR).cast(wide) * terms.cast(wide)
    return F.call_function("div", above, below) + 1


CORRECTIONS = "lang string, a int, b int, correction long"


def _corrections(postings: pa.Table, groups: pa.Table, size: int) -> pa.Table:
    """What the terms of one shard change in the distances of one tile of
    source pairs, against sources in which no term occurs."""
    if not postings.num_rows:
        return pa.table({"lang": pa.array([], pa.string()), "a": pa.array([], pa.int32()),
                         "b": pa.array([], pa.int32()), "correction": pa.array([], pa.int64())})
    number, slot = np.unique(groups.column("of_s").to_numpy(), return_index=True)
    base = groups.column("of_p0").to_numpy()[slot]
    term = postings.column("term").combine_chunks().dictionary_encode()
    term = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy()
    order = np.argsort(term, kind="stable")
    term = term[order]
    place = np.searchsorted(number, postings.column("s").to_numpy()[order])
    value = postings.column("p").to_numpy()[order]
    rows, cols = number // size == number.min() // size, number // size == number.max() // size
    out = np.zeros((rows.sum(), cols.sum()), np.int64)
    step = max(1, CELLS // len(number))
    for start in range(0, int(term[-1]) + 1, step):
        a, b = np.searchsorted(term, [start, start + step])
        held = np.unique(term[a:b])
        p = np.tile(base, (len(held), 1))
        p[np.searchsorted(held, term[a:b]), place[a:b]] = value[a:b]
        right = p[:, cols]
        for i, at in enumerate(np.flatnonzero(rows)):
            out[i] += np.abs(p[:, at : at + 1] - right).sum(0) - len(held) * np.abs(base[at] - base[cols])
    first, second = np.meshgrid(number[rows], number[cols], indexing="ij")
    wanted = (first < second) & (out != 0)
    return pa.table({
        "lang": pa.array([groups.column("of_lang")[0].as_py()] * int(wanted.sum()), pa.string()),
        "a": pa.array(first[wanted], pa.int32()), "b": pa.array(second[wanted], pa.int32()),
        "correction": pa.array(out[wanted], pa.int64()),
    })


def source_audit(
    df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    least_docs: int = 30, top_terms: int = 50,
) -> DataFrame:
    """How sources of a language differ: ``lang``, ``source``, ``part``,
    ``item``, ``value``, ``rank``.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a
    language keeps the terms in at least ``least_docs`` of its documents. With
    p = 1 + floor(10^9 (n + 5) / (N + 5 V)) for n occurrences among the N of
    the group's or language's V kept terms, part ``pair`` holds for each other
    source of the language the sum of |p - p'| over all kept terms (0 without
    any), and part ``term`` the ``top_terms`` terms that occur in the group with
    p above the language's, by the difference. Ranks count from 1, equal values
    by the item's UTF-8 bytes. NULL text, language and source are empty
    strings; rows that repeat count again; an empty table gives no rows; other
    columns are ignored. All arithmetic is exact.

    Tasks index their texts once: block postings until the block's memory is
    full, then a term-sorted run split over hash shards. Each shard merges its
    runs by a heap, in several rounds where there are more than FAN_IN. A pair's
    distance is that of two sources without any term times V, plus corrections
    streamed from the shards' terms, summed by pair; sources come in tiles.
    """
    kept = frozen(term_frequencies(df, lang_col, source_col, text_col, least_docs), "frequencies")
    sums = [F.sum("n").alias("total"), F.sum(F.col("lead").cast("long")).alias("terms")]
    langs = kept.groupBy("lang").agg(sums[0].alias("lang_total"), sums[1].alias("v"))
    groups = kept.groupBy("lang", "source").agg(sums[0])
    groups = groups.join(langs, "lang").withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    none = F.lit(0).cast("long")
    p0 = F.when(F.col("v") > 0, _p(none, F.col("total"), F.col("v"))).otherwise(none)
    groups = frozen(groups.withColumn("p0", p0), "groups")
    terms = kept.filter("term <> ''").join(groups, ["lang", "source"])
    terms = terms.withColumn("p", _p(F.col("n"), F.col("total"), F.col("v")))

    above = terms.withColumn("value", F.col("p") - _p(F.col("n_lang"), F.col("lang_total"), F.col("v"))).filter("value > 0 AND n > 0")
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    top = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    top = top.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top_terms)

    shards = 1 + kept.count() // CORRECTED
    tiles = groups.select("lang", (F.col("s") / TILE).cast("int").alias("tile")).distinct()
    tiles = tiles.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"))

    def tiled(rows: DataFrame) -> DataFrame:
        """Rows copied to each tile pair of their source's tile."""
        own = (F.col("s") / TILE).cast("int")
        rows = rows.join(tiles, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return rows.withColumn("i", F.least(own, "other")).withColumn("j", F.greatest(own, "other"))

    key = ["lang", "shard", "i", "j"]
    spread = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    held = tiled(terms.withColumn("shard", F.pmod(F.hash("term"), F.lit(shards))))
    left = held.select(*key, "s", "term", "p").groupBy(*key)
    every = tiled(groups.withColumn("shard", spread))
    every = every.select(*[F.col(c).alias(f"of_{c}") for c in [*key, "s", "p0"]])
    right = every.groupBy(*[f"of_{c}" for c in key])
    parts = left.cogroup(right).applyInArrow(lambda ours, all_of: _corrections(ours, all_of, TILE), CORRECTIONS)
    changes = parts.groupBy("lang", "a", "b").agg(F.sum("correction").alias("correction"))
    one = groups.select("lang", "v", F.col("source").alias("s1"), F.col("s").alias("a"), F.col("p0").alias("p1"))
    two = groups.select("lang", F.col("source").alias("s2"), F.col("s").alias("b"), F.col("p0").alias("p2"))
    pairs = one.join(two, "lang").filter("a < b").join(changes, ["lang", "a", "b"], "left")
    pairs = pairs.withColumn("value", F.col("v") * F.abs(F.col("p1") - F.col("p2")) + F.coalesce("correction", none))
    ends = F.explode(F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")),
                             F.struct(F.col("s2").alias("source"), F.col("s1").alias("item"))))
    both = pairs.select("lang", "value", ends.alias("ends"))
    both = both.select("lang", "ends.source", F.lit("pair").alias("part"), "ends.item", "value")
    ranked = both.withColumn("rank", F.row_number().over(by_value))
    return ranked.select(*columns).unionAll(top.select(*columns))
