"""Suffix-array dedup: removal of bytes in long matches with an earlier document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.run_index import index_of
from tallyloom.llm.words import BASE, BASE_INVERSE, BYTE, binary_array, mix, powers, text_bytes

#: Bytes of text that are handled together, and that one census bucket or one
#: index is answerable for.
SLICE_BYTES, BUCKET_BYTES, ROUTE_BYTES = 2 << 20, 8 << 20, 8 << 20
#: Bytes of an anchor, and of the anchor that splits a hot one.
ANCHOR, FINE_ANCHOR = 16, 40
#: Slices that hold an anchor before it is hot.
HOT_SLICES = 64
#: Window starts of one numpy pass, and of one string that is streamed.
PASS_WINDOWS, STRING_WINDOWS = 1 << 19, 2048
#: A NULL id counts as larger than all others.
LAST_ID = 2**63 - 1
VALUE_BITS = 48


def _hashes(chars: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``size`` bytes."""
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(BYTE[chars] * powers(BASE, len(chars)), out=sums[1:])
    n = len(chars) - size + 1
    return mix((sums[size:] - sums[:n]) * powers(BASE_INVERSE, n))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    if width == 1:
        return values
    blocks = np.append(values, np.full(-len(values) % width, ~np.uint64(0))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, size: int, window: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: ``start``, ``stop``, ``value`` and
    ``row``. The anchor of a window is the smallest hash of ``size`` bytes
    inside it, so equal windows have equal anchors wherever they stand."""
    total = len(data)
    outside = np.zeros(total + 1, np.int32)  # window starts that leave their text
    np.add.at(outside, np.maximum(offsets[:-1], offsets[1:] - window + 1), 1)
    np.add.at(outside, offsets[1:], -1)
    np.cumsum(outside, out=outside)
    starts, stops, values = [], [], []
    for a in range(0, total - window + 1, PASS_WINDOWS):
        b = min(a + PASS_WINDOWS, total - window + 1)
        value = _sliding_min(_hashes(data[a : b + window - 1], size), window - size + 1)
        inside = outside[a:b] == 0
        change = np.append(True, (value[1:] != value[:-1]) | (inside[1:] != inside[:-1]))
        at = np.flatnonzero(change)
        end = np.append(at[1:], b - a)
        own = inside[at]
        starts.append(a + at[own])
        stops.append(a + end[own])
        # scrambled again: the smallest of many hashes has few high bits
        values.append(mix(value[at[own]]) >> np.uint64(64 - VALUE_BITS))
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    start = np.concatenate(starts)
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, np.concatenate(stops), np.concatenate(values), row


def _pack(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6].ravel()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _narrow(numbers: np.ndarray, bound: int) -> np.ndarray:
    return numbers.astype(np.uint16 if bound <= 1 << 16 else np.uint32)


def _wide(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * count else np.uint32).astype(np.int64)


class Slice:
    """The texts of one slice in an order that every reading of it gives."""

    def __init__(self, table: pa.Table):
        text = table.column("_text").combine_chunks()
        data, offsets = text_bytes(text)
        ids, keys = (table.column(c).to_numpy() for c in ("_id", "_key"))
        sizes = np.diff(offsets)
        self.order = np.lexsort((sizes, ids, keys))
        self.ids = ids[self.order]
        self.offsets = np.append(0, np.cumsum(sizes[self.order]))
        self.data = np.concatenate([data[:0], *[data[offsets[k] : offsets[k + 1]] for k in self.order]])


CENSUS = "bucket int, slice long, vals binary, owners binary, ids binary, many binary"


def _census(table: pa.Table, window: int, bits: int) -> pa.Table:
    """The distinct anchors of a slice by bucket, each with the smallest id that
    has it here and whether there are others."""
    texts = Slice(table)
    _, _, value, row = anchors(texts.data, texts.offsets, ANCHOR, window)
    ids = texts.ids[row]
    order = np.lexsort((ids, value))
    value, ids = value[order], ids[order]
    at = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    last = np.append(at[1:], len(value)) - 1
    many = ids[at] != ids[last]
    value, ids = value[at], ids[at]
    bucket = (value >> np.uint64(VALUE_BITS - bits)).astype(np.int64)
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
        known, owner = np.unique(ids[a:b], return_inverse=True)
        rows.append({
            "bucket": int(bucket[a]), "slice": table.column("slice")[0].as_py(), "vals": _pack(value[a:b]).tobytes(),
            "owners": _narrow(owner, len(known)).tobytes(), "ids": np.diff(known, prepend=0).tobytes(), "many": np.packbits(many[a:b]).tobytes(),
        })
    names = [("bucket", pa.int32()), ("slice", pa.int64()), *[(n, pa.binary()) for n in ("vals", "owners", "ids", "many")]]
    return pa.Table.from_pylist(rows, pa.schema(names))


ANSWERS = "slice long, vals binary, routes binary, flags binary"
OWN, HOT = 1, 2


def _judge(table: pa.Table, routes: int) -> pa.Table:
    """Anchors of one bucket that several documents have. Each slice learns
    which of its anchors they are, the route of the smallest document that has
    it, whether that one is its own, and whether the anchor is hot."""
    rows = table.to_pylist()
    values = [_unpack(r["vals"]) for r in rows]
    sizes = np.array([len(v) for v in values])
    ids = np.concatenate([
        np.cumsum(np.frombuffer(r["ids"], np.int64))[_wide(r["owners"], n)] for r, n in zip(rows, sizes, strict=True)
    ])
    many = np.concatenate([
        np.unpackbits(np.frombuffer(r["many"], np.uint8), count=n) for r, n in zip(rows, sizes, strict=True)
    ])
    value = np.concatenate(values)
    del values
    order = np.lexsort((ids, value))
    ordered = value[order]
    at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    count = np.diff(np.append(at, len(value)))
    smallest = ids[order[at]]
    shared = (ids[order[at + count - 1]] != smallest) | np.logical_or.reduceat(many[order], at)
    route = (mix(smallest.astype(np.uint64)) % np.uint64(routes)).astype(np.int64)
    group = np.empty(len(value), np.int64)
    group[order] = np.repeat(np.arange(len(at)), count)
    flags = ((ids == smallest[group]) * OWN + (count > HOT_SLICES)[group] * HOT).astype(np.uint8)
    out, ends = [], np.append(0, np.cumsum(sizes))
    for k, r in enumerate(rows):
        mine = np.arange(ends[k], ends[k + 1])
        mine = mine[shared[group[mine]]]
        if len(mine):
            out.append({
                "slice": r["slice"], "vals": _pack(value[mine]).tobytes(),
                "routes": _narrow(route[group[mine]], routes).tobytes(), "flags": flags[mine].tobytes(),
            })
    names = [("slice", pa.int64()), *[(n, pa.binary()) for n in ("vals", "routes", "flags")]]
    return pa.Table.from_pylist(out, pa.schema(names))


def _gathered(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of consecutive ranges, and where each range begins in them."""
    begin = np.append(0, np.cumsum(size))
    return np.arange(begin[-1]) - np.repeat(begin[:-1] - start, size), begin


def _cooled(texts: Slice, runs: tuple[np.ndarray, ...], window: int, routes: int) -> tuple[np.ndarray, ...]:
    """Runs of hot anchors cut at longer anchors, which choose their routes."""
    start, stop, row, route, index = runs
    place, begin = _gathered(start, stop - start + window - 1)
    a, b, value, part = anchors(texts.data[place], begin, FINE_ANCHOR, window)
    shift = start[part] - begin[part]
    spread = mix(value ^ mix(route[part].astype(np.uint64) + np.uint64(1))) % np.uint64(routes)
    return a + shift, b + shift, row[part], spread.astype(np.int64), index[part]


def _joined(start, stop, row, route, index) -> tuple[np.ndarray, ...]:
    """Neighbouring runs of one text, route and role as one, long ones cut."""
    order = np.argsort(start, kind="stable")
    start, stop, row, route, index = (x[order] for x in (start, stop, row, route, index))
    new = np.ones(len(start), bool)
    new[1:] = (
        (start[1:] != stop[:-1]) | (row[1:] != row[:-1]) | (route[1:] != route[:-1]) | (index[1:] != index[:-1])
    )
    at = np.flatnonzero(new)
    start, stop, row, route, index = start[at], stop[np.append(at[1:], len(stop)) - 1], row[at], route[at], index[at]
    parts = -(-(stop - start) // STRING_WINDOWS)
    which = np.repeat(np.arange(len(start)), parts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = start[which] + nth * STRING_WINDOWS
    return first, np.minimum(first + STRING_WINDOWS, stop[which]), row[which], route[which], index[which]


STRINGS = "route long, slice long, data binary, sizes binary, ids binary, starts binary, indexed binary"


def _strings(route: int, slice_no: int, held: list[tuple[bytes, int, int, int, bool]]) -> dict:
    data, sizes, ids, starts, indexed = zip(*held, strict=True)
    return {
        "route": route, "slice": slice_no, "data": b"".join(data), "sizes": np.array(sizes, np.int32).tobytes(),
        "ids": np.array(ids, np.int64).tobytes(), "starts": np.array(starts, np.int64).tobytes(),
        "indexed": np.array(indexed, np.uint8).tobytes(),
    }


def _route(texts: pa.Table, answers: pa.Table, window: int, routes: int) -> pa.Table:
    """Strings of a slice whose windows may stand in several documents, by
    route. Strings of the document with the smallest id are for the index, all
    others are streamed. Of equal strings only the smallest id's goes on; the
    others are marked at once, under a route of the slice's own."""
    kind = pa.schema([("route", pa.int64()), ("slice", pa.int64()),
                      *[(n, pa.binary()) for n in ("data", "sizes", "ids", "starts", "indexed")]])
    if not answers.num_rows or not texts.num_rows:
        return pa.Table.from_pylist([], kind)
    number = texts.column("slice")[0].as_py()
    texts = Slice(texts)
    known = [(_unpack(r["vals"]), r) for r in answers.to_pylist()]
    value_of = np.concatenate([v for v, _ in known])
    route_of = np.concatenate([_wide(r["routes"], len(v)) for v, r in known])
    flag_of = np.concatenate([np.frombuffer(r["flags"], np.uint8) for _, r in known])
    order = np.argsort(value_of)
    value_of, route_of, flag_of = value_of[order], route_of[order], flag_of[order]

    start, stop, value, row = anchors(texts.data, texts.offsets, ANCHOR, window)
    at = np.minimum(np.searchsorted(value_of, value), len(value_of) - 1)
    hit = value_of[at] == value
    start, stop, row, at = start[hit], stop[hit], row[hit], at[hit]
    smallest = np.full(len(value_of), LAST_ID)
    np.minimum.at(smallest, at, texts.ids[row])
    index = ((flag_of[at] & OWN) > 0) & (texts.ids[row] == smallest[at])
    runs = start, stop, row, route_of[at], index
    hot = (flag_of[at] & HOT) > 0
    if hot.any():
        cooled = _cooled(texts, tuple(x[hot] for x in runs), window, routes)
        runs = tuple(np.concatenate([x[~hot], y]) for x, y in zip(runs, cooled, strict=True))
    start, stop, row, route, index = _joined(*runs)
    ids = texts.ids[row]
    order = np.lexsort((start, ids, ~index, route))
    blob = texts.data.tobytes()
    out, direct, held, seen, stored, now = [], [], [], {}, set(), -1
    columns = (x[order].tolist() for x in (start, stop, ids, route, index))
    for a, b, owner, to, indexed in zip(*columns, strict=True):
        if to != now:
            if held:
                out.append(_strings(now, number, held))
            held, seen, stored, now = [], {}, set(), to
        string = blob[a : b + window - 1]
        first = seen.setdefault(string, owner)
        if first < owner:
            direct.append((b"", len(string), owner, a, False))
        elif string not in stored:
            held.append((string, len(string), owner, a, indexed))
            if indexed:
                stored.add(string)
    if held:
        out.append(_strings(now, number, held))
    if direct:
        out.append(_strings(-1 - number, number, direct))
    return pa.Table.from_pylist(out, kind)


MARKS = "slice long, starts binary, sizes binary"


def _consecutive(position: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of consecutive positions that agree in ``same``."""
    new = np.append(True, position[1:] != position[:-1] + 1) if len(position) else np.zeros(0, bool)
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(position)) - 1 if len(first) else first


def _text(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(strings), np.uint8)
    return data, np.append(0, np.cumsum([len(s) for s in strings], dtype=np.int64))


def _narrowed(data: np.ndarray, runs: tuple[np.ndarray, ...], keep: np.ndarray, window: int) -> tuple[np.ndarray, list[bytes]]:
    """Where the kept runs of windows begin, neighbours as one, and their bytes."""
    start, stop, _, row = (x[keep] for x in runs)
    new = np.append(True, (start[1:] != stop[:-1]) | (row[1:] != row[:-1])) if len(start) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1
    blob = data.tobytes()
    ends = zip(start[at].tolist(), stop[last].tolist(), strict=True) if len(at) else ()
    return start[at], [blob[a : b + window - 1] for a, b in ends]


def long_matches(indexed: list[bytes], streamed: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of the streamed strings stand in an indexed one: a flag
    per byte of the strings put together, those bytes, and where strings begin.

    Only windows whose longer anchor both sides have are indexed or streamed,
    equal stretches of them once.
    """
    data, offsets = _text(streamed)
    found = np.zeros(len(data), bool)
    base, begins = _text(indexed)
    ours, theirs = anchors(base, begins, FINE_ANCHOR, window), anchors(data, offsets, FINE_ANCHOR, window)
    _, held = _narrowed(base, ours, np.isin(ours[2], theirs[2]), window)
    at, wanted = _narrowed(data, theirs, np.isin(theirs[2], ours[2]), window)
    if held and wanted:
        distinct = {s: k for k, s in enumerate(dict.fromkeys(wanted))}
        text, begin = _text(list(distinct))
        hit = index_of(sorted(set(held))).matching_statistics(text, begin, window) >= window
        size = np.array([len(s) for s in wanted])
        into, _ = _gathered(at, size)
        source, _ = _gathered(begin[[distinct[s] for s in wanted]], size)
        found[into[hit[source]]] = True
    return found, data, offsets


def _found(indexed: list[bytes], strings: list[bytes], smallest: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the strings (their smallest holders) that an earlier document
    has. What the index does not hold is matched among the strings themselves:
    windows of their smallest holder are indexed, the others streamed."""
    found, data, offsets = long_matches(indexed, strings, window)
    if not len(data):
        return found, offsets
    owner = np.repeat(np.arange(len(strings)), np.diff(offsets))
    left = np.flatnonzero(~found & (np.arange(len(data)) + window <= offsets[owner + 1]))
    if len(left):
        value = np.concatenate([
            _hashes(data[a : a + PASS_WINDOWS + window - 1], window)
            for a in range(0, len(data) - window + 1, PASS_WINDOWS)
        ])[left]
        ids = smallest[owner[left]]
        order = np.lexsort((ids, value))
        ordered = value[order]
        at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        count = np.diff(np.append(at, len(order)))
        first = np.repeat(ids[order[at]], count)
        several = np.repeat(ids[order[at + count - 1]] != ids[order[at]], count)
        keep, role = np.zeros(len(left), bool), np.zeros(len(left), bool)
        keep[order], role[order] = several, first == ids[order]
        left, role = left[keep], role[keep]
        a, b = _consecutive(left, owner[left], role)
        blob = data.tobytes()
        parts = [blob[left[i] : left[j] + window] for i, j in zip(a, b, strict=True)]
        first_of = {p for p, r in zip(parts, role[a], strict=True) if r}
        later = [k for k, r in enumerate(role[a]) if not r]
        again, _, begin = long_matches(sorted(first_of), [parts[k] for k in later], window)
        for n, k in enumerate(later):
            found[left[a[k]] : left[b[k]] + 1] |= again[begin[n] : begin[n] + b[k] - a[k] + 1]
    return found, offsets


def _stream(table: pa.Table, window: int) -> pa.Table:
    """Matching statistics of one route's strings, as marks by slice."""
    marks: dict[int, tuple[list[int], list[int]]] = {}
    indexed: set[bytes] = set()
    streamed: dict[bytes, list[tuple[int, int, int]]] = {}
    for row in table.to_pylist():
        sizes, ids, starts = (np.frombuffer(row[n], t) for n, t in (("sizes", np.int32), ("ids", np.int64), ("starts", np.int64)))
        if row["route"] < 0:
            own = marks.setdefault(row["slice"], ([], []))
            own[0].extend(starts.tolist())
            own[1].extend(sizes.tolist())
            continue
        data, at = row["data"], 0
        for size, owner, start, first in zip(sizes.tolist(), ids.tolist(), starts.tolist(), row["indexed"], strict=True):
            string = data[at : at + size]
            at += size
            if first:
                indexed.add(string)
            else:
                streamed.setdefault(string, []).append((owner, row["slice"], start))

    def mark(slice_no: int, start: int, size: int) -> None:
        own = marks.setdefault(slice_no, ([], []))
        own[0].append(start)
        own[1].append(size)

    open_strings = []
    for string, holders in streamed.items():
        smallest = min(h[0] for h in holders)
        for owner, slice_no, start in holders:
            if string in indexed or owner > smallest:
                mark(slice_no, start, len(string))
        if string not in indexed:
            open_strings.append(string)
    least = np.array([min(h[0] for h in streamed[s]) for s in open_strings], np.int64)
    found, offsets = _found(sorted(indexed), open_strings, least, window)
    hits = np.flatnonzero(found)
    owner = np.searchsorted(offsets, hits, side="right") - 1
    first, last = _consecutive(hits, owner)
    for a, b, k in zip(hits[first].tolist(), hits[last].tolist(), owner[first].tolist(), strict=True):
        for holder, slice_no, start in streamed[open_strings[k]]:
            if holder == least[k]:
                mark(slice_no, start + a - int(offsets[k]), b - a + window)
    return pa.Table.from_pylist(
        [{"slice": s, "starts": np.array(a, np.int64).tobytes(), "sizes": np.array(b, np.int32).tobytes()}
         for s, (a, b) in marks.items()],
        pa.schema([("slice", pa.int64()), ("starts", pa.binary()), ("sizes", pa.binary())]),
    )


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
OUT = "n_bytes long, n_removed long, removed array<struct<first: long, last: long>>, kept binary"


def _cut(table: pa.Table, marks: pa.Table, id_col: str) -> pa.Table:
    """Removed spans and what is left of the texts of one slice."""
    texts = Slice(table)
    data, offsets = texts.data, texts.offsets
    cover = np.zeros(len(data) + 1, np.int32)
    for row in marks.to_pylist():
        start, size = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["sizes"], np.int32)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + size, -1)
    gone = np.cumsum(cover[:-1]) > 0
    before = np.append(0, np.cumsum(gone))
    removed = before[offsets[1:]] - before[offsets[:-1]]
    at = np.flatnonzero(gone)
    row = np.searchsorted(offsets, at, side="right") - 1
    first, last = _consecutive(at, row)
    owner = row[first]
    ends = np.searchsorted(owner, np.arange(len(texts.ids) + 1))
    spans = pa.StructArray.from_arrays(
        [pa.array(at[first] - offsets[owner]), pa.array(at[last] - offsets[owner])], names=["first", "last"]
    )
    sizes = np.diff(offsets)
    return pa.table({
        id_col: table.column(id_col).take(pa.array(texts.order)), "n_bytes": sizes, "n_removed": removed,
        "removed": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans).cast(SPANS),
        "kept": binary_array(data[~gone], sizes - removed),
    })


def remove_long_matches(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50
) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``removed`` (maximal spans of
    byte numbers, both ends in) and ``kept`` (the bytes left, as binary).

    All bytes of a string of ``window`` bytes go that also starts in a row with
    a smaller id; strings never cross rows and are judged on the input. Ids are
    integers; a NULL id counts as larger than any other; rows with one id do
    not repeat each other. NULL text has no bytes; texts shorter than a window
    stay whole; an empty table gives no rows; other columns are ignored.

    Texts lie in slices by a hash of row content. Every window has an anchor,
    its smallest 16-byte hash. A census finds anchors that several documents
    have and the smallest id of each. Windows with such anchors travel, as
    strings of neighbours, to the route of that id: its own strings become a
    run-length index there, and all others are streamed against it by matching
    statistics. Windows that it does not hold are all at the same route, and
    are matched among themselves in the same way. Anchors found in more than 64
    slices are split by longer anchors. Equal strings of a slice go on once.
    """
    if window <= FINE_ANCHOR:
        raise ValueError(f"windows of fewer than {FINE_ANCHOR} bytes have no anchor")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"), text.alias("_text"))
    total = rows.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    slices = total // SLICE_BYTES + 1
    bits = max(2, (total // BUCKET_BYTES).bit_length())
    routes = total // ROUTE_BYTES + 4
    rows = rows.withColumn("_key", F.xxhash64("_id", "_text"))
    rows = rows.withColumn("slice", F.pmod("_key", F.lit(slices))).repartition("slice")
    census = rows.groupBy("slice").applyInArrow(lambda texts: _census(texts, window, bits), CENSUS)
    answers = census.groupBy("bucket").applyInArrow(lambda known: _judge(known, routes), ANSWERS)
    strings = rows.groupBy("slice").cogroup(answers.groupBy("slice"))
    strings = strings.applyInArrow(lambda texts, known: _route(texts, known, window, routes), STRINGS)
    marks = strings.groupBy("route").applyInArrow(lambda sent: _stream(sent, window), MARKS)
    kind = df.schema[id_col].dataType.simpleString()
    cut = rows.groupBy("slice").cogroup(marks.groupBy("slice"))
    return cut.applyInArrow(lambda texts, found: _cut(texts, found, id_col), f"`{id_col}` {kind}, {OUT}")
