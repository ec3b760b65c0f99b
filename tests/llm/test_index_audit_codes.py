"""Long matches, the source audit and vector codes against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import long_matches as lm
from tallyloom.llm import source_audit as audit
from tallyloom.llm.long_matches import remove_long_matches
from tallyloom.llm.run_index import RunIndex, index_of, suffix_array
from tallyloom.llm.source_audit import source_audit
from tallyloom.llm.vector_codes import nearest, vector_codes
from tests.llm.conftest import rows_of


def longest(strings, pattern, cap):
    return [
        max((n for n in range(cap + 1) if i + n <= len(pattern) and any(pattern[i : i + n] in s for s in strings)))
        for i in range(len(pattern))
    ]


@pytest.mark.parametrize("seed", range(20))
def test_index_and_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    strings = [bytes(rng.integers(0, 2 + seed % 3, rng.integers(1, 30)).astype(np.uint8)) * (1 + seed % 4) for _ in range(5)]
    patterns = [bytes(rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint8)) for _ in range(5)] + [strings[0] + strings[1]]
    index = index_of(strings)
    text = bytes(index.text)
    assert suffix_array(index.text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    data = np.frombuffer(b"".join(patterns), np.uint8)
    offsets = np.append(0, np.cumsum([len(p) for p in patterns]))
    for cap in (3, 50):
        got = index.matching_statistics(data, offsets, cap)
        for k, p in enumerate(patterns):
            assert got[offsets[k] : offsets[k + 1]].tolist() == longest(strings, p, cap)


def test_index_follows_runs_not_text():
    once = bytes(np.random.default_rng(0).integers(0, 250, 500).astype(np.uint8))
    assert len(RunIndex(np.frombuffer(once * 40 + b"\xff", np.uint8)).heads) <= len(index_of([once]).heads) + 2


def removed(rows, window):
    """Removed bytes of each (id, bytes) by definition; a missing id is the largest."""
    first = {}
    ids = [lm.LAST_ID if i is None else i for i, _ in rows]
    for i, (_, t) in zip(ids, rows, strict=True):
        for k in range(len(t) - window + 1):
            s = t[k : k + window]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, (_, t) in zip(ids, rows, strict=True):
        gone = set()
        for k in range(len(t) - window + 1):
            if first[t[k : k + window]] < i:
                gone.update(range(k, k + window))
        out.append(sorted(gone))
    return out


def spans(gone):
    return [[a, b] for a in gone if a - 1 not in gone for b in [next(x for x in gone if x >= a and x + 1 not in gone)]]


def in_process(rows, window, slices, bits=3, routes=5):
    """The operator's steps on plain tables, as Spark would group them."""
    groups = defaultdict(list)
    for i, t in rows:
        key = int.from_bytes(hashlib.md5(repr((i, t)).encode()).digest()[:7], "big")
        groups[key % slices].append((lm.LAST_ID if i is None else i, t.decode(), key, i))
    tables = {
        s: pa.table({"slice": [s] * len(g), "_id": [x[0] for x in g], "_text": [x[1] for x in g],
                     "_key": [x[2] for x in g], "id": pa.array([x[3] for x in g], pa.int64())})
        for s, g in groups.items()
    }

    def grouped(parts, key):
        whole = pa.concat_tables(parts)
        keys = sorted(set(whole.column(key).to_pylist()))
        return {k: whole.filter(pa.compute.equal(whole.column(key), k)) for k in keys}

    census = grouped([lm._census(t, window, bits) for t in tables.values()], "bucket")
    answers = [lm._judge(t, routes) for t in census.values()]
    known, none = grouped(answers, "slice"), answers[0].slice(0, 0)
    sent = grouped([lm._route(t, known.get(s, none), window, routes) for s, t in tables.items()], "route")
    found = [lm._stream(t, window) for t in sent.values()]
    marks, none = grouped(found, "slice"), found[0].slice(0, 0)
    return [r for s, t in tables.items() for r in lm._cut(t, marks.get(s, none), "id").to_pylist()]


@pytest.mark.parametrize("hot", [0, 64])
@pytest.mark.parametrize("seed", range(4))
def test_long_matches_by_steps(monkeypatch, seed, hot):
    monkeypatch.setattr(lm, "HOT_SLICES", hot)
    monkeypatch.setattr(lm, "STRING_WINDOWS", 37)
    monkeypatch.setattr(lm, "PASS_WINDOWS", 101)
    rng = np.random.default_rng(seed)
    pool = [bytes(rng.integers(97, 103, 120).astype(np.uint8)) for _ in range(4)]
    rows = []
    for k in range(60):
        pieces = []
        for _ in range(rng.integers(0, 4)):
            p = pool[rng.integers(0, 4)]
            a = rng.integers(0, 70)
            pieces += [p[a : a + rng.integers(10, 90)], bytes(rng.integers(97, 123, rng.integers(0, 30)).astype(np.uint8))]
        rows.append((None if k % 17 == 16 else int(rng.integers(-5, 50)), b"".join(pieces)))
    got = in_process(rows, 45, slices=7)
    want = removed(rows, 45)
    assert sorted((r["id"] is None, r["id"] or 0, r["n_bytes"], r["n_removed"], repr([list(s.values()) for s in r["removed"]]), r["kept"]) for r in got) == sorted(
        (i is None, i or 0, len(t), len(g), repr(spans(g)), bytes(b for k, b in enumerate(t) if k not in set(g)))
        for (i, t), g in zip(rows, want, strict=True)
    )


def test_long_matches(docs, no_docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.filter("length(text) < 10000 OR text IS NULL").collect()]
    some = docs.filter("length(text) < 10000 OR text IS NULL")
    got = remove_long_matches(some)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "removed", "kept"]
    want = sorted(
        ((i, len(t), len(g), bytes(b for k, b in enumerate(t) if k not in set(g))) for (i, t), g in zip(rows, removed(rows, 50), strict=True)),
        key=repr,
    )
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got.collect()), key=repr) == want
    assert any(n for _, _, n, _ in want)
    # the second of two very long equal texts goes whole
    long = {r.doc_id: r.n_removed for r in remove_long_matches(docs.filter("length(text) >= 10000")).collect()}
    assert long[9] == 0 and long[10] > 100_000
    assert remove_long_matches(no_docs).count() == 0
    with pytest.raises(ValueError):
        remove_long_matches(docs, window=20)


def expected_audit(rows, least):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))
        groups[(lang or "", source or "")].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = {s: c for (g, s), c in groups.items() if g == lang}

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = p(sum(mine.values(), Counter()))
        for s in mine:
            own = p(mine[s])
            pairs = [(-sum(abs(own[t] - x) for t, x in p(mine[o]).items()), o.encode(), o) for o in mine if o != s]
            terms = [(q[t] - own[t], t.encode(), t) for t in kept if mine[s][t] > 0 and own[t] > q[t]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:50], 1)]
    return sorted(out)


AUDIT = ["lang", "source", "part", "item", "value", "rank"]


def test_source_audit(docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    for least in (1, 2, 30):
        assert sorted(map(tuple, source_audit(docs, least_docs=least).select(*AUDIT).collect())) == expected_audit(rows, least)
    assert source_audit(no_docs).columns == AUDIT
    assert source_audit(no_docs).count() == 0


def test_source_audit_in_lanes(monkeypatch, docs):
    """Many runs of a shard are merged on Spark, in three rounds here."""
    monkeypatch.setattr(audit, "FAN_IN", 2)
    monkeypatch.setattr(audit, "BLOCK_BYTES", 1 << 18)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert sum(len((t or "").encode()) for _, _, t in rows) > 4 * audit.FAN_IN * (audit.BLOCK_BYTES // 4)
    got = source_audit(docs, least_docs=2).select(*AUDIT).collect()
    assert sorted(map(tuple, got)) == expected_audit(rows, 2)


def test_runs_merge_in_rounds(monkeypatch):
    """Full blocks leave as runs; merging them in rounds or at once is the same."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["Ab", "cd", "é1", "x" * 50, "ZZ", "q"], 30)) for _ in range(60)]
    block, runs = audit.Block(), []
    for k, t in enumerate(texts):
        block.add((f"l{k % 2}", f"s{k % 5}"), t.encode())
        if k % 7 == 6:
            runs += [b.to_pylist()[0] for b in block.run(1, k)]
    runs += [b.to_pylist()[0] for b in block.run(1, 0)]
    kind = pa.schema([("shard", pa.int32()), ("lane", pa.int32()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())),
                      *[(n, pa.binary()) for n in ("terms", "sizes", "owners", "counts", "docs")]])
    once = audit._frequencies(pa.Table.from_pylist(runs, kind), 2)
    halves = [audit._merge(pa.Table.from_pylist(runs[a::2], kind), 1) for a in (0, 1)]
    twice = audit._frequencies(pa.concat_tables(halves), 2)
    key = [("lang", "ascending"), ("source", "ascending"), ("term", "ascending")]
    assert once.drop(["lead"]).sort_by(key) == twice.drop(["lead"]).sort_by(key)
    assert once.num_rows > 10 and sum(once.column("lead").to_pylist()) == sum(twice.column("lead").to_pylist())


def test_tiles_of_sources():
    """Corrections by tile add up to those of one tile."""
    rng = np.random.default_rng(4)
    base = {"of_lang": ["x"] * 7, "of_s": list(range(7)), "of_p0": rng.integers(1, 50, 7)}
    terms = {"s": [], "term": [], "p": []}
    for t in range(40):
        for s in rng.choice(7, rng.integers(1, 7), replace=False):
            terms["s"].append(int(s))
            terms["term"].append(f"t{t}")
            terms["p"].append(int(rng.integers(1, 500)))
    whole = audit._corrections(pa.table(terms), pa.table(base), 100).to_pylist()
    tiled = []
    for i in range(3):
        for j in range(i, 3):
            groups = pa.table(base)
            keep = [k for k in range(7) if k // 3 in (i, j)]
            held = pa.table(terms)
            held = held.take([k for k, s in enumerate(terms["s"]) if s // 3 in (i, j)])
            tiled += audit._corrections(held, groups.take(keep), 3).to_pylist()
    assert sorted(map(repr, whole)) == sorted(map(repr, tiled)) and whole


def expected_codes(rows, parts, entries, rounds):
    kept = sorted(((math.inf if i is None else i, [math.floor(256 * x) for x in v], label) for i, v, label in rows), key=lambda r: r[:2])
    w = len(kept[0][1]) // parts
    split = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in kept]
    books = [[split[k][p] for k in range(min(entries, len(kept)))] for p in range(parts)]

    def assign(p):
        def far(a, b):
            return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

        return [min((far(s[p], c), k) for k, c in enumerate(books[p])) for s in split]

    for _ in range(rounds):
        for p in range(parts):
            chosen = assign(p)
            for k in range(len(books[p])):
                mine = [s[p] for s, (_, e) in zip(split, chosen, strict=True) if e == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    final = [assign(p) for p in range(parts)]
    text = ",".join(str(c) for b in books for e in b for c in e)
    out = [(i, label, "".join(f"{final[p][n][1]:02x}" for p in range(parts)), sum(final[p][n][0] for p in range(parts)))
           for n, (i, _, label) in enumerate(kept)]
    by_label = Counter()
    for _, label, _, error in out:
        by_label[label] += error
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted(((None if i == math.inf else i, c, e, by_label[label], digest) for i, label, c, e in out), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, pos int, error long, member int"


@pytest.mark.parametrize("entries, rounds", [(3, 1), (8, 3), (64, 2)])
def test_vector_codes(spark, entries, rounds):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (6, 32))
    rows = []
    for k in range(150):
        v = centres[k % 6] * (1 if k % 3 else 0.5) + rng.normal(0, 0.2, 32)
        rows.append((k if k % 40 else 7, [float(np.float32(x)) for x in v], None if k % 5 == 0 else k % 3))
    rows += [rows[3], rows[3], (None, rows[4][1], 1)]
    bad = [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] * 32, 2), (903, [float("inf")] + [0.0] * 31, None),
           (904, [], 1), (905, [1.0] * 16, 1), (906, [1.0] * 31, 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows + bad], VECTORS).repartition(3)
    got = vector_codes(df, entries=entries, rounds=rounds)
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert rows_of(got, *names) == expected_codes(rows, 16, entries, rounds)


def test_vector_codes_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes(none).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes(none).count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes(spark.createDataFrame([(1, [1e30] * 16, 1, 1, 1, 1)], VECTORS)).collect()


def test_nearest_takes_the_lower_of_ties():
    entry, error = nearest(np.array([[0, 0], [3, 3]]), np.array([[1, 0], [0, 1], [3, 3]]))
    assert entry.tolist() == [0, 2] and error.tolist() == [1, 0]
