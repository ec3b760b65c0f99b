"""Exact, near and substring dedup against plain Python on awkward rows."""

import glob
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tallyloom.llm import near_dedup, substrings
from tallyloom.llm.components import components
from tallyloom.llm.exact_dedup import drop_copies, exact_groups
from tallyloom.llm.near_dedup import drop_near_copies, near_groups
from tallyloom.llm.substrings import LAST_ID, remove_repeats
from tallyloom.session import scratch_path
from tests.llm.conftest import rows_of

SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def reachable(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_exact_groups(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(SPACE, " ", r.text or "")].append(r.doc_id)
    want = [
        (i, min(x for x in ids if x is not None), len(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items() for i in ids
    ]
    got = exact_groups(docs, fan_bits=1, lanes=3)
    assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    kept = rows_of(got.filter("kept"), "doc_id")
    assert kept == sorted([(min(x for x in ids if x is not None),) for ids in groups.values()], key=repr)


def test_drop_copies_keeps_columns(docs, no_docs):
    left = drop_copies(docs)
    assert left.schema == docs.schema
    assert left.count() == len({re.sub(SPACE, " ", r.text or "") for r in docs.collect()})
    assert drop_copies(no_docs).count() == 0
    assert exact_groups(no_docs).count() == 0


def shingles(text, size):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def near_brute(rows, size, percent):
    sets = [(r.doc_id, shingles(r.text, size)) for r in rows]
    links = [
        (i, j)
        for i, (a, s) in enumerate(sets) for j, (b, t) in enumerate(sets[:i])
        if s and t and a is not None and b is not None and 100 * len(s & t) >= percent * len(s | t)
    ]
    part = reachable(range(len(sets)), links)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[part[k]].append(i)
    out = []
    for k, (i, s) in enumerate(sets):
        component = None if i is None else min(least[part[k]])
        out.append((i, len(s), component, i == component))
    return sorted(out, key=repr)


def test_near_groups(docs, no_docs):
    got = near_groups(docs)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == near_brute(docs.collect(), 4, 80)
    assert near_groups(no_docs).count() == 0
    left = drop_near_copies(docs)
    assert left.schema == docs.schema
    assert {r.doc_id for r in left.collect()} >= {0, 5, 6, 7, None}


@pytest.mark.parametrize("block", [1024, 3])
def test_chains_of_near_copies(spark, monkeypatch, block):
    """Each text drifts from the one before: only neighbours are linked, so
    hubs cannot find all links and the block comparison has to."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "FAN", 2)
    rng = np.random.default_rng(4)
    rows = []
    for chain in range(3):
        text = [f"{chain}w{k}" for k in range(120)]
        for step in range(14):
            rows.append((100 * chain + step, " ".join(text)))
            for k in rng.choice(120, 2, replace=False):
                text[k] = f"{chain}n{step}{k}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_groups(docs)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == near_brute(docs.collect(), 4, 80)


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**64, 4000, np.uint64)
        k = int(4000 * share)
        n = int((4000 + k) / 2)
        a, b = np.sort(both[:n]), np.sort(np.concatenate([both[:k], both[n:]]))
        zero = np.zeros
        ra = near_dedup.registers(a, zero(len(a), np.int64), 1)
        rb = near_dedup.registers(b, zero(len(b), np.int64), 1)
        got, used = near_dedup.estimate(ra, rb, np.array([len(a)]), np.array([len(b)]))
        assert abs(got[0] - share) < 0.15 and used[0] == near_dedup.REGISTERS


def test_components_of_a_long_chain(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 100), (7, 7), (None, 3)]
    got = components(spark.createDataFrame(pairs, "x long, y long"), "x", "y")
    assert rows_of(got, "node", "component") == sorted([(k, 0) for k in range(41)] + [(90, 90), (100, 90)], key=repr)


def brute_removal(rows, size):
    starts = defaultdict(list)
    for r in rows:
        w = words(r.text)
        own = LAST_ID if r.doc_id is None else r.doc_id
        for i in range(len(w) - size + 1):
            starts[tuple(w[i : i + size])].append(own)
    out = []
    for r in rows:
        w = words(r.text)
        own = LAST_ID if r.doc_id is None else r.doc_id
        keep = [True] * len(w)
        for i in range(len(w) - size + 1):
            if min(starts[tuple(w[i : i + size])]) < own:
                keep[i : i + size] = [False] * size
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((r.doc_id, len(w), len(w) - sum(keep), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [13, 2])
def test_remove_repeats(docs, monkeypatch, size):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 1 << 10)
    got = remove_repeats(docs, window=size)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_text") == brute_removal(docs.collect(), size)
    for r in got.collect():
        spans = [(s["first"], s["last"]) for s in r.removed]
        assert sum(b - a + 1 for a, b in spans) == r.n_removed
        assert all(b + 1 < a for (_, b), (a, _) in zip(spans, spans[1:], strict=False)), "maximal intervals"


def test_remove_repeats_of_nothing(no_docs):
    assert remove_repeats(no_docs).count() == 0


def test_pairs_of_a_large_cluster(spark):
    """Candidates of one cluster of near copies stay under five a member."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(2000):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    root = scratch_path(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    before = set(glob.glob(f"{root}/stars-*"))
    got = near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=5)
    assert got.select("component_id").distinct().count() == 1
    pairs = sum(spark.read.parquet(p).count() for p in set(glob.glob(f"{root}/stars-*")) - before)
    assert 2000 <= pairs + 1 < 5 * 2000
