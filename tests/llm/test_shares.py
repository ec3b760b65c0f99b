"""Mixing, sharding, embeddings, the pipeline, and the oracle SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import embedding_dedup
from tallyloom.llm.embedding_dedup import Plan, embedding_groups
from tallyloom.llm.lanes import numbered, placed
from tallyloom.llm.mixing import apportion, mix
from tallyloom.llm.queries import ORACLES, QUERIES
from tallyloom.llm.quality import fit, quality_scores
from tallyloom.llm.sharding import shard_documents, with_shard, with_slot
from tallyloom.session import frozen
from tests import oracle
from tests.llm.conftest import rows_of
from tests.llm.test_dedup import near_brute, words

SMALL = "/root/testdata/sf0.001"


def test_apportion_is_highest_quotients(spark):
    rng = np.random.default_rng(3)
    for seats in (0, 1, 7, 500):
        claims = [float(x) for x in rng.integers(0, 1000, 9)]
        total = sum(claims)
        rows = [(k, c, 200, seats, total) for k, c in enumerate(claims)]
        df = spark.createDataFrame(rows, "who int, claim double, most long, seats long, sum_claim double")
        got = {r.who: r.quota for r in apportion(df, [], ["who"]).collect()}
        order = sorted((-c / (2 * j + 1), j, k) for k, c in enumerate(claims) for j in range(200) if c)
        want = Counter(k for _, _, k in order[:seats])
        assert got == {k: want.get(k, 0) for k in got}


def test_mix(docs, no_docs):
    rows = mix(docs, shard_words=300, block_words=4).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(words(r.doc.text))
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.copies <= 3
        sizes[r.doc.source] += r.size
        taken[r.doc.source] += r.taken
        target[r.doc.source] = r.target
    assert all(r.source_size == sizes[r.doc.source] for r in rows)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    full: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = left / sum(weights[s] for s in order if s not in full)
        more = {s for s in order if s not in full and share * weights[s] > 3 * sizes[s]}
        if not more:
            break
        full |= more
    for s in order:
        want = 3 * sizes[s] if s in full else share * weights[s]
        assert math.isclose(target[s], want) and abs(taken[s] - want) <= 8 + 0.02 * want
    assert mix(no_docs).count() == 0
    assert rows_of(mix(docs), "doc.doc_id", "taken") == rows_of(mix(docs.repartition(7)), "doc.doc_id", "taken")


def test_shards(docs, no_docs):
    rows = shard_documents(docs).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = sorted(((i, len(t.encode()) + 1, zlib.crc32(t.encode()), "key") for i, t in texts), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.law) for r in rows), key=repr) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(no_docs).count() == 0


def test_weighted_shards(spark):
    keys = spark.range(6000).withColumnRenamed("id", "doc_id")
    three = {0: 1.0, 1: 2.0, 2: 3.0}
    rows = with_shard(with_shard(keys, weights=three), weights=three | {3: 1.0}, name="more").collect()
    share = Counter(r.shard for r in rows)
    assert all(abs(share[s] / 6000 - w / 6) < 0.03 for s, w in three.items())
    assert all(r.more in (r.shard, 3) for r in rows)
    for r in rows[:200]:
        times = [
            -math.log((int(hashlib.md5(f"{r.doc_id}:{s}".encode()).hexdigest()[:13], 16) + 1) / 2**52) / w
            for s, w in three.items()
        ]
        assert r.shard == times.index(min(times))
    with pytest.raises(ValueError, match="positive"):
        with_shard(keys, weights={0: 0.0})


def vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 16))
    rows = [base[k] for k in range(40)]
    rows += [base[k] + 0.05 * rng.standard_normal(16) for k in range(20) for _ in range(8)]
    rows += [base[0]] * 30 + [2 * base[1]] * 5
    odd = [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15]
    every = [r.tolist() for r in rows] + odd + [base[2].tolist() + [0.0], [1e300] * 16, [1e-300] * 16]
    ids = list(range(len(every)))
    ids[7], ids[9] = 3, None
    return every, ids, spark.createDataFrame(
        [(i, v, 1) for i, v in zip(ids, every, strict=True)], "vec_id long, embedding array<double>, id int"
    )


def usable(v):
    return bool(v) and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0


@pytest.mark.parametrize("block", [1024, 7])
def test_embedding_groups(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    every, ids, df = vectors(spark)
    unit = [np.array(v) / np.abs(v).max() if usable(v) else None for v in every]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    near = defaultdict(set)
    for i, a in enumerate(unit):
        for j, b in enumerate(unit[:i]):
            if a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9:
                near[i].add(j)
                near[j].add(i)
    part = list(range(len(every)))
    for _ in every:
        part = [min([part[i], *(part[j] for j in near[i])]) for i in range(len(every))]
    least = defaultdict(list)
    for i, p in enumerate(part):
        least[p].append(ids[i])
    smallest = {p: min((x for x in found if x is not None), default=None) for p, found in least.items()}
    want = [(ids[i], len(near[i]), smallest[p], ids[i] == smallest[p]) for i, p in enumerate(part)]
    got = embedding_groups(df)
    assert rows_of(got, "vec_id", "n_links", "component_id", "kept") == sorted(want, key=repr)
    if block > 100:
        assert embedding_groups(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.standard_normal((1500, 64))
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.901 * a + math.sqrt(1 - 0.901**2) * z
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b]))]
    got = embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.agg({"n_links": "sum"}).first()[0] >= 0.95 * 3000
    plan = Plan.of(0.9, 10**9)
    assert plan.width > Plan.of(0.9, 10**4).width and plan.count == Plan.of(0.9, 10).count


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toArrow()
    want = oracle.connect(SMALL).sql(ORACLES[name]).to_arrow_table()
    assert oracle.compare(got, want) is None


def test_pipeline(spark):
    """Each stage by brute force on its own input."""

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(frozen(stage(spark, inputs[-1], SMALL), name.replace(" ", "-")))
    rows = [x.collect() for x in inputs]
    assert all(x.schema == docs.schema for x in inputs[:-1])
    scores = quality_scores(docs, fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet")))
    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in scores.collect() if r.predicted}
    first = {}
    for r in sorted(rows[1]):
        first.setdefault(" ".join(r.text.replace("\n", " ").split(" ")), r.doc_id)
    assert len({r.doc_id for r in rows[2]}) == len(rows[2]) and {r.doc_id for r in rows[2]} <= {r.doc_id for r in rows[1]}
    assert {r.doc_id for r in rows[3]} == {i for i, _, _, kept in near_brute(rows[2], 5, 80) if kept}
    assert {r.doc_id for r in rows[4]} <= {r.doc_id for r in rows[3]}
    copies = {r.doc.doc_id: r.copies for r in mix(inputs[3]).collect()}
    assert Counter(r.doc_id for r in rows[4]) == {i: n for i, n in copies.items() if n}
    tokenizer, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r.doc_id: r.text for r in docs.collect()}
    assert len(rows[5]) == len(rows[4])
    for r in rows[5]:
        assert r.ids == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert QUERIES["pipeline"](spark, SMALL).count() == len(rows[5])


def test_a_third_of_the_rows_share_an_id(spark, docs):
    """Hot, NULL and equal ids, rows without words: numbered in pieces, with the
    results of one sorted lane."""
    rows = [(None if k % 3 else 7, "w " * (k % 5), "x") for k in range(300)]
    rows += [(k, "w " * (k % 7), "x") for k in range(150)] + [(k % 50, "", "y") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slots = defaultdict(list)
    shards = shard_documents(df).collect()
    for r in shards:
        slots[r.shard].append((r.slot, hashlib.md5(str("null" if r.doc_id is None else r.doc_id).encode()).hexdigest()))
    assert len(shards) == len(rows)
    for found in slots.values():
        assert [s for s, _ in sorted(found)] == list(range(len(found)))
        assert [k for _, k in sorted(found)] == sorted(k for _, k in found)
    lane = placed(numbered(shard_documents(df).select("shard", "size"), "t", 3), ["shard"], ["size"], "size", "at").collect()
    for shard in slots:
        at = 0
        for r in sorted((r for r in lane if r.shard == shard), key=lambda r: r.at):
            assert r.at == at
            at += r.size
    mixed = mix(df, shard_words=100, shard_rows=40, block_words=4)
    assert rows_of(mixed, "doc.doc_id", "size", "taken") == rows_of(
        mix(df.repartition(5), shard_words=100, shard_rows=40, block_words=4), "doc.doc_id", "size", "taken"
    )
    for name in ("x", "y"):
        own = [r for r in mixed.collect() if r.doc.source == name]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.03 * own[0].target
        assert all(0 <= r.taken <= 3 * r.size for r in own)


def test_slots_beside_clashing_names(docs):
    """The caller's columns stay as they are."""
    df = docs.withColumnRenamed("id", "_order").withColumnRenamed("kept", "_lane").withColumn("shard", docs.doc_id % 2)
    got = with_slot(df.filter("doc_id IS NOT NULL"), "doc_id")
    assert got.columns == [*df.columns, "slot"]
    assert rows_of(got, *df.columns) == rows_of(df.filter("doc_id IS NOT NULL"), *df.columns)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[1:])
def test_stages_on_awkward_rows(spark, docs, no_docs, name, stage):
    """NULLs, repeated ids and rows, empty texts, clashing columns, no rows."""
    rows, out = docs.collect(), stage(spark, docs, SMALL)
    got = out.collect()
    assert stage(spark, no_docs, SMALL).count() == 0
    if name == "BPE encoding":
        assert sorted(r.doc_id or -1 for r in got) == sorted(r.doc_id or -1 for r in rows)
        assert all((r.n_tokens, r.ids) == (0, []) for r in got if r.doc_id in (3, 4))
        return
    assert out.schema == docs.schema and set(got) <= set(rows)
    if name == "exact dedup":
        texts = [" ".join(re.split(r"[\x20\x09-\x0D]+", r.text or "")) for r in got]
        assert sorted(texts) == sorted({" ".join(re.split(r"[\x20\x09-\x0D]+", r.text or "")) for r in rows})
    if name == "MinHash near-dedup":
        gone = {r.doc_id for r in rows} - {r.doc_id for r in got}
        assert {1, 10} <= gone and not gone & {None, 0, 3, 4, 5, 9}
    if name == "mixing sources":
        assert all(words(r.text) for r in got)


def test_tiny_sources_in_a_large_table(spark):
    """Blocks follow the smallest source and the smallest shard, not the table alone."""
    big = spark.range(650).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'x', 'y') AS source", "repeat('w ', 10000) AS text")
    rows = [(1000, "a", "w " * 5), (1001, "b", "w " * 20), (1002, "b", "w " * 30), (1003, "c", "")]
    tiny = spark.createDataFrame(rows, "doc_id long, source string, text string")
    rows = mix(big.unionByName(tiny)).collect()
    assert sum(r.size for r in rows) // 65536 > 3 * 20, "a block of the table's share would not fit the tiny source"
    for name, times in (("a", 3), ("b", 3), ("c", 0)):
        own = [r for r in rows if r.doc.source == name]
        assert sum(r.taken for r in own) == sum(r.target for r in {r.target: r for r in own}.values())
        assert {(r.taken, r.copies) for r in own} == {(times * r.size, times) for r in own}
    for name in ("x", "y"):
        own = [r for r in rows if r.doc.source == name]
        assert math.isclose(sum(r.taken for r in own), own[0].target, rel_tol=1e-4)


def test_tiny_shards_of_a_source(spark):
    """A shard that holds only a few short texts gives them as often as the rest."""
    one = [(k, "x", "w " * (900_000 if k == 0 else 2)) for k in range(12)]
    other = spark.range(1, 120).selectExpr("100 + id AS doc_id", "'y' AS source", "repeat('w ', 90000) AS text")
    docs = spark.createDataFrame(one, "doc_id long, source string, text string").unionByName(other)
    rows = [r for r in mix(docs, shard_words=150_000).collect() if r.doc.source == "x"]
    assert rows[0].target == 3 * sum(r.size for r in rows) and {r.copies for r in rows} == {3}


def test_mix_oracle_with_tiny_sources(spark, tmp_path):
    """The registered SQL follows the block rule where a source is tiny."""
    rows = [(k, "word " * (300 + k % 50), "big" if k % 2 else "other") for k in range(600)]
    rows += [(900, "a b c", "tiny"), (901, "a " * 40, "small"), (902, None, None), (903, "", "none")]
    schema = "doc_id long, text string, source string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    want = sorted(con.execute(ORACLES["op9_mix_sources"]).fetchdf()[names].itertuples(index=False, name=None))
    assert sorted(map(tuple, QUERIES["op9_mix_sources"](spark, str(tmp_path)).select(*names).collect())) == want
