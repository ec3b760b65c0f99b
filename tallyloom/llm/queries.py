"""The queries of this package and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from tallyloom.llm.bpe import encode_texts
from tallyloom.llm.embedding_dedup import embedding_groups
from tallyloom.llm.exact_dedup import exact_groups
from tallyloom.llm.html import extract_pages
from tallyloom.llm.long_matches import remove_long_matches
from tallyloom.llm.mixing import mix
from tallyloom.llm.near_dedup import near_groups
from tallyloom.llm.quality import fit, quality_scores
from tallyloom.llm.sharding import shard_documents
from tallyloom.llm.shipping import ship
from tallyloom.llm.source_audit import source_audit
from tallyloom.llm.substrings import remove_repeats
from tallyloom.llm.token_counts import token_counts
from tallyloom.llm.vector_codes import vector_codes
from tallyloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``(spark, folder) -> DataFrame`` under ``name``."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(configure(spark))
            return build(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op1_exact_dedup",
    r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(COALESCE(text, ''),
               '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, MIN(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
           COUNT(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = MIN(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
    FROM d""",
)
def op1(spark, folder):
    return exact_groups(table(spark, folder, "documents")).drop("row")


@query("op2_quality")
def op2(spark, folder):
    docs = table(spark, folder, "documents")
    return quality_scores(docs, fit(docs, table(spark, folder, "labels")))


@query(
    "op3_near_dedup",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (
        SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS sh
        FROM (SELECT doc_id, ws, UNNEST(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
        GROUP BY ALL),
    link AS (
        SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
        WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
    reach AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.other),
    comp AS (SELECT doc_id, MIN(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT doc_id, COALESCE(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM comp LEFT JOIN n USING (doc_id)""",
)
def op3(spark, folder):
    return near_groups(table(spark, folder, "documents").select("doc_id", "text"))


@query("op4_token_counts")
def op4(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query(
    "op5_embedding_dedup",
    """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    link AS (
        SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
        ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach AS (
        SELECT vec_id, vec_id AS other FROM embeddings
        UNION SELECT reach.vec_id, link.y FROM reach JOIN link ON link.x = reach.other),
    comp AS (SELECT vec_id, MIN(other) AS component_id FROM reach GROUP BY vec_id),
    n AS (SELECT x AS vec_id, COUNT(*) AS n FROM link GROUP BY x)
    SELECT vec_id, COALESCE(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM comp LEFT JOIN n USING (vec_id)""",
)
def op5(spark, folder):
    return embedding_groups(table(spark, folder, "embeddings"))


@query("op6_extract_html")
def op6(spark, folder):
    return extract_pages(table(spark, folder, "pages"))


@query("op7_bpe_encode")
def op7(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True)
    return coded.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


@query(
    "op8_substring_dedup",
    r"""
    WITH w AS (
        SELECT doc_id, UNNEST(ws) AS word, UNNEST(range(len(ws))) AS i, len(ws) AS n
        FROM (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
    win AS (
        SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS seq
        FROM w),
    hit AS (
        SELECT doc_id, i, word, n, i + 12 < n AND doc_id > MIN(doc_id) OVER (PARTITION BY seq, i + 12 < n) AS bad FROM win),
    cov AS (
        SELECT *, BOOL_OR(bad) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
        FROM hit),
    res AS (
        SELECT doc_id, COUNT(*) AS n_words, COUNT(*) FILTER (WHERE gone) AS n_removed,
               COALESCE(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
        FROM cov GROUP BY doc_id)
    SELECT doc_id, COALESCE(n_words, 0) AS n_words, COALESCE(n_removed, 0) AS n_removed,
           sha256(COALESCE(kept, '')) AS kept_sha256
    FROM documents LEFT JOIN res USING (doc_id)""",
)
def op8(spark, folder):
    left = remove_repeats(table(spark, folder, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op9_mix_sources",
    r"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               md5('mix:' || COALESCE(doc_id::VARCHAR, 'null')) AS key
        FROM documents),
    a AS (
        SELECT source, SUM(size)::BIGINT AS source_size, COUNT(*) AS n_rows,
               ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS s FROM d GROUP BY source),
    w AS (
        SELECT *, ((s - 1) % 3 + 1)::DOUBLE AS weight, SUM(source_size) OVER ()::BIGINT AS total,
               3 * source_size AS top, 3 * source_size / ((s - 1) % 3 + 1)::DOUBLE AS fill FROM a),
    p AS (
        SELECT *, (total - COALESCE(SUM(top) OVER b, 0)::DOUBLE)
                  / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER b, 0)) AS share
        FROM w WINDOW b AS (ORDER BY fill, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (
        SELECT *, COALESCE(LEAST(top::DOUBLE, (SELECT share FROM p WHERE share <= fill ORDER BY fill, s LIMIT 1) * weight),
                           top) AS target,
               GREATEST(1, CEIL(source_size / 1048576), CEIL(n_rows / 1048576))::BIGINT AS shards FROM p),
    r AS (
        SELECT d.*, t.s, t.source_size, t.target, ('0x' || substr(key, 1, 8))::BIGINT % t.shards AS shard
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    rings AS (SELECT s, shard, SUM(size)::BIGINT AS ring FROM r GROUP BY s, shard),
    blk AS (
        SELECT GREATEST(1, LEAST(4096, ANY_VALUE(total) // 65536, floor(MIN(NULLIF(target, 0)))::BIGINT // 64,
               floor(MIN(target * least_ring / NULLIF(source_size, 0)))::BIGINT // 16)) AS block
        FROM t LEFT JOIN (SELECT s, MIN(ring) AS least_ring FROM rings WHERE ring > 0 GROUP BY s) USING (s)),
    q AS (
        SELECT s, target / (2 * k + 1) AS quotient, k, total // block AS seats
        FROM (SELECT *, UNNEST(range(3 * source_size // block)) AS k FROM t, blk)),
    won AS (
        SELECT s, COUNT(*) AS quota FROM (
            SELECT s, seats, ROW_NUMBER() OVER (ORDER BY quotient DESC, k, s) AS place FROM q)
        WHERE place <= seats GROUP BY s),
    q2 AS (
        SELECT rings.s, shard, ring / (2 * k + 1) AS quotient, k, quota AS seats
        FROM (SELECT *, UNNEST(range(3 * ring // block)) AS k FROM rings, blk) rings JOIN won ON won.s = rings.s),
    won2 AS (
        SELECT s, shard, COUNT(*) AS quota FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY s ORDER BY quotient DESC, k, shard) AS place FROM q2)
        WHERE place <= seats GROUP BY s, shard),
    laid AS (
        SELECT rings.s, rings.shard, ring, COALESCE(quota, 0) * block // ring AS rounds,
               COALESCE(quota, 0) * block % ring AS rest,
               ('0x' || substr(md5('mix:' || rings.s || ':' || rings.shard), 1, 8))::BIGINT % ring AS bgn
        FROM rings LEFT JOIN won2 ON won2.s = rings.s AND won2.shard = rings.shard, blk WHERE ring > 0),
    z AS (
        SELECT r.*, ring, rounds, rest, bgn,
               (SUM(size) OVER (PARTITION BY r.s, r.shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT
               - size AS pos
        FROM r LEFT JOIN laid ON laid.s = r.s AND laid.shard = r.shard)
    SELECT doc_id, size, source_size, target,
           COALESCE(rounds * size + GREATEST(0, LEAST(pos + size, bgn + rest) - GREATEST(pos, bgn))
                    + GREATEST(0, LEAST(pos + size, bgn + rest - ring) - GREATEST(pos, bgn - ring)), 0)::BIGINT AS taken,
           CASE WHEN size = 0 THEN 0
                ELSE rounds + CASE WHEN (pos - bgn + ring) % ring < rest THEN 1 ELSE 0 END END::BIGINT AS copies
    FROM z""",
)
def op9(spark, folder):
    mixed = mix(table(spark, folder, "documents"), keep=["doc_id"])
    return mixed.select("doc.doc_id", "size", "source_size", "target", "taken", "copies")


_SHARD_OF = """(
    SELECT arg_min(k, (-ln((('0x' || substr(md5(COALESCE(doc_id::VARCHAR, 'null') || ':' || k), 1, 13))::BIGINT + 1)::DOUBLE
                         / 4503599627370496.0), k))
    FROM range({}) u(k))"""


@query(
    "op10_shard",
    f"""
    WITH bits AS (
        SELECT list(list_reduce([n] || range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS crc
        FROM range(256) t(n)),
    d AS (
        SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h, octet_length(encode(COALESCE(text, ''))) AS n FROM documents),
    c AS (
        SELECT doc_id, n + 1 AS size, xor(list_reduce(
                 [4294967295::BIGINT] || list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                 lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
        FROM d, bits),
    s AS (
        SELECT documents.doc_id, {_SHARD_OF.format(16)} AS shard, {_SHARD_OF.format(17)} AS grown FROM documents)
    SELECT c.doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
           ROW_NUMBER() OVER (PARTITION BY shard ORDER BY md5(c.doc_id::VARCHAR), c.doc_id) - 1 AS slot,
           grown::INT AS grown_shard
    FROM c JOIN s ON c.doc_id = s.doc_id""",
)
def op10(spark, folder):
    return shard_documents(table(spark, folder, "documents"))


@query(
    "op11_suffix_dedup",
    r"""
    WITH t AS (
        SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h, octet_length(encode(COALESCE(text, ''))) AS n,
               ROW_NUMBER() OVER () AS r
        FROM documents),
    b AS (SELECT r, doc_id, n, i, substr(h, 2 * i + 1, 2) AS byte, substr(h, 2 * i + 1, 100) AS seq
          FROM (SELECT *, UNNEST(range(n)) AS i FROM t)),
    hit AS (
        SELECT r, doc_id, i, byte, i + 50 <= n AND COALESCE(doc_id > MIN(doc_id) OVER (PARTITION BY seq),
               MIN(doc_id) OVER (PARTITION BY seq) IS NOT NULL) AS bad FROM b),
    cov AS (
        SELECT *, BOOL_OR(bad) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hit),
    edge AS (SELECT *, gone AND NOT COALESCE(LAG(gone) OVER (PARTITION BY r ORDER BY i), FALSE) AS opens FROM cov),
    res AS (
        SELECT r, COUNT(*) FILTER (WHERE gone) AS n_removed, COUNT(*) FILTER (WHERE opens) AS n_spans,
               COALESCE(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
        FROM edge GROUP BY r)
    SELECT t.doc_id, t.n::BIGINT AS n_bytes, COALESCE(n_removed, 0)::BIGINT AS n_removed,
           COALESCE(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(COALESCE(kept, ''))) AS kept_sha256
    FROM t LEFT JOIN res ON res.r = t.r""",
)
def op11(spark, folder):
    left = remove_long_matches(table(spark, folder, "documents"))
    spans = F.size("removed").cast("long").alias("n_spans")
    return left.select("doc_id", "n_bytes", "n_removed", spans, F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op12_source_audit",
    r"""
    WITH d AS (
        SELECT doc_id, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
               regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws,
               ROW_NUMBER() OVER () AS r
        FROM documents),
    t AS (SELECT r, lang, source, term, COUNT(*) AS n FROM (SELECT r, lang, source, UNNEST(ws) AS term FROM d) GROUP BY ALL),
    kept AS (SELECT lang, term, SUM(n)::HUGEINT AS n FROM t GROUP BY lang, term HAVING COUNT(*) >= 30),
    g AS (SELECT DISTINCT lang, source FROM d),
    v AS (SELECT lang, COUNT(term) AS v, COALESCE(SUM(n), 0)::HUGEINT AS total
          FROM (SELECT DISTINCT lang FROM g) LEFT JOIN kept USING (lang) GROUP BY lang),
    c AS (SELECT g.lang, g.source, kept.term, COALESCE(SUM(t.n), 0)::HUGEINT AS n
          FROM g JOIN kept ON kept.lang = g.lang
          LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = kept.term GROUP BY ALL),
    p AS (
        SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * (c.n + 5))
               // (SUM(c.n) OVER (PARTITION BY c.lang, c.source) + 5 * v.v)::HUGEINT AS p,
               1 + (1000000000 * (kept.n + 5)) // (v.total + 5 * v.v) AS q
        FROM c JOIN v ON v.lang = c.lang JOIN kept ON kept.lang = c.lang AND kept.term = c.term),
    f AS (SELECT a.lang, a.source, b.source AS item, SUM(ABS(a.p - b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(f.value, 0)::BIGINT AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, rank::INT AS rank FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
        FROM (FROM pairs UNION ALL FROM terms))
    WHERE part = 'pair' OR rank <= 50""",
)
def op12(spark, folder):
    return source_audit(table(spark, folder, "documents"))


_LLOYD_PARTS = """
    kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS (
        SELECT vec_id, label, pos, list_slice(v, pos * w + 1, pos * w + w) AS part
        FROM (SELECT *, len(v) // 16 AS w, UNNEST(range(16)) AS pos FROM kept))"""


def _lloyd_round(before: str, entries: str, after: str) -> str:
    """Assignment to ``entries`` (pos, entry, part) as table ``before``, means as table ``after``."""
    return f"""
    {before} AS (
        SELECT vec_id, x.pos, ANY_VALUE(x.part) AS part, arg_min(e.entry, (d, e.entry)) AS entry, MIN(d) AS d
        FROM (SELECT x.vec_id, x.pos, x.part, e.entry, e.part AS c, list_sum(list_transform(
                  list_zip(x.part, e.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
              FROM x JOIN {entries} e ON e.pos = x.pos) e JOIN x USING (vec_id, pos) GROUP BY vec_id, x.pos),
    {after} AS (
        SELECT o.pos, o.entry, COALESCE(n.part, o.part) AS part FROM {entries} o LEFT JOIN (
            SELECT pos, entry, list(m ORDER BY i) AS part FROM (
                SELECT pos, entry, i, floor(SUM(c)::DOUBLE / COUNT(*))::BIGINT AS m
                FROM (SELECT pos, entry, UNNEST(part) AS c, UNNEST(range(len(part))) AS i FROM {before})
                GROUP BY pos, entry, i) GROUP BY pos, entry) n
        ON n.pos = o.pos AND n.entry = o.entry)"""


@query(
    "op13_vector_codes",
    f"""
    WITH {_LLOYD_PARTS},
    b0 AS (
        SELECT pos, part, (ROW_NUMBER() OVER (PARTITION BY pos ORDER BY vec_id)) - 1 AS entry
        FROM x WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
    {_lloyd_round("a0", "b0", "b1")},
    {_lloyd_round("a1", "b1", "b2")},
    {_lloyd_round("a2", "b2", "unused")},
    coded AS (
        SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY pos) AS code, SUM(d)::BIGINT AS error
        FROM a2 GROUP BY vec_id),
    books AS (
        SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM b2)
    SELECT vec_id, code, error, (SUM(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM coded JOIN kept USING (vec_id), books""",
)
def op13(spark, folder):
    return vector_codes(table(spark, folder, "embeddings")).drop("label")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
