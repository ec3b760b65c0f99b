"""BPE encoding and decoding with content-defined chunk reuse."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import BASE, BASE_INVERSE, BYTE, mix, powers, slices, text_bytes

# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes the rolling hash looks back on.
LOOK_BACK = 16
#: A place before a word's space is a cut once in 2 ** WORD_BITS, any other
#: character start once in 2 ** ANY_BITS.
WORD_BITS, ANY_BITS = 6, 13
#: Chunks of the corpus-wide dictionary and the bytes one may have: together
#: the bound of what is broadcast.
SHARED_CHUNKS, SHARED_BYTES = 16_384, 2_048
#: Chunks one task keeps encoded.
KEPT_CHUNKS = 20_000


def _byte_of_char() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one tokenizer file (byte-level BPE, JSON)."""

    _loaded: dict[str, Codec] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        own = _byte_of_char()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        words = {w: i for w, i in spec["model"]["vocab"].items() if w not in added}
        ranks = {bytes(own[c] for c in w): i for w, i in words.items()}
        self.special = {s.encode(): i for s, i in added.items()}
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s for s, i in self.special.items()}
        self.text_of = {i: b"%d" % i for i in self.bytes_of}
        self._encode = tiktoken.Encoding(
            "chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    @classmethod
    def load(cls, path: str) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, text: bytes) -> list[int]:
        return self._encode(text.decode())

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def cuts(data: np.ndarray, word_bits: int = WORD_BITS, any_bits: int = ANY_BITS) -> np.ndarray:
    """Content-defined cut positions of ``data``, without its two ends.

    A place is cut where the hash of the ``LOOK_BACK`` bytes before it ends in
    zeros, so equal passages are cut alike wherever they stand.
    """
    size = len(data)
    if size <= LOOK_BACK:
        return np.zeros(0, np.int64)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, size), out=sums[1:])
    at = np.arange(LOOK_BACK, size)
    value = mix((sums[at] - sums[at - LOOK_BACK]) * powers(BASE_INVERSE, size)[at - LOOK_BACK])
    here, before = data[at], data[at - 1]
    word = safe(here, before) & (value & np.uint64((1 << word_bits) - 1) == 0)
    other = ((here & 0xC0) != 0x80) & (value & np.uint64((1 << any_bits) - 1) == 0)
    return at[word | other]


def safe(here: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether no pre-token can span the place between two bytes: a space
    follows a byte that is certainly no white space (ASCII, not a space or a
    control). No alternative of the pattern has a space behind such a
    character, and none looks ahead past it."""
    return (here == 32) & (before > 32) & (before < 127)


class Chunks:
    """Encoded chunks: the shared dictionary and what this task has met."""

    def __init__(self, codec: Codec, shared: dict[bytes, list[int]]):
        self.codec, self.shared, self.kept = codec, shared, {}

    def ids(self, chunk: bytes) -> list[int]:
        found = self.shared.get(chunk) or self.kept.get(chunk)
        if found is None:
            found = array("i", self.codec.encode(chunk))
            if len(self.kept) >= KEPT_CHUNKS:
                self.kept.clear()
            if len(chunk) <= SHARED_BYTES:
                self.kept[chunk] = found
        return found

    def _whole(self, text: bytes, begin: int, end: int) -> bool:
        """Whether the places around ``text[begin:end]`` are safe."""
        return all(
            p in (0, len(text)) or (text[p] == 32 and 32 < text[p - 1] < 127) for p in (begin, end)
        )

    def encode(self, text: bytes, places: np.ndarray) -> list[int]:
        """Ids of ``text``, cut at ``places``.

        A join at a safe place is right as it is. At any other, the text from
        the last safe place before it to the first one behind it is encoded
        again and takes the place of the tokens there; both ends are token
        ends of the neighbouring chunks too, which is checked.
        """
        ends = [0, *places.tolist(), len(text)]
        out: list[int] = []
        at = 0  # text[:at] is encoded for good
        for k in range(1, len(ends)):
            if ends[k] <= at:
                continue  # inside a repaired join
            begin, end = max(at, ends[k - 1]), ends[k]
            stop = end if self._whole(text, end, end) else self._safe_before(text, begin, end)
            if stop > begin:
                ids = self.ids(text[ends[k - 1] : end]) if begin == ends[k - 1] else self.codec.encode(text[begin:end])
                out += ids if stop == end else self._head(ids, stop - begin)
            at = max(stop, begin)
            if at < end:
                upto = self._safe_after(text, end)
                out += self.codec.encode(text[at:upto])
                at = upto
        return out

    def _safe_before(self, text: bytes, begin: int, end: int) -> int:
        at = text.rfind(b" ", begin + 1, end)
        while at > begin and not 32 < text[at - 1] < 127:
            at = text.rfind(b" ", begin + 1, at)
        return max(at, begin)

    def _safe_after(self, text: bytes, begin: int) -> int:
        at = text.find(b" ", begin + 1)
        while at >= 0 and not 32 < text[at - 1] < 127:
            at = text.find(b" ", at + 1)
        return at if at >= 0 else len(text)

    def _head(self, ids: list[int], size: int) -> list[int]:
        """The tokens of the first ``size`` bytes."""
        left, n = size, 0
        while left > 0:
            left -= len(self.codec.bytes_of[ids[n]])
            n += 1
        assert left == 0, "a token crosses a safe place"
        return ids[:n]


def segments(text: bytes, special: dict[bytes, int]) -> Iterator[tuple[bytes, int | None]]:
    """Stretches of ordinary text, each with the special token behind it: the
    first special string, of several at one place the longest."""
    if not special:
        yield text, None
        return
    at = 0
    wanted = b"|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))
    for hit in re.finditer(wanted, text):
        yield text[at : hit.start()], special[hit.group()]
        at = hit.end()
    yield text[at:], None


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = text_bytes(batch.column("text"))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield data[a:b].tobytes()


def chunks_of(text: bytes, cut: Callable) -> Iterator[bytes]:
    places = [0, *cut(np.frombuffer(text, np.uint8)).tolist(), len(text)]
    return (text[a:b] for a, b in zip(places[:-1], places[1:], strict=True) if b > a)


def _name(chunk: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(chunk, digest_size=8).digest(), "big", signed=True)


def _named_chunks(text: bytes, cut: Callable, special: dict) -> dict[int, bytes]:
    """The distinct chunks of a text that may be shared, by name."""
    return {
        _name(chunk): chunk
        for part, _ in segments(text, special)
        for chunk in chunks_of(part, cut)
        if len(chunk) <= SHARED_BYTES
    }


def _census(batches: Iterator[pa.RecordBatch], cut: Callable, special: dict) -> Iterator[pa.RecordBatch]:
    """Names, sizes and document counts of chunks, combined per batch, and the
    smallest key of a document that holds them."""
    for batch in batches:
        seen: dict[int, list[int]] = {}
        for text, key in zip(_texts(batch), batch.column("key").to_pylist(), strict=True):
            for name, chunk in _named_chunks(text, cut, special).items():
                entry = seen.setdefault(name, [len(chunk), 0, key])
                entry[1] += 1
                entry[2] = min(entry[2], key)
        columns = zip(*seen.values(), strict=True) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (seen.keys(), *columns)], names=["name", "size", "n", "key"]
        )


def _fetch(batches: Iterator[pa.RecordBatch], cut: Callable, special: dict, owners) -> Iterator[pa.RecordBatch]:
    """The wanted chunks, each from the documents that own it."""
    wanted: dict[int, set[int]] = {}
    for name, key in owners.value:
        wanted.setdefault(key, set()).add(name)
    for batch in batches:
        found: dict[int, bytes] = {}
        for text, key in zip(_texts(batch), batch.column("key").to_pylist(), strict=True):
            if names := wanted.get(key):
                chunks = _named_chunks(text, cut, special)
                found |= {n: chunks[n] for n in names & chunks.keys()}
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], names=["name", "chunk"]
        )


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Chunks and their ids, packed and compressed into one value for each batch."""
    codec = Codec.load(path)
    for batch in batches:
        chunks = batch.column("chunk").to_pylist()
        ids = [codec.encode(c) for c in chunks]
        sizes = np.array([[len(c), len(i)] for c, i in zip(chunks, ids, strict=True)], np.int32)
        packed = [np.int32(len(chunks)).tobytes(), sizes.tobytes(), b"".join(chunks)]
        packed += [np.array(i, np.int32).tobytes() for i in ids]
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(b"".join(packed))], pa.binary())], names=["packed"])


def unpacked(parts: list[bytes]) -> dict[bytes, array]:
    """The dictionary that the parts of :func:`_encoded` hold."""
    out: dict[bytes, array] = {}
    for part in map(zlib.decompress, parts):
        count = int(np.frombuffer(part, np.int32, 1)[0])
        sizes = np.frombuffer(part, np.int32, 2 * count, 4).reshape(-1, 2).tolist()
        at = 4 + 8 * count
        behind = at + sum(s for s, _ in sizes)
        for size, ids in sizes:
            out[part[at : at + size]] = array("i", part[behind : behind + 4 * ids])
            at, behind = at + size, behind + 4 * ids
    return out


def shared_chunks(texts: DataFrame, path: str, cut: Callable, special: dict) -> list[bytes]:
    """The chunks that save most when encoded once, packed with their ids: at
    most SHARED_CHUNKS of at most SHARED_BYTES bytes, by bytes times further
    documents. What reaches the driver are these bytes, as they are."""
    spark = texts.sparkSession
    census = texts.mapInArrow(
        partial(_census, cut=cut, special=special), "name long, size long, n long, key long"
    )
    saved = (F.col("n") - 1) * F.col("size")
    top = (
        census.groupBy("name").agg(F.min("size").alias("size"), F.sum("n").alias("n"), F.min("key").alias("key"))
        .filter("n > 1").orderBy(saved.desc(), "name").limit(SHARED_CHUNKS)
    )
    owners = spark.sparkContext.broadcast([(r.name, r.key) for r in top.select("name", "key").collect()])
    if not owners.value:
        return []
    found = texts.mapInArrow(
        partial(_fetch, cut=cut, special=special, owners=owners), "name long, chunk binary"
    ).dropDuplicates(["name"])
    parts = [bytes(r.packed) for r in found.mapInArrow(partial(_encoded, path=path), "packed binary").collect()]
    owners.destroy()
    return parts


def special_tokens(path: str) -> dict[bytes, int]:
    """The special strings of a tokenizer file, without building an encoder."""
    with open(path, encoding="utf-8") as file:
        return {t["content"].encode(): t["id"] for t in json.load(file)["added_tokens"]}


def _coded(
    batches: Iterator[pa.RecordBatch], path: str, cut: Callable, shared, names: list[str], digests: bool
) -> Iterator[pa.RecordBatch]:
    codec = Codec.load(path)
    chunks = Chunks(codec, unpacked(shared.value))
    text_of = codec.text_of
    for whole in batches:
        _, offsets = text_bytes(whole.column("text"))
        for a, b in slices(offsets):  # what is returned at once stays small
            batch = whole.slice(a, b - a)
            n, ids_out, decoded_out = [], [], []
            for text in _texts(batch):
                ids: list[int] = []
                for part, token in segments(text, codec.special):
                    if part:
                        ids += chunks.encode(part, cut(np.frombuffer(part, np.uint8)))
                    if token is not None:
                        ids.append(token)
                n.append(len(ids))
                decoded = codec.decode(ids).decode("utf-8", "replace").encode()
                if digests:
                    ids_out.append(hashlib.sha256(b",".join([text_of[i] for i in ids])).hexdigest())
                    decoded_out.append(hashlib.sha256(decoded).hexdigest())
                else:
                    ids_out.append(np.array(ids, np.int32))
                    decoded_out.append(decoded.decode())
            kind = pa.string() if digests else pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names], pa.array(n, pa.int64()),
                    pa.array(ids_out, kind), pa.array(decoded_out, pa.string()),
                ],
                names=[*names, "n_tokens", "ids", "decoded"],
            )


def encode_texts(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False,
    word_bits: int = WORD_BITS, any_bits: int = ANY_BITS,
) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids`` and ``decoded`` text, as the tokenizer
    file at ``path`` gives them without added special tokens. With ``digests``
    both are SHA-256 digests (of the ids joined by commas, of UTF-8).

    Special strings inside a text are special tokens. NULL and empty texts
    have no tokens; rows that repeat an id are encoded one by one; an empty
    table gives no rows; other columns are ignored. The file must be at the
    same path on every worker.

    Texts are cut where a rolling hash of their content says so. Chunks are
    counted over all documents; the ones whose reuse saves most are encoded
    once for the corpus and broadcast, within a fixed bound, all others once
    per task that meets them. Joins that a pre-token may span are encoded
    again until both sides agree.
    """
    texts = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = partial(cuts, word_bits=word_bits, any_bits=any_bits)
    special = special_tokens(path)
    known = shared_chunks(texts.select(F.xxhash64(id_col).alias("key"), "text"), path, cut, special)
    shared = df.sparkSession.sparkContext.broadcast(known)
    kind = df.schema[id_col].dataType.simpleString()
    out = "ids string, decoded string" if digests else "ids array<int>, decoded string"
    return texts.mapInArrow(
        partial(_coded, path=path, cut=cut, shared=shared, names=[id_col], digests=digests),
        f"`{id_col}` {kind}, n_tokens long, {out}",
    )
