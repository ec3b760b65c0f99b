"""Token counts, BPE, HTML, quality against the libraries themselves."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyloom.llm import bpe, html, quality, token_counts
from tests.llm.conftest import rows_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "b", " the", "  ", " ", "\n", "\t", "\r", "'s", "'re", "'", "r", "é", "ö", "本", "\U0001f600", "　", "\xa0",
    "\x85", "ing", "tion", ".", "!!", "12", "<|endoftext|>", "<|endof", "́", "▁", "</s>", "<0x0A>", "word", "\x00", "ﬁ",
]


def random_texts(seed, n, size):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_pre_tokens_are_independent():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = token_counts.Pieces.load(PIECES)
    for text in random_texts(1, 4000, 16):
        assert sum(map(pieces.count, token_counts.pre_tokens(text))) == len(model.encode(text)), repr(text)


def test_a_model_that_does_not_fall_apart_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as formats

    model = formats.ModelProto()
    with open(PIECES, "rb") as file:
        model.ParseFromString(file.read())
    model.pieces[-1].piece = "a▁b"
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="fall apart"):
        token_counts.Pieces(str(tmp_path / "m"))


@pytest.mark.parametrize("head", [0, 5, 1000])
def test_token_counts(docs, no_docs, head):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for r in docs.collect():
        n = len(model.encode(r.text or ""))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 4096))
    got = token_counts.token_counts(docs, PIECES, head_size=head)
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    if not head:
        assert token_counts.token_counts(no_docs, PIECES).count() == 0


@pytest.mark.parametrize("bits", [(0, 0), (0, 2), (1, 1), (6, 13)])
def test_repaired_joins_agree(bits):
    tokenizer, codec = Tokenizer.from_file(BYTES), bpe.Codec.load(BYTES)
    chunks = bpe.Chunks(codec, {})
    for text in random_texts(sum(bits), 1500, 60):
        ids = []
        for part, token in bpe.segments(text.encode(), codec.special):
            ids += chunks.encode(part, bpe.cuts(np.frombuffer(part, np.uint8), *bits)) if part else []
            ids += [] if token is None else [token]
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == want, repr(text)
        assert codec.decode(ids).decode() == tokenizer.decode(want, skip_special_tokens=False) == text


def test_encode_texts(docs, no_docs):
    tokenizer = Tokenizer.from_file(BYTES)
    got = bpe.encode_texts(docs, BYTES, word_bits=2, any_bits=4)
    want = []
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), ids, tokenizer.decode(ids, skip_special_tokens=False)))
    assert rows_of(got, "doc_id", "n_tokens", "ids", "decoded") == sorted(want, key=repr)
    assert bpe.encode_texts(no_docs, BYTES).count() == 0


def test_shared_chunks_come_from_the_corpus(docs):
    codec = bpe.Codec.load(BYTES)
    texts = docs.selectExpr("xxhash64(doc_id) AS key", "coalesce(text, '') AS text")
    cut = lambda data: bpe.cuts(data, 2, 6)
    assert bpe.special_tokens(BYTES) == codec.special
    shared = bpe.unpacked(bpe.shared_chunks(texts, BYTES, cut, codec.special))
    assert shared and all(ids.tolist() == codec.encode(chunk) for chunk, ids in shared.items())


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="x1">
<header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies, a lot of them</div>
<div class="content-%d"><h2>Title &amp; more</h2><p>First<br>line &nbsp; of %d<p>Second <i>bold</i>er
text that is long enough to count for something<form><input><p>Sign up here with your mail</form>
<ul><li>one<li>two</ul><script>var p = "<p>no</p>";</script><table><tr><td>x<td>y</table>
<div class="comments"><p>A reader comment that is longer than all of the article text, as such comments often are.</p></div></div>
<div id="sidebar">%s</div><footer>&copy; site</footer></body></html>"""
MAIN = "Title & more\n\nFirst line of {}\n\nSecond bolder text that is long enough to count for something\n\none\n\ntwo\n\nx y"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("<", "<"), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<script>x", ""),
        ("<div hidden>q</div>w", "w"), ("a &lt;b&gt; c", "a <b> c"), ("<![CDATA[x]]>y", "xy"), ("<!-- a", ""),
        ("<div style='display: none'>q</div><p class='ad'>x</p><p>y</p>", "y"),
        ("<article><header><h1>T</h1></header><p>one</p><aside>no</aside></article>", "T\n\none"),
        (PAGE % (7, 3, "links " * 80), MAIN.format(3)),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page, []) == text


def test_hosts_agree_on_a_path(spark):
    """A page whose comments-like side text is longer follows its host."""
    side = "<div class='extra'><p>" + "long unrelated side text " * 12 + "</p></div>"
    rows = [(k, f"http://u@Host.example:80/{k}", PAGE % (k, k, "")) for k in range(5)]
    rows += [(5, "https://host.example/5", (PAGE % (5, 5, "")).replace("<div id", side + "<div id"))]
    rows += [(6, None, None), (None, "not a url", "<p>x</p>"), (0, "http://host.example/0", PAGE % (0, 0, ""))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html.extract_pages(pages).collect()}
    assert len(got) == 9
    for k in range(1, 5):
        assert got[k, f"http://u@Host.example:80/{k}"] == (MAIN.format(k), len(MAIN.format(k)))
    assert got[5, "https://host.example/5"][0] == MAIN.format(5)
    assert got[6, None] == ("", 0) and got[None, "not a url"] == ("x", 1)
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_quality(spark, docs, no_docs):
    rng = random.Random(2)
    good = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    rows, labels = [], []
    for k in range(400):
        text = " ".join(rng.choice(good) for _ in range(rng.randint(20, 60)))
        if k % 4 == 0:
            text = text.upper().replace(" ", "!! ") if k % 8 else " ".join([text.split()[0]] * 40)
        rows.append((k, text))
        labels.append((k, int(k % 4 != 0), None))
    labels += [(9999, 1, 0), (None, 0, 0), (5, None, 1)]
    known = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(known, told, per_class=80)
    scores = {r.doc_id: r for r in quality.quality_scores(known, model).collect()}
    assert len(scores) == 400
    held = [k for k in scores if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k, r in scores.items() if r.held_out} == set(held)
    assert np.mean([scores[k].predicted == (k % 4 != 0) for k in held]) > 0.95
    again = quality.fit(known.repartition(5), told, per_class=80)
    assert again.bias == model.bias and (again.gain == model.gain).all()
    flipped = told.withColumn(
        "quality", quality.F.when(quality.held_out("doc_id"), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality"))
    )
    assert (quality.fit(known, flipped, per_class=80).gain == model.gain).all(), "held-out labels teach nothing"
    odd = quality.quality_scores(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in odd)
    kept = quality.drop_poor(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(r.predicted for r in odd)
    assert quality.quality_scores(no_docs, model).count() == 0
    nothing = quality.fit(no_docs, told.limit(0))
    assert {r.score for r in quality.quality_scores(docs, nothing).collect()} == {0.5}


LEAD = "<h1>Title</h1><p>The first paragraph of the text, long enough.</p><p>The second paragraph of it.</p>"
LEAD_TEXT = "Title\n\nThe first paragraph of the text, long enough.\n\nThe second paragraph of it."


@pytest.mark.parametrize(
    "wrapper",
    [
        "body class='single no-sidebar'", "div class='content has-sidebar'", "article class='post comments-open'",
        "main class='search-enabled'", "div class='content sidebar-left'", "div class='wrap menu-layout'",
        "body id='search'", "div class=withSidebar", "article class='related'",
    ],
)
def test_wrappers_with_noise_words_are_kept(wrapper):
    name = wrapper.split()[0]
    page = f"<html><{wrapper}>{LEAD}<div class='share'><p>Share this</p></div></{name}><div class='no-js ad'>x</div></html>"
    assert html.main_text(page, []) == LEAD_TEXT


LONG_BODY = "".join(f"<p>Paragraph {k} of a body that is much longer than its lead.</p>" for k in range(9))
LONG_TEXT = "\n\n".join(f"Paragraph {k} of a body that is much longer than its lead." for k in range(9))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><article><h1>Title</h1><p>lead</p><div class='content'>{LONG_BODY}</div></article>", f"Title\n\nlead\n\n{LONG_TEXT}"),
        (f"<main><h1>Title</h1><article>{LONG_BODY}</article></main><p>beside", f"Title\n\n{LONG_TEXT}"),
        (f"<div class='wrap'><div class='part-a'>{LONG_BODY}</div><div class='part-b'><p>rest</p></div></div>", f"{LONG_TEXT}\n\nrest"),
        (f"<div class='part-a'>{LONG_BODY}</div><div class='part-b'><p>rest</p></div>", f"{LONG_TEXT}\n\nrest"),
        (f"<div class='list'><a href='/'>Home</a></div><div class='part'>{LONG_BODY}</div>", LONG_TEXT),
    ],
)
def test_parts_beside_the_largest_container_are_kept(page, text):
    assert html.main_text(page, []) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>t</title><body><p>text", "text"),
        ("<html><head><meta charset=utf-8><link rel=x><p>one<p>two", "one\n\ntwo"),
        ("<head><title>t</title><script>x</script>bare text", "bare text"),
        ("<head><title>t</title><noscript><p>no</p></noscript></head><p>text", "text"),
        ("<body><p><a name=top>one<p>two<p>three", "one\n\ntwo\n\nthree"),
        ("<body><div><p><a href=/x>one<p>two and more</div><div><p>q <a data-href=x>w</a></div>", "one\n\ntwo and more\n\nq w"),
        ("<body><nav>n</nav><p><a href=/x>only</a></p><p><a href=/y>links</a></p>", "only\n\nlinks"),
    ],
)
def test_markup_that_leaves_out_tags(page, text):
    assert html.main_text(page, []) == text


def test_links_end_with_their_block():
    page = html.Page("<p>a <a href=/x>bc<p>de<p><a name=y>fg<div><a href=/z><p>hi</p></a><p>jk</div>")
    assert [(t, n) for _, t, n in page.blocks] == [("a bc", 2), ("de", 0), ("fg", 0), ("hi", 2), ("jk", 0)]


def test_rare_layouts_of_a_host_have_their_votes(spark):
    """Votes count for every layout of a host, however many there are."""
    side = "<div class='extra'><p>" + "long unrelated side text " * 10 + "</p></div>"
    rows = []
    for k in range(90):
        name = f"content lay{chr(97 + k // 10)}{chr(97 + k % 10)}"
        for copy in range(2 if k >= 80 else 3):
            rows.append((len(rows), "http://host.example/", f"<body><div class='{name}'>{LEAD}</div></body>"))
        if k >= 80:
            rows.append((1000 + k, "http://host.example/", f"<body><div class='{name}'>{LEAD}</div>{side}</body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in html.extract_pages(pages).collect()} == {LEAD_TEXT}


def test_templates_of_a_host_have_votes_of_their_own(spark):
    """A page is not cut to the container of the host's other template."""
    lead = "<div class='content'><p>" + "a short lead " * 16 + "</p></div>"
    rows = [(k, "http://host.example/", f"<body>{lead}</body>") for k in range(6)]
    rows += [(k, "http://host.example/", f"<body>{lead}<div class='longread'>{LONG_BODY}</div></body>") for k in range(6, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = ("a short lead " * 16).strip()
    got = {r.page_id: r.text for r in html.extract_pages(pages).collect()}
    assert got == {k: text if k < 6 else f"{text}\n\n{LONG_TEXT}" for k in range(9)}


def best_text(page):
    page = html.Page(page)
    return page.text(page.best()[1] or "")


def test_words_alone_do_not_drop_text():
    head = "<html><body><main>"
    leaves = '<p class="related-info">Keep this.</p><p class="share-price">This too.</p><p class="advert">Buy now</p>'
    assert best_text(head + leaves + "<p>Rest of it.</p></main></body></html>") == "Keep this.\n\nThis too.\n\nRest of it."
    one = '<div class="social-network-analysis"><p>All of the long article text stands in one block.</p></div><p>foot line</p>'
    assert best_text(f"<body>{one}</body>").startswith("All of the long article text")


@pytest.mark.parametrize("text", ["<a " * 350_000, "<div>" * 5_000 + "text", "<p>a<!-- " * 100_000, '<a href="' * 100_000 + ">x"])
def test_broken_markup_is_read_in_one_pass(text):
    start = time.process_time()
    best_text(text)
    assert time.process_time() - start < 2


def test_many_special_strings_in_one_pass():
    codec = bpe.Codec.load(BYTES)
    text = b"a <|endoftext|>" * 80_000
    start = time.process_time()
    parts = list(bpe.segments(text, codec.special))
    assert time.process_time() - start < 1 and len(parts) == 80_001
    assert b"".join(p + (b"<|endoftext|>" if t is not None else b"") for p, t in parts) == text
