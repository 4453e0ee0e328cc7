"""Tokens, media, html, classifier, joins and the pipeline against libraries and brute force."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from conftest import SF

from bruit.llm import html_text, huffman, media, ngram_join, quality_classifier, sentencepiece_codec
from bruit.llm.common import table
from bruit.llm.shingles import shingles

WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
ODD = [None, "", " ", "a", "  two  blanks ", "line\n\nline\r\n", "é́ İ Σς ΟΔΟΣ", "<|endoftext|> x<|startoftext|>", "~ a~b", "日本語 текст 😀👍🏽", "a" * 5000, "don't I'll", "▁ ▁▁x", "\x00\x1f x"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(ODD)] + [(None, "no id", "x", 1, "y"), (3, "a", "x", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n long, `key` string").cache()


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in table(spark, SF, "documents").collect()] + ODD


def test_piece_ids_are_the_librarys(texts):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    plain = [t or "" for t in texts if "\x00" not in (t or "")]
    got = sentencepiece_codec.encode_texts(plain, PIECES)
    for t, ids in zip(plain, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t)
        assert sentencepiece_codec.decode_ids(ids, PIECES) == t.replace("▁", " ")


@pytest.mark.parametrize("text", ["a" * 20_000, "=-" * 9000 + " " * 9000, "ab" * 10_000 + "é" * 5000, "-" * 12_345])
def test_search_over_texts_longer_than_its_window(text):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    ids = sentencepiece_codec.encode_texts([text], PIECES)[0]
    assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text)


def test_piece_tables(odd):
    rows = sentencepiece_codec.digest(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.round_trip for r in rows if r.doc_id is None or "▁" not in (ODD[r.doc_id] or ""))
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(odd)).collect()}
    assert back[8] == ODD[8]
    assert sentencepiece_codec.digest(odd.limit(0)).count() == 0


def test_word_ids_are_the_librarys(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(WORDS))
    got, kind = huffman.encode_texts(texts, WORDS)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, kind).tolist() == tok.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 513, 5000])
def test_huffman_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n), 60).astype(np.int64)
    counts = np.bincount(np.concatenate([ids, [3]]))
    lengths = huffman.code_lengths(counts, 8)
    assert lengths.max() <= 8
    used = lengths[lengths > 0].astype(float)
    assert (2.0**-used).sum() <= 1
    bits, offsets = huffman.pack(ids, huffman.canonical_codes(lengths), lengths, 256)
    assert huffman.unpack(bits, offsets, n, 256, huffman.decode_table(lengths)).tolist() == ids.tolist()


def test_length_limited_codes_are_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    assert (huffman.code_lengths(counts, 16) * counts).sum() == 132  # unlimited Huffman cost
    assert huffman.code_lengths(counts, 3).tolist() == [3] * 8


def test_token_files(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(WORDS))
    rows = huffman.op5_huffman_tokens(spark, SF).orderBy("doc_id").collect()
    docs = table(spark, SF, "documents").orderBy("doc_id").collect()
    at = 0
    for r, d in zip(rows, docs, strict=True):
        ids = np.array([*tok.encode(d.text, add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for df in (odd, odd.limit(0)):
        path = huffman.new_path(spark, "t")
        huffman.write_files(df.select("doc_id", "text"), path)
        assert huffman.read_files(spark, path).count() == df.count()


def test_png(spark, odd):
    rows = media.media(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        raw = ("no id" if r.doc_id is None else ODD[r.doc_id] or "").encode()
        assert bytes(r.payload) == raw + b" " * (-len(raw) % 192 if raw else 192)
    q = media.op9_media_png(spark, SF).collect()
    text = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in q:
        raw = text[r.doc_id].encode()
        pay = raw + b" " * (-len(raw) % 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))


def test_png_checksums_and_all_filters():
    image = media.png_write(b"x" * 384)
    with pytest.raises(ValueError, match="checksum"):
        media.png_read(image[:40] + bytes([image[40] ^ 1]) + image[41:])
    rng = np.random.default_rng(1)
    want = rng.integers(0, 256, (5, 6), np.uint8)
    lines = bytearray()
    for y in range(5):
        lines.append(y)
        for x in range(6):
            left = int(want[y, x - 3]) if x >= 3 else 0
            up = int(want[y - 1, x]) if y else 0
            corner = int(want[y - 1, x - 3]) if y and x >= 3 else 0
            base = left + up - corner
            near = min((abs(base - left), 0, left), (abs(base - up), 1, up), (abs(base - corner), 2, corner))[2]
            lines.append((int(want[y, x]) - (0, left, up, (left + up) // 2, near)[y]) % 256)
    head = struct.pack(">IIBBBBB", 2, 5, 8, 2, 0, 0, 0)
    image = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(bytes(lines))) + media._chunk(b"IEND", b"")
    assert (media.png_read(image).reshape(5, 6) == want).all()


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav><div class="ad">Buy this, now.</div>
<article><h1>Head &amp; line</h1><p>First   paragraph,\n with <b>bold<br><p>Second one. It is longer, and has a &lt;mark&gt;.</p>
<aside>Related stuff.</aside><div class="comments"><p>I disagree, says a reader at some length.</p></div></article>
<footer>&copy; nobody</footer></body></html>"""


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (PAGE, "Head & line First paragraph, with bold Second one. It is longer, and has a <mark>."),
        (None, ""),
        ("", ""),
        ("bare text &amp; more", "bare text & more"),
        ("<p>unclosed<p>next <i>one", "unclosed next one"),
        ("<nav>menu only</nav>", ""),
        ("<!-- c --><article><p>a<!-- b -->c</p></article>", "ac"),
        ("<article><p>x < y</p></article>", "x < y"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article><p title="abc>First paragraph.</p><p>Second.</p></article>', "First paragraph. Second."),
        ('<article><div class="side-effects">Nausea.</div><p class="promo-code">X1</p><div class="ad-slot">Buy</div></article>', "Nausea. X1"),
        ('<article><p data-x="a>b" class=y>Text</p><a href=/x/>link</a></article>', "Text link"),
        ("<article><p>End</p><p class", "End"),
        ("<article><ul><li>a<li><b>b</b><ul><li>c</ul><li>d</ul></article>", "a b c d"),
    ],
)
def test_broken_markup(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    "html",
    [
        '<a "' * 200_000, "<div>text " * 50_000, "<b>" * 100_000 + "x" + "</i>" * 100_000, "<p>a" * 100_000 + "</section>" * 100_000,
        "<b><div>" + "<i>" * 150_000 + "</b>" * 150_000, "<i>" * 100_000 + "<tr>" * 100_000, "<table>" + "<i>" * 100_000 + "<tr>x" * 100_000,
        "<svg " + "=" * 500_000 + "/>", "<i>" * 100_000 + "<td>" * 50_000 + "</i>" * 100_000,
        "<a href='x\">" * 60_000, "<li>" * 100_000, "<!--" * 200_000, "<svg><b>" * 30_000, "a < b " * 100_000,
    ],
)
def test_long_broken_pages_take_seconds(html):
    import time

    began = time.process_time()
    html_text.main_text(html)
    assert time.process_time() - began < 20


LONG = "A sentence of the text, long enough to count as one. " * 12


@pytest.mark.parametrize(
    "html",
    [
        f'<article><h1>Title</h1><p>Lead</p><div class="body"><p>{LONG}</p><p>{LONG}</p></div></article>',
        f"<main><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>Short.</p></section><section><p>End</p></section></main>",
        f'<body><div class="wrap"><h1>Title</h1><p>Lead, said shortly.</p><div class="body"><p>{LONG}</p><p>{LONG}</p></div></div></body>',
        f"<body><p>{LONG}</p><h4>Part</h4><ul><li>one</li><li>two</li></ul><blockquote>Ha</blockquote><table><tr><td>5</td></tr></table><p>{LONG}</p></body>",
    ],
)
def test_all_parts_of_the_text(html):

    assert html_text.main_text(html) == " ".join(re.sub("<[^>]*>", " ", html).split())


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article><p>Before.</p><svg class="icon"/><p>After.</p></article>', "Before. After."),
        ('<article><p>Before <svg viewBox="0 0 1 1"><title>t</title><path d="M0"/><g><text>no</text></g></svg> after.</p></article>', "Before after."),
        ("<article><p>One <math/>two <svg/>three</p><svg><style>x</style></svg><p>four</p></article>", "One two three four"),
        ("<article><p>We know <math><mi>x</mi><mo>=</mo><mrow><mn>2</mn></mrow></math> here.</p></article>", "We know x=2 here."),
        ("<article><p>Open <svg><path><p>next</p></article>", "Open next"),
        ("<article><p>A <svg a=b/>no</svg> B</p></article>", "A B"),
        ("<article><svg><foreignObject><div>no<br>no</div></foreignObject></svg><p>yes</p></article>", "yes"),
    ],
)
def test_foreign_elements(html, text):
    assert html_text.main_text(html) == text


PROSE = "The author goes on, at length, about what was seen. Then more of it follows, as it must."


@pytest.mark.parametrize(
    ("part", "stays"),
    [
        ('<div class="user-comments"><p>No, says a reader, at length. I do not agree with any of it.</p></div>', False),
        ('<section id="comment-thread"><p>No, says a reader, at length. I do not agree with any of it.</p></section>', False),
        ('<div class="reader-responses"><p>No, says a reader, at length. I do not agree with any of it.</p></div>', False),
        ('<div class="ad-300x250">Buy this now, it is cheap. Then buy more of it, as you must, and again.</div>', False),
        ('<div class="google-ads">Buy this now</div>', False),
        ('<div class="notice">We use cookies</div>', False),
        ('<p class="tags"><a href="/a">one</a> <a href="/b">two</a></p>', False),
        (f'<div class="notice"><p>{PROSE}</p></div>', True),
        (f'<p class="tags">{PROSE}</p>', True),
        (f'<p class="ad-hoc">{PROSE}</p>', True),
    ],
)
def test_names_inside_articles(part, stays):
    words = " ".join(re.sub("<[^>]*>", " ", part).split())
    page = f"<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>{PROSE}</p><p>{PROSE}</p>{part}</article>"
    assert html_text.main_text(page) == f"Head {PROSE} {PROSE}" + (f" {words}" if stays else "")


def test_comment_of_the_author_stays_between_paragraphs():
    page = f'<article><p>{PROSE}</p><div class="editor-comment">{PROSE}</div><pre>x <span class="comment"># y</span></pre><p>{PROSE}</p></article>'
    assert html_text.main_text(page) == f"{PROSE} {PROSE} x # y {PROSE}"
    only = f'<article><h1>Head</h1><div class="comment-of-the-day">{PROSE}</div></article>'
    assert html_text.main_text(only) == f"Head {PROSE}"


def test_all_pages_against_the_blocks_of_their_article():
    """Every given page has one article: its text is all that stands in it, by a plain cut with patterns."""
    import duckdb
    from html import unescape

    blocks = "p|h1|h2|h3|h4|h5|h6|li|ul|ol|div|br|article|blockquote|pre|table|tr|td"
    got = 0
    for (html,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall():
        body = re.search(r"<article[^>]*>(.*?)</article>", html, re.S)
        if body is None:
            continue
        cut = re.sub(rf"</?(?:{blocks})\b[^>]*>", "\x00", body[1])
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in cut.split("\x00")]
        want = " ".join(x for x in parts if x)
        assert html_text.main_text(html) == want
        assert html_text.main_text(re.sub("(</?)article", r"\1div", html)) == want
        got += 1
    assert got > 100


def test_html_tables(spark):
    schema = "page_id long, url string, html string, text string"
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], schema)
    assert html_text.extract(df).count() == 3
    assert html_text.extract(df.limit(0)).count() == 0


def test_classifier(spark, odd):
    sf = SF.replace("0.001", "0.01")
    rows = quality_classifier.op4_quality_classifier(spark, sf).collect()
    label = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    held = [(label[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in label]
    assert len(held) > 50
    assert sum(a == b for a, b in held) / len(held) > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    model = quality_classifier.train(odd, spark.createDataFrame([(3, 1), (3, 0)], "doc_id long, quality int"))
    out = quality_classifier.classify(odd, model).collect()
    assert len(out) == odd.count()
    assert all(0 <= r.score <= 1 for r in out)
    assert quality_classifier.classify(odd.limit(0), None).count() == 0


def test_risk_and_gradient():
    """Against the risk as defined and its finite differences, on both sides of where the second part vanishes."""
    rng = np.random.default_rng(5)
    soft = lambda f: np.log1p(np.exp(f))
    met = set()
    for prior, shift in ((None, 0), (0.3, 0), (0.9, 3)):
        a, b, w = rng.normal(1 + shift, 1, (40, 6)), rng.normal(0, 1, (90, 6)), np.abs(rng.normal(0, 0.3, 6))
        value, slope, counts = quality_classifier.risk(w, a, b, prior)
        second = soft(b @ w).mean() - (prior or 0) * soft(a @ w).mean()
        assert counts == (second >= 0)
        met.add(counts)
        want = (1 if prior is None else prior) * soft(-(a @ w)).mean() + second if counts else -second
        assert value == pytest.approx(want)
        for k in range(6):
            e = np.eye(6)[k] * 1e-5
            more, less = (quality_classifier.risk(w + s * e, a, b, prior)[0] for s in (1, -1))
            assert (more - less) / 2e-5 == pytest.approx(slope[k], abs=1e-6)
    assert met == {True, False}


def test_weights_are_the_mean_over_blocks_of_all_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (3000, quality_classifier.N_STATS))
    pos = rng.normal(0.5, 1, (200, quality_classifier.N_STATS))
    df = spark.createDataFrame([(k, bytearray(r.tobytes())) for k, r in enumerate(x)], "row long, x binary").repartition(5)
    model = quality_classifier.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((1, x.shape[1])))
    p = quality_classifier.PuParams(block_rows=1000, steps=20)
    block = np.array([r[0] for r in df.sparkSession.sql("SELECT pmod(xxhash64(id), 3L) FROM range(3000) ORDER BY id").collect()])
    want = sum(quality_classifier.descend(model.basis(pos), model.basis(x[block == k]), 0.4, p) * (block == k).sum() for k in range(3)) / 3000
    np.testing.assert_allclose(quality_classifier.mean_weights(model, pos, df, 3000, 0.4, p), want, atol=1e-8)


def test_sums_and_scales_cover_all_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(3, 2, (5000, quality_classifier.N_STATS))
    df = spark.createDataFrame([(bytearray(r.tobytes()),) for r in x], "x binary").repartition(7)
    model, n = quality_classifier.scales(df)
    assert n == 5000
    np.testing.assert_allclose(model.mean, x.mean(axis=0))
    np.testing.assert_allclose(model.scale, x.std(axis=0), rtol=1e-5)
    np.testing.assert_allclose(model.knots, np.quantile(model.scaled(x), [0.05, 0.5, 0.95], axis=0), atol=0.07)


def test_a_repeated_document_is_one_positive(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality_classifier, "fit", lambda pos, rows, p: seen.update(pos=len(pos), rows=rows.count()))
    docs = spark.range(3000).selectExpr("if(id < 2000, 1L, id) as doc_id", "concat('text ', id) as text")
    quality_classifier.train(docs, spark.createDataFrame([(1, 1), (2500, 1)], "doc_id long, quality int"))
    outside = sum(zlib.crc32(str(d).encode()) % 5 != 0 for d in range(2000, 3000))
    one, two = (zlib.crc32(d) % 5 != 0 for d in (b"1", b"2500"))
    assert seen == {"pos": one + two, "rows": outside + 2000 * one} and one


def brute_links(docs, k, num, den):
    s = {d: set(shingles(t, k).tolist()) for d, t in docs}
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            i = len(s[a] & s[b])
            if i and den * i >= num * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s[d]), find(d)) for d in ids}


def family(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.integers(len(w))] = f"e{rng.integers(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("p", [ngram_join.JoinParams(slices=3), ngram_join.JoinParams(words=3, num=90, page=8, node=2)])
def test_jaccard_join(spark, p):
    rng = np.random.default_rng(5)
    texts = []
    for size, members in ((9, 6), (14, 8), (25, 10), (60, 20), (150, 40), (400, 12)):
        base = [f"w{rng.integers(10**6)}" for _ in range(size)]
        texts += [family(rng, base, rng.integers(0, 1 + size // 12)) for _ in range(members)]
    texts += ["", None, " ", "one", "ONE", "one two", "a b c", "A  b\tc"]
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(texts)) * 3, texts, strict=True)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, n string, `key` int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(df, p).collect()}
    want = brute_links(docs, p.words, p.num, p.den)
    assert len({c for _, c in want.values()}) < len(want) - 20
    assert got == want


def test_jaccard_join_of_odd_tables(spark, odd):
    rows = ngram_join.link(odd).collect()
    assert len(rows) == odd.count()
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert ngram_join.link(odd.limit(0)).count() == 0
    assert ngram_join.filter_documents(odd).columns == odd.columns


def test_jaccard_join_of_repeated_ids(spark):
    rng = np.random.default_rng(8)
    base, other = ([f"w{rng.integers(10**6)}" for _ in range(200)] for _ in range(2))
    first, second = " ".join(base), " ".join(other)
    near = " ".join([*other[:-1], "end"])
    # 5 has a copy of 1's text and one of its own, to which 7 is near.
    rows = [(1, first, "a"), (5, first, "a"), (5, second, "a"), (7, near, "a"), (9, "quite another text", "a"), (9, "quite another text", "b")]
    df = spark.createDataFrame([*rows, (None, "x", "a"), (None, "x", "a")], "doc_id long, text string, tag string")
    assert {r.doc_id: r.component_id for r in ngram_join.link(df).collect()} == {1: 1, 5: 1, 7: 1, 9: 9, None: None}
    got = [ngram_join.filter_documents(d).collect() for d in (df, df.repartition(5))]
    assert sorted(r.doc_id or 0 for r in got[0]) == [0, 0, 1, 9]
    assert sorted(map(repr, got[0])) == sorted(map(repr, got[1]))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    base = [f"w{rng.integers(10**6)}" for _ in range(120)]
    line = "a line that many documents share, long enough to be counted here"
    docs = [(i, " ".join(f"w{rng.integers(10**6)}" for _ in range(60)), "en", "s1") for i in range(30)]
    docs += [(100 + i, family(rng, base, 2 if i else 0), "en", "s2") for i in range(6)]
    docs += [(200 + i, line + "\n" + " ".join(f"v{rng.integers(10**6)}" for _ in range(50)), "de", "s1") for i in range(7)]
    docs += [(300, "too short", "en", "s1"), (301, None, None, None), (302, "spam " * 50, "en", "s1")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = stages["quality_rules"](spark, d, str(tmp_path))
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert one.columns == d.columns
    assert ids(one) == [i for i, *_ in docs if i < 300]
    two = stages["line_dedup"](spark, one, str(tmp_path))
    assert ids(two) == ids(one)
    assert sum(line in r.text for r in two.collect()) == 1
    three = stages["ngram_jaccard"](spark, two, str(tmp_path))
    assert ids(three) == [i for i, *_ in docs if i <= 100 or 200 <= i < 300]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(ids(three))
    assert all(r.round_trip for r in out)


def test_memo_starts_anew_with_the_group_at_hand():
    from bruit.llm.words_cache import ChunkCache

    asked = []
    memo = ChunkCache(lambda new: asked.append(sorted(new)) or [c.encode() for c in new], limit=4, max_chars=3)
    assert memo.encode_texts([["a", "b"], ["a", "c"]]) == [b"ab", b"ac"]
    assert memo.encode_texts([["a", "d", "e"], [], ["long!"]]) == [b"ade", b"", b"long!"]
    assert sorted(memo) == ["a", "d", "e"]
    assert asked == [["a", "b", "c"], ["d", "e", "long!"]]
