"""Language identification against a plain tree of dictionaries, and its accuracy on held-out texts."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF

from bruit.llm import language_id
from bruit.llm.common import table
from bruit.llm.language_id import LangParams, classify, train


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 3 == 1


def plain_tree(texts, order):
    tree = defaultdict(Counter)
    for t in texts:
        raw = b"\0" * order + t.lower().encode()
        for i in range(order, len(raw)):
            for k in range(order + 1):
                tree[raw[i - k : i]][raw[i]] += 1
    return tree


def plain_length(tree, text, order):
    unit = lambda x: round(-math.log2(x) * 65536)
    raw, bits = b"\0" * order + text.lower().encode(), 0
    for i in range(order, len(raw)):
        for k in range(order, -1, -1):
            seen = tree.get(raw[i - k : i])
            if seen:
                total = sum(seen.values()) + len(seen)
                if raw[i] in seen:
                    bits += unit(seen[raw[i]] / total)
                    break
                bits += unit(len(seen) / total)
        else:
            bits += 8 * 65536
    return bits


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def test_code_lengths_are_those_of_plain_trees(docs):
    p = LangParams(order=3)
    model = train(docs, p)
    rows = docs.collect()
    trees = {x: plain_tree([r.text for r in rows if r.lang == x and not held(r.doc_id)], 3) for x in model.langs}
    assert set(trees) == {r.lang for r in rows}
    texts = ["", "Übergrößen, où?", "zzzz qqq \x00 日本語", *[r.text[:400] for r in rows[:25]]]
    want = [[plain_length(trees[x], t, 3) for x in model.langs] for t in texts]
    assert model.lengths(texts).tolist() == want


def test_slices_make_no_difference(docs):
    model = train(docs)
    texts = [r.text for r in docs.limit(30).collect()]
    want = model.lengths(texts)
    model.p = LangParams(slice_bytes=1000)
    assert (model.lengths(texts) == want).all() and model.predict(texts)[0] == [model.langs[j] for j in want.argmin(axis=1)]


def test_held_out_accuracy(spark):
    big = table(spark, SF.replace("0.001", "0.01"), "documents")
    got = classify(big, train(big)).join(big.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(got) > 250
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98


SCHEMA = "doc_id long, text string, lang string, score double, `n` int"
KNOWN = [(i, t, x, 0.0, 1) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 30)]


def test_nulls_repeats_and_clashing_columns(spark):
    more = [(None, "the dog", "en", 0.0, 1), (1000, None, "en", 0.0, 1), (1001, "", "en", 0.0, 1), (1002, "12 34!", "de", 0.0, 1), (1003, "und die", None, 0.0, 1)]
    df = spark.createDataFrame([*KNOWN, *more, (3, "die Katze", "de", 0.0, 1), (1004, "x" * 3_000_000, "en", 0.0, 1)], SCHEMA)
    rows = classify(df, train(df)).collect()
    assert len(rows) == df.count()
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (None, 1000, 1001, 1002, 1003)] == ["en", "und", "und", "und", "de"]
    assert by[1000].score == 0 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == held(r.doc_id) for r in rows)


def test_equal_costs_go_to_the_smaller_name(spark):
    df = spark.createDataFrame([(i, "same text", x, 0.0, 1) for x in ("b", "a") for i in range(20)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in classify(df, train(df)).collect()} == {("a", 0.5)}


def test_no_rows_and_no_languages(spark):
    df = spark.createDataFrame(KNOWN, SCHEMA)
    assert classify(df.limit(0), train(df.limit(0))).count() == 0
    none = df.withColumn("lang", df.lang.substr(1, 0)).replace("", None, ["lang"])
    assert {r.lang_pred for r in classify(none, train(none)).collect()} == {"und"}


def test_model_is_bounded_and_closed(docs):
    """A small bound keeps frequent nodes, and of whatever it keeps the suffixes."""
    p = LangParams(cells=1 << 12)
    t = language_id.nodes(docs.select("doc_id", "text", "lang"), p)
    room = p.cells // len(t.langs) ** 2
    have = set(zip(t.lang.tolist(), t.length.tolist(), t.gram.tolist(), strict=True))
    for j in range(len(t.langs)):
        assert sum(x == j and n > 1 for x, n, _ in have) <= room
    assert all((x, n - 1, g & ((1 << 8 * (n - 1)) - 1)) in have for x, n, g in have if n > 1)
    texts = [r.text for r in docs.where("lang = 'de' and length(text) > 200").limit(10).collect()]
    assert train(docs, p).predict(texts)[0].count("de") == len(texts)
