"""Scalar functions against hand-written answers."""

import math
import time

import pytest
from pyspark.sql import functions as F

from bruit.functions import geo, text, vectors
from bruit.params import Params


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("given", "words"),
    [
        ("é@bob hi x@y.com @al https://t.co/x ahttps://q", "hi x y com ahttps q"),
        ("Héllo Wörld_1 don't", "h llo w rld_1 don t"),
        ("@a https://b", ""),
        ("a\u212aB \u0130x @\u212ay", "a b x"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean_words(spark, given, words):
    assert " ".join(one(spark, text.clean_words, given)) == words


@pytest.mark.parametrize(
    ("given", "tokens"),
    [
        ("#FooBar", "<hashtag> fo <elong> bar <endhashtag>"),
        ("#MapTag", "<hashtag> map tag <endhashtag>"),
        ("#NASA", "<hashtag> nasa <endhashtag>"),
        ("wow!!!", "wow ! <repeat>"),
        ("sooo", "so <elong>"),
        ("100", "10 <elong> <number>"),
        ("@me", "<user>"),
        ("<3", "<heart>"),
        (":)", "<smile>"),
        (":D", "<lolface>"),
        ("3.14", "3 . 14 <number>"),
        ("8/10", "<sadface> 10 <number>"),
        ("http://a.b/c x", "<url> x"),
        ("@bob\u2028 www.x", "<user> <url>"),
        ("x\n#NASA\u00e9 #A\t:) ab-oo \u00c9", "x # nasae <hashtag> a <endhashtag> <smile> ab - o <elong> e"),
        (None, ""),
    ],
)
def test_tokenize(spark, given, tokens):
    assert " ".join(one(spark, text.tokenize, given)) == tokens


@pytest.mark.parametrize("given", ["@a https://b", "", None, "..", "a", "@a b"])
def test_has_words(spark, given):
    assert one(spark, text.has_words, given) == bool(one(spark, text.clean_words, given))


def test_elongations_are_searched_once_for_each_place(spark):
    """A run of 40,000 letters without one; from each letter anew it took the square of its length."""
    long = "ab" * 20_000
    began = time.monotonic()
    assert one(spark, text.tokenize, long) == [long]
    assert time.monotonic() - began < 5


def test_fold_tables_have_one_letter_each():
    assert len(text.FOLD_FROM) == len(text.FOLD_TO)


def test_cosine_of_a_zero_vector_is_unknown(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [None, 0.0]


def test_mean_vector(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],), ([],)], "v array<array<double>>")
    got = [r[0] for r in df.select(vectors.mean_vector(F.col("v"), 2)).collect()]
    assert got == [[2.0, 3.0], [0.0, 0.0]]


def test_region_is_clipped_at_the_grid(spark):
    p = Params()
    df = spark.createDataFrame([(0, 0), (1799, 899), (900, 450)], "x long, y long")
    n = {(r.x, r.y): r["count"] for r in geo.region(df, p).groupBy("x", "y").count().collect()}
    assert n == {(0, 0): 36, (1799, 899): 36, (900, 450): 121}


def test_reach_cells():
    assert Params().reach_cells == 5
    assert Params(radius=0.5).reach_cells == math.ceil(2.5)
