"""Votes, feeds, integrity, streams."""

import pytest

from bruit.operators import feeds, integrity, labels, votes
from bruit.params import Params

LOG = "seq long, tweet_id long, user_ip string, property string, value boolean"


def test_an_explicit_null_overwrites(spark):
    log = spark.createDataFrame([(1, 1, "a", "spam", True), (2, 1, "a", "spam", None), (3, 1, "a", "event", False)], LOG)
    row = votes.state(log).first()
    assert (row.spam, row.event, row.disaster) == (None, False, None)


def test_consensus_needs_more_than_locked(spark):
    rows = [(i, 1, f"u{i}", "spam", True) for i in range(3)]
    assert votes.consensus(spark.createDataFrame(rows, LOG), Params()).count() == 0
    rows.append((9, 1, "u9", "spam", True))
    assert votes.consensus(spark.createDataFrame(rows, LOG), Params()).first().votes == 4


@pytest.mark.parametrize(("text", "n"), [("5", 5), ("500", 100), ("0", 1), ("x", 1), ("7up", 7), ("", 1)])
def test_limit(text, n):
    assert feeds.limit_of(text) == n


def test_unknown_feed(spark):
    with pytest.raises(ValueError, match="unknown source"):
        feeds.feed("other", None, None, "me")


def test_page_takes_the_next_ones(spark):
    t = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id long, text string")
    done = spark.createDataFrame([(3,), (4,)], "id long")
    assert [r.id for r in feeds.page(t, 2, 3, done).collect()] == [5, 6, 7]


def test_integrity(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id int, ref int")
    parent = spark.createDataFrame([(10,)], "id int")
    assert [r.id for r in integrity.orphans(child, "ref", parent, "id").collect()] == [2]
    assert sorted(r.id for r in integrity.cascade_delete(child, "ref", parent, "id").collect()) == [2, 3]
    nulled = {r.id: r.ref for r in integrity.set_null(child, "ref", parent, "id").collect()}
    assert nulled == {1: None, 2: 11, 3: None}


def test_repeated_token_keeps_its_last_line(spark):
    lines = spark.createDataFrame([(1, "a 1 2"), (2, "a 3 4"), (3, "b 5 6")], "at long, value string")
    got = {r.token: r.vector for r in labels.parse_token_vectors(lines).collect()}
    assert got == {"a": [3.0, 4.0], "b": [5.0, 6.0]}
