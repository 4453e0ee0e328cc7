"""Newest-first feeds, the queue of messages to tag, and pages of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bruit.operators.votes import CROWD, MODEL

SOURCES = ("all", "breaking", "crowdflower")


def limit_of(text: str) -> int:
    """A requested number of rows: 1 to 100, and 1 where it isn't a number."""
    digits = text.strip().lstrip("+")
    head = digits[: len(digits) - len(digits.lstrip("0123456789"))]
    return min(100, max(1, int(head))) if head else 1


def latest_texts(tweets: DataFrame, n: int) -> DataFrame:
    return tweets.select("id", "text").orderBy(F.desc("id")).limit(n)


def newest(tweets: DataFrame, n: int = 50) -> DataFrame:
    return tweets.select("id", "lon", "lat", "text").orderBy(F.desc("id")).limit(n)


def breaking(tweets: DataFrame, state: DataFrame, n: int = 20) -> DataFrame:
    hits = state.where((F.col("user_ip") == MODEL) & F.col("disaster")).select(F.col("tweet_id").alias("id"))
    return newest(tweets.join(hits, "id"), n)


def to_tag(tweets: DataFrame, state: DataFrame, me: str) -> DataFrame:
    """Messages on the crowd's list that I haven't submitted."""
    listed = state.where(F.col("user_ip") == CROWD).select(F.col("tweet_id").alias("id"))
    mine = state.where((F.col("user_ip") == me) & F.col("submit")).select(F.col("tweet_id").alias("id"))
    return tweets.join(listed, "id", "left_semi").join(mine, "id", "left_anti")


def feed(source: str, tweets: DataFrame, state: DataFrame, me: str) -> DataFrame:
    """The rows of one source with the number still to tag, which only the crowd's list has."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}")
    if source == "all":
        rows, count = newest(tweets), None
    elif source == "breaking":
        rows, count = breaking(tweets, state), None
    else:
        queue = to_tag(tweets, state, me)
        rows, count = newest(queue, 20), queue.agg(F.count("*").alias("count"))
    rows = rows.withColumn("source", F.lit(source))
    return rows.withColumn("count", F.lit(0).cast("long")) if count is None else rows.crossJoin(F.broadcast(count))  # one row


def page(tweets: DataFrame, after: int, n: int, done: DataFrame | None = None) -> DataFrame:
    """``n`` messages after an id in id order; those ``done`` (id) are left out and the next ones take their place."""
    rows = tweets.where(F.col("id") > after)
    if done is not None:
        rows = rows.join(done, "id", "left_anti")
    return rows.orderBy("id").limit(n)
