"""Events: accepted clusters, their summaries and messages, and published snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bruit.operators.store import Versions
from bruit.params import Params


def accepted(clusters: DataFrame, tweets: DataFrame, p: Params) -> DataFrame:
    """(event_id, seed_idx, label, size, users) of clusters that are large enough and of several users."""
    by = clusters.join(tweets.select("id", "uid"), "id").groupBy("seed_idx", "label")
    by = by.agg(F.count("*").alias("size"), F.countDistinct("uid").alias("users"))
    by = by.where((F.col("size") >= p.min_size) & (F.col("users") >= p.min_users))
    # Numbers go on from seed to seed: the sums of earlier seeds' events come from a row for each seed, of which
    # there are at most ``max_seeds``.
    seeds = by.groupBy("seed_idx").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("seed_idx").rowsBetween(Window.unboundedPreceding, -1))
    seeds = seeds.select("seed_idx", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("seed_idx").orderBy("label"))
    return by.withColumn("own", own).join(seeds, "seed_idx").withColumn("event_id", F.col("before") + F.col("own") - 1).drop("own", "before")


def summarise(clusters: DataFrame, events: DataFrame, tweets: DataFrame) -> DataFrame:
    """(event_id, lon, lat, start_time, end_time, users)."""
    rows = clusters.join(events.select("event_id", "seed_idx", "label"), ["seed_idx", "label"])
    return rows.join(tweets, "id").groupBy("event_id").agg(
        F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"), F.min("time").alias("start_time"),
        F.max("time").alias("end_time"), F.countDistinct("uid").alias("users"))


def members(clusters: DataFrame, events: DataFrame, tweets: DataFrame) -> DataFrame:
    """(event_id, tweet_id, time, lat, lon, exact, text) with the place of the event."""
    place = summarise(clusters, events, tweets).select("event_id", F.col("lon").alias("elon"), F.col("lat").alias("elat"))
    rows = clusters.join(events.select("event_id", "seed_idx", "label"), ["seed_idx", "label"]).join(place, "event_id")
    return rows.join(tweets, "id").select(
        "event_id", F.col("id").alias("tweet_id"), "time", F.col("elat").alias("lat"), F.col("elon").alias("lon"), "exact", "text")


def publish(spark: SparkSession, tables: dict[str, DataFrame], base: str, number: int | None = None, keep: int = 2) -> bool:
    """Publish tables (``events``, and others like ``members``) together as version ``number``, by default the next one.

    Without events the version before stays.  Returns whether there is a new version.
    """
    versions = Versions(spark, base, keep)
    if tables["events"].isEmpty():
        return False
    if number is None:
        number = -1 if versions.newest() is None else versions.newest()
        number += 1
    return versions.write(number, tables)


def current(spark: SparkSession, base: str, *names: str) -> DataFrame | tuple[DataFrame, ...]:
    """The published events, or the tables with these names, all of one version."""
    versions = Versions(spark, base)
    n = versions.newest()
    found = tuple(versions.read(name, n) for name in names or ("events",))
    return found if len(found) > 1 else found[0]
