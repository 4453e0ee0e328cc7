"""Message, property, vote and seed tables over the driver's tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bruit.functions.text import clean_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _next_id(df: DataFrame, c: str) -> DataFrame:
    """One row: the number after the largest id."""
    return F.broadcast(df.agg((F.max(c) + 1).alias("next_id")))


def tweets(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Messages: id, time, lon, lat, exact, uid, text (whole), vector; with ``only`` (id) those alone, and no other texts are moved.

    Ten messages are about the same: they share a main embedding, each with a quarter of another one, in turn over all
    embeddings.  So vectors differ, and kinds of them grow with the table.
    """
    d, v = (table(spark, sf_dir, t) for t in ("documents", "embeddings"))
    n_vectors = _next_id(table(spark, sf_dir, "embeddings"), "vec_id").withColumnRenamed("next_id", "n_vectors")
    n = _next_id(table(spark, sf_dir, "documents"), "doc_id").crossJoin(n_vectors)
    n = n.select(F.least(F.expr("(next_id + 9) div 10"), "n_vectors").alias("kinds"), "n_vectors")
    other = v.select(F.col("vec_id").alias("other_id"), F.col("embedding").cast("array<double>").alias("other"))
    # Texts are moved once: they meet what is known of their events, not each table in turn.
    e = _events(spark, sf_dir, "ts", "user_id", "event_type").crossJoin(F.broadcast(n))
    e = e.join(v, v.vec_id == e.event_id % F.col("kinds")).join(other, F.expr("other_id = (event_id + event_id div kinds * 31) % n_vectors"))
    if only is not None:
        d = d.join(only.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    joined = d.select("doc_id", "text").join(e, e.event_id == d.doc_id)
    return joined.select(
        F.col("doc_id").alias("id"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("time"),
        (F.lit(-130.0) + F.col("label") * F.lit(6.5) + (F.col("doc_id") * 7919 % 100) / F.lit(50.0)).alias("lon"),
        (F.lit(20.0) + F.col("label") * F.lit(3.5) + (F.col("doc_id") * 104729 % 100) / F.lit(50.0)).alias("lat"),
        (F.col("event_type") != "error").alias("exact"),
        F.col("user_id").alias("uid"),
        "text",
        F.zip_with(F.col("embedding").cast("array<double>"), "other", lambda x, y: x * 4 + y).alias("vector"),
    )


def _events(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """``event_id`` and ``cols`` of the events that are those of a document."""
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"))
    return table(spark, sf_dir, "events").select("event_id", *cols).join(known, "event_id", "left_semi")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of the messages; vectors aren't looked at."""
    d = table(spark, sf_dir, "documents")
    e = _events(spark, sf_dir)
    return d.join(e, e.event_id == d.doc_id).select(d.doc_id.alias("id"), d.text)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their cleaned words in order."""
    return tweets(spark, sf_dir).withColumn("words", clean_words(F.col("text")))


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("tweet_id"),
        (F.col("toxic") == 1).alias("crowdflower"),
        (F.col("quality") == 0).alias("spam"),
        (F.col("doc_id") % 3 != 0).alias("random_forest_train"),
        (F.col("doc_id") % 7 == 0).alias("tagger_train"),
    )


def vote_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log of votes, over all messages in turn: seq, tweet_id, user_ip, property, value (null is a value)."""
    e = table(spark, sf_dir, "events").crossJoin(_next_id(table(spark, sf_dir, "documents"), "doc_id"))
    u = F.col("user_id")
    kinds = {"click": "spam", "error": "disaster", "purchase": "event", "signup": "informative"}
    prop = F.lit("submit")
    for kind, name in kinds.items():
        prop = F.when(F.col("event_type") == kind, name).otherwise(prop)
    ip = F.when(u % 4 == 0, "0.0.0.0").when(u % 4 == 1, "1.1.1.1")
    return e.select(
        F.col("event_id").alias("seq"),
        (F.col("event_id") % F.col("next_id")).alias("tweet_id"),
        ip.otherwise(F.concat(F.lit("10.0.0."), (u % 16).cast("string"))).alias("user_ip"),
        prop.alias("property"),
        F.when(F.col("event_id") % 11 != 0, F.col("value") > 50).alias("value"),
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").where("vec_id < 10")
    return v.select(F.col("vec_id").cast("int").alias("seed_idx"), F.col("embedding").cast("array<double>").alias("vector"))


SQL = r"""
kinds_v AS (SELECT n, least((SELECT max(doc_id) + 10 FROM documents) // 10, n) AS kinds FROM (SELECT max(vec_id) + 1 AS n FROM embeddings)),
tweets_v AS (
  SELECT d.doc_id AS id, CAST(date_trunc('second', e.ts) AS TIMESTAMP) AS time,
         CAST(-130 AS DOUBLE) + v.label * CAST(6.5 AS DOUBLE) + ((d.doc_id * 7919) % 100) / CAST(50 AS DOUBLE) AS lon,
         CAST(20 AS DOUBLE) + v.label * CAST(3.5 AS DOUBLE) + ((d.doc_id * 104729) % 100) / CAST(50 AS DOUBLE) AS lat,
         e.event_type <> 'error' AS exact, e.user_id AS uid, d.text,
         list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])), lambda x: x[1] * 4 + x[2]) AS vector
  FROM documents d JOIN events e ON e.event_id = d.doc_id CROSS JOIN kinds_v k JOIN embeddings v ON v.vec_id = d.doc_id % k.kinds
  JOIN embeddings o ON o.vec_id = (d.doc_id + d.doc_id // k.kinds * 31) % k.n),
words_v AS (
  SELECT *, list_filter(string_split(trim(lower(regexp_replace(regexp_replace(text, '((\B@)|(\bhttps?:\/\/))[^\s]+', ' ', 'g'),
            '[^\w]+', ' ', 'g'))), ' '), lambda w: w <> '') AS words FROM tweets_v),
texts_v AS (SELECT d.doc_id AS id, d.text FROM documents d JOIN events e ON e.event_id = d.doc_id),
props_v AS (
  SELECT doc_id AS tweet_id, toxic = 1 AS crowdflower, quality = 0 AS spam, doc_id % 3 <> 0 AS random_forest_train,
         doc_id % 7 = 0 AS tagger_train FROM labels),
votes_v AS (
  SELECT event_id AS seq, event_id % (SELECT max(doc_id) + 1 FROM documents) AS tweet_id,
         CASE WHEN user_id % 4 = 0 THEN '0.0.0.0' WHEN user_id % 4 = 1 THEN '1.1.1.1'
              ELSE concat('10.0.0.', CAST(user_id % 16 AS VARCHAR)) END AS user_ip,
         CASE event_type WHEN 'click' THEN 'spam' WHEN 'error' THEN 'disaster' WHEN 'purchase' THEN 'event'
              WHEN 'signup' THEN 'informative' ELSE 'submit' END AS property,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE value > 50 END AS value
  FROM events),
state_v AS (
  SELECT tweet_id, user_ip,
         max(value) FILTER (WHERE property = 'spam') AS spam, max(value) FILTER (WHERE property = 'disaster') AS disaster,
         max(value) FILTER (WHERE property = 'event') AS event, max(value) FILTER (WHERE property = 'informative') AS informative,
         max(value) FILTER (WHERE property = 'submit') AS submit, max(value) FILTER (WHERE property = 'fiction') AS fiction,
         max(value) FILTER (WHERE property = 'poetry') AS poetry, max(value) FILTER (WHERE property = 'use') AS use,
         max(value) FILTER (WHERE property = 'personal') AS personal, max(value) FILTER (WHERE property = 'eyewitness') AS eyewitness,
         max(value) FILTER (WHERE property = 'secondhand') AS secondhand, max(value) FILTER (WHERE property = 'breaking') AS breaking
  FROM (SELECT *, row_number() OVER (PARTITION BY tweet_id, user_ip, property ORDER BY seq DESC) AS rn FROM votes_v) WHERE rn = 1
  GROUP BY tweet_id, user_ip),
seeds_v AS (SELECT CAST(vec_id AS INT) AS seed_idx, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE vec_id < 10)
"""


def sql(body: str, more: str = "") -> str:
    """DuckDB SQL with the views (and further ``more`` common tables) in front of ``body``."""
    return f"WITH RECURSIVE {SQL}{', ' + more if more else ''}\n{body}"
