"""Registered queries of the event engine over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bruit.functions import geo, text, vectors
from bruit.operators import density, events, feeds, integrity, labels, ml, pairs, paragraphs, rates, votes
from bruit.operators.store import scratch, stored, tidied
from bruit.params import Params
from bruit.sources import views
from bruit.streaming import jobs

P = Params()
WIDE = density.wide(P)
#: Rates over a few days of test data: periods of six hours and cells that hold more than one message.
RATES = Params(period_seconds=6 * 3600, cell=2.0)
RETAINED = Params(recall_seconds=86400)
TWO_DAYS = Params(recall_seconds=2 * 86400)
ME = "10.0.0.2"
ALLOWED = ["0.0.0.0", "1.1.1.1", "10.0.0.2", "10.0.0.3", "10.0.0.6"]
MARKS = ("the", "der", "que", "les")
FROM, TO = "2024-01-01 12:00:00", "2024-01-02 12:00:00"

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def joined(c, sep: str = " "):
    return F.array_join(c, sep)


# --- sources and sinks -----------------------------------------------------


@query
def scan_tweets(spark: SparkSession, d: str) -> DataFrame:
    return views.tweets(spark, d).select("id", "time", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "exact", "uid", "text")


@query
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Messages written as JSON lines, twice, read as a stream within the box, each id once."""
    src, out = scratch(spark), scratch(spark)
    lines = views.tweets(spark, d).drop("vector").withColumn("time", F.col("time").cast("timestamp"))
    lines.unionByName(lines).write.json(src)
    rows = jobs.deduplicated(jobs.ingest_json(spark, src, P), "60 days")
    jobs.start(rows, jobs.into_folder(out), scratch(spark)).awaitTermination()
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(out).select("id", "uid", "text")


@query
def load_token_vectors(spark: SparkSession, d: str) -> DataFrame:
    known = labels.synthetic_token_vectors(views.words(spark, d))
    lines = known.select(F.lit(1).alias("at"), F.concat_ws(" ", "token", joined(F.transform("vector", lambda x: x.cast("string")))).alias("value"))
    return labels.parse_token_vectors(lines).select("token", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("vector").alias("n"))


@query
def parse_json_vector(spark: SparkSession, d: str) -> DataFrame:
    t = views.tweets(spark, d).select("id", F.to_json("vector").alias("j"))
    v = t.select("id", vectors.parse_json_vector(F.col("j")).alias("v"))
    return v.select("id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query
def load_seed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Seeds stored wide, a column for each number, packed into one array."""
    s = views.seeds(spark, d)
    wide = s.select("seed_idx", *[F.col("vector")[k].alias(f"v{k}") for k in range(64)])
    v = wide.select("seed_idx", vectors.pack([f"v{k}" for k in range(64)]).alias("v"))
    return v.select("seed_idx", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query
def pending_batch(spark: SparkSession, d: str) -> DataFrame:
    """The pending half of the queue, marked as taken, with the number that was pending."""
    q = views.tweets(spark, d).select("id", (F.col("id") % 2).cast("int").alias("status")).where("status = 0")
    return q.withColumn("status", F.lit(1)).crossJoin(F.broadcast(q.agg(F.count("*").alias("pending"))))


@query
def export_labelled(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a known label through a CSV file."""
    rows = views.tweets(spark, d).join(views.properties(spark, d).where("crowdflower is not null"), F.col("id") == F.col("tweet_id"))
    path = scratch(spark)
    rows.select("id", "text").write.option("ignoreTrailingWhiteSpace", "false").option("ignoreLeadingWhiteSpace", "false").option("quoteAll", "true").option("escape", '"').option("header", "true").csv(path)
    return spark.read.schema("id long, text string").option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


@query
def publish_events(spark: SparkSession, d: str) -> DataFrame:
    base = scratch(spark)
    events.publish(spark, {"events": event_summary(spark, d)}, base)
    return events.current(spark, base)


@query
def score_votes(spark: SparkSession, d: str) -> DataFrame:
    w = views.words(spark, d)
    hit = labels.score_rule(F.col("words"), MARKS)
    return w.where(text.has_words(F.col("text"))).select(F.col("id").alias("tweet_id"), F.lit(votes.MODEL).alias("user_ip"), hit.alias("disaster"))


@query
def tagger_batch(spark: SparkSession, d: str) -> DataFrame:
    queue = views.properties(spark, d).where("tagger_train").select("tweet_id").orderBy("tweet_id").limit(100)
    t = views.tweets(spark, d).select(F.col("id").alias("tweet_id"), "text")
    return queue.join(t, "tweet_id").select("tweet_id", F.lit("tagger").alias("model_id"), "text")


@query
def positives(spark: SparkSession, d: str) -> DataFrame:
    s = score_votes(spark, d).where("disaster").select(F.col("tweet_id").alias("id"))
    return views.tweets(spark, d).join(s, "id", "left_semi").select("id", "text")


# --- filters and projections -----------------------------------------------


@query
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    p = Params(west=-120.0, east=-80.0, south=25.0, north=45.0)
    return geo.bbox(views.tweets(spark, d), p).select("id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query
def time_slice(spark: SparkSession, d: str) -> DataFrame:
    t = views.tweets(spark, d)
    lo, hi = F.lit(FROM).cast("timestamp_ntz"), F.lit(TO).cast("timestamp_ntz")
    return t.where((F.col("time") >= lo) & (F.col("time") < hi)).select("id", "time").orderBy("time", "id")


@query
def nonempty_words(spark: SparkSession, d: str) -> DataFrame:
    return views.words(spark, d).where(text.has_words(F.col("text"))).select("id", F.size("words").alias("n"))


@query
def retention(spark: SparkSession, d: str) -> DataFrame:
    t = views.tweets(spark, d)
    now = F.broadcast(t.agg(F.max("time").alias("now")))  # one row
    age = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("time").cast("timestamp"))
    return t.crossJoin(now).where(age < RETAINED.recall_seconds).select("id", "time")


@query
def training_set(spark: SparkSession, d: str) -> DataFrame:
    return labels.training_set(views.tweets(spark, d), views.properties(spark, d), "random_forest", "crowdflower").select("id", "label")


@query
def geo_project(spark: SparkSession, d: str) -> DataFrame:
    t = views.tweets(spark, d)
    return t.select("id", geo.wkt(F.col("lon"), F.col("lat")).alias("wkt"), F.round("lon", 6).alias("x"), F.round("lat", 6).alias("y"))


@query
def allowed_votes(spark: SparkSession, d: str) -> DataFrame:
    people = F.broadcast(spark.createDataFrame([(x,) for x in ALLOWED], "user_ip string"))  # five rows
    return votes.allowed(views.vote_log(spark, d), people).select("seq", "tweet_id", "user_ip", "property")


@query
def grid_cell(spark: SparkSession, d: str) -> DataFrame:
    return geo.with_cell(views.tweets(spark, d), P).select("id", "x", "y")


@query
def cell_region(spark: SparkSession, d: str) -> DataFrame:
    cells = geo.with_cell(views.tweets(spark, d), P)
    return geo.region(cells, P).groupBy("x", "y").agg(F.count("*").alias("n"), F.min("rx").alias("x0"), F.max("ry").alias("y1"))


@query
def final_rows(spark: SparkSession, d: str) -> DataFrame:
    p = views.properties(spark, d).withColumns({"final": F.col("tagger_train"), "association": ~F.col("spam")})
    return p.where("final and association").select("tweet_id", "crowdflower")


# --- joins -----------------------------------------------------------------


@query
def tweets_with_props(spark: SparkSession, d: str) -> DataFrame:
    t, p = views.tweets(spark, d), views.properties(spark, d)
    return t.join(p, t.id == p.tweet_id, "left").select("id", "crowdflower", "spam", "random_forest_train")


@query
def feed_breaking(spark: SparkSession, d: str) -> DataFrame:
    return feeds.breaking(views.tweets(spark, d), votes.state(views.vote_log(spark, d))).select("id", "text")


@query
def to_tag_queue(spark: SparkSession, d: str) -> DataFrame:
    q = feeds.to_tag(views.tweets(spark, d), votes.state(views.vote_log(spark, d)), ME)
    return feeds.newest(q, 20).select("id", "text")


@query
def to_tag_count(spark: SparkSession, d: str) -> DataFrame:
    return feeds.to_tag(views.tweets(spark, d), votes.state(views.vote_log(spark, d)), ME).agg(F.count("*").alias("n"))


@query
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.candidates(views.words(spark, d), P)


@query
def seed_candidates(spark: SparkSession, d: str) -> DataFrame:
    return pairs.seed_candidates(views.tweets(spark, d), views.seeds(spark, d), P)


@query
def token_vectors(spark: SparkSession, d: str) -> DataFrame:
    w = views.words(spark, d)
    v = labels.token_vectors(w, labels.synthetic_token_vectors(w), 8)
    return v.select("id", "pos", "token", F.round(F.col("vector")[0], 6).alias("v0"), F.round(F.col("vector")[7], 6).alias("v7"))


@query
def token_vectors_random(spark: SparkSession, d: str) -> DataFrame:
    w = views.words(spark, d)
    return labels.token_vectors(w, labels.synthetic_token_vectors(w), 8, "random").select("id", "pos", "token", "vector")


@query
def vote_upsert(spark: SparkSession, d: str) -> DataFrame:
    return votes.state(views.vote_log(spark, d))


@query
def props_upsert(spark: SparkSession, d: str) -> DataFrame:
    changes = views.vote_log(spark, d).where(f"user_ip = '{votes.CROWD}' and property = 'disaster'")
    return votes.upsert_properties(views.properties(spark, d), changes)


@query
def orphans(spark: SparkSession, d: str) -> DataFrame:
    links = views.table(spark, d, "events").select("event_id", F.col("event_id").alias("tweet_id"))
    return integrity.orphans(links, "tweet_id", views.tweets(spark, d), "id").select("event_id")


@query
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = views.tweets(spark, d).where("id % 10 = 0")
    return integrity.cascade_delete(views.vote_log(spark, d), "tweet_id", gone, "id").select("seq", "tweet_id")


@query
def set_null(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").select("event_id", "event_type")
    gone = e.where("event_type = 'error'").select("event_type").distinct()
    return integrity.set_null(e, "event_type", gone, "event_type").select("event_id", "event_type")


@query
def rename_source(spark: SparkSession, d: str) -> DataFrame:
    docs = views.table(spark, d, "documents").select("doc_id", "source")
    names = docs.select("source").distinct().where("source like '%1'").select(F.col("source").alias("old"), F.concat(F.lit("feed-"), "source").alias("new"))
    return integrity.rename(docs, "source", names).select("doc_id", "source")


@query
def vote_descriptions(spark: SparkSession, d: str) -> DataFrame:
    log = views.vote_log(spark, d)
    name = F.col("property")
    meanings = log.select("property").distinct().select("property", F.concat(name, F.lit(": yes")).alias("up"), F.concat(name, F.lit(": no")).alias("down"))
    return votes.describe(log, meanings)


# --- aggregates ------------------------------------------------------------


@query
def high_water(spark: SparkSession, d: str) -> DataFrame:
    t = views.tweets(spark, d).agg(F.max("time").alias("t"))
    return t.select((F.unix_timestamp(F.col("t").cast("timestamp")) - 1).alias("high_water"))


@query
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.properties(spark, d).groupBy("crowdflower").agg(F.count("*").alias("n"))


@query
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return labels.corpus_stats(views.texts(spark, d))


@query
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return labels.length_histogram(views.texts(spark, d))


@query
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return labels.tfidf(views.texts(spark, d)).select("id", "word", F.round("weight", 6).alias("weight"))


@query
def one_per_user(spark: SparkSession, d: str) -> DataFrame:
    return rates.one_per_user(views.tweets(spark, d), RATES).select("period", "uid", "id")


@query
def cell_counts(spark: SparkSession, d: str) -> DataFrame:
    return rates.cell_counts(views.tweets(spark, d), RATES)


@query
def word_cell_counts(spark: SparkSession, d: str) -> DataFrame:
    return rates.word_cell_counts(views.words(spark, d), RATES)


def _rates(spark: SparkSession, d: str) -> DataFrame:
    return stored(rates.word_rates(views.words(spark, d), RATES))


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query
def word_rates(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rates.word_rates(views.words(spark, d), RATES), "local_rate", "global_rate")


@query
def word_history(spark: SparkSession, d: str) -> DataFrame:
    h = rates.word_history(_rates(spark, d), RATES)
    return _rounded(h.select("period", "x", "y", "word", "mean", "sd"), "mean", "sd")


@query
def grid_blur(spark: SparkSession, d: str) -> DataFrame:
    n = rates.cell_counts(views.tweets(spark, d), RATES).groupBy("x", "y").agg(F.sum("n").cast("double").alias("n"))
    return _rounded(rates.grid_blur(n, "n"), "n")


@query
def burst_events(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rates.burst_events(_rates(spark, d), RATES), "local_rate", "global_rate", "mean", "sd", "blurred")


@query
def label_consensus(spark: SparkSession, d: str) -> DataFrame:
    return votes.consensus(views.vote_log(spark, d), P)


@query
def user_points(spark: SparkSession, d: str) -> DataFrame:
    log = views.vote_log(spark, d)
    return votes.points(log, votes.users(log), P)


@query
def whitelist_after_lock(spark: SparkSession, d: str) -> DataFrame:
    return votes.whitelist_after_lock(views.vote_log(spark, d), P)


# --- feeds -----------------------------------------------------------------


@query
def latest_texts(spark: SparkSession, d: str) -> DataFrame:
    return feeds.latest_texts(views.tweets(spark, d), feeds.limit_of("500"))


@query
def feed_all(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(feeds.newest(views.tweets(spark, d)), "lon", "lat")


@query
def feed_events(spark: SparkSession, d: str) -> DataFrame:
    """The three sources together, as one table."""
    t, s = views.tweets(spark, d), votes.state(views.vote_log(spark, d))
    out = None
    for source in feeds.SOURCES:
        rows = feeds.feed(source, t, s, ME).select("source", "id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "count")
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def queue_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of twenty without the messages of which I have submitted a vote."""
    t = views.tweets(spark, d)
    mine = views.vote_log(spark, d).where(f"user_ip = '{ME}'").select(F.col("tweet_id").alias("id")).distinct()
    return feeds.page(t, 20, 20, mine).select("id", "text")


# --- scalar functions ------------------------------------------------------


@query
def clean_words(spark: SparkSession, d: str) -> DataFrame:
    docs = views.table(spark, d, "documents")
    return docs.select("doc_id", joined(text.clean_words(F.col("text"))).alias("words"))


@query
def word_set(spark: SparkSession, d: str) -> DataFrame:
    return views.texts(spark, d).select("id", joined(text.word_set(F.col("text"))).alias("words"))


@query
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return views.tweets(spark, d).select("id", joined(text.tokenize(F.col("text"))).alias("tokens"))


@query
def ascii_fold(spark: SparkSession, d: str) -> DataFrame:
    return views.texts(spark, d).select("id", text.ascii_fold(F.col("text")).alias("folded"))


@query
def epoch_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    t = views.tweets(spark, d).select("id", "time", F.unix_timestamp(F.col("time").cast("timestamp")).alias("epoch"))
    return t.select("id", "epoch", F.timestamp_seconds("epoch").cast("timestamp_ntz").alias("back"))


@query
def cosine_distance(spark: SparkSession, d: str) -> DataFrame:
    t, s = views.tweets(spark, d), views.seeds(spark, d)
    rows = pairs.seed_candidates(t, s, P).join(F.broadcast(s.withColumnRenamed("vector", "sv")), "seed_idx").join(t, "id")  # ten seeds
    return rows.select("id", "seed_idx", F.round(vectors.cosine_distance(F.col("vector"), F.col("sv")), 6).alias("dist"))


@query
def doc_vectors(spark: SparkSession, d: str) -> DataFrame:
    w = views.words(spark, d)
    v = labels.doc_vectors(w, labels.token_vectors(w, labels.synthetic_token_vectors(w), 8), 8)
    return v.select("id", *[F.round(F.col("vector")[k], 6).alias(f"v{k}") for k in range(8)])


# --- density ---------------------------------------------------------------


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages with their different words, without texts, written once."""
    return stored(views.words(spark, d).drop("text").withColumn("words", F.array_distinct("words")), "zstd")


def _graph(spark: SparkSession, d: str, p: Params, edges=density.kept_edges):
    """Messages without words and vectors, which go when the edges are found, edges and core distances."""
    with tidied(spark) as keep:
        whole = _messages(spark, d)
        e = keep(edges(whole, views.seeds(spark, d), p))
        t = keep(stored(whole.drop("words", "vector")))
    c = stored(density.core_distance(t, e, p))
    return t, e, c


def _clusters(spark: SparkSession, d: str, p: Params, edges=density.kept_edges):
    """Messages and clusters; what comes between goes when these are written, the graph stays for those that share it."""
    t, e, c = _graph(spark, d, p, edges)
    with tidied(spark) as keep:
        return t, keep(stored(density.clusters(e, c, density.reachability(t, e, c, p), p)))


@query
def neighbor_edges(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(density.neighbor_edges(_messages(spark, d), views.seeds(spark, d), P), "dist")


@query
def core_distance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_graph(spark, d, P)[2], "core")


@query
def reachability(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(density.reachability(*_graph(spark, d, P), P), "reach")


@query
def reachability_as_written(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(density.reachability(*_graph(spark, d, P), P, as_written=True), "reach")


@query
def non_noise(spark: SparkSession, d: str) -> DataFrame:
    return density.reachability(*_graph(spark, d, P), P).where(F.col("reach") <= P.epsilon).select("id")


@query
def seed_membership(spark: SparkSession, d: str) -> DataFrame:
    _, e, c = _graph(spark, d, P)
    return density.seed_membership(e, c, P)


@query
def seed_membership_wide(spark: SparkSession, d: str) -> DataFrame:
    _, e, c = _graph(spark, d, WIDE, density.telling_edges)
    return density.seed_membership(e, c, WIDE)


@query
def clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d, P)[1]


@query
def clusters_wide(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d, WIDE, density.telling_edges)[1]


@query
def clusters_unseeded(spark: SparkSession, d: str) -> DataFrame:
    return density.clusters_unseeded(_messages(spark, d), P)


@query
def accepted_clusters(spark: SparkSession, d: str) -> DataFrame:
    t, c = _clusters(spark, d, P)
    return events.accepted(c, t, P).select("event_id", "seed_idx", "size", "users")


@query
def event_summary(spark: SparkSession, d: str) -> DataFrame:
    t, c = _clusters(spark, d, P)
    return events.summarise(c, events.accepted(c, t, P), t)


@query
def event_tweets(spark: SparkSession, d: str) -> DataFrame:
    t, c = _clusters(spark, d, P)
    found = stored(events.accepted(c, t, P))
    ids = stored(c.join(found, ["seed_idx", "label"], "left_semi").select("id").distinct())
    return events.members(c, found, views.tweets(spark, d, ids))


@query
def incremental_update(spark: SparkSession, d: str) -> DataFrame:
    """Core distances after a tenth of the messages has gone and another tenth has come."""
    t = _messages(spark, d)
    before = t.where("id % 10 <> 1")
    edges = density.kept_edges(before, None, P)
    core = stored(density.core_distance(before, edges, P))
    _, out = density.incremental_update(t, t.where("id % 10 = 2"), t.where("id % 10 = 1"), edges, core, P)
    return _rounded(out, "core")


# --- models ----------------------------------------------------------------


@query
def pipeline_score(spark: SparkSession, d: str) -> DataFrame:
    t = views.tweets(spark, d)
    training = labels.training_set(t, views.properties(spark, d), "random_forest", "spam")
    model = ml.train_or_load(["tokenizer", "tfidf", "random_forest"], training, scratch(spark))
    return ml.score(model, t)


@query
def rf_train_score(spark: SparkSession, d: str) -> DataFrame:
    with tidied(spark) as keep:  # words go when their vectors are written
        w = stored(views.words(spark, d).select("id", "words"), "zstd")
        v = keep(stored(labels.doc_vectors(w, labels.token_vectors(w, labels.synthetic_token_vectors(w), 8), 8)))
    rows = v.select("id", F.lit("").alias("text"))  # texts aren't looked at
    known = labels.training_set(rows, views.properties(spark, d), "random_forest", "spam").select("id", "label")
    return ml.array_forest_scores(v, known)


@query
def w2v_docs(spark: SparkSession, d: str) -> DataFrame:
    with tidied(spark) as keep:  # tokens go when vectors are written
        return keep(ml.document_vectors(stored(views.tweets(spark, d).select("id", text.tokenize(F.col("text")).alias("tokens")), "zstd")))


@query
def tag_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of the labels' vectors for every message; four fifths of the labelled ones train them."""
    t = stored(views.tweets(spark, d).select("id", text.tokenize(F.col("text")).alias("tokens")), "zstd")
    known = views.properties(spark, d).where("spam is not null and tweet_id % 5 <> 0")
    tagged = t.join(known, F.col("id") == F.col("tweet_id")).select("id", F.when(F.col("spam"), "spam").otherwise("no spam").alias("tag"), "tokens")
    found = paragraphs.train(tagged)
    near = paragraphs.nearest_tags(paragraphs.infer(t, found), found)
    return near.select("id", "tag", F.round("likeness", 6).alias("likeness"))


@query
def lsa_2d(spark: SparkSession, d: str) -> DataFrame:
    return ml.lsa(views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")))


# --- streams ---------------------------------------------------------------


def _message_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, with the rest of each message from stored tables."""
    e = jobs.read_table(spark, d, "events").select("event_id", "ts")
    t = views.tweets(spark, d).select("id", "lon", "lat", "uid").join(views.texts(spark, d), "id")
    return e.join(t, e.event_id == t.id).withColumn("time", F.date_trunc("second", F.col("ts")).cast("timestamp")).drop("event_id", "ts")


@query
def stream_word_counts(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark)
    counts = jobs.word_counts(_message_stream(spark, d), RATES)
    jobs.start(counts, jobs.replacing(out), scratch(spark), mode="complete").awaitTermination()
    return jobs.newest(spark, out, counts.schema).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query
def stream_scored(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark)
    hit = labels.score_rule(text.clean_words(F.col("text")), MARKS)
    rows = jobs.scored(_message_stream(spark, d), views.properties(spark, d), lambda df: df.select("id", "spam", hit.alias("disaster")))
    jobs.start(rows, jobs.into_folder(out), scratch(spark)).awaitTermination()
    return spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(out)


@query
def stream_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last two days, found anew with each micro-batch."""
    target = scratch(spark)
    e = jobs.read_table(spark, d, "events").select("event_id", "ts")
    t = views.words(spark, d).drop("time")
    rows = e.join(t, e.event_id == t.id).withColumn("time", F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")).drop("event_id", "ts")
    jobs.start(rows, jobs.reclustered(scratch(spark), target, views.seeds(spark, d), TWO_DAYS), scratch(spark)).awaitTermination()
    return events.current(spark, target)


def _in_turn(spark: SparkSession, rows: DataFrame, parts: list, start) -> None:
    """Gives the rows of each of the conditions ``parts`` to a stream that goes on where it stopped: one micro-batch each.

    ``start`` begins the stream, from a streaming frame and the folder of its progress.
    """
    src, progress = scratch(spark), scratch(spark)
    for part in parts:
        rows.where(part).write.option("compression", "zstd").mode("append").parquet(src)
        start(spark.readStream.schema(rows.schema).parquet(src), progress).awaitTermination()


def _times(spark: SparkSession, d: str) -> DataFrame:
    """Messages without words and vectors, with the time of their event as a timestamp."""
    t = views.tweets(spark, d).select("id", "time", "lon", "lat", "uid", "text")
    return stored(t.withColumn("time", F.col("time").cast("timestamp")))


@query
def stream_events_kept(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last two days, from clusters that are kept while the older half of the messages and then the newer one come."""
    target, t = scratch(spark), stored(views.words(spark, d).withColumn("words", F.array_distinct("words")), "zstd")
    middle = t.agg(F.expr("percentile_approx(unix_timestamp(cast(time as timestamp)), 0.5)")).first()[0]
    late = F.unix_timestamp(F.col("time").cast("timestamp")) > middle
    each = jobs.maintained(scratch(spark), target, views.seeds(spark, d), TWO_DAYS)
    _in_turn(spark, t, [~late, late], lambda stream, progress: jobs.start(stream, each, progress))
    return events.current(spark, target)


@query
def stream_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Three batches of messages by id, the last two with rows of the one before again: what is accepted, late or a duplicate
    with a delay of a day."""
    base, n = scratch(spark), F.col("id") % 6
    each = jobs.sifted(base, 86400)
    _in_turn(spark, _times(spark, d), [n < 2, (n > 0) & (n < 4), n > 2], lambda stream, progress: jobs.start(stream, each, progress))
    return jobs.told_apart(spark, base)


@query
def stream_word_windows(spark: SparkSession, d: str) -> DataFrame:
    """Words in windows of two days, one beginning each day, each given out once when it is over."""
    out, t = scratch(spark), _times(spark, d)
    newest = t.agg(F.max("time")).first()[0]
    edge = F.col("time") > F.lit(newest) - F.expr("interval 3 days")
    counts = lambda stream: jobs.word_counts(stream, RATES, "2 days", "1 day", "1 hour")
    _in_turn(spark, t, [~edge, edge], lambda stream, progress: jobs.start(counts(stream), jobs.into_folder(out), progress))
    rows = spark.read.schema("start timestamp, x long, y long, word string, n long").option("recursiveFileLookup", "true").parquet(out)
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query
def vote_state(spark: SparkSession, d: str) -> DataFrame:
    """The votes of ``vote_upsert`` from requests in five batches, one of them repeated, with a snapshot on the way."""
    log, kept = views.vote_log(spark, d), votes.VoteState(spark, scratch(spark), compact_after=3)
    size = log.agg(F.max("seq")).first()[0] // 5 + 1
    for k in (0, 1, 2, 1, 3, 3, 4):
        kept.add(log.where(F.floor(F.col("seq") / size) == k), k)
    return kept.state()


@query
def stream_model_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes of a forest that is trained by the stream, anew when it is older than 30 seconds."""
    out, base = scratch(spark), scratch(spark)
    training = labels.training_set(views.tweets(spark, d), views.properties(spark, d), "random_forest", "spam")
    make = lambda path: ml.train_or_load(["tokenizer", "tfidf", "random_forest"], training, path)
    jobs.start(_message_stream(spark, d), jobs.voting(spark, base, out, make, 30.0), scratch(spark)).awaitTermination()
    return jobs.voted(spark, out)
