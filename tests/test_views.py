"""Messages carry whole texts, and vectors and votes grow with the tables."""

from conftest import SF

from bruit.plans.registry import QUERIES
from bruit.sources import views


def test_whole_messages(spark):
    docs = {r.doc_id: r.text for r in views.table(spark, SF, "documents").collect()}
    vecs = {r.vec_id: list(r.embedding) for r in views.table(spark, SF, "embeddings").collect()}
    rows = views.tweets(spark, SF).collect()
    assert {r.id: r.text for r in rows} == docs
    kinds = min(-(-len(docs) // 10), len(vecs))
    n = len(vecs)
    mixed = lambda i: [4 * x + y for x, y in zip(vecs[i % kinds], vecs[(i + i // kinds * 31) % n], strict=True)]
    assert all(r.vector == mixed(r.id) for r in rows)
    assert len({tuple(r.vector) for r in rows}) == len(rows)


def test_votes_on_all_messages(spark):
    docs, log = views.table(spark, SF, "documents"), views.vote_log(spark, SF)
    assert log.select("tweet_id").distinct().count() == docs.count()


def test_tokens_behind_the_prefix(spark):
    at = max(views.table(spark, SF, "documents").collect(), key=lambda r: len(r.text))
    tokens = QUERIES["tokenize"](spark, SF).where(f"id = {at.doc_id}").first().tokens
    assert len(tokens) > 280 * 5


def test_documents_and_events_that_come_again(spark, tmp_path):
    """Each document meets each event of its number, whether vectors are asked for or not."""
    for name, key, more in (("documents", "doc_id", "doc_id < 3"), ("events", "event_id", "event_id < 2"), ("embeddings", "vec_id", "false")):
        t = views.table(spark, SF, name)
        t.unionByName(t.where(more)).write.parquet(str(tmp_path / f"{name}.parquet"))
    n = lambda df: {r.id: r["count"] for r in df.where("id < 4").groupBy("id").count().collect()}
    assert n(views.tweets(spark, str(tmp_path))) == n(views.texts(spark, str(tmp_path))) == {0: 4, 1: 4, 2: 2, 3: 1}


def test_texts_are_moved_once_and_vectors_not_at_all(spark):
    """Without broadcasts a text goes through one exchange, and a query of texts reads no embeddings."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows, vectors in ((views.texts(spark, SF), False), (views.tweets(spark, SF), True)):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert ("embeddings" in plan) == vectors
            text = [x for x in plan.splitlines() if "Scan parquet" in x and "text#" in x]
            first = plan.splitlines().index(text[0])
            above = [x for x in plan.splitlines()[:first] if "Join" in x]
            assert len(text) == 1 and sum("SortMergeJoin" in x for x in above) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
