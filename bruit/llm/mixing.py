"""Mixing sources to target weights by weighted fair queueing (operator 6).

Each source offers its documents in a shuffled order, ``max_repeats`` times.  A
copy's virtual finish time is its source's cumulative tokens, itself included,
divided by the source's weight.  Sorted globally by that time, all sources
advance in proportion to their weights; a source that has offered everything
leaves its share to the others.  The mix is the prefix of that order whose
tokens fit the budget.

The cumulative sums never put a source or the whole order into one task: a
source is dealt into cells by ranges of the shuffle hash, the order into ranges
of the finish time, and only the cells' sums are added up in order.

Defined results: null or empty text has size 0; such a document takes no words;
null is a source of its own, after all others; rows with equal ``doc_id`` and
source order by size; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bruit.llm.common import WORD_RE, beside, materialize, pick, piecewise, quantile_bounds, restored, table


@dataclass(frozen=True)
class MixParams:
    """Budget: ``share`` of all tokens.  Sources by code point, null last, have ``weights`` in turn.
    A cell is a task of about ``cell_rows`` rows.  Up to ``max_broadcast`` rows (id, copies) go to all tasks."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    max_repeats: int = 2
    cell_rows: int = 2_000_000
    max_broadcast: int = 500_000
    seed: str = "mix-1"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_RE)).cast("long")


def _before(cells: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Sum of ``value`` over earlier cells of the same ``keys``; ``cells`` has one row per cell."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))).drop(value)


def targets(rows: DataFrame, p: MixParams) -> DataFrame:
    """One row per source: source, source_size, weight, target.  Computed over the table of sources alone.

    Sources fill in proportion to weight up to ``max_repeats`` times their size.  In ascending order
    of capacity / weight, the level at which the k-th source is full is known from prefix sums.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(order) - 1) % len(p.weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in p.weights]), (turn + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("double"))
    cap = (F.col("source_size") * p.max_repeats).cast("double")
    by = by.withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight"))
    up = Window.partitionBy(F.lit(0)).orderBy("full_at", F.col("source").isNull(), F.col("source").cast("binary"))
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    above = up.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("budget", F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(p.share))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(above)
    by = by.withColumn("level", level)
    # The first level that its own source doesn't reach is the common one; else everything is full.
    common = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "level"))).over(Window.partitionBy(F.lit(0)))["level"]
    target = F.least(F.col("cap"), F.coalesce(common, F.lit(float("inf"))) * F.col("weight"))
    return by.select("source", "source_size", "weight", target.alias("target"))


def schedule(rows: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The mix in order: doc_id, source, size, copy (0, 1, ..), finish, total (tokens up to here), for all copies taken.

    ``rows`` (doc_id, source, size) should be a stored table; it is read a few times.
    """
    t = materialize(targets(rows, p), "targets")
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    budget, cells_wanted = F.floor(F.lit(p.share) * (total or 0)), max(256, n // p.cell_rows)
    u = F.conv(F.substring(F.md5(F.concat(F.lit(p.seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("u", u).withColumn("cell", F.floor(F.col("u") / F.lit(2**60 // cells_wanted)).cast("int"))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("n"))
    cells = _before(cells, ["source"], "cell", "n").withColumnRenamed("source", "s").withColumnRenamed("cell", "c")
    here = Window.partitionBy("source", "cell").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("own", F.sum("size").over(here))
    # One row per source and cell, and one per source: small against the documents, sides that Spark may broadcast.
    own = own.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).drop("s", "c")
    t = t.withColumnRenamed("source", "s")
    own = own.join(t, F.col("source").eqNullSafe(F.col("s")))
    copies = own.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(p.max_repeats - 1))))
    total = F.col("source_size") * F.col("copy") + F.col("before") + F.col("own")
    copies = copies.select("doc_id", "source", "size", "copy", (total / F.col("weight")).alias("finish"))
    copies = materialize(copies, "copies")
    bounds = quantile_bounds(copies, "finish", cells_wanted)
    copies = copies.withColumn("cell", piecewise(F.col("finish"), bounds))
    sums = _before(copies.groupBy("cell").agg(F.sum("size").alias("n")), [], "cell", "n")
    here = Window.partitionBy("cell").orderBy("finish", "doc_id", "copy", "source", "size").rowsBetween(Window.unboundedPreceding, 0)
    # One row for each cell.
    out = copies.withColumn("own", F.sum("size").over(here)).join(F.broadcast(sums), "cell")
    out = out.withColumn("total", F.col("before") + F.col("own")).where(F.col("total") <= budget)
    return out.select("doc_id", "source", "size", "copy", "finish", "total")


def filter_documents(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The documents of the mix in the columns they came with, a row for each copy."""
    mix = schedule(materialize(_sized(docs), "sizes"), p).groupBy("doc_id").agg(F.count("*").alias("n"))
    same = pick(docs, "doc_id").groupBy("doc_id").agg(F.count("*").alias("m"))
    mix = mix.join(same, mix.doc_id.eqNullSafe(same.doc_id)).select(mix.doc_id, F.col("n").cast("int").alias("n"), "m")
    mix = materialize(mix, "taken")
    own = beside(docs, "doc_id").withColumnRenamed("doc_id", "d")
    mix = F.broadcast(mix) if mix.count() <= p.max_broadcast else mix
    out = own.join(mix, F.col("d").eqNullSafe(mix.doc_id))
    if not mix.where("m > 1").isEmpty():
        # Rows that share an id share its copies as evenly as can be.
        cols = [f"c{i}" for i in range(len(docs.columns))]
        rank = F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64(F.to_json(F.struct(*cols)))))
        part = F.floor(F.col("n") / F.col("m")) + (F.col("rank") <= F.col("n") % F.col("m")).cast("int")
        again = out.where("m > 1").withColumn("rank", rank).withColumn("n", part.cast("int")).drop("rank").where("n > 0")
        out = out.where("m = 1").unionByName(again)
    return restored(out.withColumn("k", F.explode(F.sequence(F.lit(1), "n"))), docs)


def _sized(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("size"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = MixParams()
    rows = materialize(_sized(table(spark, sf_dir, "documents")), "sizes")
    taken = schedule(rows, p).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    same = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    k = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "source", "size")]
    each = same.alias("a").join(taken.alias("b"), k[0] & k[1] & k[2], "left")
    # Rows alike in all three share their copies as evenly as can be.
    row = F.explode(F.sequence(F.lit(0), (F.col("a.m") - 1).cast("int"))).alias("row")
    each = each.select("a.doc_id", "a.source", "a.size", "a.m", F.coalesce("b.n", F.lit(0)).alias("n"), row)
    mine = F.floor(F.col("n") / F.col("m")) + (F.col("row") < F.col("n") % F.col("m")).cast("long")
    t = targets(rows, p).withColumnRenamed("source", "s")
    return each.join(t, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (mine * F.col("size")).cast("long").alias("taken")
    )


OP6_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
             1.5 * sum(source_size) OVER () AS budget FROM s),
f AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, 2 * source_size / weight AS full_at FROM w),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY full_at, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY full_at, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, weight, least(cap, coalesce((SELECT arg_min(level, full_at) FROM l WHERE level < full_at), CAST('inf' AS DOUBLE)) * weight) AS target FROM l),
o AS (SELECT d.*, source_size, weight, target,
             sum(size) OVER (PARTITION BY d.source ORDER BY CAST('0x' || left(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 15) AS BIGINT), doc_id, size ROWS UNBOUNDED PRECEDING) AS own
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (source_size * copy + own) / weight AS finish FROM o CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1) k),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, doc_id, copy, source, size ROWS UNBOUNDED PRECEDING) AS total FROM c)
SELECT doc_id, size, source_size, target,
       CAST(coalesce(sum(size) FILTER (WHERE total <= floor(1.5 * (SELECT sum(size) FROM d))), 0) AS BIGINT) AS taken
FROM g GROUP BY doc_id, source, size, source_size, target
"""
