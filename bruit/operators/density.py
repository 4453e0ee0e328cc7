"""Density clustering of messages by order-free forms of reachability and seeded expansion.

Nodes are message ids; a seed with index s is node -(s + 1).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bruit.functions.vectors import cosine_distance
from bruit.operators import near
from bruit.operators.graph import components
from bruit.operators.pairs import around, checked_seeds, tiled
from bruit.operators.store import stored, tidied
from bruit.params import Params


def seed_node(c: Column) -> Column:
    return (-c - 1).cast("long")


def near_pairs(tweets: DataFrame, p: Params, new: DataFrame | None = None) -> DataFrame:
    """(a, b, dist), a < b, of the candidates within epsilon; with ``new`` (rows of ``tweets``) those with an end in it."""
    rows = tiled(tweets, p, "vector")
    with tidied(tweets.sparkSession) as keep:  # blocks of vectors go when the pairs are written
        if new is None:
            return keep(near.near_pairs(rows, p))
        come = stored(rows.join(new.select("id"), "id", "left_semi"))
        return keep(near.near_pairs(stored(around(rows, come)), p, come))


def _both_ways(found: DataFrame) -> DataFrame:
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return found.select(F.explode(ways).alias("e"), "dist").select("e.src", "e.dst", "dist")


def _seed_pairs(tweets: DataFrame, seeds: DataFrame, p: Params) -> DataFrame:
    """(a, b, dist) of seeds (as nodes) and messages within epsilon."""
    known = F.broadcast(checked_seeds(seeds, p).select("seed_idx", F.col("vector").alias("va")))
    s = tweets.select(F.col("id").alias("b"), F.col("vector").alias("vb")).crossJoin(known)
    s = s.select(seed_node(F.col("seed_idx")).alias("a"), "b", cosine_distance(F.col("va"), F.col("vb")).alias("dist"))
    return s.where(F.col("dist") <= p.epsilon)


def neighbor_edges(tweets: DataFrame, seeds: DataFrame | None, p: Params) -> DataFrame:
    """(src, dst, dist) in both directions for candidates within epsilon.  Each distance is computed once."""
    found = near_pairs(tweets, p)
    return _both_ways(found if seeds is None else found.unionByName(_seed_pairs(tweets, seeds, p)))


def kept_edges(tweets: DataFrame, seeds: DataFrame | None, p: Params) -> DataFrame:
    """``neighbor_edges`` from a table that has each pair once; the other direction is made where they are read."""
    with tidied(tweets.sparkSession) as keep:
        found = near_pairs(tweets, p)
        return keep(_both_ways(stored(found if seeds is None else found.unionByName(_seed_pairs(tweets, seeds, p)))))


def telling_edges(tweets: DataFrame, seeds: DataFrame, p: Params) -> DataFrame:
    """Like ``kept_edges``, without most edges between cores: core distances, reachability, seeds' membership and clusters are the same.

    ``kept_edges`` grows as the square of the messages of a place, these as the rows that are shipped to find them.
    """
    if p.reach_min > 0:  # then a cluster is cut by more than the upper end of its band
        return kept_edges(tweets, seeds, p)
    with tidied(tweets.sparkSession) as keep:
        rows = tiled(tweets, p, "vector")
        return keep(_both_ways(stored(near.telling_pairs(rows, p, min(p.epsilon, p.reach_max), _seed_pairs(tweets, seeds, p)))))


def added_edges(tweets: DataFrame, new: DataFrame, seeds: DataFrame | None, p: Params) -> DataFrame:
    """Those of the edges of ``tweets`` that have an end in ``new`` (rows of ``tweets``)."""
    found = near_pairs(tweets, p, new.select("id"))
    return _both_ways(found if seeds is None else found.unionByName(_seed_pairs(new, seeds, p)))


def core_distance(tweets: DataFrame, edges: DataFrame, p: Params) -> DataFrame:
    """(id, core): distance of the ``min_points``-th neighbour, epsilon + 1 if there are fewer."""
    w = Window.partitionBy("src").orderBy("dist", "dst")
    kth = edges.where("src >= 0").withColumn("k", F.row_number().over(w)).where(F.col("k") == p.min_points)
    kth = kth.select(F.col("src").alias("id"), "dist")
    return tweets.select("id").join(kth, "id", "left").select("id", F.coalesce("dist", F.lit(p.epsilon + 1)).alias("core"))


def _cores(core: DataFrame, limit: float) -> DataFrame:
    return core.where(F.col("core") <= limit)


def reachability(tweets: DataFrame, edges: DataFrame, core: DataFrame, p: Params, as_written: bool = False) -> DataFrame:
    """(id, reach): least over core neighbours of max(distance, their core distance); epsilon + 1 if none.

    Seeds are core with distance 0.  ``as_written`` takes the message's own core distance where that of the
    neighbour is the larger one.
    """
    c = _cores(core, p.epsilon).select(F.col("id").alias("dst"), F.col("core").alias("other"))
    e = edges.where("src >= 0").join(c, "dst", "left").withColumn("other", F.when(F.col("dst") < 0, 0.0).otherwise(F.col("other")))
    e = e.where("other is not null")
    if as_written:
        e = e.join(core.select(F.col("id").alias("src"), "core"), "src")
        r = F.when(F.col("dist") > F.col("other"), F.col("dist")).otherwise(F.col("core"))
    else:
        r = F.greatest("dist", "other")
    low = e.select(F.col("src").alias("id"), r.alias("r")).groupBy("id").agg(F.min("r").alias("r"))
    return tweets.select("id").join(low, "id", "left").select("id", F.coalesce("r", F.lit(p.epsilon + 1)).alias("reach"))


def core_components(edges: DataFrame, core: DataFrame, p: Params) -> DataFrame:
    """(id, label): components of cores."""
    cores = stored(_cores(core, p.epsilon).select("id"))
    a, b = cores.withColumnRenamed("id", "src"), cores.withColumnRenamed("id", "dst")
    return components(cores, edges.join(a, "src").join(b, "dst"))


def _touch(edges: DataFrame) -> DataFrame:
    """(id, seed_idx) of messages next to a seed."""
    return edges.where("dst < 0").select(F.col("src").alias("id"), (-F.col("dst") - 1).cast("int").alias("seed_idx"))


def owners(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """(id, seed_idx) of cores: a component belongs to its least seed."""
    owner = _touch(edges).join(comp, "id").groupBy("label").agg(F.min("seed_idx").alias("seed_idx"))
    return comp.join(owner, "label").select("id", "seed_idx")


def borders(edges: DataFrame, owned: DataFrame) -> DataFrame:
    """(id, seed_idx) of messages that aren't cores, whose ``edges`` these are: the least of their own seeds and the owners of
    adjacent cores."""
    via = edges.join(owned, edges.dst == owned.id).select(F.col("src").alias("id"), "seed_idx").where("id >= 0")
    return _touch(edges).unionByName(via).groupBy("id").agg(F.min("seed_idx").alias("seed_idx"))


def dealt_out(edges: DataFrame, core: DataFrame, comp: DataFrame, p: Params) -> DataFrame:
    """(id, seed_idx): the first seed that reaches a message through cores, given their components."""
    owned = stored(owners(edges, comp))
    outside = edges.join(comp.select(F.col("id").alias("src")), "src", "left_anti")
    return owned.unionByName(borders(outside, owned))


def seed_membership(edges: DataFrame, core: DataFrame, p: Params) -> DataFrame:
    """(id, seed_idx): the first seed that reaches a message through cores.

    Components of cores; a component belongs to its least seed, a border message to the least of its own
    seeds and the owners of adjacent cores.
    """
    return dealt_out(edges, core, stored(core_components(edges, core, p)), p)


def clusters(edges: DataFrame, core: DataFrame, reach: DataFrame, p: Params, member: DataFrame | None = None) -> DataFrame:
    """(id, seed_idx, label): runs of messages with reachability in the accepted band, within a seed's messages.

    The band's upper end cuts the graph: components of messages that are core at that level, the seed
    included, with the messages at their border.  ``member`` is the seeds' membership where it is known.
    """
    cut = min(p.epsilon, p.reach_max)
    member = seed_membership(edges, core, p) if member is None else member
    band = reach.where(F.col("reach").between(p.reach_min, p.reach_max)).select("id")
    member = stored(member.join(band, "id"))
    is_core = _cores(core, cut).select("id", F.lit(True).alias("is_core"))
    node = member.join(is_core, "id", "left").select("id", "seed_idx", F.coalesce("is_core", F.lit(False)).alias("is_core"))
    seeds = member.select("seed_idx").distinct().select(seed_node(F.col("seed_idx")).alias("id"), "seed_idx", F.lit(True).alias("is_core"))
    node = stored(node.unionByName(seeds))
    s = node.select(F.col("id").alias("src"), F.col("seed_idx").alias("s1"), F.col("is_core").alias("c1"))
    d = node.select(F.col("id").alias("dst"), F.col("seed_idx").alias("s2"), F.col("is_core").alias("c2"))
    inner = edges.where(F.col("dist") <= cut).join(s, "src").join(d, "dst").where("s1 = s2")
    inner = stored(inner)
    comp = components(node.where("is_core").select("id"), inner.where("c1 and c2"))
    label = comp.select(F.col("id").alias("dst"), "label")
    border = inner.where("c2 and not c1").join(label, "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("label"))
    own = comp.where("id >= 0").unionByName(border)
    return own.join(member, "id").select("id", "seed_idx", "label")


def clusters_unseeded(tweets: DataFrame, p: Params) -> DataFrame:
    """(id, label): components of cores without seeds, and the messages at their border."""
    edges = kept_edges(tweets, None, p)
    core = stored(core_distance(tweets, edges, p))
    comp = stored(core_components(edges, core, p))
    near = edges.join(comp, edges.dst == comp.id).groupBy("src").agg(F.min("label").alias("label"))
    border = near.join(comp.select(F.col("id").alias("src")), "src", "left_anti").select(F.col("src").alias("id"), "label")
    return comp.unionByName(border)


def incremental_update(tweets: DataFrame, expired: DataFrame, new: DataFrame, edges: DataFrame, core: DataFrame, p: Params):
    """Edges and core distances after ``expired`` (id) leave and ``new`` (ids in ``tweets``) come (``incremental.step``
    keeps all the rest as well).

    ``edges`` and ``core`` are of the messages before.  Only pairs with a new end are compared, and core
    distances are recomputed only for messages that gained or lost a neighbour.  Returns (edges, core).
    """
    gone, fresh = stored(expired.select("id")), stored(new.select("id"))
    old = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    active = tweets.join(gone, "id", "left_anti")
    with tidied(tweets.sparkSession) as keep:
        added = keep(stored(added_edges(active, fresh, None, p)))
    lost = edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi")
    touched = added.select("src").unionByName(lost.select("src")).unionByName(fresh.withColumnRenamed("id", "src")).distinct()
    touched = stored(touched.withColumnRenamed("src", "id"))
    now = old.unionByName(added)
    redone = core_distance(active.join(touched, "id", "left_semi"), now.join(touched.withColumnRenamed("id", "src"), "src", "left_semi"), p)
    kept = core.join(touched, "id", "left_anti").join(gone, "id", "left_anti")
    return now, kept.unionByName(redone)


def wide(p: Params) -> Params:
    """The settings at which components have several hops."""
    return replace(p, epsilon=0.85)
