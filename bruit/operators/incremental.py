"""Clusters that are kept while messages come and go.

A ``State`` holds what is known of the active messages.  ``step`` takes the messages that expire and those
that come.  Vectors are compared for pairs with a new end alone; core distances
and reachability are redone for messages whose neighbours changed; of the components of cores those are taken apart that lost
a core or an edge, and all others stand as one node each in a small graph that the new edges join;
seeds are dealt out anew to components that changed, and clusters are found anew for seeds whose messages changed.
What doesn't change is copied, so the search follows the change; writing the state follows the window.

The result is that of ``full`` over the messages that are left, row for row.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bruit.operators import density
from bruit.operators.graph import components
from bruit.operators.store import Versions, stored
from bruit.params import Params


@dataclass
class State:
    """``tweets``; ``edges`` (src, dst, dist) of messages and seeds; ``core`` (id, core); ``reach`` (id, reach); ``comp``
    (id, label) of cores; ``member`` (id, seed_idx); ``clusters`` (id, seed_idx, label)."""

    tweets: DataFrame
    edges: DataFrame
    core: DataFrame
    reach: DataFrame
    comp: DataFrame
    member: DataFrame
    clusters: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @classmethod
    def of(cls, versions: Versions, n: int) -> State:
        return cls(*[versions.read(f.name, n) for f in fields(cls)])


def full(tweets: DataFrame, seeds: DataFrame, p: Params) -> State:
    """The state of ``tweets`` from nothing."""
    tweets = stored(tweets, "zstd")
    edges = stored(density.neighbor_edges(tweets, seeds, p))
    core = stored(density.core_distance(tweets, edges, p))
    reach = stored(density.reachability(tweets, edges, core, p))
    comp = stored(density.core_components(edges, core, p))
    member = stored(density.dealt_out(edges, core, comp, p))
    return State(tweets, edges, core, reach, comp, member, stored(density.clusters(edges, core, reach, p, member)))


def _ids(*frames: DataFrame) -> DataFrame:
    """Different ids of the first columns."""
    return reduce(DataFrame.unionByName, [f.select(F.col(f.columns[0]).alias("id")) for f in frames]).distinct()


def _only(df: DataFrame, ids: DataFrame, c: str = "id", how: str = "left_semi") -> DataFrame:
    return df.join(ids.select(F.col("id").alias(c)), c, how)


def _without(df: DataFrame, ids: DataFrame, c: str = "id") -> DataFrame:
    return _only(df, ids, c, "left_anti")


def _changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids whose rows differ, or that are in one of both alone."""
    both = old.withColumn("s", F.lit(1)).unionByName(new.withColumn("s", F.lit(2)))
    return both.groupBy(*old.columns).agg(F.sum("s").alias("s")).where("s <> 3").select("id").distinct()


def step(state: State, expired: DataFrame, new: DataFrame, seeds: DataFrame, p: Params) -> State:
    """The state after ``expired`` (id) are gone and ``new`` (rows like the state's messages) have come."""
    gone, new = stored(expired.select("id")), stored(new.select(*state.tweets.columns), "zstd")
    tweets = stored(_without(state.tweets, gone).unionByName(new), "zstd")
    fresh = new.select("id")

    # Edges: of the old ones those between messages that stay; new ones have a new end.
    added = stored(density.added_edges(tweets, new, seeds, p))
    lost = stored(_only(state.edges, gone, "src").unionByName(_without(_only(state.edges, gone, "dst"), gone, "src")))
    edges = stored(_without(_without(state.edges, gone, "src"), gone, "dst").unionByName(added))
    touched = stored(_without(_ids(fresh, added.select("src"), lost.select("src"), lost.select("dst")), gone).where("id >= 0"))

    # Core distances of touched messages, reachability of these and of the neighbours of changed ones.
    around = _only(edges, touched, "src")
    redone = density.core_distance(touched, around, p)
    core = stored(_without(state.core, _ids(touched, gone)).unionByName(redone))
    moved = stored(_without(_changed(_without(state.core, gone), core), gone))
    stale = stored(_ids(touched, _only(edges, moved, "dst").where("src >= 0").select("src")))
    redone = density.reachability(stale, _only(edges, stale, "src"), core, p)
    reach = stored(_without(state.reach, _ids(stale, gone)).unionByName(redone))

    comp = stored(_components(state, gone, lost, added, edges, core, p))
    member = stored(_members(state, gone, touched, edges, core, comp, p))
    return State(tweets, edges, core, reach, comp, member, stored(_clusters(state, gone, touched, edges, core, reach, member, p)))


def _components(state: State, gone: DataFrame, lost: DataFrame, added: DataFrame, edges: DataFrame, core: DataFrame, p: Params) -> DataFrame:
    """Components of cores.  Clean ones are single nodes, under their label, of the graph that is searched."""
    cores = stored(core.where(F.col("core") <= p.epsilon).select("id"))
    no_more = state.comp.join(cores, "id", "left_anti").select("id")
    # An edge goes with an end of it, so a component that lost an edge between cores also lost one of them.
    broken = _only(state.comp, no_more).select("label").distinct()
    loose = stored(_ids(_without(cores, state.comp.select("id")), state.comp.join(broken, "label", "left_semi").join(cores, "id", "left_semi")))
    # Edges that may join: those at loose nodes, and new ones.
    live = _only(edges, loose, "src").unionByName(_only(added, loose, "src", "left_anti")).where("src >= 0 and dst >= 0").select("src", "dst")
    live = _only(_only(live, cores, "src"), cores, "dst")
    back = _without(live, loose, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    live = live.unionByName(back)
    clean = state.comp.join(broken, "label", "left_anti")
    at = lambda c, n: clean.select(F.col("id").alias(c), F.col("label").alias(n))
    graph = live.join(at("src", "l1"), "src", "left").join(at("dst", "l2"), "dst", "left")
    graph = stored(graph.select(F.coalesce("l1", "src").alias("src"), F.coalesce("l2", "dst").alias("dst")).where("src <> dst").distinct())
    found = stored(components(_ids(loose, graph.select("src")), graph))
    now = clean.join(found.select(F.col("id").alias("label"), F.col("label").alias("top")), "label", "left")
    now = now.select("id", F.coalesce("top", "label").alias("label"))
    return now.unionByName(_only(found, loose))


def _members(state: State, gone: DataFrame, touched: DataFrame, edges: DataFrame, core: DataFrame, comp: DataFrame, p: Params) -> DataFrame:
    """Seeds of components that changed, and of messages at their border."""
    other = stored(_ids(_changed(_without(state.comp, gone), _without(comp, gone)), touched))
    labels = _only(comp, other).select("label").unionByName(_only(state.comp, _ids(other, gone)).select("label")).distinct()
    again = stored(comp.join(labels, "label", "left_semi"))
    owned = density.owners(edges, again)
    cores = comp.select("id")
    whole = stored(_without(_only(state.member, cores), again).unionByName(owned))
    differ = _changed(_only(state.member, state.comp.select("id")), whole)
    edge_of = stored(_without(_ids(touched, _only(edges, _ids(differ, other), "dst").where("src >= 0").select("src")), cores))
    border = density.borders(_only(edges, edge_of, "src"), whole)
    kept = _without(_without(_without(state.member, cores), edge_of), gone)
    return whole.unionByName(kept).unionByName(border)


def _clusters(state: State, gone: DataFrame, touched: DataFrame, edges: DataFrame, core: DataFrame, reach: DataFrame, member: DataFrame, p: Params) -> DataFrame:
    """Clusters of the seeds to which something happened."""
    moved = stored(_ids(touched, gone, _changed(state.member, member), _changed(state.reach, reach), _changed(state.core, core)))
    seeds = _only(member, moved).select("seed_idx").unionByName(_only(state.member, moved).select("seed_idx")).distinct()
    seeds = stored(seeds)
    mine = stored(member.join(seeds, "seed_idx", "left_semi").select("id", "seed_idx"))
    nodes = _ids(mine, seeds.select(density.seed_node(F.col("seed_idx")).alias("id")))
    again = density.clusters(_only(_only(edges, nodes, "src"), nodes, "dst"), core, reach, p, mine)
    return state.clusters.join(seeds, "seed_idx", "left_anti").select("id", "seed_idx", "label").unionByName(again)
