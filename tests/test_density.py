"""The hand-made scenario of twelve messages and two seeds."""

import math
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest

from bruit.functions.text import clean_words
from bruit.operators import density, events, near
from bruit.operators.pairs import candidates
from bruit.operators.store import stored, tidied
from bruit.params import Params
from pyspark.sql import functions as F

P = Params()


def vec(deg):
    return [math.cos(math.radians(deg)), math.sin(math.radians(deg))]


@pytest.fixture(scope="module")
def scene(spark):
    rows = []
    places = {7: (-96.9, 40.1)} | {i: (-80.1, 30.1) for i in (9, 10, 11, 12)}
    texts = {8: "game tonight"} | {i: "flood river" for i in (9, 10, 11, 12)}
    angle = dict(zip(range(1, 13), (0, 2, 4, 6, 8, 42, 4, 4, 90, 92, 94, 96), strict=True))
    for i in range(1, 13):
        lon, lat = places.get(i, (-99.9, 40.1))
        rows.append((i, lon, lat, True, 9 if i >= 9 else i, texts.get(i, "fire downtown"), vec(angle[i])))
    t = spark.createDataFrame(rows, "id long, lon double, lat double, exact boolean, uid long, text string, vector array<double>")
    t = t.withColumn("time", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int), 0)"))
    t = t.withColumn("words", clean_words(F.col("text"))).cache()
    s = spark.createDataFrame([(0, vec(4)), (1, vec(93))], "seed_idx int, vector array<double>")
    return t, s


def graph(scene, seeded):
    t, s = scene
    e = density.neighbor_edges(t, s if seeded else None, P).cache()
    c = density.core_distance(t, e, P).cache()
    return t, e, c


def as_map(df):
    return {r[0]: r[1] for r in df.collect()}


def test_candidates(scene):
    assert candidates(scene[0], P).count() == 21


@pytest.mark.parametrize(
    ("seeded", "cores", "reach"),
    [
        (False, {1: 0.005478105, 3: 0.00243595, 9: 0.005478105}, {1: 0.00243595, 3: 0.00243595, 6: 0.170962427, 10: 0.00243595, 7: 1.2, 8: 1.2}),
        (True, {1: 0.00243595, 3: 0.000609173, 9: 0.00243595}, {1: 0.000609173, 3: 0.0, 6: 0.170962427, 10: 0.000152305, 7: 0.0, 8: 0.0}),
    ],
)
def test_core_and_reachability(scene, seeded, cores, reach):
    t, e, c = graph(scene, seeded)
    assert e.where("src >= 0 and dst >= 0").count() == 36
    assert e.where("src < 0").count() == (11 if seeded else 0)
    core = as_map(c)
    assert {i for i, v in core.items() if v <= P.epsilon} == ({1, 2, 3, 4, 5, 9, 10, 11, 12})
    for i, v in cores.items():
        assert core[i] == pytest.approx(v, abs=1e-9)
    r = as_map(density.reachability(t, e, c, P))
    for i, v in reach.items():
        assert r[i] == pytest.approx(v, abs=1e-9)


def test_reachability_as_written(scene):
    for seeded, first in ((False, 0.005478105), (True, 0.00243595)):
        t, e, c = graph(scene, seeded)
        r = as_map(density.reachability(t, e, c, P, as_written=True))
        assert r[1] == pytest.approx(first, abs=1e-9)
        assert r[7] == pytest.approx(1.2)


def test_accepted_event(scene):
    t, e, c = graph(scene, True)
    cl = density.clusters(e, c, density.reachability(t, e, c, P), P).cache()
    acc = events.accepted(cl, t, P)
    row = events.summarise(cl, acc, t).collect()
    assert len(row) == 1
    assert (row[0].lon, row[0].lat, row[0].users) == (-99.525, 40.1, 8)
    ids = {r.tweet_id for r in events.members(cl, acc, t).collect()}
    assert ids == set(range(1, 9))


def test_unseeded_clusters(scene):
    got = as_map(density.clusters_unseeded(scene[0], P))
    assert {i for i, v in got.items() if v == 1} == {1, 2, 3, 4, 5, 6}
    assert {i for i, v in got.items() if v == 9} == {9, 10, 11, 12}


def test_edges_leave_nothing_else_on_disk(spark, scene):
    """Blocks of vectors and what comes between go, and jobs' shuffle files with them; pairs are written once each."""
    t, s = scene
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    base.mkdir(exist_ok=True)
    before = set(base.iterdir())
    e = density.kept_edges(t, s, P)
    left = set(base.iterdir()) - before
    assert {Path(f.removeprefix("file://")).parent.name for f in e.inputFiles()} == {p.name for p in left} and len(left) == 1
    key = lambda df: sorted(map(tuple, df.select("src", "dst", "dist").collect()))
    assert key(e) == key(density.neighbor_edges(t, s, P))
    assert e.count() == 2 * spark.read.parquet(str(next(iter(left)))).count()


def test_outer_tidied_takes_what_an_inner_one_kept(spark):
    with tidied(spark) as outer:
        with tidied(spark) as inner:
            kept = inner(stored(spark.range(3)))
        name = kept.inputFiles()[0].removeprefix("file://")
        assert Path(name).exists()
        outer(spark.range(1))
    assert not Path(name).exists()


def test_incremental_equals_full(scene):
    t, _ = scene
    before = t.where("id <> 3")
    e = density.neighbor_edges(before, None, P)
    c = density.core_distance(before, e, P)
    edges, core = density.incremental_update(t, t.where("id = 10"), t.where("id = 3"), e, c, P)
    after = t.where("id <> 10")
    full = density.neighbor_edges(after, None, P)
    key = lambda df: sorted(map(tuple, df.select("src", "dst", "dist").collect()))
    assert key(edges) == key(full)
    assert as_map(core) == as_map(density.core_distance(after, full, P))


def test_few_edges_tell_what_all_tell(spark, monkeypatch):
    """At a wide epsilon edges grow as the square of a place's messages; those that are kept instead don't, and nothing that is made of them changes."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        about = rng.normal(size=4) * (1 + i % 3)
        words = ["w"] * (i % 5 > 0) + [f"s{k}" for k in rng.integers(0, 150, 3)] * (i % 7 > 0)
        x = [0.0] * 4 if i == 5 else (rows[-1][7] if i % 10 == 9 else np.round(about, 3).tolist())
        rows.append((i, -99.9 + i % 8 * 0.4, 40.1 + i % 3 * 0.7, True, i % 9, "", words, x))
    t = spark.createDataFrame(rows, "id long, lon double, lat double, exact boolean, uid long, text string, words array<string>, vector array<double>").cache()
    s = spark.createDataFrame([(k, rng.normal(size=4).round(3).tolist()) for k in range(3)], "seed_idx int, vector array<double>")
    monkeypatch.setattr(near, "MASK", 64)  # some pairs have no frequent word in common
    key = lambda df: sorted(map(tuple, df.collect()))
    for p in (replace(P, epsilon=0.5, reach_max=0.12, block_bits=3), replace(P, epsilon=0.3, block_bits=11)):
        found = []
        for edges in (density.kept_edges(t, s, p), density.telling_edges(t, s, p)):
            c = density.core_distance(t, edges, p).cache()
            r = density.reachability(t, edges, c, p).cache()
            found.append((edges, [key(x) for x in (c, r, density.core_components(edges, c, p), density.seed_membership(edges, c, p), density.clusters(edges, c, r, p))]))
        (all_, want), (some, got) = found
        assert got == want and all(want) and set(key(some)) <= set(key(all_))
        if p.block_bits == 11:
            assert some.count() < all_.count() * 0.7


def test_forests_span_what_is_apart():
    rng = np.random.default_rng(8)
    for n, m in ((1, 0), (30, 20), (200, 150), (50, 900)):
        i, j, label = rng.integers(0, n, m), rng.integers(0, n, m), np.arange(n)
        used = near.joined(label, i, j)
        assert (label[i] == label[j]).all() and len(used) == n - len(set(label.tolist()))
        again = np.arange(n)
        near.joined(again, i[used], j[used])
        assert (again == label).all()
