"""Centroid clustering against plain integers and SQL."""

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import SF

from bruit.llm import centroids
from bruit.llm.centroids import Centers, CentroidParams, Simplex, cluster, op13_centroid_clustering

SCHEMA = "vec_id long, embedding array<double>, cluster string, `q` int"


def plain(rows, p=CentroidParams()):
    """(vec_id, cluster, distance) by a comparison of all with all, in Python's integers."""
    rows = [(i, v) for i, v in rows if v is not None and len(v) == p.size and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [centroids.whole(x, p.scale) for x in v]) for i, v in rows]
    name = lambda r: hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    c = [q for _, q in sorted(ints, key=lambda r: (name(r), r[1]))[: p.k]]
    near = lambda q: min((sum((x - y) ** 2 for x, y in zip(q, b, strict=True)), j) for j, b in enumerate(c))
    for _ in range(p.rounds):
        mine = [[q for _, q in ints if near(q)[1] == j] for j in range(len(c))]
        c = [[sum(col) // len(m) for col in zip(*m, strict=True)] if m else old for m, old in zip(mine, c, strict=True)]
    return sorted(((i, j, min(d, centroids.MOST)) for i, q in ints for d, j in [near(q)]), key=repr), c


def same(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    found, points = cluster(df)
    want, c = plain(rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert points == c


def vectors(n, seed, scale=1.0):
    rnd = random.Random(seed)
    return [[rnd.gauss(0, scale) for _ in range(64)] for _ in range(n)]


def test_small_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found, points = cluster(spark.read.parquet(f"{SF}/embeddings.parquet"))
    want, c = plain(rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert points == c


def test_oracle(spark, duck):
    got = op13_centroid_clustering(spark, SF)
    want = duck.sql(centroids.OP13_SQL)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    pick = lambda cols, rows: sorted(tuple(r[cols.index(n)] for n in names) for r in rows)
    assert pick(got.columns, [tuple(r) for r in got.collect()]) == pick(want.columns, want.fetchall())


def test_nulls_repeats_and_ties(spark):
    v = vectors(30, 1)
    bad = [None, [], v[0][:63], [*v[0], 1.0], [*v[0][:63], None], [*v[0][:63], float("nan")], [*v[0][:63], float("-inf")]]
    rows = [(i, x) for i, x in enumerate(v)] + [(100 + i, x) for i, x in enumerate(bad)] + [(None, v[3]), (None, v[4]), (5, v[6])] + [(7, v[7])] * 40
    same(spark, rows)
    same(spark, [(i, [float(i % 3)] * 64) for i in range(20)])  # equal centroids: the smaller number


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    same(spark, [(i, x) for i, x in enumerate(vectors(n, 2))])


def test_long_integers(spark):
    same(spark, [(i, x) for i, x in enumerate([*vectors(12, 3), *vectors(4, 4, 1e9), *vectors(2, 5, 1e30), [1e308] * 64, [-1e308] * 64, [5e-324] * 64, [-5e-324] * 64])])


def test_bounds_hold_and_drop_most():
    """Lower and upper bounds hold the true distance, and near copies of the pivots leave few candidates."""
    rng = np.random.default_rng(1)
    points = [[int(x) for x in row] for row in rng.integers(-500, 500, (8, 64))]
    simplex = Simplex(points, 8)
    assert len(simplex.pivots) == 8
    q = np.array([np.array(points[i % 8]) + rng.integers(-60, 60, 64) for i in range(400)])
    centers = Centers([[int(x) for x in c] for c in np.array(points) + rng.integers(-20, 20, (8, 64))], simplex)
    a, b = simplex.project(q), centers.apex
    flat = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
    true = ((q[:, None] - centers.q[None]) ** 2).sum(axis=2)
    assert (flat + (a[:, None, -1] - b[None, :, -1]) ** 2 <= true * (1 + 1e-9)).all()
    assert (flat + (a[:, None, -1] + b[None, :, -1]) ** 2 >= true * (1 - 1e-9)).all()
    may = centers.candidates(a)
    assert may[np.arange(400), true.argmin(axis=1)].all() and may.mean() < 0.3


def test_pivots_in_one_plane():
    """A pivot in the space of the others is left out."""
    line = [[k] * 64 for k in (0, 3, 7, 7)] + [[0] * 63 + [50]]
    simplex = Simplex(line, 8)
    assert simplex.pivots == [line[0], line[1], line[4]]
