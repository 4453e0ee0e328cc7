"""Clusters kept over arrivals and expiry against plain loops over what is left.

Each of ten worlds has vectors of its own two dimensions and a place of its own, so a step is ten random steps at once.
"""

import math
import random
from dataclasses import replace

from plain_density import plain_state

from bruit.operators import incremental
from bruit.operators.store import tidied
from bruit.params import Params

SCHEMA = "id long, lon double, lat double, uid long, words array<string>, vector array<double>"
WORLDS = 10


def in_world(w, angle):
    return [0.0] * (2 * w) + [math.cos(angle), math.sin(angle)] + [0.0] * (2 * (WORLDS - 1 - w))


def message(rnd, i, w):
    angle = rnd.choice([0.2, 1.0, 1.25, 1.5, 3.0]) + rnd.gauss(0, 0.12)
    words = rnd.sample(["fire", "flood", "game", "rain", "the"], rnd.randint(1, 3))
    return (i, -120 + 5 * w + rnd.random() * 1.6, 40 + rnd.random() * 1.6, i % 5, words, in_world(w, angle))


def rows(data):
    return sorted((tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in data), key=repr)


def same(state, active, seeds, p):
    for name, want in plain_state(active, seeds, p).items():
        df = getattr(state, name)
        assert rows(map(tuple, df.select(*sorted(df.columns)).collect())) == rows(want), name


def run(spark, p, steps):
    rnd = random.Random(11)
    seeds = [(3 * w + k, in_world(w, a)) for w in range(WORLDS) for k, a in enumerate((1.1, 0.25, 1.45))]
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    known = spark.createDataFrame(seeds, "seed_idx int, vector array<double>")
    active = [message(rnd, 100 * w + i, w) for w in range(WORLDS) for i in range(25)]
    with tidied(spark) as keep:
        state = keep(incremental.full(frame(active), known, p))
    same(state, active, seeds, p)
    for k in range(1, steps + 1):
        gone, come = set(), []
        for w in range(WORLDS):
            mine = [r for r in active if r[0] // 100 % 10 == w]
            middle = [r[0] for r in mine if 0.9 < math.atan2(r[5][2 * w + 1], r[5][2 * w]) < 1.3]
            gone |= set({0: [], 1: middle, 2: [r[0] for r in mine[:-3]]}.get((w + k) % 10, rnd.sample([r[0] for r in mine], min(len(mine), 5))))
            come += [message(rnd, 1000 * k + 100 * w + j, w) for j in range(0 if w == 3 else 12 if w == 7 else 5)]
        with tidied(spark) as keep:
            state = keep(incremental.step(state, spark.createDataFrame([(i,) for i in sorted(gone)], "id long"), frame(come), known, p))
        active = [r for r in active if r[0] not in gone] + come
        same(state, active, seeds, p)


def test_ten_random_steps_twice(spark):
    run(spark, Params(epsilon=0.015), 2)


def test_clusters_cut_below_epsilon(spark):
    run(spark, replace(Params(epsilon=0.03), reach_max=0.008), 1)


def test_nothing_comes_and_all_goes(spark):
    rnd, p = random.Random(2), Params(epsilon=0.015)
    active = [message(rnd, i, 0) for i in range(12)]
    seeds = spark.createDataFrame([(0, in_world(0, 1.1))], "seed_idx int, vector array<double>")
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    state = incremental.full(frame(active), seeds, p)
    state = incremental.step(state, frame(active).select("id"), frame([]), seeds, p)
    assert all(getattr(state, n).isEmpty() for n in ("tweets", "edges", "core", "reach", "comp", "member", "clusters"))
