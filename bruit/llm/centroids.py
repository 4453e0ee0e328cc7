"""Centroid clustering whose comparisons are filtered by n-simplex projection (operator 13).

Centroids of an earlier round serve as pivots.  A vector's distances to n pivots, which
are taken once and kept over rounds, become the apex of a simplex over them: n - 1 coordinates
in the pivots' own space and an altitude over it.  For two apexes the distance with
altitudes on the same side is a lower bound of the true one, on opposite sides an
upper bound.  In each round the centroids' apexes are taken from their distances
to the pivots; a centroid whose lower bound exceeds the least upper bound can't
be the nearest, and the rest are compared by exact integers.  The nearer centroids are to
the pivots' space, the closer are the bounds, so pivots are renewed in the rounds of
``renew``, while centroids still move far.  Bounds are widened
by a millionth of the squares that they are made of, far above the rounding of
doubles; pivots that lie nearly in the space of the others are left out.

Vectors are stored once as integers with their apexes.  A round is one scan: tasks
know the eight centroids and give back exact sums, split into limbs of 40 bits, so
that Spark adds them up and the driver sees at most some thousand numbers whatever
the rows.  Nothing is grouped by vector, so equal vectors are no burden.

Defined results: vectors with another number of components, or with a null or a
non-finite one, aren't returned; repeated rows each count; a null vec_id hashes as the empty string;
equal hashes are ordered by the components; fewer than eight vectors make as many centroids; integers
over 27 bits are compared exactly without bounds, and distances and sums over 63
bits are given as the largest long; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bruit.llm.common import map_pandas, materialize, pick, steps, table


@dataclass(frozen=True)
class CentroidParams:
    k: int = 8
    rounds: int = 10
    seed: int = 3
    size: int = 64
    scale: int = 1024
    pivots: int = 8
    renew: tuple[int, ...] = (0, 2, 5)


SMALL = 1 << 27  # squares of differences of smaller integers, summed over 64 components, fit a long
LIMB = 40
MOST = (1 << 63) - 1
MARGIN = 1e-6
#: A pivot's least altitude over the others, as a share of its distance to the first.
LEAST_ALTITUDE = 1e-2


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    n, d = float(x).as_integer_ratio()
    return n * scale // d


def exact_square(a, b) -> int:
    return sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True))


def apexes(base: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Coordinates and altitude from squared distances to the pivots (a row each) whose own coordinates are ``base``."""
    x = np.zeros((len(squares), len(base) + 1))
    for i, b in enumerate(base):  # row i is zero behind its own altitude, so coordinates follow one by one
        x[:, i] = ((squares[:, 0] - squares[:, i + 1] + b @ b) / 2 - x[:, :i] @ b[:i]) / b[i]
    x[:, -1] = np.sqrt(np.maximum(0, squares[:, 0] - (x[:, :-1] ** 2).sum(axis=1)))
    return x


class Simplex:
    """Pivots (lists of integers) and their coordinates, found from distances alone."""

    def __init__(self, points: list[list[int]], most: int):
        self.pivots, self.base = points[:1], np.zeros((0, 0))
        for p in points[1:]:
            if len(self.pivots) == most or max(map(abs, p)) > SMALL or max(map(abs, self.pivots[0])) > SMALL:
                continue
            squares = np.array([[float(exact_square(p, q)) for q in self.pivots]])
            own = apexes(self.base, squares)[0]
            if own[-1] > LEAST_ALTITUDE * np.sqrt(squares[0, 0]):
                self.base = np.vstack([np.hstack([self.base, np.zeros((len(self.base), 1))]), own])
                self.pivots = [*self.pivots, p]

    def project(self, q: np.ndarray) -> np.ndarray:
        squares = np.stack([((q - np.array(p, np.int64)) ** 2).sum(axis=1) for p in self.pivots], axis=1)
        return apexes(self.base, squares.astype(np.float64))


class Centers:
    """Centroids of a round."""

    def __init__(self, points: list[list[int]], simplex: Simplex):
        self.points = points
        self.small = all(abs(x) <= SMALL for p in [*points, *simplex.pivots] for x in p)
        if self.small:
            self.q = np.array(points, np.int64)
            self.apex = simplex.project(self.q)

    def candidates(self, apex: np.ndarray) -> np.ndarray:
        """Which centroids may be the nearest, by the bounds alone."""
        flat = np.maximum(0, (apex[:, None, :-1] - self.apex[None, :, :-1]) ** 2).sum(axis=2)
        up, down = apex[:, None, -1], self.apex[None, :, -1]
        slack = MARGIN * ((apex**2).sum(axis=1)[:, None] + (self.apex**2).sum(axis=1)[None] + 1)
        low, high = flat + (up - down) ** 2 - slack, flat + (up + down) ** 2 + slack
        return low <= high.min(axis=1)[:, None]

    def nearest(self, q: np.ndarray, apex: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The nearest centroid of each vector, the smaller number of equal ones, and the squared distance."""
        if not self.small:
            return self.nearest_big(q)
        near, found = np.zeros(len(q), np.int64), np.full(len(q), MOST)
        may = self.candidates(apex)
        for j, c in enumerate(self.q):
            rows = np.flatnonzero(may[:, j])
            d = q[rows] - c
            d = np.einsum("ij,ij->i", d, d)
            less = d < found[rows]
            near[rows[less]], found[rows[less]] = j, d[less]
        return near, found.tolist()

    def nearest_big(self, q) -> tuple[np.ndarray, list[int]]:
        best = [min((exact_square(v, c), j) for j, c in enumerate(self.points)) for v in q]
        return np.array([j for _, j in best], np.int64), [d for d, _ in best]


def kept_vectors(embeddings: DataFrame, p: CentroidParams) -> DataFrame:
    """(vec_id, x) of the vectors that take part; ``x`` as doubles."""
    e = pick(embeddings, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return e.where((F.size("x") == p.size) & ~odd)


def starts(kept: DataFrame, p: CentroidParams) -> list[list[int]]:
    name = F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = kept.select(F.sha2(name, 256).alias("h"), "x").orderBy("h", "x").limit(p.k).collect()
    return [[whole(v, p.scale) for v in r.x] for r in rows]


def _integers(kept: DataFrame, p: CentroidParams) -> DataFrame:
    """(vec_id, q, big): the integers, as text in ``big`` where they are long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["x"].tolist(), np.float64).reshape(-1, p.size)
            small = (np.abs(x) < SMALL / p.scale).all(axis=1)
            q = [np.floor(p.scale * v).astype(np.int32) if s else None for v, s in zip(x, small, strict=True)]
            big = [None if s else [str(whole(c, p.scale)) for c in v] for v, s in zip(x, small, strict=True)]
            yield pd.DataFrame({"vec_id": b["vec_id"], "q": q, "big": big})

    return map_pandas(kept, run, "vec_id long, q array<int>, big array<string>")


def _cached(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """``vectors`` with the apexes that their distances to the pivots make; none for long integers."""
    usable = all(abs(v) <= SMALL for s in simplex.pivots for v in s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            apex, small = [None] * len(b), np.flatnonzero(b["q"].notna())
            if len(small):
                q = np.stack(b["q"].iloc[small].tolist()).astype(np.int64)
                found = simplex.project(q) if usable else np.zeros((len(q), 1))
                for k, a in zip(small, found, strict=True):
                    apex[k] = a
            yield b.assign(apex=apex)

    return map_pandas(vectors, run, "vec_id long, q array<int>, big array<string>, apex array<double>")


def _groups(b: pd.DataFrame, centers: Centers) -> Iterator[tuple[pd.Series, object, np.ndarray, list[int]]]:
    """Per kind of row: which rows, their integers, the nearest centroids and squared distances."""
    is_big = b["big"].notna()
    if (~is_big).any():
        rows = b[~is_big]
        q, apex = np.stack(rows["q"].tolist()).astype(np.int64), np.stack(rows["apex"].tolist())
        yield rows, q, *centers.nearest(q, apex)
    if is_big.any():
        rows = b[is_big]
        q = np.array([[int(v) for v in r] for r in rows["big"]], dtype=object)
        yield rows, q, *centers.nearest_big(q)


def limbs(v: int) -> list[int]:
    """Digits of 40 bits, the lowest first, all with the number's sign."""
    out, sign, v = [], -1 if v < 0 else 1, abs(v)
    while v:
        out.append(sign * (v & ((1 << LIMB) - 1)))
        v >>= LIMB
    return out


def _sums(vectors: DataFrame, centers: Centers, p: CentroidParams) -> dict[tuple[int, int], int]:
    """(cluster, component) -> exact sum; component -1 is the number of vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(centers.points), p.size + 1), dtype=object)
        for b in batches:
            for _, q, near, _ in _groups(b, centers):
                for j in np.unique(near):
                    mine = near == j
                    total[j, :-1] += np.array([int(v) for v in q[mine].sum(axis=0)], dtype=object)
                    total[j, -1] += int(mine.sum())
        rows = [(j, i if i < p.size else -1, k, s) for j, row in enumerate(total) for i, v in enumerate(row) for k, s in enumerate(limbs(int(v)))]
        yield pd.DataFrame(rows, columns=["cluster", "dim", "limb", "s"])

    parts = map_pandas(vectors.drop("vec_id"), run, "cluster int, dim int, limb int, s long")
    rows = parts.groupBy("cluster", "dim", "limb").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect()
    out: dict[tuple[int, int], int] = {}
    for r in rows:
        out[r.cluster, r.dim] = out.get((r.cluster, r.dim), 0) + (int(r.s) << (LIMB * r.limb))
    return out


def _moved(points: list[list[int]], sums: dict[tuple[int, int], int], p: CentroidParams) -> list[list[int]]:
    full = lambda j: sums.get((j, -1), 0)
    return [[sums.get((j, i), 0) // full(j) for i in range(p.size)] if full(j) else c for j, c in enumerate(points)]


def cluster(embeddings: DataFrame, p: CentroidParams = CentroidParams()) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) for every vector that takes part, and the final centroids."""
    spark = embeddings.sparkSession
    kept = kept_vectors(embeddings, p)
    points = starts(kept, p)
    schema = "vec_id long, cluster int, distance long"
    if not points:
        return spark.createDataFrame([], schema), []
    with steps(spark) as own:
        vectors = own.put("integers", _integers(kept, p))
        for n in range(p.rounds + 1):
            if n in p.renew:
                simplex = Simplex(points, p.pivots)
                cached = own.put("apexes", _cached(vectors, simplex))
            last = Centers(points, simplex)
            if n < p.rounds:
                points = _moved(points, _sums(cached, last, p), p)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for rows, _, near, found in _groups(b, last):
                    yield pd.DataFrame({"vec_id": rows["vec_id"], "cluster": near, "distance": [min(d, MOST) for d in found]})

        return materialize(map_pandas(cached, run, schema), "clusters"), points


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, points = cluster(table(spark, sf_dir, "embeddings"))
    by = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()  # a row for each centroid
    by = {r.cluster: int(r.s) for r in by}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in points]
    known = [(j, min(by.get(j, 0), MOST), h) for j, h in enumerate(sha)]
    known = F.broadcast(spark.createDataFrame(known, "cluster int, cluster_inertia long, centroid_sha256 string"))  # eight rows
    total = F.lit(min(sum(by.values()), MOST)).cast("long")
    return found.join(known, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")


def _round(n: int) -> str:
    """SQL of a round: nearest centroids of ``c{n}``, and the next ones."""
    return f"""
d{n} AS (SELECT r, k, sum((vd.x - c{n}.x) * (vd.x - c{n}.x)) AS d FROM vd JOIN c{n} USING (i) GROUP BY r, k),
a{n} AS MATERIALIZED (SELECT r, k, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, k) AS rn FROM d{n}) WHERE rn = 1),
m{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN vd USING (r) GROUP BY k, i),
c{n + 1} AS MATERIALIZED (SELECT c.k, c.i, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x
  FROM c{n} c LEFT JOIN m{n} m USING (k, i))"""


OP13_SQL = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
vd AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, CAST(floor(1024 * unnest(e)) AS HUGEINT) AS x FROM v),
c0 AS MATERIALIZED (SELECT k, i, x FROM vd JOIN (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM v
  QUALIFY k < 8) USING (r)),{reduce(lambda s, n: s + ("," if s else "") + _round(n), range(10), "")},
d10 AS (SELECT r, k, sum((vd.x - c10.x) * (vd.x - c10.x)) AS d FROM vd JOIN c10 USING (i) GROUP BY r, k),
a10 AS MATERIALIZED (SELECT r, k, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, k) AS rn FROM d10) WHERE rn = 1),
h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c10 GROUP BY k)
SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256 FROM a10 JOIN v USING (r) JOIN h USING (k)"""
