"""Quality classifier by positive-unlabelled learning (operator 4).

Trusted positives are labelled good documents; the rest of the corpus is
unlabelled web text.  The class prior is estimated from these two alone: a
first model, which has seen one half of both, tells positives from unlabelled
text, and for the sets of its highest scores P(unlabelled in set) / P(positive
in set) in the other half is at least the prior, nearly so where no bad text
scores as high; the least such ratio is taken.  Then a logistic model over text
statistics minimises the non-negative unbiased risk: prior * E_p[l(f)] +
max(0, E_u[l(-f)] - prior * E_p[l(-f)]); where the second part falls below
zero, a step goes against it.

Statistics of all whole texts are computed once and stored (216 bytes a row).
Scales, knots and the prior's shares are sums over all rows outside fold 0,
taken by Spark.  The risk is minimised over all of them, too, in blocks of about
``block_rows`` random rows, each with all positives at hand; the model is
the mean of the blocks' weights.  Only sums come to the driver.  Labelled
positives are a sample of at most ``max_positives`` documents, one row each.

Defined results: null or empty text has zero statistics and the score that
follows; null ``doc_id`` hashes as the empty string, which is in fold 0;
conflicting labels of a document count as good; rows with a ``doc_id`` in common
are one positive (that of the least statistics) and as many unlabelled rows;
without positives the score is 0.5 for all; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bruit.llm.common import map_pandas, materialize, pick, ship, steps, table


@dataclass(frozen=True)
class PuParams:
    """``max_positives``: bound of the labelled sample; ``block_rows``: unlabelled rows of a block, about;
    ``threshold``: score of a positive."""

    max_positives: int = 12_000
    block_rows: int = 12_000
    steps: int = 300
    rate: float = 0.05
    decay: float = 1e-4
    threshold: float = 0.3
    folds: int = 5


_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9), "line": (10,),
    "wide": range(128, 256), "bang": (33,), "bar": (124,), "stop": (46,), "comma": (44,),
    "symbol": [ord(c) for c in "#*$%&<>@^~_=+\\{}[]"], "quote": (34, 39), "slash": (47, 58), "round": (40, 41),
}
_MAP = np.zeros((256, len(_GROUPS)))
for _k, _bytes in enumerate(_GROUPS.values()):
    _MAP[list(_bytes), _k] = 1.0
N_STATS = len(_GROUPS) + 12


def stats(text: str | None) -> np.ndarray:
    """Statistics of a whole text: shares of kinds of characters, and of words and lines."""
    out = np.zeros(N_STATS)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out[: len(_GROUPS)] = np.sqrt(np.bincount(raw, minlength=256) @ _MAP / len(raw))
    w, lines = text.split(), text.split("\n")
    n = max(1, len(w))
    distinct = len(set(w))
    own = out[len(_GROUPS) :]
    own[0] = np.log1p(len(w))
    own[1] = np.log1p(len(text) / n)
    own[2] = distinct / n
    own[3] = distinct / np.sqrt(n)
    own[4] = len(set(lines)) / len(lines)
    own[5] = np.log1p(len(text) / len(lines))
    own[6] = sum(x.isupper() for x in w) / n
    own[7] = sum(x.isalpha() for x in w) / n
    own[8] = sum(not x[-1].isalnum() for x in w) / n
    own[9] = np.sqrt(sum(map(operator.eq, w, w[1:])) / n)
    own[10] = np.sqrt(sum(map(operator.eq, w, w[2:])) / n)
    own[11] = sum(len(set(x)) < 3 for x in w) / n
    return out


@dataclass
class Model:
    """Logistic model over scaled statistics and their hinges at quantiles."""

    mean: np.ndarray
    scale: np.ndarray
    knots: np.ndarray = field(default_factory=lambda: np.zeros((0, N_STATS)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.5

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -SPAN, SPAN)

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = self.scaled(x)
        parts = [np.ones((len(z), 1)), z, *[np.maximum(0, z - k) for k in self.knots]]
        return np.hstack(parts)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sig(self.basis(x) @ self.weights)


#: Scaled statistics are cut at this many deviations; bins of the histograms that knots come from.
SPAN, BINS = 8, 128


def _sig(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def risk(w: np.ndarray, a: np.ndarray, b: np.ndarray, prior: float | None) -> tuple[float, np.ndarray, bool]:
    """Value and gradient of the unbiased risk of positives ``a`` and unlabelled rows ``b``, and whether its second
    part isn't negative; without a prior, of telling positives from unlabelled rows.  If the second part is
    negative, value and gradient are those of that part with its sign turned: the step goes against it."""
    fa, fb = a @ w, b @ w
    first, slope = np.logaddexp(0, -fa).mean(), a.T @ (_sig(fa) - 1) / len(a)
    second, down = np.logaddexp(0, fb).mean(), b.T @ _sig(fb) / len(b)
    if prior is None:
        return first + second, slope + down, True
    second, down = second - prior * np.logaddexp(0, fa).mean(), down - prior * (a.T @ _sig(fa)) / len(a)
    if second < 0:
        return -second, -down, False
    return prior * first + second, prior * slope + down, True


def descend(a: np.ndarray, b: np.ndarray, prior: float | None, p: PuParams) -> np.ndarray:
    """Weights after ``steps`` steps of Adam."""
    w, m, v = (np.zeros(a.shape[1]) for _ in range(3))
    for t in range(1, p.steps + 1):
        g = risk(w, a, b, prior)[1] + p.decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _matrix(x: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x), "<f8").reshape(-1, N_STATS)


def sums(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over all rows of the ``width`` numbers that ``f`` gives for a block of statistics."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for b in batches:
            total += f(_matrix(b["x"]))
        yield pd.DataFrame({"v": [total]})

    parts = map_pandas(rows.select("x"), run, "v array<double>")
    got = parts.agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(width)]).first()
    return np.array([v or 0.0 for v in got])


def scales(rows: DataFrame) -> tuple[Model, int]:
    """Means, deviations and knots (quantiles 0.05, 0.5, 0.95 to a part of a bin) of all rows, and their number."""
    got = sums(rows, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]), 1 + 2 * N_STATS)
    n = max(1, int(got[0]))
    mean = got[1 : 1 + N_STATS] / n
    model = Model(mean, np.sqrt(np.maximum(0, got[1 + N_STATS :] / n - mean**2)) + 1e-6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(N_STATS * BINS, np.int64)
        for b in batches:
            at = np.minimum(BINS - 1, ((model.scaled(_matrix(b["x"])) + SPAN) * (BINS / 2 / SPAN)).astype(np.int64))
            total += np.bincount((at + np.arange(N_STATS) * BINS).ravel(), minlength=N_STATS * BINS)
        k = np.flatnonzero(total)
        yield pd.DataFrame({"k": k, "n": total[k]})

    counts = np.zeros(N_STATS * BINS)
    for k, c in map_pandas(rows.select("x"), run, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        counts[k] = c
    edges = np.linspace(-SPAN, SPAN, BINS + 1)
    below = np.hstack([np.zeros((N_STATS, 1)), counts.reshape(N_STATS, BINS).cumsum(axis=1)])
    model.knots = np.array([[np.interp(q * n, c, edges) for c in below] for q in (0.05, 0.5, 0.95)])
    return model, int(got[0])


def estimated_prior(first: Model, pos: np.ndarray, rows: DataFrame, n: int) -> float:
    """Least ratio of the shares of unlabelled rows and of positives above a score, over scores of positives."""
    sa = first.basis(pos) @ first.weights
    cuts = np.quantile(sa, np.linspace(0.02, 0.7, 60))
    above = sums(rows, lambda x: (first.basis(x) @ first.weights >= cuts[:, None]).sum(axis=1).astype(float), len(cuts))
    ratios = [(k / n + 1 / np.sqrt(n) / 4) / (sa >= cut).mean() for k, cut in zip(above, cuts, strict=True)]
    return float(min(0.98, max(0.02, min(ratios))))


def mean_weights(model: Model, pos: np.ndarray, rows: DataFrame, n: int, prior: float | None, p: PuParams) -> np.ndarray:
    """Mean over blocks of all ``n`` rows (row, x) of the weights of least risk, weighted by their rows."""
    blocks, width = max(1, round(n / p.block_rows)), model.basis(pos[:1]).shape[1]

    def run(block: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(block.sort_values(["row"])["x"])
        return pd.DataFrame({"v": [descend(model.basis(pos), model.basis(x), prior, p) * len(x)]})

    ship(rows.sparkSession)
    dealt = rows.select("row", "x", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    parts = dealt.groupBy("block").applyInPandas(run, "v array<double>")
    got = parts.agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(width)]).first()
    return np.round(np.array(got, float) / n, 9)


def fit(pos: pd.DataFrame, rows: DataFrame, p: PuParams = PuParams()) -> Model:
    """Model from a sample of positives (x, half) and all unlabelled rows (row, x, half)."""
    model, n = scales(rows)
    x, seen = _matrix(pos["x"]), (pos["half"] == 0).to_numpy()
    # The prior from one half of the documents, of which the first model has seen the others.
    left, right = rows.where("half = 0"), rows.where("half = 1")
    n_left = left.count()
    model.prior = 0.98
    if seen.any() and not seen.all() and 0 < n_left < n:
        first = replace(model, weights=mean_weights(model, x[seen], left, n_left, None, p))
        model.prior = estimated_prior(first, x[~seen], right, n - n_left)
    model.weights = mean_weights(model, x, rows, n, model.prior, p)
    return model


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, x, row): the statistics of each whole text as doubles in bytes, and a number of the row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": [stats(t).astype("<f8").tobytes() for t in b["text"]]})

    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_pandas(docs, run, "doc_id long, x binary").withColumn("row", F.monotonically_increasing_id())


def learn(described: DataFrame, labels: DataFrame, p: PuParams = PuParams()) -> Model | None:
    """Fits on rows outside fold 0.  ``described`` is read five times and should be a stored table."""
    rows = described.where(fold(F.col("doc_id"), p.folds) != 0).withColumn("half", F.xxhash64("doc_id", F.lit(2)).bitwiseAND(F.lit(1)))
    good = pick(labels, "doc_id", "quality").where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # One row for each labelled document, however often it is in the table.
    pos = rows.join(good, "doc_id").groupBy("doc_id", "half").agg(F.min("x").alias("x"))
    pos = pos.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_positives).toPandas()
    if not len(pos):
        return None
    return fit(pos, rows, p)


def train(docs: DataFrame, labels: DataFrame, p: PuParams = PuParams()) -> Model | None:
    """``learn`` from documents."""
    with steps(docs.sparkSession) as own:
        return learn(own.put("described", describe(docs)), labels, p)


def scored(described: DataFrame, model: Model | None, p: PuParams = PuParams()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every described document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(_matrix(b["x"])) if model else np.full(len(b), 0.5)})

    out = map_pandas(described.select("doc_id", "x"), run, "doc_id long, score double")
    return out.select(
        "doc_id", (fold(F.col("doc_id"), p.folds) == 0).alias("held_out"), "score",
        (F.col("score") >= p.threshold).cast("int").alias("predicted"),
    )


def classify(docs: DataFrame, model: Model | None, p: PuParams = PuParams()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, in one pass over the texts."""
    return scored(describe(docs), model, p)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = materialize(describe(table(spark, sf_dir, "documents")), "described")
    return scored(described, learn(described, table(spark, sf_dir, "labels")))
