"""Quality rules with risk-controlled thresholds (operator 10), DataFrame functions only.

Fixed base rules reject texts that are too short or repeat themselves.  Further
rules compare a feature with a cutoff.  Labelled holdout documents select each
cutoff: for every stratum (language) and rule those cutoffs of a fixed grid are
proven for which an exact binomial bound shows that at most ``alpha / rules``
of the good documents lie above.  The confidence ``delta`` is shared over all
strata and rules (Bonferroni); going down the grid needs no further share,
because the false-rejection rate only grows and the search stops at the first
cutoff that isn't proven, so all proven ones hold together and any may be chosen.
Of those that reject no more labelled good documents than bad ones, the highest
is taken that rejects the most bad ones; where the labels show no bad one to
reject, the lowest that rejects no good one; where all reject mostly good ones,
the rule has no cutoff.  So with probability ``1 - delta`` no stratum loses
more than ``alpha`` of its good documents to these rules.  A stratum with too
few labels proves no cutoff and rejects nothing.

Defined results: null or empty text has no words and fails the base rule; null
``doc_id`` is kept as null; repeated rows give repeated results; further columns
of the input are ignored by ``features`` and kept by ``filter_documents``; an
empty table gives an empty result; documents of a stratum without labels face
the base rules only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bruit.llm.common import beside, materialize, pick, restored, table, words

#: (rule, width of a grid step, number of steps)
RULES = (
    ("symbols_per_word", 0.05, 60),
    ("dup_line_share", 0.02, 50),
    ("exclaims_per_word", 0.05, 60),
)


@dataclass(frozen=True)
class RiskParams:
    """``alpha``: share of a stratum's good documents that may be lost; ``delta``: chance that this fails.
    Tables of up to ``max_broadcast`` rows go to all tasks."""

    alpha: float = 0.05
    delta: float = 0.1
    max_broadcast: int = 500_000


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts, ``base_failed`` and the features of the rules; rows stay in place (no shuffle).

    A document's repeated five-word windows are found inside its row: hashes of
    all windows, and only where two are equal a sort of (hash, position).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__w", words(F.col(text)))
    df = df.withColumn("__wh", F.transform("__w", lambda w: F.xxhash64(w)))
    wh = F.col("__wh")
    window = lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(5)])
    starts = F.sequence(F.lit(0), F.size("__wh") - 5)
    none = F.array().cast("array<bigint>")
    df = df.withColumn("__g", F.when(F.size("__wh") >= 5, F.transform(starts, window)).otherwise(none))
    paired = F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    df = df.withColumn(
        "__s",
        F.when(F.size(F.array_distinct("__g")) < F.size("__g"), F.sort_array(paired)),
    )
    s = F.col("__s")
    same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
    near = F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False)))
    df = df.withColumn("__p", F.sort_array(F.transform(near, lambda x: x["p"])))
    # Windows start at sorted positions: each adds the words that the one before doesn't cover.
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(-5).alias("at"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(5), p - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = (
        df.withColumn("n_words", F.size("__w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("__exclaims", F.regexp_count(t, F.lit("!")))
        .withColumn("__l", lines)
        .withColumn("__lines", F.size("__l"))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    )
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return (
        df.withColumn("base_failed", failed)
        .withColumn("symbols_per_word", F.col("n_symbols") / n)
        .withColumn("dup_line_share", F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1)))
        .withColumn("exclaims_per_word", F.col("__exclaims") / n)
        .drop("__w", "__wh", "__g", "__s", "__p", "__l", "__lines", "__exclaims")
    )


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, exact up to rounding, by the incomplete beta function's continued fraction."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    return _beta_inc(n - k, k + 1, 1.0 - p)


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_inc(b, a, 1.0 - x)
    log = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(100_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return math.exp(log) * (f - 1.0) / a


def _stratum(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _provable(n: Column, limit: float, level: float) -> Column:
    """The most documents of ``n`` above a cutoff that prove it: the largest k with P(X <= k) <= ``level``, -1 if there is none."""
    first = n * F.lit(math.log1p(-limit))
    at = F.struct(first.alias("log"), F.exp(first).alias("p"), F.when(F.exp(first) <= level, 0).otherwise(-1).cast("long").alias("k"))
    odds = math.log(limit) - math.log1p(-limit)

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1) / i) + F.lit(odds)
        p = a["p"] + F.exp(log)
        return F.struct(log.alias("log"), p.alias("p"), F.when(p <= level, i).otherwise(a["k"]).alias("k"))

    # Beyond the mean the probability is about a half at least.
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.ceil(n * F.lit(limit))), at, step, lambda a: a["k"])


def cutoffs(counted: DataFrame, labels: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """(lang, rule, step): the cutoffs ``step`` times the rule's width, from documents with counts and ``labels``
    (doc_id, quality 1 = good).  A document with conflicting labels is good; rows with the same doc_id count once in a stratum.  Strata without good labels have none."""
    labels = pick(labels, "doc_id", "quality").where("quality is not null")
    labels = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"))
    counted = counted.select("doc_id", _stratum(F.col("lang")).alias("lang"), "base_failed", *[r for r, _, _ in RULES])
    held = counted.where("not base_failed").join(labels, "doc_id")
    # Rows of one document are one draw, and it is above a cutoff if one of them is.
    held = held.groupBy("doc_id", "lang", "good").agg(*[F.max(r).alias(r) for r, _, _ in RULES])
    steps = F.array(*[
        F.struct(F.lit(k).alias("rule"), F.least(F.ceil(F.col(r) / w), F.lit(n + 1)).cast("int").alias("step"))
        for k, (r, w, n) in enumerate(RULES)
    ])
    cells = held.select("lang", "good", F.explode(steps).alias("x")).groupBy("lang", "x.rule", "x.step")
    cells = materialize(cells.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")), "cells")
    # A row for each stratum and rule, with a cell for each step of the grid at most.
    rows = cells.groupBy("lang", "rule").agg(F.collect_list(F.struct("step", "good", "bad")).alias("cells"), F.sum("good").alias("n"))
    rows = rows.where("n > 0")
    limit = params.alpha / len(RULES)
    rows = rows.withColumn("most", _provable(F.col("n"), limit, params.delta / max(1, rows.count())))
    none = F.lit(0).cast("long")
    above = lambda what, at: F.aggregate("cells", none, lambda s, c: s + F.when(c["step"] > at, c[what]).otherwise(none))
    grid = F.get(F.array(*[F.lit(n) for _, _, n in RULES]), F.col("rule"))
    tried = F.transform(F.sequence(F.lit(0), grid), lambda k: F.struct(above("bad", k).alias("bad"), k.alias("step"), above("good", k).alias("good")))
    rows = rows.withColumn("tried", tried)
    fit = F.filter("tried", lambda x: (x["good"] <= F.col("most")) & (x["good"] <= x["bad"]))
    rows = rows.withColumn("fit", fit).where(F.size("fit") > 0)
    best = F.array_max("fit")  # most bad documents, then the highest step
    lowest = F.array_min(F.transform("fit", lambda x: x["step"]))
    return rows.select("lang", "rule", F.when(best["bad"] > 0, best["step"]).otherwise(lowest).alias("step"))


def calibrate(counted: DataFrame, labels: DataFrame, params: RiskParams = RiskParams()) -> dict[str, dict[str, float]]:
    """The table of ``cutoffs`` as {stratum: {rule: cutoff}}, for a look at it."""
    out: dict = {}
    for r in cutoffs(counted, labels, params).collect():
        rule, width, _ = RULES[r["rule"]]
        out.setdefault(r["lang"], {})[rule] = r["step"] * width
    return out


def verdict(counted: DataFrame, cuts: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """Adds ``kept``: false where the base rules or a proven cutoff of the document's stratum reject."""
    at = [F.max(F.when(F.col("rule") == k, F.col("step"))).alias(f"__c{k}") for k in range(len(RULES))]
    cuts = materialize(cuts.groupBy(F.col("lang").alias("__lang")).agg(*at), "cutoffs")
    cuts = F.broadcast(cuts) if cuts.count() <= params.max_broadcast else cuts
    bad = F.lit(False)
    for k, (rule, width, _) in enumerate(RULES):
        bad = bad | F.coalesce(F.ceil(F.col(rule) / width) > F.col(f"__c{k}"), F.lit(False))
    joined = counted.join(cuts, _stratum(F.col("lang")) == F.col("__lang"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~bad).drop("__lang", *[f"__c{k}" for k in range(len(RULES))])


def filter_documents(docs: DataFrame, labels: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """The documents that all rules keep, with the columns they came with.

    One pass over the texts stores the counts, for calibration and verdict.  What is rejected goes by an
    anti-join on two hashes of the row's id, language and text; its size is counted, and only up to
    ``max_broadcast`` rows go to all tasks.
    """
    row = ("doc_id", "lang", "text")
    keys = {"k1": F.xxhash64(*row), "k2": F.xxhash64(F.lit(7), *row)}
    counted = materialize(with_counts(pick(docs, *row).withColumns(keys)).drop("text"), "counted")
    gone = verdict(counted, cutoffs(counted, labels, params), params).where("not kept").select("k1", "k2").distinct()
    gone = F.broadcast(gone) if gone.count() <= params.max_broadcast else gone
    return restored(beside(docs, *row).withColumns(keys).join(gone, ["k1", "k2"], "left_anti"), docs)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "lang", "text")
    counted = materialize(with_counts(docs).drop("text"), "counts")
    return verdict(counted, cutoffs(counted, table(spark, sf_dir, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
