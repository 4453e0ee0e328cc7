"""Language identification by prediction by partial matching (operator 12).

Each language has a tree of byte contexts of up to ``order`` bytes.  A text costs,
for each byte and in the longest context that the tree knows, -log2(n / (total +
kinds)) bits if that byte followed there n times, and else -log2(kinds / (total +
kinds)) bits to escape to the context that is a byte shorter; below no context
all 256 bytes cost eight bits.  Statistics are frozen: a text is scored by the
trees as trained, so its cost is exact whatever was scored before.  Costs are
kept as whole multiples of 2^-16 bit, so sums don't depend on the order of
additions.  The language with the shortest code is predicted; the score is its
share of 2^-bits over all languages.

Training counts the sequences of ``order`` + 1 bytes of every training text, per
task first; counts of shorter ones follow from these.  Nodes are kept from the
language's least count at which they fit its part of ``cells`` (a number for each
node and language), so what is broadcast is bounded (some times ``cells`` 32-bit numbers)
and a tree still holds the suffixes of whatever it holds.  The bound is the
model's size; counts cover all rows.  At most ``max_langs`` languages are
learned, those with the most bytes.  Texts are lower-cased, and
a text begins in the context of zero bytes.

Scoring is a scan: a batch's bytes are looked up together, in slices of bounded
size, the longest context first, and only bytes not found go on to shorter ones.

Defined results: null text, or one without a letter, is ``und`` with score 0; null
``doc_id`` hashes as the empty string; equal costs go to the smaller language by
code point; without a training text all are ``und``; repeated rows each count; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bruit.llm.common import map_pandas, materialize, pick, table

UNKNOWN = "und"


@dataclass(frozen=True)
class LangParams:
    """``order``: longest context in bytes (at most 6); ``cells``: bound of the model; ``slice_bytes``: text looked up at once."""

    order: int = 4
    cells: int = 1 << 21
    max_langs: int = 200
    slice_bytes: int = 1 << 20
    folds: int = 3
    held_out: int = 1


UNIT = 1 << 16
ALL_BYTES = 8 * UNIT
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column, p: LangParams) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % p.folds == p.held_out


def joined_bytes(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' lower-cased bytes, each behind ``order`` zeros, and where each text's bytes begin and the next text's zeros."""
    pad = b"\0" * order
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) + order for r in raw], np.int64)
    return np.frombuffer(b"".join(x for r in raw for x in (pad, r)), np.uint8), np.cumsum(size) - size


def keys_at(data: np.ndarray, length: int) -> np.ndarray:
    """For each byte the number that it and the ``length`` - 1 bytes before it spell; right from byte ``length`` - 1 on."""
    out = data.astype(np.uint64)
    for k in range(1, length):
        out[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def counts(docs: DataFrame, p: LangParams) -> DataFrame:
    """(lang, gram, n) of all sequences of ``order`` + 1 bytes in the training texts (lang, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[str, list] = {}
        for b in batches:
            for lang, part in b.groupby("lang"):
                for k in range(0, len(part), 64):  # a long text alone sets the size of a step
                    texts = part["text"].iloc[k : k + 64].tolist()
                    data, begin = joined_bytes(texts, p.order)
                    inside = np.ones(len(data), bool)
                    inside[(begin[:, None] + np.arange(p.order)).ravel()] = False
                    grams, n = np.unique(keys_at(data, p.order + 1)[inside], return_counts=True)
                    own = have.setdefault(lang, [])
                    own.append((grams, n))
                    if len(own) > 32:
                        have[lang] = [_counted(*map(np.concatenate, zip(*own, strict=True)))]
        for lang, own in have.items():
            grams, n = _counted(*map(np.concatenate, zip(*own, strict=True)))
            for k in range(0, len(grams), 100_000):
                yield pd.DataFrame({"lang": lang, "gram": grams[k : k + 100_000].astype(np.int64), "n": n[k : k + 100_000]})

    parts = map_pandas(docs, run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Nodes:
    """All nodes of all trees, a row each: number of the language, bytes, sequence, count."""

    langs: list[str]
    lang: np.ndarray
    length: np.ndarray
    gram: np.ndarray
    n: np.ndarray


def nodes(docs: DataFrame, p: LangParams) -> Nodes:
    """Counts over all training rows of (doc_id, text, lang); of the trees the nodes that fit ``cells``."""
    spark = docs.sparkSession
    train = docs.where(~held_out(F.col("doc_id"), p) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    longest = materialize(counts(train, p), "grams")
    size = longest.groupBy("lang").agg(F.sum("n").alias("bytes")).orderBy(F.desc("bytes"), "lang").limit(p.max_langs)
    langs = sorted(r.lang for r in size.collect())
    if not langs:
        return Nodes([], *[np.zeros(0, np.int64)] * 4)
    room = p.cells // len(langs) ** 2
    known = F.broadcast(spark.createDataFrame(list(enumerate(langs)), "at int, lang string"))  # at most max_langs rows
    cut = F.array(*[F.struct(F.lit(k).alias("length"), F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")) for k in range(1, p.order + 2)])
    every = longest.join(known, "lang").select("at", "n", F.explode(cut).alias("g")).groupBy("at", "g.length", "g.gram").agg(F.sum("n").alias("n"))
    # How many nodes have a count of 1, 2, 3, 4, 6, 8, ...: the least such step from which a language's nodes fit.
    step = F.when(F.col("n") < 2, F.lit(0)).otherwise(F.floor(F.log2(F.col("n").cast("double")) * 2).cast("int"))
    every = materialize(every.withColumn("step", step), "nodes")
    floors, have = dict.fromkeys(range(len(langs)), 1 << 30), dict.fromkeys(range(len(langs)), 0)
    for r in sorted(every.groupBy("at", "step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step):
        have[r.at] += r.n
        if have[r.at] <= room:
            floors[r.at] = r.step
    kept = F.broadcast(spark.createDataFrame(list(floors.items()), "at int, floor int"))
    rows = every.join(kept, "at").where("step >= floor or length = 1").select(F.col("at").cast("short").alias("at"), F.col("length").cast("short").alias("length"), "gram", "n").toArrow()
    return Nodes(langs, *[rows.column(c).to_numpy() for c in ("at", "length", "gram", "n")])


class Lookup:
    """Sorted keys as an open-addressing table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several the last one stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't there."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        at = self._home(keys)
        left = np.arange(len(keys))
        while len(left):
            slot = self.slots[at]
            full = slot >= 0
            hit = full & (self.keys[slot] == keys[left])
            out[left[hit]] = slot[hit]
            go = full & ~hit
            left, at = left[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out


def _bits(share: np.ndarray) -> np.ndarray:
    return np.round(-np.log2(share) * UNIT).astype(np.int32)


class Model:
    """Costs of all languages together: for each context length the sequences known to any, with each language's
    full cost of their last byte, and the contexts known to any, with each language's cost to escape (0 where
    it doesn't know the context)."""

    def __init__(self, t: Nodes, p: LangParams):
        self.p, self.langs = p, t.langs
        self.grams, self.costs, self.contexts, self.escapes = [], [], [], []
        for k in range(p.order + 1):
            mine = t.length == k + 1
            g, own, count = t.gram[mine].astype(np.uint64), t.lang[mine], t.n[mine].astype(np.float64)
            keys, at = np.unique(g, return_inverse=True)
            ctx, ctx_at = np.unique(g >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((2, len(ctx), len(self.langs)))
            np.add.at(total, (ctx_at, own), count)
            np.add.at(kinds, (ctx_at, own), 1.0)
            escape = np.zeros(total.shape, np.int32)
            there = kinds > 0
            escape[there] = _bits(kinds[there] / (total[there] + kinds[there]))
            self.contexts.append(Lookup(ctx))
            self.escapes.append(escape)
            # A language that doesn't know the sequence escapes to the shorter one, which it may know.
            cost = escape[self.contexts[k].find(keys >> np.uint64(8))] + self._shorter(keys, k)
            cost[at, own] = _bits(count / (total[ctx_at, own] + kinds[ctx_at, own]))
            self.grams.append(Lookup(keys))
            self.costs.append(cost.astype(np.int32))

    def _shorter(self, keys: np.ndarray, k: int) -> np.ndarray:
        return self.cost(keys & np.uint64((1 << 8 * k) - 1), k - 1)

    def cost(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Costs (byte, language) of the last byte of each key of ``k`` + 1 bytes."""
        out = np.zeros((len(keys), len(self.langs)), np.int32)
        left = np.arange(len(keys))
        for j in range(k, -1, -1):
            at = self.grams[j].find(keys[left])
            hit = at >= 0
            out[left[hit]] += self.costs[j][at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            ctx = self.contexts[j].find(keys[left] >> np.uint64(8))
            seen = ctx >= 0
            out[left[seen]] += self.escapes[j][ctx[seen]]
            keys = keys & np.uint64((1 << 8 * j) - 1)
        out[left] += ALL_BYTES
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Exact code length (text, language) in multiples of 2^-16 bit."""
        order, width = self.p.order, max(1, len(self.langs))
        data, begin = joined_bytes(texts, order)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        slice_ = max(1024, self.p.slice_bytes * 4 // width)
        owner = np.zeros(len(data) + 1, np.int32)
        np.add.at(owner, begin[1:], 1)
        owner = np.cumsum(owner[:-1])
        inside = np.ones(len(data), bool)
        inside[(begin[:, None] + np.arange(order)).ravel()] = False
        for k in range(order, len(data), slice_):
            keys = keys_at(data[k - order : k + slice_], order + 1)[order:]
            mine = inside[k : k + slice_]
            cost = self.cost(keys[mine], order).astype(np.int64)
            who = owner[k : k + slice_][mine]
            if len(who):
                first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                out[who[first]] += np.add.reduceat(cost, first, axis=0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if t is not None and self.langs and any(map(str.isalpha, t))]
        group, size = [], 0
        for i in at:  # texts together up to a slice, so memory follows the slice or the longest text
            group.append(i)
            size += len(texts[i])
            if size >= self.p.slice_bytes:
                self._group(group, texts, names, scores)
                group, size = [], 0
        self._group(group, texts, names, scores)
        return names, scores

    def _group(self, at: list[int], texts: list, names: list[str], scores: np.ndarray) -> None:
        if not at:
            return
        bits = self.lengths([texts[i] for i in at])
        best = bits.argmin(axis=1)
        over = (bits - bits.min(axis=1, keepdims=True)) / UNIT
        share = 1 / np.exp2(-np.minimum(over, 1000)).sum(axis=1)
        for i, j, s in zip(at, best, share, strict=True):
            names[i], scores[i] = self.langs[j], s


def train(docs: DataFrame, p: LangParams = LangParams()) -> Model:
    """Trees from the texts of (doc_id, text, lang) that aren't held out and have a language."""
    return Model(nodes(pick(docs, "doc_id", "text", "lang"), p), p)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document, from its text alone."""
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LangParams.cells

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names, scores = shared.value.predict(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": names, "score": scores})

    out = map_pandas(docs, run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), model.p).alias("held_out"), "lang_pred", "score")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs))
