"""N-gram Jaccard join by points of group counts (operator 8).

A document's shingles are hashed into groups; its counts per group are a point.
For two documents the sum of coordinate minima bounds their overlap, for two
nodes of a tree the sum of minima of their upper corners does.

A single tree over whole points can't be dealt to machines: documents of
similar size lie in each other's search range almost regardless of content.  So
its upper part routes by blocks of coordinates.  Sizes fall into classes; if
two documents of a class reach similarity t, at most d = 2u(1-t)/(1+t) shingles
(u: the class's largest size) stand in one set alone, so of m > d blocks of
groups at least m - d are equal in both.  A document goes to a leaf for each
block (class, block, content of the block), and to those of the next class if a
partner may be there.  Blocks without shingles make no leaf, or unrelated
documents would meet there; a document with m - d or more of them is also cut
by another hash.

Equal sets are one point.  In turns, each leaf chooses a leader, which meets a
member of every other component of the leaf; of the pairs of a component that
pass the bound the one with the highest bound is verified against the sets, and
components that are linked become one.  Leaves with one component left are done.
When a turn finds little, the members of the other leaves are packed into
pages, and pairs of pages, then of nodes, whose corners leave room for the
similarity give the pairs in different components that pass the bound, each
pair in the first leaf that both have; these are all verified.  So no link
between components is lost, and a large group of near copies costs about one
verified pair for each member, not all pairs.

Sets are exact up to 64-bit hashes of shingles.

Defined results: null, empty or blank text has no shingles and is linked with
nothing; null ``doc_id`` gets a null component and is linked with nothing; rows
with an equal id get one component, with the links of all their texts; an empty
table gives an empty result; further columns are ignored by ``link`` and kept by
``filter_documents``.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bruit.llm.common import Steps, beside, components, map_pandas, materialize, pick, restored, steps, table
from bruit.llm.shingles import mix, shingles, signed, sum64


@dataclass(frozen=True)
class JoinParams:
    """Similarity of at least ``num / den`` on ``words``-word shingles.

    A document has about 2.2 (1 - t) leaves for each shingle.  More ``slices`` of leaves need less disk at
    a time and hash the texts again for each.
    """

    words: int = 5
    num: int = 80
    den: int = 100
    groups: int = 128
    fine_groups: int = 2048
    class_ratio: float = 0.65
    page: int = 256
    node: int = 16
    slices: int = 1
    broadcast_ids: int = 500_000

    def enough(self, overlap, total):
        """Whether ``overlap`` of sets with ``total`` elements together suffices; exact in integers."""
        return overlap * (self.num + self.den) >= total * self.num

    def differing(self, u: int) -> int:
        """Shingles that at most stand in one set alone, for two sets of at most ``u`` that reach the similarity."""
        return 2 * u * (self.den - self.num) // (self.den + self.num)


_classes: dict[float, list[int]] = {}


def _class(n: int, p: JoinParams) -> tuple[int, list[int]]:
    """Number of the size class of ``n``, and the classes' least sizes (one more than needed at the end)."""
    low = _classes.setdefault(p.class_ratio, [1])
    while len(low) < 3 or low[-3] <= n:
        low.append(int(low[-1] / p.class_ratio) + 1)
    return bisect_right(low, n) - 1, low


_levels: dict[tuple, tuple[int, int]] = {}


def _level(c: int, low: list[int], p: JoinParams) -> tuple[int, int]:
    """(blocks, differing) of class ``c``: at most ``differing`` of the blocks differ in a pair that reaches the similarity.

    There are so many blocks that even the smallest set of the class leaves fewer of them empty, as a rule,
    than are equal.
    """
    key = (c, p.num, p.den, p.class_ratio)
    if key not in _levels:
        d = p.differing(low[c + 1] - 1)
        least = max(1, low[c] * p.num // p.den)
        m = next((m for m in range(d + 1, 3 * d + 3) if m - d > (e := m * math.exp(-least / m)) + 2 * math.sqrt(e)), d + 1)
        _levels[key] = m, d
    return _levels[key]


def _block_keys(s: np.ndarray, m: int, d: int, salt: int, depth: int = 0) -> list[np.ndarray]:
    part = (mix(s, 0x51 + 7919 * depth) % np.uint64(m)).astype(np.int64)
    v = mix(s, 0xA3 + depth)
    # Sums of 64-bit values by halves, which stay exact in doubles.
    lo = np.bincount(part, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), m).astype(np.uint64)
    hi = np.bincount(part, (v >> np.uint64(32)).astype(np.float64), m).astype(np.uint64)
    full = np.bincount(part, minlength=m) > 0
    keys = mix((hi << np.uint64(32)) + lo + mix(np.arange(m, dtype=np.uint64) + np.uint64(salt), 0xC0FFEE + depth))
    if full.sum() > d:  # of the m - d equal blocks of a pair at least one isn't empty
        return [keys[full]]
    # A partner that is equal in empty blocks alone has as many of them and comes here too.
    return [keys] if depth >= 4 else [keys[full], *_block_keys(s, m, d, salt, depth + 1)]


def leaf_keys(s: np.ndarray, p: JoinParams) -> np.ndarray:
    """Leaves (64-bit keys) where a set meets every set that it may reach the similarity with."""
    if not len(s):
        return np.zeros(0, np.int64)
    n = len(s)
    k, low = _class(n, p)
    keys = []
    for c in (k, k + 1):
        if c == k or n * p.den >= low[c] * p.num:
            keys += _block_keys(s, *_level(c, low, p), 0x9E37 * (c + 1))
    return np.unique(np.concatenate(keys)).view(np.int64)


def point(s: np.ndarray, p: JoinParams) -> bytes:
    """Counts per group in a byte each.  What a byte can't hold is the set's excess: its size less the counts' sum."""
    group = (mix(s, 0x77) % np.uint64(p.groups)).astype(np.int64)
    return np.minimum(np.bincount(group, minlength=p.groups), 255).astype(np.uint8).tobytes()


POINT = "doc_id long, n long, sig1 long, sig2 long, point binary"


def points(docs: DataFrame, p: JoinParams, packed: bool = False) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                s = shingles(text, p.words)
                sigs = signed(sum64(mix(s, 1))), signed(sum64(mix(s, 2)))
                at = point(s, p)
                rows.append((doc_id, len(s), *sigs, zlib.compress(at, 1) if packed else at))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "sig1", "sig2", "point"])
            yield out.astype({"doc_id": "Int64"})

    return map_pandas(docs, run, POINT)


def leaves(docs: DataFrame, p: JoinParams, piece: int = 0) -> DataFrame:
    """(key, id): the leaves of each document in one slice of the key space."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.iloc[k : k + 500]
                keys = [leaf_keys(shingles(t, p.words), p) for t in part["text"]]
                if p.slices > 1:
                    keys = [x[x.view(np.uint64) % np.uint64(p.slices) == piece] for x in keys]
                ids = np.repeat(part["doc_id"].to_numpy(np.int64), [len(x) for x in keys])
                yield pd.DataFrame({"key": np.concatenate(keys), "id": ids})

    return map_pandas(docs, run, "key long, id long")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, id, lead) of all leaves with two rows or more, from rows sorted by key; a leaf's first row leads.

    Only the last row stays in memory from batch to batch.
    """
    last_key, lead, alone = None, None, False
    for b in batches:
        k, i = b["key"].to_numpy(), b["id"].to_numpy()
        first = np.concatenate([[last_key is None or k[0] != last_key], k[1:] != k[:-1]])
        leads = np.concatenate([[i[0] if lead is None else lead], i[first]])[np.cumsum(first)]
        more = np.concatenate([~first[1:], [False]])  # the next row is of the same leaf
        keep = ~first | more
        k, i, keep_leads = k[keep], i[keep], leads[keep]
        if alone and not first[0]:  # the row that ended the last batch was the first of this leaf
            k, i, keep_leads = np.append(k, last_key), np.append(i, lead), np.append(keep_leads, lead)
        yield pd.DataFrame({"key": k, "id": i, "lead": keep_leads})
        last_key, lead, alone = b["key"].iat[-1], leads[-1], bool(first[-1])


def shared_leaves(docs: DataFrame, p: JoinParams, own: Steps) -> DataFrame:
    """(key, id, lead) for the leaves that hold several documents, with the member that leads each.

    The key space is worked through in slices, so the shuffle's files of one slice are on disk at a time.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = None
    for i in range(p.slices):
        rows = leaves(docs, p, i).repartition(n, "key")
        # id XOR key puts a leaf's members in an order of its own.
        rows = rows.sortWithinPartitions("key", F.col("id").bitwiseXOR(F.col("key")))
        part = own.put(f"leaves{i}", map_pandas(rows, _runs, "key long, id long, lead long"))
        out = part if out is None else out.unionByName(part)
    return out


def sets(docs: DataFrame, p: JoinParams) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.iloc[k : k + 500]
                yield pd.DataFrame({"id": part["doc_id"], "items": [shingles(t, p.words).tobytes() for t in part["text"]]})

    return map_pandas(docs, run, "id long, items binary")


def _only(docs: DataFrame, ids: DataFrame, n: int, how: str, p: JoinParams) -> DataFrame:
    """Documents (not) among ``ids`` (id), of which there are at most ``n``.  A short list goes to all tasks; a long
    one joins by shuffle."""
    ids = ids.select(F.col("id").alias("doc_id"))
    return docs.join(F.broadcast(ids) if n <= p.broadcast_ids else ids, "doc_id", how)


PAIR = "a long, b long, ca long, cb long"


def _slices(batches: Iterator[pd.DataFrame], rows: int = 2000) -> Iterator[pd.DataFrame]:
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.iloc[k : k + rows]


def finer(pairs: DataFrame, n: int, texts: DataFrame, p: JoinParams) -> DataFrame:
    """Of ``n`` pairs (a, b, ca, cb) those that a bound over more groups leaves, for which the texts are hashed again.

    Its points, compressed, are a tenth of the sets, so pairs that don't link needn't bring these.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    fine = points(_only(texts, ids, 2 * n, "left_semi", p), replace(p, groups=p.fine_groups), packed=True)
    return bounded(pairs, fine, p, packed=True).drop("score")


def bounded(pairs: DataFrame, pts: DataFrame, p: JoinParams, packed: bool = False) -> DataFrame:
    """The pairs (a, b, and their components ca, cb) whose summed coordinate minima leave room for the similarity,
    with that bound of it as ``score``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            x, y = (np.frombuffer(b"".join(map(zlib.decompress, b[c]) if packed else b[c]), np.uint8).reshape(len(b), -1) for c in ("pa", "pb"))
            over = np.minimum(b["na"] - x.sum(axis=1, dtype=np.int64), b["nb"] - y.sum(axis=1, dtype=np.int64)).to_numpy()
            most, total = np.minimum(x, y).sum(axis=1, dtype=np.int64) + over, (b["na"] + b["nb"]).to_numpy()
            ok = p.enough(most, total)
            yield b.loc[ok, ["a", "b", "ca", "cb"]].assign(score=(most / np.maximum(total, 1))[ok])

    own = lambda x: pts.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"))
    return map_pandas(pairs.join(own("a"), "a").join(own("b"), "b"), run, f"{PAIR}, score double")


def verified(pairs: DataFrame, n: int, texts: DataFrame, p: JoinParams) -> DataFrame:
    """Of ``n`` pairs (a, b, ca, cb) those whose sets reach the similarity.  Only their own texts are hashed again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b["ia"], b["ib"], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
                ok.append(bool(len(x)) and bool(p.enough(int((y[at] == x).sum()), len(x) + len(y))))
            yield b.loc[np.array(ok, bool), ["a", "b", "ca", "cb"]]

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    items = sets(_only(texts, ids, 2 * n, "left_semi", p), p)
    own = lambda x: items.select(F.col("id").alias(x), F.col("items").alias(f"i{x}"))
    return map_pandas(pairs.join(own("a"), "a").join(own("b"), "b"), run, PAIR)


FIRST = [f"f{i}" for i in range(4)]


def _twins(ids, comps, n, pts, first, keys, p: JoinParams, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows (x, y) those that this leaf has to give: in different components, past the bound, and
    without an earlier leaf in common among the first ones of each."""
    ok = comps[x] != comps[y]
    x, y = x[ok], y[ok]
    ok = p.enough(np.minimum(pts[x], pts[y]).sum(axis=1), n[x] + n[y])
    x, y = x[ok], y[ok]
    met = ((first[x][:, :, None] == first[y][:, None, :]) & (first[x] < keys[x][:, None])[:, :, None]).any(axis=(1, 2))
    return x[~met], y[~met]


def _page_pairs(comps, n, pts, other: np.ndarray, own: np.ndarray, p: JoinParams) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two pages in nodes whose corners leave room for the similarity."""
    mine, theirs = _nodes(n, own, p), _nodes(n, other, p)
    top_x, low_x = (np.array([f(v[x]) for x in mine]) for f, v in ((lambda a: a.max(axis=0), pts), (np.min, n)))
    top_y, low_y = (np.array([f(v[y]) for y in theirs]) for f, v in ((lambda a: a.max(axis=0), pts), (np.min, n)))
    if not p.enough(int(np.minimum(top_x.max(axis=0), top_y.max(axis=0)).sum()), int(low_x.min() + low_y.min())):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, x in enumerate(mine):
        near = p.enough(np.minimum(top_x[i], top_y).sum(axis=1), low_x[i] + low_y)
        y = np.concatenate([np.zeros(0, np.int64), *(theirs[j] for j in np.flatnonzero(near))])
        left.append(np.repeat(x, len(y)))
        right.append(np.tile(y, len(x)))
    return np.concatenate(left), np.concatenate(right)


def _nodes(n: np.ndarray, page: np.ndarray, p: JoinParams) -> list[np.ndarray]:
    page = page[np.argsort(n[page], kind="stable")]
    return [page[i : i + p.node] for i in range(0, len(page), p.node)]


def rest_pairs(members: DataFrame, pts: DataFrame, p: JoinParams) -> DataFrame:
    """Pairs (a, b, ca, cb) of members of the same leaf, in different components, that pass the bound.

    members: (key, id, comp).  Each row brings the least keys of its document's leaves, so that of the many leaves
    that near copies share only the first one gives their pair.  In a leaf the members of its largest component
    meet the others alone; both are dealt into pages, and pairs of pages are the tasks' units.
    """
    first = F.array_sort(F.collect_list("key"))  # as many as the document has leaves
    first = members.groupBy("id").agg(first.alias("first"))
    high = F.lit(2**63 - 1)
    first = first.select("id", *[F.coalesce(F.get("first", F.lit(i)), high).alias(c) for i, c in enumerate(FIRST)])
    info = first.join(pts.select(F.col("doc_id").alias("id"), "n", "point"), "id")
    size = members.groupBy("key", "comp").agg(F.count("*").alias("m"))
    size = size.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("m"))
    pages = lambda c: F.ceil(c / p.page).cast("int")
    size = size.select(
        "key", F.col("top.comp").alias("bulk"), pages(F.col("top.m")).alias("big"), pages(F.col("m") - F.col("top.m")).alias("small")
    )
    own = members.join(size, "key")
    is_bulk = F.col("comp") == F.col("bulk")
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    own = own.withColumn("page", F.when(is_bulk, deal(F.col("big"))).otherwise(F.col("big") + deal(F.col("small"))))
    last = F.col("big") + F.col("small") - 1
    own = own.withColumn("with", F.explode(F.sequence(F.when(is_bulk, F.col("big")).otherwise(F.lit(0)), last)))
    own = own.select("key", F.least("page", "with").alias("i"), F.greatest("page", "with").alias("j"), "page", "id", "comp")
    unit = ["key", "i", "j"]

    def emit(b: pd.DataFrame) -> pd.DataFrame:
        ids, comps, n, keys = (b[c].to_numpy(np.int64) for c in ("id", "comp", "n", "key"))
        pts = np.frombuffer(b"".join(b["point"]), np.uint8).reshape(len(b), p.groups).astype(np.int64)
        pts = np.hstack([pts, (n - pts.sum(axis=1))[:, None]])  # the excess bounds like one more coordinate
        page, i, j = (b[c].to_numpy() for c in ("page", "i", "j"))
        new = np.flatnonzero((np.diff(keys) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        lows, highs = np.array([0, *new]), np.array([*new, len(b)])
        two = highs - lows == 2
        some = [(lows[two], lows[two] + 1)]  # units of two rows, all at once
        for lo, hi in zip(lows[~two], highs[~two], strict=True):
            if (comps[lo:hi] == comps[lo]).all():
                continue
            rows = np.arange(lo, hi)
            mine, other = (rows, rows) if i[lo] == j[lo] else (rows[page[lo:hi] == i[lo]], rows[page[lo:hi] == j[lo]])
            if len(mine) and len(other):
                some.append(_page_pairs(comps, n, pts, other, mine, p))
        first = b[FIRST].to_numpy(np.int64)
        got = [_twins(ids, comps, n, pts, first, keys, p, x, y) for x, y in some]
        x, y = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        swap = ids[x] > ids[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        return pd.DataFrame({"a": ids[x], "b": ids[y], "ca": comps[x], "cb": comps[y]}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:  # units in order; the last of a batch may go on in the next
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            last = b[unit].iloc[-1]
            open_ = (b[unit] == last).all(axis=1).to_numpy()
            first = int(np.argmax(open_))
            held = b.iloc[first:].reset_index(drop=True)
            if first:
                yield emit(b.iloc[:first].reset_index(drop=True))
        if held is not None and len(held):
            yield emit(held)

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.join(info, "id").repartition(n, *unit).sortWithinPartitions(*unit, "page")
    return map_pandas(own, run, PAIR).distinct()


def _best(scored: DataFrame) -> DataFrame:
    """For each component its pair with the highest bound."""
    row = F.max(F.struct("score", "a", "b", "ca", "cb")).alias("r")
    own = scored.withColumn("own", F.explode(F.array("ca", "cb"))).groupBy("own").agg(row)
    return own.select("r.a", "r.b", "r.ca", "r.cb").distinct()


def _leaders(rest: DataFrame, turn: int) -> DataFrame:
    """In each leaf a member leads, another one each turn, and meets a member of every other component."""
    order = F.xxhash64("id", "key", F.lit(turn))
    by = rest.groupBy("key", "comp").agg(F.min(F.struct(order.alias("o"), "id")).alias("x"))
    top = by.groupBy("key").agg(F.min(F.struct("x.o", "x.id", "comp")).alias("lead"))
    both = by.join(top, "key").where(F.col("comp") != F.col("lead.comp"))
    return both.select(F.col("x.id").alias("x"), F.col("comp").alias("cx"), F.col("lead.id").alias("y"), F.col("lead.comp").alias("cy"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """(x, cx, y, cy) as distinct (a, b, ca, cb) with a < b."""
    first = F.col("x") < F.col("y")
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return pairs.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("cx", "cy").alias("ca"), pick("cy", "cx").alias("cb")).distinct()


def _hooked(links: DataFrame) -> DataFrame:
    """(id, component): the smallest component within two links (ca, cb) of each; so all that meet in a leader become one.

    Longer chains wait: labels only save work in the turns, all links count in the end.
    """
    both = links.select("ca", "cb").unionByName(links.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
    one = both.groupBy("ca").agg(F.min("cb").alias("m")).select("ca", F.least("ca", "m").alias("m"))
    two = both.join(one, "ca").groupBy(F.col("cb").alias("id")).agg(F.min("m").alias("component"))
    return two.where("component < id")


def _relabelled(df: DataFrame, comp: DataFrame, *cols: str) -> DataFrame:
    """Columns of components with their new names; ``comp`` (id, component) has those that changed."""
    for c in cols:
        new = comp.select(F.col("id").alias(c), F.col("component").alias("new"))
        df = df.join(new, c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
    return df


def link(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    with steps(docs.sparkSession) as own:
        return materialize(_link(docs, p, own), "linked")


def _link(docs: DataFrame, p: JoinParams, own: Steps) -> DataFrame:
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    every = own.put("points", points(docs, p))
    pts = every.where("n > 0 and doc_id is not null")
    sig = ["sig1", "sig2", "n"]
    classes = pts.groupBy(*sig).agg(F.min("doc_id").alias("rep"))
    # Equal sets are one point, that of their smallest id; only it goes to leaves.
    member = own.put("member", pts.select("doc_id", *sig).join(classes, sig).select("doc_id", "rep").distinct())
    copies = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # An id with several texts may stand for another set as well, and then goes there, too.
    others = member.where("doc_id = rep").select(F.col("doc_id").alias("id"))
    gone = own.put("gone", copies.select(F.col("a").alias("id")).distinct().join(others, "id", "left_anti"))
    texts = _only(docs.where("doc_id is not null"), gone, gone.count(), "left_anti", p)

    members = shared_leaves(texts, p, own)
    # Leaves with the same members (by number, ends and three hash sums) search the same pairs: one of them is enough.
    sums = [F.sum(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 30))).alias(f"s{i}") for i in range(3)]
    size = members.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("a"), F.max("id").alias("b"), *sums)
    size = own.put("size", size.groupBy("m", "a", "b", "s0", "s1", "s2").agg(F.min("key").alias("key")))
    # Leaves of two have one pair, which is kept; those of more are searched.
    both = size.where("m = 2 and a <> b").select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
    pool = own.put("pool", bounded(both, pts, p))
    rest = members.join(size.where("m > 2").select("key"), "key").select("key", "id", F.col("id").alias("comp"))
    rest = own.put("rest", rest)
    own.drop("size", *[f"leaves{i}" for i in range(p.slices)])
    links, turn = [], 0
    while True:
        best = own.put("best", _best(bounded(_ordered(_leaders(rest, turn)), pts, p).unionByName(pool)))
        tried = best.count()
        # Most of the first turn's pairs link, most of the later ones don't.
        near = own.put("fine", finer(best, tried, texts, p)) if turn else best
        found = own.put(f"found{turn}", verified(near, tried, texts, p))
        links.append(found)
        joined = found.count()
        if joined:
            new = own.put("new", _hooked(found))
            pool = _relabelled(pool.join(best, ["a", "b"], "left_anti"), new, "ca", "cb").where("ca <> cb")
            pool = own.put("pool", pool.select("a", "b", "ca", "cb", "score"))
            rest = _relabelled(rest, new, "comp")
            open_ = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
            rest = own.put("rest", rest.join(open_, "key").select("key", "id", "comp"))
        turn += 1
        # Further turns are worth their cost as long as they find much; what they leave is searched below.
        if joined * 2 <= tried:
            break
    comp = links[0].select("a", "b")
    for x in links[1:]:
        comp = comp.unionByName(x.select("a", "b"))
    comp = own.put("comp", components(comp))
    pool = _relabelled(pool.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), comp, "ca", "cb").where("ca <> cb")
    rest = _relabelled(rest.select("key", "id", F.col("id").alias("comp")), comp, "comp")
    open_ = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    rest = own.put("rest", rest.join(open_, "key").select("key", "id", "comp"))
    more = own.put("more", rest_pairs(rest, pts, p).unionByName(pool).distinct())
    n = more.count()
    more = own.put("fine", finer(more, n, texts, p))
    last = own.put("last", verified(more, n, texts, p))
    known = comp.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    edges = copies.unionByName(known).unionByName(last.select("a", "b"))
    comp = components(edges).withColumnRenamed("id", "doc_id")
    return every.join(comp, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), JoinParams(words=3, num=90))


OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s FROM w),
z AS (SELECT doc_id, len(s) AS n FROM g),
u AS (SELECT doc_id, unnest(s) AS x FROM g),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE 100 * i >= 90 * (za.n + zb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS id, doc_id AS root FROM z UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id)
SELECT z.doc_id, n AS n_shingles, min(root) AS component_id FROM z JOIN c ON c.id = z.doc_id GROUP BY z.doc_id, n
"""


def filter_documents(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """One document of each component, the one with the smallest id, with the columns they came with.

    Of rows with the same id and text one stays; rows with an id in common but different texts, or without an id, all do.
    """
    linked = link(docs, p).where("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("k")).distinct()
    gone = pick(docs, "doc_id").select(F.col("doc_id").cast("long").alias("k")).distinct().join(linked, "k", "left_anti")
    key = ["k", "h1", "h2"]
    own = beside(docs, "doc_id", "text").withColumn("k", F.col("doc_id").cast("long"))
    own = own.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})
    kept = own.join(gone.where("k is not null"), "k", "left_anti")
    again = own.where("k is not null").groupBy(*key).count().where("count > 1").select(*key)
    again = materialize(again, "repeated")
    n = again.count()
    if not n:
        return restored(kept, docs)
    again = F.broadcast(again) if n <= p.broadcast_ids else again
    cols = [f"c{i}" for i in range(len(docs.columns))]
    shown = [F.to_json(F.struct(*cols))]
    order = F.struct(F.xxhash64(*shown), F.xxhash64(F.lit(7), *shown))
    one = kept.join(again, key, "left_semi").groupBy(*key).agg(F.min_by(F.struct(*cols), order).alias("row")).select("row.*")
    return restored(kept.join(again, key, "left_anti").select(*cols).unionByName(one), docs)
