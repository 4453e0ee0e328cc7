"""Joins of messages near in place by pairs of blocks.

Messages are sorted by tile and by what makes them alike, over all machines, and
cut into blocks of at most 2 to the power of ``bits`` rows of one tile.  Blocks
of the same and of adjacent tiles are paired by what is known of them (a row
each), and each pair that may hold a result is one group of bounded size, whose
rows are compared with numpy.  So a dense tile becomes many groups, no row is
compared with more than the blocks that its own may meet, and each is shipped
once for a pair of blocks instead of once for a pair of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bruit.operators.store import ship, stored, tidied, with_place

#: A tile and the half of its neighbours that meets each unordered pair of adjacent tiles once; all nine tiles.
HALF = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
ALL = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
BLOCK = ["tx", "ty", "blk"]


def blocked(df: DataFrame, order: list[str], bits: int) -> DataFrame:
    """``df`` (with tx, ty) written with its block: rows of a tile in a run of the order of ``order``, which must end in a unique column.

    Equal (tx, ty, blk) is a block.  Runs go on over the ends of parts, so blocks don't depend on how many parts there are.
    ``df`` is written first, since sorting reads it twice.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = ["tx", "ty", *order]
    with tidied(df.sparkSession) as keep:
        df = stored(df, "zstd")
        rows = df.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("mid", F.monotonically_increasing_id())
        rows = keep(stored(rows, "zstd"))
    return with_place(rows, "mid").withColumn("blk", F.shiftright("at", bits)).drop("at")


def copied(df: DataFrame, tiles: list[tuple[int, int]]) -> DataFrame:
    """``df`` at each of the ``tiles`` around its own (``ox``, ``oy``); ``home`` marks the copy that stays."""
    near = F.array(*[F.struct((F.col("tx") - i).alias("tx"), (F.col("ty") - j).alias("ty"), F.lit((i, j) == (0, 0)).alias("home")) for i, j in tiles])
    df = df.withColumn("tile", F.explode(near)).withColumnsRenamed({"tx": "ox", "ty": "oy"})
    return df.select("*", "tile.*").drop("tile")


def block_pairs(left: DataFrame, right: DataFrame, known: dict[str, Column], close: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], same: bool) -> DataFrame:
    """Pairs of blocks in adjacent tiles that may hold a result: (ltx, lty, lblk, rtx, rty, rblk, same).

    ``known`` are aggregates of a block; ``close`` tells from those of both (by name) whether they may meet.  Where
    ``same``, left and right are the same rows, and each unordered pair comes once.
    """
    about = lambda df: df.groupBy(*BLOCK).agg(*[c.alias(n) for n, c in known.items()])
    a = about(left).withColumnsRenamed({n: f"a_{n}" for n in [*known, "blk"]})
    b = copied(about(right), HALF if same else ALL).withColumnsRenamed({n: f"b_{n}" for n in [*known, "blk"]})
    met = a.join(b, ["tx", "ty"]).where(close(lambda n: F.col(f"a_{n}"), lambda n: F.col(f"b_{n}")))
    if same:
        met = met.where(~F.col("home") | (F.col("a_blk") <= F.col("b_blk")))
    return met.select(F.col("tx").alias("ltx"), F.col("ty").alias("lty"), F.col("a_blk").alias("lblk"), F.col("ox").alias("rtx"), F.col("oy").alias("rty"), F.col("b_blk").alias("rblk"), F.lit(same).alias("same"))


def meet_blocks(left: DataFrame, right: DataFrame, pairs: DataFrame, compare: Callable[[pa.Table, pa.Table, bool], Iterator[dict[str, np.ndarray]]], schema: str) -> DataFrame:
    """What ``compare`` gives, part by part, for the rows of each pair of blocks; its third argument says whether both are one
    block, whose rows are shipped once.

    ``left`` and ``right`` have the same columns; rows come to ``compare`` in no particular order.
    """
    ship(left.sparkSession)
    one = F.col("same") & (F.col("lblk") == F.col("rblk")) & (F.col("ltx") == F.col("rtx")) & (F.col("lty") == F.col("rty"))
    pairs = stored(pairs.select("*", one.alias("one"), F.monotonically_increasing_id().alias("pair")))

    def side(df: DataFrame, s: str) -> DataFrame:
        met = pairs if s == "l" else pairs.where("not one")
        at = met.select("pair", "one", F.col(f"{s}tx").alias("tx"), F.col(f"{s}ty").alias("ty"), F.col(f"{s}blk").alias("blk"))
        return at.join(df, BLOCK).drop(*BLOCK).withColumn("is_left", F.lit(s == "l"))

    both = side(left, "l").unionByName(side(right, "r"))
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        mask, same = table.column("is_left"), table.column("one")[0].as_py()
        rows = table.drop_columns(["pair", "one", "is_left"])
        a = rows.filter(mask)
        for found in compare(a, a if same else rows.filter(pc.invert(mask)), same):
            yield from pa.table({n: found[n] for n in names}).to_batches(max_chunksize=1 << 16)

    return both.groupBy("pair").applyInArrow(run, schema)


def integers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """A column of arrays of the same length as rows."""
    col = table.column(name).combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def lists(a: pa.Table, b: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Arrays of strings or numbers of both tables as numbers: (numbers, bounds) of each, and how many numbers there are."""
    cols = [t.column(name).combine_chunks() for t in (a, b)]
    flat = pa.chunked_array([c.flatten() for c in cols]).combine_chunks().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in cols]
    bounds = [np.r_[0, np.cumsum(s)] for s in sizes]
    cut = bounds[0][-1]
    return codes[:cut], bounds[0], codes[cut:], bounds[1], len(flat.dictionary)


def sharing(a: pa.Table, b: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
    """Rows whose arrays of strings or numbers have one in common: a matrix, or pairs of places where they are few.

    Strings that are in many rows of both go through a product of 0-1 matrices; for the others each pair
    of rows with the string is listed, so work follows the pairs that share something, not all pairs.
    """
    ca, ba, cb, bb, n = lists(a, b, name)
    ra, rb = np.repeat(np.arange(len(a)), np.diff(ba)), np.repeat(np.arange(len(b)), np.diff(bb))
    na, nb = np.bincount(ca, minlength=n), np.bincount(cb, minlength=n)
    work = na * nb
    if work.sum() * 8 < len(a) * len(b):
        return _listed(ca, ra, cb, rb, work > 0, n)
    out = np.zeros((len(a), len(b)), bool)
    often = np.flatnonzero(work > len(a) * len(b) // 256)  # a product costs about as much as listing this many
    often = often[np.argsort(-work[often])]
    for k in range(0, len(often), 256):
        place = np.full(n, -1)
        part = often[k : k + 256]
        place[part] = np.arange(len(part))
        x, y = np.zeros((len(a), len(part)), np.float32), np.zeros((len(b), len(part)), np.float32)
        in_a, in_b = place[ca] >= 0, place[cb] >= 0
        x[ra[in_a], place[ca[in_a]]] = 1
        y[rb[in_b], place[cb[in_b]]] = 1
        out |= x @ y.T > 0
        if out.all():
            return out
    rest = work > 0
    rest[often] = False
    i, j = _listed(ca, ra, cb, rb, rest, n)
    out[i, j] = True
    return out


def _listed(ca: np.ndarray, ra: np.ndarray, cb: np.ndarray, rb: np.ndarray, take: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) for each number of ``take`` that both have; a pair may come again."""
    keep_a, keep_b = take[ca], take[cb]
    ca, ra, cb, rb = ca[keep_a], ra[keep_a], cb[keep_b], rb[keep_b]
    order = np.argsort(cb, kind="stable")
    cb, rb = cb[order], rb[order]
    many = np.bincount(cb, minlength=n)
    first = np.cumsum(many) - many
    each = many[ca]
    i = np.repeat(ra, each)
    at = np.repeat(first[ca], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return i, rb[at]


def pairs_of(found: tuple[np.ndarray, np.ndarray] | np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once."""
    if isinstance(found, np.ndarray):
        return np.nonzero(found)
    return np.divmod(np.unique(found[0] * width + found[1]), width)


def within(a: pa.Table, b: pa.Table, i: np.ndarray, j: np.ndarray, reach: int) -> np.ndarray:
    """Of the pairs of places those whose cells are within reach."""
    near = [np.abs(integers(a, c)[i] - integers(b, c)[j]) <= reach for c in ("x", "y")]
    return near[0] & near[1]
