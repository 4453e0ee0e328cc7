"""Sharding by histogram sort (operator 1), DataFrame functions only.

Rows are ordered by (hash of the text, id, number of the row), so equal texts
lie together, and the order is cut into shards of near-equal bytes.  Rounds of
exact byte counts below probes refine the splitters: each round splits every
key interval that still holds an open splitter into equal parts, counts the
bytes of all parts in one aggregation and keeps the part that holds the
splitter.  A splitter is done when a probe lies within the tolerance of its
target; if one hash holds more than that (a large group of equal texts), the
rounds go on over the ids inside that hash, and over the row numbers inside an
id.  Only counts come to the driver: at most ``2 ** bits`` (plus one) for each
of the open intervals, of which there are fewer than shards, whatever the
number of rows.  Then rows move once, by (shard, key) into cells of whole key
ranges, are sorted there, and get gapless slots from the cells' row counts and
their places in the cell.

Defined results: null text has size 1 (the end mark); rows with a null id
come first; rows that share text and id are told apart by the number they got
when the keys were written, so a large group of them is cut like any other; an
empty table gives an empty result; further columns move along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bruit.llm.common import materialize, pick, steps, table

LOW, HIGH = -(2**63), 2**63 - 1
KEY = ("h", "i", "j")
#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
ROW_BITS = 33


@dataclass(frozen=True)
class ShardParams:
    """``tolerance``: distance of a shard's cut from its target, in parts of a shard's bytes.
    Rows move into ``cells`` tasks for each shard, or more, of about ``cell_rows`` rows; 2 ** ``bits`` probes per
    open interval and round bound the driver's work."""

    shards: int = 8
    tolerance: float = 0.0005
    cells: int = 4
    cell_rows: int = 2_000_000
    bits: int = 10


@dataclass
class _Cut:
    """A cut between shards: ``at`` is the first key above it; ``tie`` the key that holds it, if one key must be cut."""

    target: int
    slack: float
    below: int = 0
    prefix: int | None = None
    at: int | None = None
    tie: int | None = None


def _refine(rows: DataFrame, key: str, cuts: list[_Cut], bits: int) -> None:
    """Moves the cuts until each is done or lies inside the rows of one key.

    Probes are multiples of a power of two, so a row's interval is a shift of
    its key; each round looks ``bits`` deeper into the intervals still open.
    """
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    if lo is None:
        return
    shift, last, open_ = max(0, (hi - lo).bit_length() - bits), None, cuts
    while open_:
        here = rows.select(key, "size", F.shiftright(key, shift).alias("b"))
        here = here.withColumn("p", F.lit(0) if last is None else F.shiftright(key, last))
        if last is not None:
            here = here.where(F.col("p").isin(sorted({c.prefix for c in open_})))
        got = here.groupBy("p", "b").agg(
            F.sum("size").alias("size"), F.count("*").alias("rows"), F.min(key).alias("lo"), F.max(key).alias("hi")
        )
        parts: dict[int, list] = {}
        for r in sorted(got.collect(), key=lambda r: r["b"]):
            parts.setdefault(r["p"], []).append(r)
        for c in open_:
            for r in parts[c.prefix or 0] if last is not None else parts[0]:
                under, over = c.target - c.below, c.below + r["size"] - c.target
                if over >= 0:
                    if min(under, over) <= c.slack or r["rows"] == 1:
                        c.at = r["lo"] if under <= over else r["hi"] + 1
                    elif r["lo"] == r["hi"]:
                        c.tie = r["lo"]
                    c.prefix = r["b"]
                    break
                c.below += r["size"]
            else:
                c.at = hi + 1
        open_ = [c for c in open_ if c.at is None and c.tie is None]
        last, shift = shift, max(0, shift - bits)


def _tree(cuts: list[tuple[int, ...]], first: int = 0) -> str:
    """SQL for the number of cuts at or below the row's key: a balanced tree of tests."""
    if not cuts:
        return str(first)
    m = len(cuts) // 2
    return f"CASE WHEN {_under(KEY, cuts[m])} THEN {_tree(cuts[:m], first)} ELSE {_tree(cuts[m + 1 :], first + m + 1)} END"


def _under(key: tuple[str, ...], cut: tuple[int, ...]) -> str:
    """SQL test whether a row's key is below a cut, which may lie above all longs."""
    if cut[0] > HIGH:
        return "true"
    less = f"{key[0]} < {_long(cut[0])}"
    if all(v == LOW for v in cut[1:]):
        return less
    return f"({less} OR ({key[0]} = {_long(cut[0])} AND {_under(key[1:], cut[1:])}))"


def _long(v: int) -> str:
    return f"{v}L" if v > LOW else f"({v + 1}L - 1L)"


def find_cuts(rows: DataFrame, p: ShardParams) -> list[tuple[int, ...]]:
    """Cuts (hash, id, row number) between shards, in order; rows: (h, i, j, size)."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = total / p.shards * p.tolerance

    def place(here: DataFrame, level: int, cuts: list[_Cut]) -> list[tuple[int, ...]]:
        _refine(here, KEY[level], cuts, p.bits)
        rest = (LOW,) * (len(KEY) - level - 1)
        out = [(c.at, *rest) for c in cuts if c.at is not None]
        for v in sorted({c.tie for c in cuts if c.tie is not None}):  # one key holds the cut: go on inside it
            own = [_Cut(c.target, c.slack, c.below) for c in cuts if c.tie == v]
            if rest:
                out += [(v, *deeper) for deeper in place(here.where(F.col(KEY[level]) == F.lit(v)), level + 1, own)]
            else:
                out += [(v,)] * len(own)
        return out

    return sorted(place(rows, 0, [_Cut(total * k // p.shards, slack) for k in range(1, p.shards)]))


def shard(df: DataFrame, p: ShardParams = ShardParams()) -> DataFrame:
    """Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard, in key order).

    ``df`` has ``h`` (long, the sort key), ``i`` (long, breaks ties) and ``size`` (long) besides
    other columns, none of which is named ``j``, ``shard``, ``cell``, ``place`` or ``slot``.
    """
    spark = df.sparkSession
    with steps(spark) as own:
        keys = own.put("keys", df.withColumn("j", F.monotonically_increasing_id()))
        cuts = find_cuts(keys.select(*KEY, "size"), p)
        cells = max(p.shards * p.cells, -(-keys.count() // p.cell_rows))
        moved = keys.withColumn("shard", F.expr(_tree(cuts))).repartitionByRange(cells, "shard", *KEY)
        # After the sort a row's number in its partition is its place in the order.
        moved = moved.sortWithinPartitions("shard", *KEY).withColumn("place", F.monotonically_increasing_id())
        moved = moved.withColumn("cell", F.shiftright("place", ROW_BITS))
        moved = moved.withColumn("place", F.col("place").bitwiseAND(F.lit(2**ROW_BITS - 1))).drop("j")
        out = materialize(moved, "shards")
    # One row for each pair of a shard and a cell: at most as many as there are cells and shards.
    sizes = out.groupBy("shard", "cell").agg(F.count("*").alias("n"), F.min("place").alias("least"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("shard", "cell", (F.coalesce(before, F.lit(0)) - F.col("least")).alias("before"))
    out = out.join(F.broadcast(sizes), ["shard", "cell"])
    return out.withColumn("slot", F.col("before") + F.col("place")).drop("before", "place", "cell")


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    keyed = docs.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("h"),
        F.coalesce("doc_id", F.lit(LOW)).cast("long").alias("i"),
    )
    return shard(keyed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
