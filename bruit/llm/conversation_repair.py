"""Conversation structure repair by the auction algorithm for shortest paths (operator 11).

A conversation's rows are layers of a lattice; its four states say which role
may come next (``(s?(ua)+)?``: nothing yet, after system, after user, after
assistant).  Arcs are the edits: keep, rerole and delete go on to the next row,
insert goes to another state before the same row.  Costs are small integers.

The auction keeps a price for each node, never above the cost from there on.
A path grows from its origin along an arc that is tight (price = cost + price
behind it); where none is tight, the node's price rises to the least offer and
the path shrinks by one.  When the path ends at the sink, a path from the origin
is shortest if and only if all its arcs are tight, so the least audit is found by
going along tight arcs that lead on to the sink, in the order of the letters.

A conversation may hold a third of all rows, so rows are sorted and numbered
over all machines and cut into blocks of at most ``block`` rows of one
conversation.  Auctions over each block give its costs between the four states
(no task sees more than a block at once); prices pass from block to block, last
to first, as four numbers; each block is then traced from all its four entries
with the prices of its exits; and one state passes from first to last.  Texts
aren't part of that.  The SHA-256 of a conversation is a chain over its bytes by
definition: one task streams the edited rows of a conversation, a batch at a time.

Rows with the same turn are ordered by role, text (first 64 characters, then
hash); equal rows are the same whatever their order.

Defined results: null conv_id, turn, role or text count as one space; a null
conv_id is a conversation of its own, returned as null; a role that begins with
none of s, u, a (an empty one, too) can't be kept; a conversation that loses all
its rows has zeros, an empty audit and the hash of the empty string; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bruit.llm.common import WS_CHARS, Steps, map_pandas, materialize, pick, steps, table


@dataclass(frozen=True)
class RepairParams:
    """``block_bits``: a block has at most 2 to the power of this many rows."""

    block_bits: int = 5


#: (state, initial that follows) -> next state.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = ("user", "user", "assistant", "user")  # what a state lets one insert or rerole to
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: What is left to do behind the last row: cost and letters.
END, END_EDITS = (0, 4, 2, 0), ("", "II", "I", "")
LETTERS = "su a"  # a row's code is 4 * (place of its initial here) + 2 * (must go) + (ends within a sentence)
FAR = -1
LAST_BLOCK = 2**62


def _arcs(code: int, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, layers on, state, cost) of the edits at a row, in the order of their letters."""
    initial, gone, cut = LETTERS[code >> 2], code >> 1 & 1, code & 1
    made = 2 if ROLE[state] == "user" else 3
    out = [("D", 1, state, DELETE), ("I", 0, made, INSERT)]
    if not gone and (state, initial) in NEXT:
        out.append(("K", 1, NEXT[state, initial], KEEP + CUT * cut))
    if not gone:
        out.append(("R", 1, made, REROLE + CUT * cut))
    return tuple(out)


ARCS = [[_arcs(code, state) for state in range(4)] for code in range(16)]


class Lattice:
    """Nodes 4 * layer + state and a sink; ``exits`` are the sink arcs of the last layer."""

    def __init__(self, codes: str, exits: dict[int, int]):
        n = len(codes)
        self.sink = 4 * n + 4
        self.arcs = [[(e, 4 * (t + on) + to, cost) for e, on, to, cost in ARCS[ord(c) - 65][q]] for t, c in enumerate(codes) for q in range(4)]
        self.arcs += [[("", self.sink, exits[q])] if q in exits else [] for q in range(4)]
        self.price = [0] * (self.sink + 1)

    def auction(self, origin: int) -> int:
        """The cost from ``origin`` to the sink, which must be reachable.  Prices stay valid for further origins."""
        arcs, price, sink, far = self.arcs, self.price, self.sink, float("inf")
        path = [origin]
        while (at := path[-1]) != sink:
            best, to = far, sink
            for _, j, cost in arcs[at]:
                if cost + price[j] < best:
                    best, to = cost + price[j], j
            if price[at] < best:  # no tight arc: the price rises, the path contracts
                price[at] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price[origin] - price[sink]

    def trace(self, origin: int) -> tuple[str, int]:
        """The least letters along tight arcs from ``origin``, and the state at the end."""
        price, arcs, sink = self.price, self.arcs, self.sink
        good = [False] * sink + [True]
        for layer in range(sink - 4, -1, -4):
            for _ in range(3):  # inserts stay in the layer; tight ones make no cycle
                for i in range(layer, layer + 4):
                    good[i] = good[i] or any(good[j] and price[i] == cost + price[j] for _, j, cost in arcs[i])
        out, at = [], origin
        while True:
            letter, j = next((e, j) for e, j, cost in arcs[at] if good[j] and price[at] == cost + price[j])
            if j == sink:
                return "".join(out), at & 3
            out.append(letter)
            at = j


@lru_cache(maxsize=20_000)
def block_costs(codes: str) -> list[int]:
    """Least costs of a block from each state (rows) to each state (columns), ``FAR`` where there is no way."""
    keeps_system = any(ord(c) - 65 in (0, 1) for c in codes)
    out = [FAR] * 16
    for to in range(4):
        lattice = Lattice(codes, {to: 0})
        for origin in range(4):
            if to >= 2 or origin == to or (origin, to) == (0, 1) and keeps_system:
                out[4 * origin + to] = lattice.auction(origin)
    return out


@lru_cache(maxsize=20_000)
def block_edits(codes: str, exits: tuple[int, ...]) -> tuple[list[str], list[int]]:
    """From each state the least letters of a shortest path, given the prices of the exits, and the state it ends in."""
    lattice = Lattice(codes, dict(enumerate(exits)))
    for origin in range(4):
        lattice.auction(origin)
    found = [lattice.trace(origin) for origin in range(4)]
    return [e for e, _ in found], [q for _, q in found]


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _initial(code: str) -> str:
    return LETTERS[(ord(code) - 65) >> 2]


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(convs: DataFrame) -> DataFrame:
    """(cid, turn, role, text) after the damage that a hash of conversation and turn decides; ``cid`` is the id as text."""
    c = pick(convs, "conv_id", "turn", "role", "text").select(_text(F.col("conv_id")).alias("cid"), "turn", _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text"))
    kind = F.crc32(F.concat("cid", F.lit(":"), _text(F.col("turn"))).cast("binary")) % 20
    c = c.withColumn("kind", kind).where("kind <> 0")
    c = c.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    c = c.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return c.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _numbered(rows: DataFrame, own: Steps, p: RepairParams) -> DataFrame:
    """Rows sorted over all machines: ``pos`` grows with (cid, turn, role, text), without gaps inside a partition;
    ``blk`` is a run of positions."""
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumns({"head": F.left("text", F.lit(64)), "sha": F.sha2(F.concat("role", F.lit("\0"), "text"), 256), "tie": F.monotonically_increasing_id()})
    key = ["cid", F.col("turn").asc_nulls_first(), "role", "head", "sha", "tie"]
    rows = rows.repartitionByRange(n, *key).sortWithinPartitions(*key).drop("head", "tie").withColumn("pos", F.monotonically_increasing_id())
    own_text = F.rtrim(F.col("text"), F.lit(WS_CHARS))
    rows = rows.withColumns({"blank": own_text == "", "cut": ~F.substring(own_text, -1, 1).isin(".", "!", "?")})
    return own.put("rows", rows.withColumn("blk", F.shiftright("pos", p.block_bits)))


def _coded(rows: DataFrame, own: Steps) -> DataFrame:
    """(cid, pos, blk, turn, fault, code): each row's first fault, and what the search must know of it."""
    slim = rows.select("cid", "pos", "blk", "turn", "sha", "blank", "cut", F.substring("role", 1, 1).alias("initial"))
    first = slim.groupBy("cid", "sha").agg(F.min("pos").alias("first"))
    slim = slim.join(first, ["cid", "sha"])
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    slim = slim.withColumn("fault", fault)
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 3).otherwise(2)
    gone, cut = F.col("fault").isin("blank", "duplicate").cast("int"), (F.col("fault") == "truncated").cast("int")
    code = F.char(F.lit(65) + 4 * kind + 2 * gone + cut)
    return own.put("coded", slim.select("cid", "pos", "blk", "turn", "fault", code.alias("code")))


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of a conversation from the last to the first: prices of the exits, and the cost from state 0 on."""
    cid, price = None, END
    for b in batches:
        out = []
        for c, costs in zip(b["cid"], b["costs"], strict=True):
            if c != cid:
                cid, price = c, END
            low = min(price)
            exits = [x - low for x in price]
            price = tuple(min(int(m) + price[r] for r in range(4) if (m := costs[4 * q + r]) != FAR) for q in range(4))
            out.append((exits, price[0]))
        yield b[["cid", "blk", "start", "codes"]].assign(exits=[x[0] for x in out], cost=[x[1] for x in out])


def _forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of a conversation from the first to the last: the state they are entered in, their edits and illegal pairs.
    What is inserted behind the last row comes as one more block."""
    cid, state, last = None, 0, ""
    names = ["cid", "blk", "start", "codes", "state", "edits", "illegal"]
    rest = lambda: [(cid, LAST_BLOCK, 0, "", state, END_EDITS[state], 0)] if cid is not None and END_EDITS[state] else []
    for b in batches:
        out = []
        for c, blk, start, codes, edits, ends in zip(*(b[n] for n in ("cid", "blk", "start", "codes", "edits", "ends")), strict=True):
            if c != cid:
                out += rest()
                cid, state, last = c, 0, ""
            roles = last + "".join(map(_initial, codes))
            out.append((c, blk, start, codes, state, edits[state], sum(not _legal(x, y) for x, y in zip(roles, roles[1:]))))  # noqa: B905
            state, last = int(ends[state]), roles[-1]
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame(rest(), columns=names)


def _costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(costs=[block_costs(c) for c in b["codes"]])


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [block_edits(c, tuple(int(x) for x in e)) for c, e in zip(b["codes"], b["exits"], strict=True)]
        yield b[["cid", "blk", "start", "codes"]].assign(edits=[x[0] for x in found], ends=[x[1] for x in found])


def _single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each edit: its letter, the position of its row (null for an insert) and the role that it gives."""
    for b in batches:
        out = []
        for cid, blk, start, codes, state, edits in zip(*(b[n] for n in ("cid", "blk", "start", "codes", "state", "edits")), strict=True):
            at = 0
            for k, e in enumerate(edits):
                out.append((cid, blk, k, e, None if e == "I" else start + at, ROLE[state] if e in "IR" else None))
                if e == "K":
                    state = NEXT[state, _initial(codes[at])]
                elif e in "IR":
                    state = 2 if ROLE[state] == "user" else 3
                at += e != "I"
        yield pd.DataFrame(out, columns=["cid", "blk", "k", "edit", "pos", "made"]).astype({"pos": "Int64"})


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edited rows in their order: letters and hash of each conversation."""
    cid, audit, sha, first = None, [], hashlib.sha256(), True
    names = ["cid", "audit", "repaired_sha256"]
    for b in batches:
        out = []
        for c, e, role, text in zip(b["cid"], b["edit"], b["role"], b["text"], strict=True):
            if c != cid:
                if cid is not None:
                    out.append((cid, "".join(audit), sha.hexdigest()))
                cid, audit, sha, first = c, [], hashlib.sha256(), True
            audit.append(e)
            if e != "D":
                sha.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
                first = False
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame([] if cid is None else [(cid, "".join(audit), sha.hexdigest())], columns=names)


@dataclass
class Repaired:
    """``rows``: (cid, blk, k, edit, role, text) in the order of (blk, k), deleted rows included, whose role and text are
    as before; ``counts``: (cid, gaps, blank, duplicate, truncated, illegal, cost)."""

    rows: DataFrame
    counts: DataFrame


def repair(convs: DataFrame, own: Steps, p: RepairParams = RepairParams()) -> Repaired:
    """The cheapest edits of damaged conversations.  Both results read tables of ``own``."""
    rows = _numbered(damaged(convs), own, p)
    coded = _coded(rows, own)
    blocks = coded.groupBy("cid", "blk").agg(F.min("pos").alias("start"), F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("c"))
    blocks = blocks.select("cid", "blk", "start", F.array_join("c.code", "").alias("codes"))
    head = "cid string, blk long, start long, codes string"
    costs = map_pandas(blocks, _costs, f"{head}, costs array<long>")
    back = costs.repartition("cid").sortWithinPartitions("cid", F.desc("blk"))
    back = own.put("prices", map_pandas(back, _backward, f"{head}, exits array<long>, cost long"))
    edits = map_pandas(back.drop("cost").repartition("blk"), _edits, f"{head}, edits array<string>, ends array<int>")
    way = edits.repartition("cid").sortWithinPartitions("cid", "blk")
    way = own.put("way", map_pandas(way, _forward, f"{head}, state int, edits string, illegal long"))
    single = map_pandas(way.drop("illegal").repartition("blk", "cid"), _single, "cid string, blk long, k int, edit string, pos long, made string")
    texts = rows.select("pos", "role", "text")
    edited = single.join(texts, "pos", "left").select("cid", "blk", "k", "edit", F.coalesce("made", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = coded.where("turn is not null").groupBy("cid", "turn").agg(F.lit(1)).groupBy("cid").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    faults = coded.groupBy("cid").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    least = back.groupBy("cid").agg(F.min_by("cost", "blk").alias("cost"))
    bad = way.groupBy("cid").agg(F.sum("illegal").alias("illegal"))
    counts = faults.join(turns, "cid", "left").join(least, "cid").join(bad, "cid")
    return Repaired(edited, counts.select("cid", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost"))


def repair_report(convs: DataFrame, p: RepairParams = RepairParams()) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = convs.sparkSession
    with steps(spark) as own:
        done = repair(convs, own, p)
        stream = done.rows.repartition("cid").sortWithinPartitions("cid", "blk", "k")
        digest = map_pandas(stream.select("cid", "edit", "role", "text"), _digest, "cid string, audit string, repaired_sha256 string")
        ids = pick(convs, "conv_id").distinct().withColumn("cid", _text(F.col("conv_id")))
        out = ids.join(done.counts, "cid", "left").join(digest, "cid", "left")
        zero = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        empty = F.lit(hashlib.sha256(b"").hexdigest())
        out = out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
        return materialize(out, "repaired")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))
