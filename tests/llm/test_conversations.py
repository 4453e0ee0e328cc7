"""Conversation repair against a plain dynamic program over whole conversations."""

import hashlib
import random
import re
import zlib

import pytest
from conftest import SF

from bruit.llm import conversation_repair as repair
from bruit.llm.common import table
from bruit.llm.conversation_repair import RepairParams, block_costs, block_edits, repair_report

SPACE = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}


def damage(conv_id, rows):
    out = []
    for turn, role, text in rows:
        blank = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{blank(conv_id)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def follows(state, c):
    """The grammar by a pattern alone: a prefix stands for its state."""
    return bool(re.fullmatch(r"s?(ua)*u?", state + c))


def finished(prefix):
    return bool(re.fullmatch(r"(s?(ua)+)?", prefix))


def short(prefix):
    """The least prefix from which the same may follow."""
    if prefix in ("", "s"):
        return prefix
    return "u" if prefix.endswith("u") else "ua"


def expected(conv_id, rows):
    rows = sorted(damage(conv_id, rows), key=key)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        own = text.strip(SPACE)
        faults.append("blank" if not own else "duplicate" if (role, text) in seen else "truncated" if own[-1] not in ".!?" else "")
        seen.add((role, text))
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))  # noqa: B905
    # prefix of initials -> (cost, letters, repaired rows), relaxed until inserts change nothing
    best = {"": (0, "", ())}
    for k in range(len(rows) + 1):
        while True:
            more = dict(best)
            for s, (c, e, r) in best.items():
                for role in "ua":
                    if follows(s, role):
                        t, v = short(s + role), (c + 2, e + "I", (*r, f"{NAMES[role]}:"))
                        more[t] = min(more.get(t, (10**9,)), v)
            if more == best:
                break
            best = more
        if k == len(rows):
            break
        (_, role, text), fault, new = rows[k], faults[k], {}
        for s, (c, e, r) in best.items():
            opts = [(s, (c + 3, e + "D", r))]
            if fault not in ("blank", "duplicate"):
                own = c + (fault == "truncated")
                opts += [(s + role[:1], (own, e + "K", (*r, f"{role}:{text}")))] if role and follows(s, role[0]) else []
                opts += [(s + x, (own + 2, e + "R", (*r, f"{NAMES[x]}:{text}"))) for x in "ua" if follows(s, x)]
            for t, v in opts:
                new[short(t)] = min(new.get(short(t), (10**9,)), v)
        best = new
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    cost, audit, kept = min(v for s, v in best.items() if finished(s))
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def key(r):
    turn, role, text = r
    return (turn is not None, turn or 0, role, text[:64], hashlib.sha256(f"{role}\0{text}".encode()).hexdigest())


def check(df, p=RepairParams()):
    convs = {}
    for r in df.select("conv_id", "turn", "role", "text").collect():
        convs.setdefault(r[0], []).append(tuple(r)[1:])
    got = {r[0]: tuple(r)[1:] for r in repair_report(df, p).collect()}
    assert got == {c: expected(c, rows) for c, rows in convs.items()}


def test_whole_table(spark):
    check(table(spark, SF, "conversations"))


def odd(spark):
    rnd = random.Random(7)
    texts = [None, "", " \n", "Yes.", "yes", "No!", "a longer one?", "x" * 30_000 + ".", "x" * 30_000]
    roles = [None, "", "system", "user", "assistant", "tool", "User", "sage"]
    rows = [(c, rnd.choice([None, 1, 2, t, t]), rnd.choice(roles), rnd.choice(texts), 1, "z") for c in (None, 1, 2, 3, 4, -5) for t in range(12)]
    rows += [(9, t, rnd.choice(roles[2:5]), f"Line {t}" + "." * rnd.randint(0, 1), 1, "z") for t in range(400)]
    rows += [(10, 5, "user", "The same.", 1, "z")] * 200
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cid long, `pos` string")


@pytest.mark.parametrize("bits", [0, 2, 5])
def test_nulls_ties_repeats_and_long_conversations(spark, bits):
    check(odd(spark).repartition(7), RepairParams(block_bits=bits))


def test_no_rows(spark):
    assert repair_report(odd(spark).limit(0)).count() == 0


def test_all_rows_dropped(spark):
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    check(spark.createDataFrame([(c, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string"))


def test_edited_rows(spark):
    """The operator's rows: an insert has no text, a rerole a new role; kept rows spell the grammar."""
    from bruit.llm.common import steps

    with steps(spark) as own:
        rows = repair.repair(table(spark, SF, "conversations"), own).rows.orderBy("cid", "blk", "k").collect()
    convs = {}
    for r in rows:
        assert r.edit != "I" or (r.text == "" and r.role in ("user", "assistant"))
        convs.setdefault(r.cid, []).append(r.role[0] if r.edit != "D" else "")
    assert all(finished("".join(v)) for v in convs.values())


def test_blocks_of_any_size_give_the_same(spark):
    rnd = random.Random(3)
    for _ in range(200):
        codes = "".join(chr(65 + rnd.randrange(16)) for _ in range(rnd.randint(1, 14)))
        found = set()
        for size in (1, 3, 20):
            blocks = [codes[i : i + size] for i in range(0, len(codes), size)]
            price, exits = repair.END, []
            for b in reversed(blocks):
                exits.append(tuple(x - min(price) for x in price))
                m = block_costs(b)
                price = tuple(min(m[4 * q + r] + price[r] for r in range(4) if m[4 * q + r] >= 0) for q in range(4))
            state, out = 0, ""
            for b, e in zip(blocks, reversed(exits), strict=True):
                edits, ends = block_edits(b, e)
                out, state = out + edits[state], ends[state]
            found.add((price[0], out + repair.END_EDITS[state]))
        assert len(found) == 1


def test_prices_never_exceed_costs():
    """Complementary slackness after each auction: no arc offers less than a node's price."""
    rnd = random.Random(5)
    for _ in range(100):
        codes = "".join(chr(65 + rnd.randrange(16)) for _ in range(rnd.randint(1, 20)))
        lattice = repair.Lattice(codes, {0: 0, 1: 4, 2: 2, 3: 0})
        for origin in range(4):
            lattice.auction(origin)
            assert all(lattice.price[i] <= c + lattice.price[j] for i, arcs in enumerate(lattice.arcs) for _, j, c in arcs)
