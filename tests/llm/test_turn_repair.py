import hashlib
import random
import re
import zlib

import pytest

from velario.llm import queries, turn_repair
from velario.llm.turn_repair import END, FORCED, faults, matrix_of, unroll

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block string, alone int, messages string"


def plain_audit(rows):
    """Cheapest edits of (initial, fault) rows, all of them kept side by side; the least string."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {("", 0): (0, {""})}
    order = [(0, "")]

    def offer(i, state, cost, audits):
        known = best.get((state, i))
        if known is None or cost < known[0]:
            best[state, i] = (cost, audits)
        elif cost == known[0]:
            best[state, i] = (cost, known[1] | audits)

    for i in range(len(rows) + 1):
        for _ in range(4):                                     # insertions, until nothing gets better
            for state in step:
                if (state, i) in best:
                    cost, audits = best[state, i]
                    offer(i, turn[state], cost + 2, {a + "I" for a in audits if not a.endswith("IIIII")})
        if i == len(rows):
            break
        initial, fault = rows[i]
        for state in step:
            if (state, i) not in best:
                continue
            cost, audits = best[state, i]
            offer(i + 1, state, cost + 3, {a + "D" for a in audits})
            if fault not in "bd":
                more = fault == "t"
                offer(i + 1, turn[state], cost + 2 + more, {a + "R" for a in audits})
                if initial in step[state]:
                    offer(i + 1, step[state][initial], cost + more, {a + "K" for a in audits})
    ends = [best[s, len(rows)] for s in ("", "a") if (s, len(rows)) in best]
    low = min(c for c, _ in ends)
    return low, min(a for c, audits in ends if c == low for a in audits)


def symbol(row):
    initial, fault = row
    return FORCED if fault in "bd" else 2 * {"s": 0, "u": 1, "a": 2}.get(initial, 3) + (fault == "t")


def test_audits_are_the_least_of_the_cheapest():
    rng = random.Random(1)
    for _ in range(1500):
        rows = []
        while len(rows) < 8 and rng.random() < 0.9:
            rows += [(rng.choice("suax"), rng.choice("---tb"))] * rng.randint(1, 3)
        symbols = [symbol(r) for r in rows]
        letters, state = unroll(symbols)
        cost, audit = plain_audit(rows)
        assert "".join(letters) + turn_repair.closing(state) == audit
        assert turn_repair._applied(matrix_of(symbols), END)[0] == cost


def test_long_runs_go_by_powers():
    symbols = [2] * 1000 + [FORCED] * 70_000 + [4] * 513
    letters, state = unroll(symbols)
    assert len(letters) == len(symbols) and set(letters[1000:71_000]) == {"D"}
    assert unroll(symbols[:9], 0, unroll_after(symbols, 9))[0] == letters[:9]
    assert turn_repair.run_lengths(symbols) == [(2, 1000), (FORCED, 70_000), (4, 513)]


def unroll_after(symbols, n):
    return turn_repair._applied(matrix_of(symbols[n:]), END)


def plain(rows):
    """The contract's row of each conversation of (conv_id, turn, role, text), by loops."""
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        show = " " if conv is None else str(conv)
        dealt = zlib.crc32(f"{show}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if dealt == 0:
            continue
        text = "" if dealt == 1 else re.sub("[.!?]", "", text) if dealt == 2 else text
        own += [(turn is not None, turn or 0, "user" if dealt == 4 else role, text)] * (2 if dealt == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort()
        found, seen = [], set()
        for _, _, role, text in own:
            body = text.rstrip(" \t\n\v\f\r")
            found.append((role[:1], "b" if not body else "d" if (role, text) in seen else "-" if body[-1] in ".!?" else "t"))
            seen.add((role, text))
        cost, audit = plain_audit(found)
        state, at, left = "", 0, []
        for letter in audit:
            role, text = own[at][2:] if at < len(own) else (None, None)
            if letter in "IR":
                state = "a" if state == "u" else "u"
                left.append(("assistant" if state == "a" else "user") + ":" + (text if letter == "R" else ""))
            elif letter == "K":
                state = role[:1]
                left.append(f"{role}:{text}")
            at += letter != "I"
        turns = [t for known, t, _, _ in own if known]
        initials = [i for i, _ in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = [sum(f == x for _, f in found) for x in "bdt"]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit,
                    hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        n = rng.randint(0, 7)
        for turn in range(n):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "open end", " \t", "", None, "Why? ", "É vero.", "a:b\nc."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
    return rows + rows[:9]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "m") for r in rows], SCHEMA)


@pytest.mark.parametrize("block_rows", [4096, 2])
def test_repairs_equal_plain_loops(spark, block_rows):
    rows = conversations()
    given = frame(spark, rows)
    found = queries.repair_digests(turn_repair.repair(queries.damaged(given), block_rows=block_rows), given)
    assert sorted([tuple(r) for r in found.collect()], key=str) == plain(rows)


def test_one_conversation_over_many_blocks(spark):
    rng = random.Random(9)
    rows = [(7, t // 2, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no end", f"New {t}."])) for t in range(60)]
    rows += [(8, t, "user", "Same.") for t in range(5)]
    given = frame(spark, rows)
    repaired = turn_repair.repair(given, block_rows=7)
    sizes = [r["rows"] for r in repaired.where("conv_id = 7").collect()]
    assert max(sizes) <= 7 and sum(sizes) == 60
    own = sorted((r for r in repaired.collect() if r["conv_id"] == 7), key=lambda r: r["block"])
    ordered = sorted((t, role, text) for c, t, role, text in rows if c == 7)
    names, _ = faults([r for _, r, _ in ordered], [x for _, _, x in ordered])
    letters, state = unroll(faults([r for _, r, _ in ordered], [x for _, _, x in ordered])[1])
    assert "".join(r["audit"] for r in own) == "".join(letters) + turn_repair.closing(state)
    assert sum(r["duplicate"] for r in own) == names.count("d") and sum(r["turns"] for r in own) == 30
    roles = [m["role"][0] for r in own for m in r["messages"]]
    assert re.fullmatch("(s?(ua)+)?", "".join(roles))


def test_given_conversations_and_none(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    found = queries.turn_repair_query(spark, "/root/testdata/sf0.001")
    assert sorted([tuple(r) for r in found.collect()], key=str) == plain(rows)
    nothing = given.limit(0)
    assert queries.repair_digests(turn_repair.repair(queries.damaged(nothing)), nothing).count() == 0


def test_a_text_of_megabytes(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "x" * 3_000_000)]
    given = frame(spark, rows)
    found = turn_repair.repair(given).collect()
    assert "".join(r["audit"] for r in sorted(found, key=lambda r: r["block"])) == "KK"
    assert sum(characters(r) for r in found) == len(rows[0][3]) + len(rows[1][3])


def characters(row):
    return sum(len(m["text"]) for m in row["messages"])
