import hashlib
import heapq
import random
import re
import zlib

import pytest

from neo.llm import conversation as C
from neo.llm.catalog import op13_conversation_repair
from tests.conftest import SF_SMALL

NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
BLANKS = " \t\n\v\f\r"


def cheapest(rows):
    """Cheapest and then least edits of ``(initial, fault)`` by Dijkstra over whole strings."""
    after = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    queue, seen = [(0, "", 0, "0")], set()
    while queue:
        cost, audit, i, q = heapq.heappop(queue)
        if i == len(rows) and q in "0a":
            return cost, audit
        if (i, q) in seen:
            continue
        seen.add((i, q))
        for role in "ua":
            if (q, role) in after:
                heapq.heappush(queue, (cost + 3, audit + "I", i, after[q, role]))
        if i == len(rows):
            continue
        initial, fault = rows[i]
        heapq.heappush(queue, (cost + 4, audit + "D", i + 1, q))
        if fault in ("blank", "duplicate"):
            continue
        extra = 3 * (fault == "truncated")
        if (q, initial) in after:
            heapq.heappush(queue, (cost + extra, audit + "K", i + 1, after[q, initial]))
        for role in "ua":
            if (q, role) in after:
                heapq.heappush(queue, (cost + extra + 3, audit + "R", i + 1, after[q, role]))


def brute(rows):
    """Figures of one conversation's rows ``turn, role, text``, in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        shown = text.rstrip(BLANKS)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen
                      else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest(list(zip(initials, faults)))
    out, i = [], 0
    for letter in audit:
        if letter == "I":
            out.append(("user" if not out or out[-1][0][0] in "sa" else "assistant", ""))
            continue
        _, role, text = rows[i]
        i += 1
        if letter == "K":
            out.append((role, text))
        elif letter == "R":
            out.append(("user" if not out or out[-1][0][0] in "sa" else "assistant", text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest), out


def damage(rows):
    """The contract's damage of ``conv, turn, role, text``, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    return out


def figures(df):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in df.collect()}


def talk(rng, n, start=0):
    """Rows of one conversation with distinct turns and every kind of fault."""
    out = []
    for turn in sorted(rng.sample(range(2 * n + 1), n)):
        role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "unknown"])
        text = rng.choice(["Yes.", "No!", "cut off", "", " \n", f"{rng.randrange(n)}.", f"{rng.randrange(n)}"])
        out.append((start + turn, role, text))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, block string, kind int, copy int"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(parts)


def test_chunks_agree_with_one_pass():
    rng = random.Random(1)
    for _ in range(200):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(1, 40)))
        behind, start, gain = C.backward(codes, C._END)
        cut = rng.randrange(len(codes))
        left = C.backward(codes[:cut], C._END)
        right = C.backward(codes[cut:], C._END)
        fixed = C.fix_up(codes[:cut], *left, right[1]) if cut else ([], right[1], 0)
        assert (fixed[0] + right[0], fixed[1], fixed[2] + right[2]) == (behind, start, gain)


def test_edits_against_search():
    rng = random.Random(2)
    names = {0: "t", 1: "s", 2: "u", 3: "a"}
    faults = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
    for _ in range(400):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(0, 9)))
        behind, start, gain = C.backward(codes, C._END)
        letters, state = C.trace(codes, behind, 0)
        got = start[0] + gain, "".join(letters) + C._LAST_EDITS[state]
        assert got == cheapest([(names[c % 4], faults[c // 4]) for c in codes])


@pytest.mark.parametrize("size", [3, 4_096])
def test_conversations(spark, size):
    rng = random.Random(size)
    rows = [(c, *r) for c in range(60) for r in talk(rng, rng.randrange(1, 12))]
    rows += [(99, *r) for r in talk(rng, 400)] + [(None, *r) for r in talk(rng, 20)]
    rows += [(100, None, "user", "a."), (101, 5, None, None), (102, 1, "user", "x" * 300_000 + ".")]
    want = {c: brute(sorted([r[1:] for r in rows if r[0] == c], key=lambda r: (r[0] is not None, r[0] or 0)
                            ) if c != 101 else [(5, " ", " ")]) for c in {r[0] for r in rows}}
    df = frame(spark, rows)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        assert figures(C.repair(df, block_rows=size)) == {c: w[0] for c, w in want.items()}
        turns = {}
        for r in sorted(C.repair(df, with_turns=True, block_rows=size).collect(), key=lambda r: r.block):
            turns.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
        assert turns == {c: w[1] for c, w in want.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_one_conversation_over_many_tasks(spark):
    """A conversation in many blocks, with long stretches in which nothing converges at once."""
    rows = [(1, i, "tool", f"{i}.") for i in range(300)] + [(1, 300 + i, "user", "same.") for i in range(300)]
    rows += [(1, 600 + i, "assistant", f"{i % 7}") for i in range(200)] + [(2, i, "user", "") for i in range(100)]
    got = figures(C.repair(frame(spark, rows, 9), block_rows=16))
    assert got == {c: brute([r[1:] for r in rows if r[0] == c])[0] for c in (1, 2)}


def test_ties_repeats_and_nothing(spark):
    rows = [(1, 1, "user", "a.")] * 5 + [(1, 2, "assistant", "b.")] + [(2, None, "user", "a."), (2, None, "assistant", "b.")]
    got = figures(C.repair(frame(spark, rows)))
    assert got[1] == brute([r[1:] for r in rows[:6]])[0]
    assert got[2] == brute([(None, "assistant", "b."), (None, "user", "a.")])[0]
    assert figures(C.repair(frame(spark, []))) == {}
    gone = spark.createDataFrame([("c", 1, "user", "a.", True)], "conv_id string, turn int, role string, text string, gone boolean")
    assert figures(C.repair(gone, gone_col="gone")) == {"c": (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_damage_and_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect()]
    want = {c: brute(kept)[0] for c, kept in damage(rows).items()}
    assert figures(op13_conversation_repair(spark, SF_SMALL)) == want
    odd = [(c, t, r, x) for c in (None, *range(40)) for t in (None, 1, 2, 5) for r, x in [("user", None if c == 3 else "Hi. So!")]]
    got = figures(C.repair(C.damaged(frame(spark, odd)), gone_col="gone"))
    assert got == {c: brute(kept)[0] for c, kept in damage(odd).items()}
