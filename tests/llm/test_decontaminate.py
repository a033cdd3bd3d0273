import hashlib
import random
import re

from neo.llm import decontaminate as D
from tests.llm.conftest import odd_rows, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=13):
    out = []
    for i, text in docs:
        w, hit, held = split(text), set(), set()
        for item, t in items:
            x = split(t)
            n = min(size, len(x))
            for s in range(len(x) - n + 1 if n else 0):
                for a in range(len(w) - n + 1):
                    if w[a:a + n] == x[s:s + n]:
                        hit.update(range(a, a + n))
                        held.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(held), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string, window string")
    return sorted([tuple(r)[:6] for r in D.contamination(docs, bench).collect()], key=str)


def test_brute_force(spark):
    rng = random.Random(4)
    items = [(i, words(rng, rng.choice([1, 2, 5, 13, 14, 40]))) for i in range(14)]
    items += [(20, items[5][1]), (21, "THE the " * 20), (22, None), (23, " .. "), (None, words(rng, 15))]
    docs = []
    for i in range(60):
        parts = [words(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            x = split(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(x) - 13))
            parts += [" , ".join(x[a:a + rng.choice([12, 13, 20])]).upper(), words(rng, 30)]
        docs.append((i, " ".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute(docs, items)
    assert any(r[5] for r in want) and any(r[2] and not r[5] for r in want)
    assert run(spark, df, [(*x, "clash") for x in items]) == want


def test_odd_rows(spark, odd, none):
    rows = [r[:2] for r in odd_rows()]
    items = [(1, " ".join(rows[0][1].split(" ")[:20])), (2, "two words"), (3, "one"), (4, "a" * 700)]
    items = [(*x, None) for x in items]
    assert run(spark, odd, items) == brute(rows, [x[:2] for x in items])
    assert run(spark, odd, []) == brute(rows, [])
    assert run(spark, none, items) == []


def test_only_prefixes_are_joined(spark):
    """Of a window's shingles the rarest one is its prefix; a window that lacks a shingle has none."""
    keyed = spark.createDataFrame([("a", 13, i, k) for i, k in enumerate([5, 6, 7])]
                                  + [("b", 13, i, k) for i, k in enumerate([6, 5, 9])], "window string, len int, at int, key long")
    grams = spark.createDataFrame([(k,) for k in [5] * 4 + [6] * 2 + [7] * 3 + [8]], "key long")
    assert [tuple(r) for r in D.prefixes(keyed, grams).collect()] == [(6, 1, 13)]


def test_shuffled_sides(spark, odd, monkeypatch):
    rows = [r[:2] for r in odd_rows()]
    items = [(1, " ".join(rows[0][1].split(" ")[:20]), None), (2, "two words", None)]
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    assert run(spark, odd, items) == brute(rows, [x[:2] for x in items])


def test_no_python_in_the_plan(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    plan = D.contamination(odd, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan
