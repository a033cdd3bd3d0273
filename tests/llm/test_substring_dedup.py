import hashlib

import numpy as np
import pytest

from neo.llm import substring_dedup as S
from tests.llm.conftest import odd_rows


def brute(rows, size=100):
    """Every window of every text, one after the other; rows at the same id and start are ties."""
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        raw = (rows[k][1] or "").encode()
        key = float("inf") if rows[k][0] is None else rows[k][0]
        for s in range(len(raw) - size + 1):
            w = raw[s:s + size]
            seen[w] = min(seen.get(w, (key, s)), (key, s))
    for k in order:
        raw = (rows[k][1] or "").encode()
        key = float("inf") if rows[k][0] is None else rows[k][0]
        gone = bytearray(len(raw) + 1)
        for s in range(len(raw) - size + 1):
            if seen[raw[s:s + size]] < (key, s):
                gone[s:s + size] = b"\1" * size
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        out.append((rows[k][0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, **options):
    got = S.remove_repeats(df, **options).collect()
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str)


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("ab"), rng.integers(0, 400)))) for i in range(20)]
    rows += [(30, "a" * 500), (31, "ab" * 300), (32, "x" + "a" * 130 + "y"), (33, "abc" * 100 + "é" * 80)]
    letters = (lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n)))
    base = letters(700)
    for k in range(40, 80):
        p = rng.integers(0, 600)
        rows.append((k, base[p:p + rng.integers(50, 400)] + letters(40) + base[:rng.integers(80, 260)]))
    return [(int(i), t) for i, t in rows]


def test_brute_force(spark, mixed):
    df = spark.createDataFrame(mixed, "doc_id long, text string").repartition(3)
    want = brute(mixed)
    assert run(df) == want
    schema = S.arrow_schema(S.ANCHORS)
    found = df.selectExpr("doc_id", "0L", "text").mapInArrow(
        lambda it: S._anchors(it, np.empty(0, np.uint64), 1000, schema), S.ANCHORS).select("anchor").distinct().collect()
    every = np.array([r[0] for r in found if r[0] is not None], np.int64).view(np.uint64)
    assert run(df, heavy=every) == want  # every window on its own
    assert run(df, heavy=every[::2]) == want


def test_odd_rows(odd, none):
    assert run(odd) == brute([r[:2] for r in odd_rows()])
    assert run(none) == []
