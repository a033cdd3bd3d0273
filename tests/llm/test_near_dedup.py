import collections
import itertools
import math
import random
import re

import numpy as np
import pytest

from neo.llm import near_dedup as N
from tests.llm.conftest import odd_rows, words

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def weighted(text):
    w = WORD.findall((text or "").encode().lower())
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    return {k: 1 + math.log(n) for k, n in collections.Counter(grams).items()}


def similarity(x, y):
    union = list(x.keys() | y.keys())
    a, b = (np.array([s.get(k, 0.0) for k in union]) for s in (x, y))
    return sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero((a > 0) & (b > 0)))


def brute_groups(rows):
    """Group number of each row: connected components over all pairs."""
    sets = [weighted(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
            label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


def expected(rows):
    groups = brute_groups(rows)
    ids = collections.defaultdict(list)
    for (i, _), g in zip(rows, groups):
        ids[g].append(i)
    first = {g: min((i for i in v if i is not None), default=None) for g, v in ids.items()}
    return sorted([(i, first[g]) for (i, _), g in zip(rows, groups)], key=str)


def copies():
    """Three families of near copies around the threshold, and texts of their own."""
    rng = random.Random(6)
    rows = []
    for family in range(3):
        base = words(rng, 150).split(" ")
        for k in range(30):
            w = list(base)
            for _ in range(k % 5):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((len(rows), " ".join(w)))
    return rows + [(200 + i, words(rng, rng.randint(1, 80))) for i in range(40)]


def test_groups(spark):
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = N.near_duplicates(df).collect()
    assert sorted([(r.doc_id, r.group_id) for r in got], key=str) == expected(rows)
    assert all(r.kept == (r.doc_id == r.group_id) for r in got)


def test_odd_rows(odd, none):
    rows = [r[:2] for r in odd_rows()]
    got = N.near_duplicates(odd).collect()
    assert sorted([(r.doc_id, r.group_id) for r in got], key=str) == expected(rows)
    assert N.near_duplicates(none).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_registers_estimate_the_similarity(share):
    rng = np.random.default_rng(8)
    common, n = int(300 * share), 300
    items = rng.integers(1, 1 << 63, 2 * n - common, dtype=np.uint64)
    weight = 1 + rng.random(len(items)) * 3
    a, b = np.arange(n), np.append(np.arange(common), np.arange(n, len(items)))
    row = np.repeat([0, 1], n)
    registers = N.prob_min_hash(row, np.append(items[a], items[b]), np.append(weight[a], weight[b]), 2, 4096)
    want = similarity({int(i): w for i, w in zip(items[a], weight[a])}, {int(i): w for i, w in zip(items[b], weight[b])})
    assert abs((registers[0] == registers[1]).mean() - want) < 0.04


def test_exact_similarity():
    rng = np.random.default_rng(9)
    for _ in range(50):
        x = {int(k): float(w) for k, w in zip(rng.integers(0, 40, 20), rng.integers(1, 4, 20))}
        y = {int(k): float(w) for k, w in zip(rng.integers(0, 40, 20), rng.integers(1, 4, 20))}
        a, b = np.array(sorted(x), np.uint64), np.array(sorted(y), np.uint64)
        got = N.probability_jaccard(a, np.array([x[int(k)] for k in a], np.float32), b,
                                    np.array([y[int(k)] for k in b], np.float32))
        assert math.isclose(got, similarity(x, y), rel_tol=1e-5, abs_tol=1e-9)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 100)] + [(200, 201)], "hub long, cls long")
    got = dict(N.components(links).collect())
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200}


def test_pairs_of_a_large_bucket_are_all_found(spark):
    """Pairs of similar texts, all of them less similar variants of one text."""
    rng = random.Random(12)
    base, rows = words(rng, 300).split(" "), []
    for k in range(200):
        center = list(base)
        for at in rng.sample(range(4, 296), 2):
            center[at] = f"center{k}x{at}"
        for side in ("left", "right"):
            w = list(center)
            for at in rng.sample(range(4, 296), 3):
                w[at] = f"{side}{k}x{at}"
            rows.append((len(rows), " ".join(w)))
    sets = [weighted(t) for _, t in rows]
    at = {g: i for i, g in enumerate({g for s in sets for g in s})}
    table = np.zeros((len(rows), len(at)), np.float32)
    for i, s in enumerate(sets):
        assert set(s.values()) == {1.0}  # so the similarity is that of plain sets
        table[i, [at[g] for g in s]] = 1
    common, size = table @ table.T, table.sum(axis=1)
    near = common / (size[:, None] + size - common) >= 0.8
    label = np.arange(len(rows))
    while True:
        new = np.where(near, label, len(rows)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert 20 < len(set(label.tolist())) < len(rows) - 20
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.group_id for r in got} == dict(enumerate(label.tolist()))


def test_no_partial_count_of_links(none):
    assert N.near_duplicates(none).columns == ["doc_id", "class_id", "group_id", "kept", "row1", "row2"]


def test_sketches_agree_as_registers_do(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, (40, 512), dtype=np.uint64)
    b = np.where(rng.random((40, 512)) < 0.7, a, rng.integers(0, 1 << 63, (40, 512), dtype=np.uint64))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(N.register_bits(a), N.register_bits(b)))],
                               "i int, x array<long>, y array<long>")
    got = {r.i: r.n for r in df.select("i", N.agreeing("x", "y", 512).alias("n")).collect()}
    for i in range(40):
        same = int((a[i] == b[i]).sum())
        assert same <= got[i] <= same + 60  # unequal registers have equal bits once in eight


def test_regrouped_joins_groups(spark):
    labels = spark.createDataFrame([(i, i - i % 3) for i in range(12)], "cls long, label long")
    links = spark.createDataFrame([(1, 2), (2, 4), (5, 10), (3, 4)], "hub long, cls long")
    assert dict(N.regrouped(labels, links).collect()) == {i: {0: 0, 3: 0, 9: 0, 6: 6}[i - i % 3] for i in range(12)}
