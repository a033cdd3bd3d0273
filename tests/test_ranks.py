"""Order statistics, quantiles and running totals against brute force; KLL sketches within their error."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from neo.operators import aggregates as A
from neo.operators import ml as M
from neo.operators import ranks as R
from neo.operators import sketches as SK


def test_many_groups_and_large_numbers(spark):
    """50,000 groups, whole numbers beyond 2^53, one group and one value with a third of all rows each."""
    big = 2**60
    df = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50_000).alias("g"),
        F.when(F.col("id") % 3 == 1, F.lit(big)).otherwise(F.lit(big) + F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("v"))
    got = R.order_values(df, "v", {"low": F.lit(0), "mid": F.floor(F.col("n") / 2), "none": F.col("n")}, ["g"])
    want = df.toPandas().groupby("g")["v"].agg(lambda s: tuple(int(x) for x in (len(s), s.min(), np.sort(s.to_numpy())[len(s) // 2]))).to_dict()
    rows = got.collect()
    assert {r.g: (r.n, r.low, r.mid) for r in rows} == want and len(want) > 33_000
    assert all(r.none is None for r in rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_like_numpy(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), 0.5, float("nan"), None])) for _ in range(900)]
    df = spark.createDataFrame([*rows, ("c", None)], "g string, v double").repartition(parts)
    got = {r.g: (r.n, r.q, r.m) for r in R.quantiles(df, "v", {"q": 0.25, "m": 0.9}, ["g"]).collect()}
    for g in ("a", "b", None):
        v = [x for k, x in rows if k == g and x is not None and x == x]
        assert got[g][0] == len(v) and got[g][1:] == pytest.approx(tuple(np.quantile(v, [0.25, 0.9])), abs=1e-15)
    assert set(got) == {"a", "b", None}
    assert R.quantiles(df.where("g = 'c'"), "v", {"q": 0.5}).collect() == []


def test_running_totals(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xy"), rng.randrange(40), rng.randrange(3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, w int")
    got = {(r.g, r.v): (r.w, r.w_before, r.w_all) for r in R.running_totals(df, "v", {"w": F.col("w")}, ["g"]).collect()}
    want = {(g, v): (sum(w for a, b, w in rows if a == g and b == v), sum(w for a, b, w in rows if a == g and b < v),
                     sum(w for a, b, w in rows if a == g)) for g, v, _ in rows}
    assert got == want


def test_auc_counts_ties_half(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(12) / 12, rng.random() < 0.4) for i in range(300)]
    df = spark.createDataFrame([(i, p, int(y)) for i, p, y in rows], "id int, p double, label int")
    pos, neg = ([p for _, p, y in rows if y == t] for t in (True, False))
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert M.roc_auc(df, "p").first()[0] == pytest.approx(want, abs=1e-12)
    assert M.roc_auc(df.where("label = 1"), "p").first()[0] is None


def test_sketch_ranks(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(size=40_000), np.full(20_000, 0.25)])
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)], "g int, v double").repartition(9)
    halves = df.groupBy("g").agg(SK.sketch("v").alias("s"))
    q = halves.agg(SK.sketch_merge("s").alias("s")).select(SK.sketch_quantiles("s", [0.25, 0.5, 0.9]).alias("q")).first().q
    for p, x in zip((0.25, 0.5, 0.9), q):
        assert (values < x).mean() <= p + 2 * SK.RANK_ERROR and (values <= x).mean() >= p - 2 * SK.RANK_ERROR


def test_iqr_steps_keep_order_and_skip_empty_columns(spark):
    rng = random.Random(8)
    rows = [(rng.gauss(0, 1), None, rng.gauss(0, 1) * (9 if i % 50 == 0 else 1)) for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    for method, error in (("exact", 1e-9), ("approx", 0.05)):
        steps = A.iqr_steps(df, ("a", "b", "c"), method)
        assert [s.feature for s in steps] == ["a", "c"]
        left = [r for r in rows if steps[0].low <= r[0] <= steps[0].high]
        for step, column in zip(steps, ([r[0] for r in rows], [r[2] for r in left])):
            for p, q in ((0.25, step.q1), (0.75, step.q3)):
                n = len(column)
                assert sum(v < q for v in column) / n <= p + error + 1 / n and sum(v <= q for v in column) / n >= p - error - 1 / n


def test_box_of_many_levels(spark):
    df = spark.range(6000).select(F.concat(F.lit("L"), F.col("id") % 700).alias("risk_level"),
                                  F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("size"))
    got = {r.risk_level: r for r in A.size_box_stats(df).collect()}
    frame = df.toPandas()
    for level, part in list(frame.groupby("risk_level")["size"])[:60]:
        q = np.quantile(part, [0.25, 0.5, 0.75])
        assert (got[level].q1, got[level].median, got[level].q3) == pytest.approx(tuple(q))
        inside = part[(part >= q[0] - 1.5 * (q[2] - q[0])) & (part <= q[2] + 1.5 * (q[2] - q[0]))]
        assert (got[level].whisker_low, got[level].whisker_high, got[level].n) == (inside.min(), inside.max(), len(part))
    assert len(got) == 700


def test_label_of_large_whole_numbers(spark):
    big = 2**60
    df = spark.range(100).select((F.lit(big) + F.col("id")).alias("s"))
    assert A.percentile_label(df, "s", 0.85).where("label = 1").agg(F.min("s"), F.count("*")).first()[:] == (big + 85, 15)


def test_split_of_many_labels(spark):
    df = spark.range(9000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 900).alias("label"))
    got = M.stratified_split(df).groupBy("label", "split").count().collect()
    for r in got:
        n = 3000 if r.label is None else 10
        assert r["count"] == {"train": int(0.6 * n), "validation": int(0.8 * n) - int(0.6 * n), "test": n - int(0.8 * n)}[r.split]
