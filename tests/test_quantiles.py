"""Exact order statistics / quantiles against numpy, and the IQR filter."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from neo.operators import aggregates as A
from neo.operators import quantiles as Q
from neo.operators import ranks as R


def _df(spark, vals, groups=None):
    if groups is None:
        return spark.createDataFrame([(float(v),) for v in vals], "v double")
    return spark.createDataFrame([(g, float(v)) for g, v in zip(groups, vals)], "g string, v double")


def test_order_statistics_match_sorted(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.lognormal(0, 2, 3000), np.full(500, 3.25), rng.normal(0, 1e-9, 200)])
    df = _df(spark, vals)
    ranks = [0, 1, 17, 499, 1500, 3500, len(vals) - 1]
    got = Q.order_statistics(df, "v", ranks)
    srt = np.sort(vals)
    for k in ranks:
        assert got[k] == srt[k]


def test_quantiles_match_numpy_linear(spark):
    rng = np.random.default_rng(11)
    vals = rng.exponential(5.0, 2001)
    got = Q.quantiles(_df(spark, vals), "v", [0.0, 0.25, 0.5, 0.85, 1.0])
    want = np.quantile(vals, [0.0, 0.25, 0.5, 0.85, 1.0])
    assert got == pytest.approx(list(want), rel=1e-12)


def test_grouped_quantiles_with_skewed_group(spark):
    rng = np.random.default_rng(3)
    big = rng.normal(10, 3, 5000)
    small = rng.normal(0, 1, 7)
    vals = np.concatenate([big, small])
    groups = ["big"] * len(big) + ["small"] * len(small)
    rows = R.quantiles(_df(spark, vals, groups), "v", {"q1": 0.25, "q3": 0.75}, by=["g"]).collect()
    got = {r["g"]: [r["q1"], r["q3"]] for r in rows}
    assert got["big"] == pytest.approx(list(np.quantile(big, [0.25, 0.75])), rel=1e-12)
    assert got["small"] == pytest.approx(list(np.quantile(small, [0.25, 0.75])), rel=1e-12)


def test_empty_and_constant(spark):
    assert Q.quantiles(_df(spark, []), "v", [0.5]) is None
    assert Q.quantiles(_df(spark, [2.0] * 10), "v", [0.1, 0.9]) == [2.0, 2.0]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=60),
       st.floats(min_value=0, max_value=1))
def test_quantile_property(spark, vals, p):
    got = Q.quantile(_df(spark, vals), "v", p)
    assert got == pytest.approx(float(np.quantile(np.array(vals), p)), rel=1e-9, abs=1e-9)


def test_iqr_filter_sequential_and_subset(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, 400).tolist() + [50.0, -60.0]
    b = rng.normal(0, 1, 402).tolist()
    b[3] = 99.0
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))], "i long, a double, b double")
    out = A.iqr_outliers(df, ["a", "b"], method="exact")
    kept = {r["i"] for r in out.collect()}
    # reference computation: sequential filters with numpy quantiles
    import pandas as pd
    pdf = pd.DataFrame({"i": range(len(a)), "a": a, "b": b})
    for f in ["a", "b"]:
        q1, q3 = np.quantile(pdf[f], [0.25, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        pdf = pdf[(pdf[f] >= lo) & (pdf[f] <= hi)]
    assert kept == set(pdf["i"])
    assert 400 not in kept and 3 not in kept
    approx = {r["i"] for r in A.iqr_outliers(df, ["a", "b"], method="approx").collect()}
    assert approx <= set(range(len(a)))


def test_iqr_on_empty_skips(spark):
    df = spark.createDataFrame([], "size double, mass double")
    assert A.iqr_outliers(df, ["size", "mass"]).count() == 0


def test_percentile_label_and_balance(spark):
    vals = list(range(100))
    df = spark.createDataFrame([(float(v),) for v in vals], "collision_risk double")
    lab = A.percentile_label(df, "collision_risk", 0.85)
    bal = A.class_balance(lab).first()
    thr = np.quantile(vals, 0.85)
    assert bal["positives"] == sum(v > thr for v in vals) and bal["total"] == 100


def test_box_stats(spark):
    rng = np.random.default_rng(2)
    vals = rng.lognormal(0, 1, 300)
    lv = ["HIGH" if i % 3 == 0 else None for i in range(300)]
    df = spark.createDataFrame([(l, float(v)) for l, v in zip(lv, vals)], "risk_level string, size double")
    got = {r["risk_level"]: r for r in A.size_box_stats(df).collect()}
    for level, mask in (("HIGH", [x == "HIGH" for x in lv]), ("LOW", [x is None for x in lv])):
        v = vals[np.array(mask)]
        q1, med, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        r = got[level]
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, med, q3), rel=1e-12)
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert r["whisker_high"] == inside.max() and r["n"] == len(v)


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 10]] + [(None,)],
                               "enhanced_collision_probability double")
    got = {r["bin"]: r["count"] for r in A.probability_histogram(df, bins=5).collect()}
    assert got == {0: 3, 1: 2, 2: 1, 4: 1}
    assert sum(got.values()) == 7
    one = spark.createDataFrame([(0.5,), (0.5,)], "enhanced_collision_probability double")
    assert [(r["bin"], r["count"]) for r in A.probability_histogram(one).collect()] == [(0, 2)]


def test_wrong_bracket_falls_back_to_full_range(spark):
    vals = list(range(1000))
    df = _df(spark, vals)
    got = Q.order_statistics(df, "v", [10, 990], brackets={10: (500.0, 600.0), 990: (0.0, 5.0)})
    assert got[10] == 10.0 and got[990] == 990.0


def test_infinities_are_ordered_not_searched(spark):
    vals = [float("-inf")] * 3 + [float(i) for i in range(10)] + [float("inf")] * 2
    got = Q.order_statistics(_df(spark, vals), "v", [0, 2, 3, 7, 12, 13, 14])
    srt = sorted(vals)
    assert [got[k] for k in (0, 2, 3, 7, 12, 13, 14)] == [srt[k] for k in (0, 2, 3, 7, 12, 13, 14)]
    q = Q.quantiles(_df(spark, vals), "v", [0.5])
    assert q == [float(np.quantile(np.array(vals), 0.5))]


def test_kept_values_are_computed_once_a_row(spark, monkeypatch):
    """The tests for null and NaN lie above the kept values, so that they do not compute them again."""
    plans, own = [], Q.column_stats
    monkeypatch.setattr(Q, "column_stats", lambda base, *a: (plans.append(base._jdf.queryExecution().optimizedPlan().toString()), own(base, *a))[1])
    df = spark.range(1001).select(F.when(F.col("id") > 0, F.sin(F.col("id")) * 0 + F.col("id")).alias("x"))
    assert Q.quantile(df, "x", 0.5) == 500.5
    assert "InMemoryRelation" in plans[0] and "Filter" in plans[0].split("InMemoryRelation")[0]
    assert "Filter" not in plans[0].split("InMemoryRelation")[1]
