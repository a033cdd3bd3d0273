"""Aggregations.

Global reports are ONE ``agg`` each (partial aggregation on every map task, a
single tiny final merge), grouped ones are ``groupBy`` with map-side combine.
Exact quantiles of a column go through :mod:`neo.operators.quantiles`, those of groups through
:mod:`neo.operators.ranks`, approximate ones through KLL sketches (:mod:`neo.operators.sketches`).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neo import constants as K
from neo.operators import quantiles as Q
from neo.operators import ranks as R
from neo.operators import sketches as SK


def _count_if(cond: Column) -> Column:
    return F.count_if(cond)


def risk_counts(df: DataFrame, level: str = "risk_level") -> DataFrame:
    """A1: total, HIGH and MEDIUM counts in one pass."""
    lv = F.col(level)
    return df.agg(F.count(F.lit(1)).alias("total_asteroids"),
                  _count_if(lv == "HIGH").alias("high_risk_asteroids"),
                  _count_if(lv == "MEDIUM").alias("medium_risk_asteroids"))


def classification_counts(df: DataFrame, col: str = "classification") -> DataFrame:
    """A2."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def size_stats(df: DataFrame, col: str = "size") -> DataFrame:
    """A3: mean, sample standard deviation, min, max."""
    c = F.col(col)
    return df.agg(F.avg(c).alias("avg_size"), F.stddev_samp(c).alias("stddev_size"),
                  F.min(c).alias("min_size"), F.max(c).alias("max_size"))


def distance_stats(df: DataFrame, col: str = "distance_from_earth") -> DataFrame:
    """A4."""
    c = F.col(col)
    return df.agg(F.avg(c).alias("avg_earth_distance"), F.min(c).alias("min_earth_distance"),
                  F.max(c).alias("max_earth_distance"))


def summary(df: DataFrame) -> DataFrame:
    """A5: A1, A3 and A4 as ONE single-row aggregate (the reference runs eight jobs).
    The per-class counts (A2) are the separate grouped frame."""
    lv, s, d = F.col("risk_level"), F.col("size"), F.col("distance_from_earth")
    return df.agg(
        F.count(F.lit(1)).alias("total_asteroids"),
        _count_if(lv == "HIGH").alias("high_risk_asteroids"),
        _count_if(lv == "MEDIUM").alias("medium_risk_asteroids"),
        F.avg(s).alias("avg_size"), F.stddev_samp(s).alias("stddev_size"),
        F.min(s).alias("min_size"), F.max(s).alias("max_size"),
        F.avg(d).alias("avg_earth_distance"), F.min(d).alias("min_earth_distance"),
        F.max(d).alias("max_earth_distance"))


def panel_stats(df: DataFrame, prob: str = "enhanced_collision_probability") -> DataFrame:
    """Total, HIGH, MEDIUM, LOW, average size, max probability (0 when empty;
    a missing probability counts as 0)."""
    lv = F.col("risk_level")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        _count_if(lv == "HIGH").alias("high"), _count_if(lv == "MEDIUM").alias("medium"),
        _count_if(lv == "LOW").alias("low"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_size"),
        F.coalesce(F.max(F.coalesce(F.col(prob), F.lit(0.0))), F.lit(0.0)).alias("max_probability"))


def probability_histogram(df: DataFrame, prob: str = "enhanced_collision_probability",
                          bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram of the probability (missing = 0).

    bin = min(floor((p - min) / width), bins - 1) with width = (max - min) / bins;
    the maximum lands in the last bin, a zero range gives one bin.  min and max
    are one scalar subquery (one partial aggregate), not a driver round trip.
    Columns: bin, bin_start, bin_end, count (empty bins are not listed)."""
    p = F.coalesce(F.col(prob), F.lit(0.0))
    vals = df.select(p.alias("__p"))
    rng = vals.agg(F.struct(F.min("__p").alias("lo"), F.max("__p").alias("hi")).alias("r")).select("r").scalar()
    lo, hi = rng.getField("lo"), rng.getField("hi")
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col("__p") - lo) / width), F.lit(bins - 1)).cast("int"))
    counted = vals.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        "bin",
        (lo + F.col("bin") * width).alias("bin_start"),
        F.when(hi == lo, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("bin_end"),
        "count")


def size_box_stats(df: DataFrame, value: str = "size", level: str = "risk_level") -> DataFrame:
    """Per risk level (missing = LOW): n, min, q1, median, q3, max, the 1.5 IQR
    fences and the whiskers (extreme values inside the fences).  Quartiles are exact
    (:mod:`neo.operators.ranks`); any number of levels is one plan, and nothing comes to the driver."""
    keyed = df.select(F.coalesce(F.col(level), F.lit("LOW")).alias("risk_level"), F.col(value).alias("__v"))
    iqr = K.IQR_MULTIPLIER * (F.col("q3") - F.col("q1"))
    fences = R.quantiles(keyed, "__v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["risk_level"]).select(
        "risk_level", "q1", "median", "q3", (F.col("q1") - iqr).alias("lower_fence"), (F.col("q3") + iqr).alias("upper_fence"))
    inside = F.col("__v").between(F.col("lower_fence"), F.col("upper_fence"))
    names = ["risk_level", "q1", "median", "q3", "lower_fence", "upper_fence"]
    return keyed.where(F.col("__v").isNotNull()).join(fences, "risk_level").groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"), F.min("__v").alias("min"), F.max("__v").alias("max"),
        F.min(F.when(inside, F.col("__v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__v"))).alias("whisker_high")).select(
        "risk_level", "n", "min", "q1", "median", "q3", "max", "lower_fence", "upper_fence", "whisker_low", "whisker_high")


def size_box_sketch(df: DataFrame, value: str = "size", level: str = "risk_level") -> DataFrame:
    """A8 in one pass: as :func:`size_box_stats` without whiskers, quartiles from KLL sketches."""
    found = (df.groupBy(F.coalesce(F.col(level), F.lit("LOW")).alias("risk_level"))
             .agg(SK.sketch(value).alias("s"), F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
             .where("n > 0").withColumn("q", SK.sketch_quantiles("s", [0.25, 0.5, 0.75])))
    q1, median, q3 = (F.col("q")[i] for i in range(3))
    return found.select("risk_level", "n", "min", q1.alias("q1"), median.alias("median"), q3.alias("q3"), "max",
                        (q1 - K.IQR_MULTIPLIER * (q3 - q1)).alias("lower_fence"),
                        (q3 + K.IQR_MULTIPLIER * (q3 - q1)).alias("upper_fence"))


class IqrStep(NamedTuple):
    """Quartiles of a feature over the rows that the features before it kept, and its bounds."""

    feature: str
    q1: float
    q3: float

    @property
    def low(self) -> float:
        return self.q1 - K.IQR_MULTIPLIER * (self.q3 - self.q1)

    @property
    def high(self) -> float:
        return self.q3 + K.IQR_MULTIPLIER * (self.q3 - self.q1)

    def keeps(self) -> Column:
        return (F.col(self.feature) >= F.lit(self.low)) & (F.col(self.feature) <= F.lit(self.high))


def iqr_quartiles(df: DataFrame, feature: str, method: str = "approx") -> IqrStep | None:
    """Q1 and Q3 of ``feature`` (None when there are no values): ``approx`` from one KLL sketch, whose
    rank error (0.7 %) is well inside the 5 % the reference allows, ``exact`` interpolated."""
    if method == "approx":
        got = SK.group_quantiles(df, feature, [0.25, 0.75]).first()
        return IqrStep(feature, *got["q"]) if got else None
    if method == "exact":
        got = Q.quantiles(df, feature, [0.25, 0.75])
        return IqrStep(feature, *got) if got else None
    raise ValueError(f"unknown method {method!r}")


def iqr_steps(df: DataFrame, features=K.IQR_FEATURES, method: str = "approx", persist: bool = True) -> list[IqrStep]:
    """The bounds of A9, feature by feature; a feature with no values is skipped.

    Eager: one sketch job per feature (``approx``) or two or three passes (``exact``).  Only the feature
    columns are persisted for those jobs (memory and disk; a lost executor recomputes only its own blocks)."""
    narrow = df.select(*features)
    narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK) if persist else narrow
    steps: list[IqrStep] = []
    cur = narrow
    try:
        for feature in features:
            step = iqr_quartiles(cur, feature, method)
            if step is not None:
                steps.append(step)
                cur = cur.where(step.keeps())
    finally:
        if persist:
            narrow.unpersist()
    return steps


def iqr_outliers(df: DataFrame, features=K.IQR_FEATURES, method: str = "approx", persist: bool = True) -> DataFrame:
    """Keep rows inside [Q1 - 1.5 IQR, Q3 + 1.5 IQR] (inclusive) for each feature
    in turn; each feature's quartiles come from the rows the previous features
    kept (order matters).  The bounds (:func:`iqr_steps`, eager) become literals of the returned lazy
    plan, which computes every other column once, in the consumer's pass."""
    for step in iqr_steps(df, list(features), method, persist):
        df = df.where(step.keeps())
    return df


def iqr_checked(df: DataFrame, steps: list[IqrStep], error: float = K.IQR_RELATIVE_ERROR) -> DataFrame:
    """Whether each step's quartiles stand at their ranks, give or take ``error`` of the rows that
    the steps before it kept: ``feature, q1_within, q3_within``; one pass for all steps."""
    kept, aggs = F.lit(True), []
    for i, step in enumerate(steps):
        v = F.when(kept, F.col(step.feature).cast("double"))
        for name, p, q in (("q1", 0.25, step.q1), ("q3", 0.75, step.q3)):
            within = ((F.count_if(v < F.lit(q)) <= (p + error) * F.count(v))
                      & (F.count_if(v <= F.lit(q)) >= (p - error) * F.count(v)))
            aggs.append(within.alias(f"{name}{i}"))
        kept = kept & step.keeps()
    rows = F.array(*[F.struct(F.lit(s.feature).alias("feature"), F.col(f"q1{i}").alias("q1_within"), F.col(f"q3{i}").alias("q3_within"))
                     for i, s in enumerate(steps)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def prediction_stats(results: DataFrame) -> DataFrame:
    """A10: over successful predictions, min / max / mean probability and mean time."""
    ok = results.where(F.col("success"))
    return ok.agg(F.count(F.lit(1)).alias("successful"),
                  F.min("ml_probability").alias("min_probability"),
                  F.max("ml_probability").alias("max_probability"),
                  F.avg("ml_probability").alias("mean_probability"),
                  F.avg("prediction_time_ms").alias("mean_prediction_time_ms"))


def risk_distribution(results: DataFrame, level: str = "ml_risk_level") -> DataFrame:
    """Count and percentage of successful predictions per level, sorted by level.
    The total is a window over the grouped rows (one per level, a handful), so
    the input is scanned once."""
    from pyspark.sql import Window

    ok = results.where(F.col("success"))
    counted = ok.groupBy(F.col(level).alias("risk_level")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counted.withColumn("percentage", F.col("count") * F.lit(100.0) / total).orderBy("risk_level")


def success_rate(results: DataFrame) -> DataFrame:
    """Successes, failures, rate in percent and its grade."""
    out = results.agg(F.count(F.lit(1)).alias("total"), _count_if(F.col("success")).alias("successes"))
    rate = F.when(F.col("total") > 0, F.col("successes") * F.lit(100.0) / F.col("total")).otherwise(F.lit(0.0))
    out = out.withColumns({"failures": F.col("total") - F.col("successes"), "success_rate": rate})
    grade = None
    for lim, name in K.SUCCESS_GRADES:
        cond = F.col("success_rate") >= F.lit(lim)
        grade = F.when(cond, F.lit(name)) if grade is None else grade.when(cond, F.lit(name))
    return out.withColumn("grade", grade.otherwise(F.lit(K.SUCCESS_GRADE_DEFAULT)))


def percentile_label(df: DataFrame, score: str = "collision_risk", p: float = K.PERCENTILE_LABEL,
                     out: str = "label") -> DataFrame:
    """Label 1 where score > the exact interpolated p-quantile of the score.

    The quantile lies between two neighbouring values, so the scores above it are those above
    the lower one: whole numbers of any size are compared with that, never as doubles."""
    low = R.order_values(df, score, {"low": F.floor((F.col("n") - 1) * F.lit(float(p)))}).select("low").scalar() \
        if df.schema[score].dataType.typeName() in ("byte", "short", "integer", "long", "decimal") else None
    if low is None:
        t = Q.quantile(df, score, p)
        low = F.lit(float("inf")) if t is None else F.lit(t)
    return df.withColumn(out, (F.col(score) > low).cast("int"))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Positives, negatives and their shares."""
    lb = F.col(label)
    out = df.agg(F.count(F.lit(1)).alias("total"), _count_if(lb == 1).alias("positives"),
                  _count_if(lb == 0).alias("negatives"))
    return out.withColumns({
        "positive_share": F.try_divide(F.col("positives").cast("double"), F.col("total").cast("double")),
        "negative_share": F.try_divide(F.col("negatives").cast("double"), F.col("total").cast("double"))})


def high_risk_list(results: DataFrame, threshold: float = K.ALERT_THRESHOLD) -> DataFrame:
    """A15 (first half): successful predictions above the alert threshold."""
    return results.where(F.col("success") & (F.col("ml_probability") > F.lit(threshold))).select(
        "scenario", "asteroid_id", "ml_probability", "ml_risk_level")


def failure_list(results: DataFrame) -> DataFrame:
    """A15 (second half): failed predictions and their errors."""
    return results.where(~F.col("success")).select(
        "scenario", "asteroid_id", F.coalesce(F.col("error"), F.lit("unknown error")).alias("error"))

