"""Quantiles from KLL sketches: mergeable, of fixed size, with a stated rank error.

A sketch of ``KLL_K`` holds a column of any length in about ten kilobytes.  The rank of a
quantile read from it is off by at most ``RANK_ERROR`` of the rows with 99 % confidence, whatever
the data and however many sketches were merged.  The aggregate combines on the map side, so a
group of any size reaches the shuffle as one sketch per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter, and the rank error that it gives with 99 % confidence.
KLL_K, RANK_ERROR = 400, 0.007


def sketch(value: str, k: int = KLL_K) -> Column:
    """Aggregate: the sketch of a column's values; nulls and NaN are left out."""
    v = F.col(value).cast("double")
    return F.kll_sketch_agg_double(F.when(~F.isnan(v), v), F.lit(k))


def sketch_merge(column: str) -> Column:
    """Aggregate: one sketch for many."""
    return F.kll_merge_agg_double(column)


def sketch_quantiles(column: str, probs) -> Column:
    """The values at the shares ``probs``; null where the sketch holds no value."""
    some = F.kll_sketch_get_n_double(column) > 0
    return F.when(some, F.kll_sketch_get_quantile_double(F.col(column), F.array(*[F.lit(float(p)) for p in probs])))


def group_quantiles(df: DataFrame, value: str, probs, by=(), k: int = KLL_K) -> DataFrame:
    """``by..., n, q`` of every group that has values, in one pass whatever the number of groups."""
    found = df.groupBy(*by).agg(sketch(value, k).alias("s"))
    return (found.withColumn("n", F.kll_sketch_get_n_double("s")).where("n > 0")
            .withColumn("q", sketch_quantiles("s", probs)).drop("s"))


def rank_within(value: str, p: float, q: Column, error: float) -> Column:
    """Aggregate: whether ``q`` stands at the share ``p`` of the values, give or take ``error``."""
    v = F.col(value).cast("double")
    n = F.count(v)
    return (F.count_if(v < q) <= (p + error) * n) & (F.count_if(v <= q) >= (p - error) * n)
