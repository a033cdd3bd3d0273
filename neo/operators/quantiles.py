"""Exact order statistics and quantiles of one column without moving its rows.

Nothing is sorted or shuffled by value: the k-th smallest value is found by *histogram
narrowing*.  Each round is one aggregation pass (``groupBy(bucket).agg(count, min, max)`` with
map-side combine) over the candidate interval, the driver picks the bucket that holds rank k
(at most ``BUCKETS`` small rows a rank), and the interval shrinks to that bucket's [min, max].  A
few rounds suffice; the search ends exactly when the interval holds one value.

This is for a whole column and a handful of ranks, compared as doubles.  For groups, and for whole
numbers, texts or structs, see :mod:`neo.operators.ranks`.

Interpolated quantiles use the rule of DuckDB's ``quantile_cont`` and numpy's
default: h = (n - 1) p, q = v[floor h] + (v[ceil h] - v[floor h]) (h - floor h).
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
APPROX_ACCURACY = 10_000


class Stats(NamedTuple):
    """Values that are neither null nor NaN: how many, the finite extremes, the infinite ones, and
    approximate percentiles as first brackets."""

    n: int
    lo: float | None
    hi: float | None
    approx: dict
    neg: int
    pos: int


def _values(df: DataFrame, value: str) -> DataFrame:
    return df.select(F.col(value).cast("double").alias("v"))


def _present(base: DataFrame) -> DataFrame:
    """Rows of the kept values that are neither null nor NaN.  A filter below the kept rows would compute the
    value again for each of its tests."""
    return base.where(F.col("v").isNotNull() & ~F.isnan("v"))


def column_stats(base: DataFrame, probs=()) -> Stats:
    v = F.col("v")
    finite = F.when(~v.isin(float("inf"), float("-inf")), v)
    aggs = [F.count(F.lit(1)).alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"),
            F.count_if(v == F.lit(float("-inf"))).alias("neg"), F.count_if(v == F.lit(float("inf"))).alias("pos")]
    if probs:
        aggs.append(F.percentile_approx(v, [float(p) for p in probs], APPROX_ACCURACY).alias("approx"))
    r = base.agg(*aggs).first()
    approx = dict(zip(probs, r["approx"])) if probs and r["n"] else {}
    return Stats(r["n"], r["lo"], r["hi"], approx, r["neg"], r["pos"])


def order_statistics(df: DataFrame, value: str, ranks: Iterable[int], brackets: dict | None = None,
                     buckets: int = BUCKETS) -> dict[int, float]:
    """Exact k-th smallest values (0-based ``k``) of ``value``; nulls and NaN are ignored.

    ``brackets`` ``{k: (lo, hi)}`` are optional first guesses; each is verified in the first round
    and replaced by the full range if it does not hold the rank."""
    base = _values(df, value).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        values = _present(base)
        return _search(values, column_stats(values), ranks, brackets or {}, buckets)
    finally:
        base.unpersist()


def _search(base: DataFrame, stats: Stats, ranks: Iterable[int], brackets: dict, buckets: int = BUCKETS) -> dict[int, float]:
    targets, result = [], {}  # target: [k, lo, hi, below]; below None = a guess, not known yet
    for k in sorted({int(x) for x in ranks}):
        if not 0 <= k < stats.n:
            raise ValueError(f"rank {k} outside 0..{stats.n - 1}")
        if k < stats.neg:                      # ranks on infinities need no search
            result[k] = float("-inf")
        elif k >= stats.n - stats.pos:
            result[k] = float("inf")
        elif stats.lo == stats.hi:
            result[k] = stats.lo
        elif k in brackets:
            targets.append([k, max(stats.lo, brackets[k][0]), min(stats.hi, brackets[k][1]), None])
        else:
            targets.append([k, stats.lo, stats.hi, stats.neg])
    v = F.col("v")
    # lo and hi of an interval always fall into different buckets, so each round is at
    # most one bucket wide: the search ends
    while targets:
        tags = []  # one pass for every open rank; bucket -1 counts the rows below a guessed bracket
        for i, (_k, lo, hi, below) in enumerate(targets):
            width = hi - lo
            bucket = (F.least(F.floor((v - F.lit(lo)) / F.lit(width) * F.lit(float(buckets))), F.lit(buckets - 1)).cast("long")
                      if width > 0 else F.lit(0).cast("long"))
            tag = F.when((v >= F.lit(lo)) & (v <= F.lit(hi)), F.lit(i * (buckets + 1) + 1) + bucket)
            if below is None:
                tag = tag.when(v < F.lit(lo), F.lit(i * (buckets + 1)))
            tags.append(tag)
        tagged = base.select("v", F.explode(F.filter(F.array(*tags), lambda t: t.isNotNull())).alias("t"))
        cells: dict[int, list] = {}
        for r in tagged.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            cells.setdefault(r["t"] // (buckets + 1), []).append((r["t"] % (buckets + 1) - 1, r["c"], r["lo"], r["hi"]))
        still = []
        for i, (k, lo, hi, below) in enumerate(targets):
            mine = sorted(cells.get(i, []))
            if below is None:
                below = sum(c for b, c, _l, _h in mine if b < 0)
                mine = [x for x in mine if x[0] >= 0]
                if not below <= k < below + sum(c for _b, c, _l, _h in mine):
                    still.append([k, stats.lo, stats.hi, stats.neg])   # bracket missed: full finite range
                    continue
            for _bucket, c, blo, bhi in mine:
                if below + c > k:
                    if blo == bhi or c == 1:
                        result[k] = blo
                    else:
                        still.append([k, blo, bhi, below])
                    break
                below += c
            else:
                raise RuntimeError("rank not found in histogram")
        targets = still
    return result


def quantiles(df: DataFrame, value: str, probs) -> list[float] | None:
    """Exact linearly interpolated quantiles; None without values.  One pass for counts and approximate
    brackets, then usually one histogram pass."""
    probs = [float(p) for p in probs]
    margin = 3.0 / APPROX_ACCURACY
    ends = {p: tuple(min(1.0, max(0.0, round(p + d, 6))) for d in (-margin, margin)) for p in probs}
    base = _values(df, value).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        values = _present(base)
        stats = column_stats(values, sorted({e for pair in ends.values() for e in pair}))
        if not stats.n:
            return None
        places = [((stats.n - 1) * p, p) for p in probs]
        brackets = {k: tuple(stats.approx[e] for e in ends[p]) for h, p in places for k in (math.floor(h), math.ceil(h))}
        got = _search(values, stats, brackets, brackets)
        out = []
        for h, _p in places:
            lo, hi = got[math.floor(h)], got[math.ceil(h)]
            out.append(lo if lo == hi else lo + (hi - lo) * (h - math.floor(h)))
        return out
    finally:
        base.unpersist()


def quantile(df: DataFrame, value: str, p: float) -> float | None:
    """One exact interpolated quantile of the whole column (None when empty)."""
    got = quantiles(df, value, [p])
    return got[0] if got else None
