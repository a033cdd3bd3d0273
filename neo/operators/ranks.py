"""Ranks, order statistics and running totals of any number of groups of any size.

A sort of a group in one task, or a loop over groups on the driver, ends with the first large group
or the first many groups.  Here values are counted first (equal values become one row with its
weights, combined on the map side), then dealt by range over (group, value), so that a large group
spreads over tasks and small ones share a task.  Every task is a *bucket*: the weights of each
group in each bucket are a small table, and a running sum over it tells what lies before a
bucket.  Within a bucket a window does the rest.  Values keep their own type: whole numbers beyond
2^53, texts and structs are compared as they are, and nothing comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neo.session import scratch_path


def _dealt(df: DataFrame, value: Column, by: list[str], weights: dict[str, Column]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Distinct values ``g..., v, weights..., bucket`` and what lies in and before the buckets:
    ``g..., bucket, <w>_in, <w>_before, <w>_all``.  Null and NaN values are left out."""
    spark = df.sparkSession
    groups = [f"g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(g) for b, g in zip(by, groups)], value.alias("v"), *[w.alias(n) for n, w in weights.items()])
    rows = rows.where(F.col("v").isNotNull())
    if rows.schema["v"].dataType.typeName() in ("double", "float"):
        rows = rows.where(~F.isnan("v"))
    rows = rows.groupBy(*groups, "v").agg(*[F.sum(n).alias(n) for n in weights])
    # the buckets must stay as they are for both reads, so the dealt values are written
    path = scratch_path(spark, "ranks")
    order = [*groups, "v"]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("bucket", F.spark_partition_id())
     .write.parquet(path))
    rows = spark.read.schema(rows.schema.add("bucket", "integer")).parquet(path)
    group = Window.partitionBy(*groups)
    earlier = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*groups, "bucket").agg(*[F.sum(n).alias(f"{n}_in") for n in weights])
    sums = sums.withColumns({f"{n}_before": F.coalesce(F.sum(f"{n}_in").over(earlier), F.lit(0)) for n in weights}
                            | {f"{n}_all": F.sum(f"{n}_in").over(group) for n in weights})
    return rows, sums, groups


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's keys go."""
    there = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(there[f"_{k}"])
    return left.join(there, on, how).drop(*[f"_{k}" for k in keys])


def order_values(df: DataFrame, value: Column | str, at: dict[str, Column], by=()) -> DataFrame:
    """Values at 0-based ranks: ``by..., n, <name>...``, one row per group with values.

    ``at`` gives each name its rank, an expression of the group's size ``n``; a rank outside 0 to n - 1, or
    null, gives null.  Only the buckets that hold a rank are looked into."""
    by = list(by)
    value = F.col(value) if isinstance(value, str) else value
    rows, sums, groups = _dealt(df, value, by, {"c": F.lit(1)})
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), k.cast("long").alias("k")) for name, k in at.items()])
    inside = F.col("k").between(F.col("c_before"), F.col("c_before") + F.col("c_in") - 1)
    wanted = (sums.withColumn("n", F.col("c_all")).withColumn("r", F.explode(ranks)).select("*", "r.*").where(inside)
              .select(*groups, "bucket", "name", (F.col("k") - F.col("c_before")).alias("k")))
    keys = [*groups, "bucket"]
    looked = match(rows, wanted.select(*keys).distinct(), keys, "left_semi")
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))
    found = match(looked.withColumn("upto", upto), wanted, keys).where(
        (F.col("upto") > F.col("k")) & (F.col("upto") - F.col("c") <= F.col("k")))
    sizes = sums.groupBy(*groups).agg(F.max("c_all").alias("n")).where("n IS NOT NULL")
    picked = found.groupBy(*groups).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in at])
    out = match(sizes, picked, groups, "left") if groups else sizes.crossJoin(F.broadcast(picked))
    return out.withColumnsRenamed(dict(zip(groups, by)))


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by=()) -> DataFrame:
    """Exact linearly interpolated quantiles: ``by..., n, <name>...`` (h = (n - 1) p between the
    values at floor h and ceil h)."""
    at = {}
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(float(p))
        at |= {f"{name}_low": F.floor(h), f"{name}_high": F.ceil(h)}
    found = order_values(df, value, at, by)
    out = []
    for name, p in probs.items():
        low, high = (F.col(f"{name}_{e}").cast("double") for e in ("low", "high"))
        h = (F.col("n") - 1) * F.lit(float(p))
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (h - F.floor(h))).alias(name))
    return found.select(*by, "n", *out)


def running_totals(df: DataFrame, value: Column | str, weights: dict[str, Column], by=()) -> DataFrame:
    """Per distinct value: its weights, and their sums over the smaller values of its group:
    ``by..., v, <w>..., <w>_before..., <w>_all...``."""
    by = list(by)
    value = F.col(value) if isinstance(value, str) else value
    rows, sums, groups = _dealt(df, value, by, weights)
    keys = [*groups, "bucket"]
    inside = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"{n}_inside": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in weights})
    out = match(local, sums, keys)
    before = [(F.col(f"{n}_before") + F.col(f"{n}_inside")).alias(f"{n}_before") for n in weights]
    return out.select(*[F.col(g).alias(b) for g, b in zip(groups, by)], "v", *weights, *before, *[f"{n}_all" for n in weights])
