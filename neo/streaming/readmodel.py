"""Live read-model (ST4) from mergeable partial aggregates per time slice.

Every micro-batch is reduced to one row per (day, risk level): counts, sums, extremes, the
cells of a fixed-range histogram, a KLL sketch of the sizes, and the riskiest rows.  These merge with
the rows of the version before; days that leave the window are dropped.  A refresh thus reads
the batch and a few rows per day, never the history, and any panel over the last days and
any set of levels is read from the same rows.

Beside them the sizes and probabilities of every row are kept, a folder for each day and batch under
``rows``, written once and gone with their day: quartiles, fences, whiskers and the histogram over the range of
the data are exact, and are computed when they are read (:func:`exact_tables`).

Versions are whole folders, ``version=<batch id>``.  A version becomes current when the file
``CURRENT`` is replaced by rename (atomic on HDFS and local disks), so a reader finds the old tables or the
new ones, never none.  A batch that is run again finds its version current and does
nothing, or writes the same folder anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from neo import constants as K
from neo.functions.timefn import to_ntz
from neo.operators import aggregates as A
from neo.operators.sketches import sketch, sketch_merge, sketch_quantiles
from neo.sources import tables as T
from neo.streaming.landing import _trigger

#: Parts in which the riskiest rows of a slice are ranked before they are ranked together.
PARTS = 32

_BINS = [f"b{i}" for i in range(K.HISTOGRAM_BINS)]
_WIDTH = K.PROBABILITY_SCALE / K.HISTOGRAM_BINS
_VALUES = "slice date, batch long, level string, size double, probability double"
_TOP = ("id", "event_id", "size", "distance_from_earth", "probability")


def sliced(df: DataFrame, prob: str = "enhanced_collision_probability", ts_col: str = "timestamp") -> DataFrame:
    """The columns the model needs, with the day as ``slice``; rows without a time are in no slice."""
    return df.select(F.to_date(to_ntz(df, ts_col)).alias("slice"), F.col("risk_level").alias("level"), "id", "event_id", "size",
                     "distance_from_earth", F.coalesce(F.col(prob), F.lit(0.0)).alias("probability")).where("slice IS NOT NULL")


def partials(rows: DataFrame) -> DataFrame:
    """One row per slice and level of ``sliced`` rows."""
    cell = F.least(F.floor(F.col("probability") / F.lit(_WIDTH)), F.lit(K.HISTOGRAM_BINS - 1))
    return rows.withColumn("cell", F.greatest(cell, F.lit(0))).groupBy("slice", "level").agg(
        F.count(F.lit(1)).alias("n"), F.count("size").alias("n_size"), F.sum("size").alias("sum_size"),
        F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.max("probability").alias("max_probability"),
        *[F.count_if(F.col("cell") == i).alias(b) for i, b in enumerate(_BINS)], sketch("size").alias("sizes"))


def merged(parts: DataFrame) -> DataFrame:
    """Partial rows of the same slice and level as one."""
    return parts.groupBy("slice", "level").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_size", "sum_size")], F.min("min_size").alias("min_size"),
        F.max("max_size").alias("max_size"), F.max("max_probability").alias("max_probability"),
        *[F.sum(b).alias(b) for b in _BINS], sketch_merge("sizes").alias("sizes"))


def riskiest(rows: DataFrame, k: int = K.TOP_K_TABLE) -> DataFrame:
    """The ``k`` riskiest rows of every slice and level, ranked in parts first."""
    order = [F.desc("probability"), F.asc("id"), F.asc("event_id")]
    for keys in (["slice", "level", F.pmod(F.xxhash64("event_id"), F.lit(PARTS))], ["slice", "level"]):
        rows = (rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
                .where(F.col("place") <= k).drop("place"))
    return rows.select("slice", "level", *_TOP)


def current_version(spark: SparkSession, path: str) -> int | None:
    """The version readers use; none before the first."""
    if not any(name == "CURRENT" for name, _ in T.children(spark, path)):
        return None
    return int(spark.read.text(f"{path}/CURRENT").first()[0])


def _point(spark: SparkSession, path: str, version: int) -> None:
    """Make a version current; the one before it stays for readers that have just found it."""
    before = current_version(spark, path)
    T.replace_text(spark, f"{path}/CURRENT", str(version))
    for v in T.partition_values(spark, path, "version"):
        if int(v) not in (before, version):
            T.remove(spark, f"{path}/version={v}")


def _slices(spark: SparkSession, at: str) -> set[str]:
    """The days of a version; at most as many as it keeps."""
    return {str(r[0]) for r in spark.read.parquet(f"{at}/partials").select("slice").distinct().collect()}


def refresh(batch: DataFrame, version: int, path: str, days: int) -> None:
    """Merge a batch of records into the model under ``path``; ``days`` slices are kept."""
    spark = batch.sparkSession
    before = current_version(spark, path)
    if before is not None and before >= version:
        return
    rows = sliced(batch).persist()
    try:
        parts, top = partials(rows), riskiest(rows)
        if before is not None:
            parts = merged(spark.read.parquet(f"{path}/version={before}/partials").unionByName(parts))
            top = riskiest(spark.read.parquet(f"{path}/version={before}/riskiest").unionByName(top))
        out = f"{path}/version={version}"
        newest = F.max("slice").over(Window.partitionBy())
        parts = parts.withColumn("newest", newest).where(F.col("slice") > F.date_sub("newest", days)).drop("newest")
        parts.write.mode("overwrite").parquet(f"{out}/partials")
        kept = spark.read.parquet(f"{out}/partials").select("slice").distinct()
        top.join(kept, "slice", "left_semi").write.mode("overwrite").parquet(f"{out}/riskiest")
        for day in T.partition_values(spark, f"{path}/rows", "slice"):  # of a run of this batch that failed
            T.remove(spark, f"{path}/rows/slice={day}/batch={version}")
        (rows.join(F.broadcast(kept), "slice", "left_semi")
         .select("slice", F.lit(version).alias("batch"), "level", F.col("size").cast("double").alias("size"), "probability")
         .write.mode("append").partitionBy("slice", "batch").parquet(f"{path}/rows"))
    finally:
        rows.unpersist()
    _point(spark, path, version)
    used = _slices(spark, out) | (_slices(spark, f"{path}/version={before}") if before is not None else set())
    for day in T.partition_values(spark, f"{path}/rows", "slice"):
        if day not in used:
            T.remove(spark, f"{path}/rows/slice={day}")


def live_read_model(stream: DataFrame, path: str, checkpoint: str, days: int = 30, trigger: str = "30 seconds") -> StreamingQuery:
    """ST4: keep the model of the last ``days`` days under ``path`` (read it with :func:`read_live_model`)."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: refresh(batch, i, path, days))
    return _trigger(w, trigger).start()


def model_tables(parts: DataFrame, top: DataFrame, days: int | None = None, levels=None, k: int = K.TOP_K_TABLE) -> dict[str, DataFrame]:
    """Panel (A6), histogram (A7 over the fixed range of the probability), box (A8, quartiles from
    sketches) and top (W4) of the last ``days`` slices and of ``levels``; a missing level is LOW."""
    newest = parts.agg(F.max("slice")).scalar()
    kept = F.lit(True) if days is None else F.col("slice") > F.date_sub(newest, days)
    if levels is not None:
        kept = kept & F.coalesce("level", F.lit("LOW")).isin(list(levels))
    parts, top = parts.where(kept), top.where(kept)

    def count(c, when=None):
        return F.coalesce(F.sum(c if when is None else F.when(when, F.col(c))), F.lit(0))

    panel = parts.agg(
        count("n").alias("total"), *[count("n", F.col("level") == v).alias(v.lower()) for v in ("HIGH", "MEDIUM", "LOW")],
        F.coalesce(F.try_divide(F.sum("sum_size"), F.sum("n_size")), F.lit(0.0)).alias("avg_size"),
        F.coalesce(F.max("max_probability"), F.lit(0.0)).alias("max_probability"))
    cells = F.array(*[F.struct(F.lit(i).alias("bin"), F.col(b).alias("count")) for i, b in enumerate(_BINS)])
    histogram = (parts.select(F.explode(cells).alias("c")).groupBy("c.bin").agg(F.sum("c.count").alias("count")).where("count > 0")
                 .select("bin", (F.col("bin") * F.lit(_WIDTH)).alias("bin_start"),
                         ((F.col("bin") + 1) * F.lit(_WIDTH)).alias("bin_end"), "count"))
    box = (parts.where("n_size > 0").groupBy(F.coalesce("level", F.lit("LOW")).alias("risk_level"))
           .agg(F.sum("n_size").alias("n"), F.min("min_size").alias("min"), F.max("max_size").alias("max"),
                sketch_merge("sizes").alias("s")))
    box = box.withColumn("q", sketch_quantiles("s", [0.25, 0.5, 0.75]))
    q1, median, q3 = (F.col("q")[i] for i in range(3))
    box = box.select("risk_level", "n", "min", q1.alias("q1"), median.alias("median"), q3.alias("q3"), "max",
                     (q1 - K.IQR_MULTIPLIER * (q3 - q1)).alias("lower_fence"),
                     (q3 + K.IQR_MULTIPLIER * (q3 - q1)).alias("upper_fence"))
    top = top.orderBy(F.desc("probability"), "id", "event_id").limit(k).select(
        "id", "size", F.coalesce("distance_from_earth", F.lit(0.0)).alias("distance_from_earth"),
        F.col("probability").alias("collision_probability"), F.coalesce("level", F.lit("LOW")).alias("risk_level"))
    return {"panel": panel, "histogram": histogram, "box": box, "top": top}


def exact_tables(values: DataFrame, newest: Column, days: int | None = None, levels=None) -> dict[str, DataFrame]:
    """Histogram over the range of the probability (A7) and box with whiskers (A8) from the kept rows."""
    if days is not None:
        values = values.where(F.col("slice") > F.date_sub(newest, days))
    if levels is not None:
        values = values.where(F.coalesce("level", F.lit("LOW")).isin(list(levels)))
    return {"exact_histogram": A.probability_histogram(values, "probability"), "exact_box": A.size_box_stats(values, level="level")}


def read_live_model(spark: SparkSession, path: str, days: int | None = None, levels=None) -> dict[str, DataFrame] | None:
    """The current tables, and ``exact_histogram`` and ``exact_box``; none before the first batch."""
    version = current_version(spark, path)
    if version is None:
        return None
    at = f"{path}/version={version}"
    parts = spark.read.parquet(f"{at}/partials")
    days_kept = parts.select("slice").distinct()
    values = spark.read.schema(_VALUES).parquet(f"{path}/rows").where(F.col("batch") <= version)
    values = values.join(F.broadcast(days_kept), "slice", "left_semi")
    return (model_tables(parts, spark.read.parquet(f"{at}/riskiest"), days, levels)
            | exact_tables(values, parts.agg(F.max("slice")).scalar(), days, levels))
