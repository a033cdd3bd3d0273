"""Composite pipelines (Q1-Q7): the public entry points of the library."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neo import constants as K
from neo import schemas as S
from neo.operators import aggregates as A
from neo.operators import alerts as AL
from neo.operators import collision as C
from neo.operators import features as FE
from neo.operators import joins as J
from neo.operators import ml as M
from neo.operators import motion as MO
from neo.operators import windows as W
from neo.session import scratch_path
from neo.sources import tables as T


def features(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """F1 -> F2 -> F3-F11 (lazy; the null filter reaches the scan)."""
    return FE.orbital_features(FE.flatten_state(FE.drop_incomplete(df)), ts_col)


def clean(df: DataFrame, method: str = "approx", persist: bool = True) -> DataFrame:
    """Q1: F1 -> F2 -> F3-F11 -> A9 (sequential IQR on size, mass, speed, distance)."""
    return A.iqr_outliers(features(df), method=method, persist=persist)


def trajectories(df: DataFrame, planets: DataFrame, body: str = "Earth",
                 future_earth=(K.AU_KM, 0.0, 0.0)) -> DataFrame:
    """Q2: J1 -> F12-F18 -> F21 on cleaned rows (flat state columns).

    The reference body is the newest row of ``body`` (scalar subquery), or
    (AU, 0, 0) without one; future distances use ``future_earth`` (fixed by
    default, as the reference)."""
    earth = J.reference_body(planets, body)
    return MO.propagate_horizons(C.collision_risk(df, earth=earth), earth=future_earth)


def ml_ready(df: DataFrame):
    """Q3: M1 -> M2 -> M3.  Returns (frame with ``features``/``scaled_features``, scaler)."""
    return M.scale(M.assemble(M.fill_features(df)))


def run_batch(spark: SparkSession, asteroid_path: str, planet_path: str, processed_path: str,
              ml_path: str, method: str = "approx") -> DataFrame | None:
    """Q4: read both tables, clean, score, project, prepare ML features, write
    both outputs, and return the one-row summary (A5).  None on empty input.

    The cleaned frame is persisted once (A9 needs it for its quantile jobs) and
    every later step reads it; the summary is one aggregate over the written
    table, not eight jobs over the lineage."""
    asteroids = T.read_table(spark, asteroid_path, S.ASTEROID_LANDING, conform_types=True)
    if asteroids.isEmpty():
        return None
    planets = T.read_table(spark, planet_path, S.PLANET, conform_types=True)
    processed = trajectories(clean(asteroids, method), planets)
    T.write_table(processed, processed_path)
    written = spark.read.parquet(processed_path)
    ready, _ = ml_ready(written)
    T.write_table(ready.withColumn("scaled_features", M.vector_to_array(F.col("scaled_features")))
                  .drop("features"), ml_path)
    return A.summary(written)


def batch_classes(written: DataFrame) -> DataFrame:
    """The class breakdown (A2) of the batch report, over the table that :func:`run_batch` wrote."""
    return A.classification_counts(written)


class ReadModel(dict):
    """The read-model tables; they share one persisted input, released by
    :meth:`unpersist` once the tables are written."""

    def __init__(self, source: DataFrame, tables: dict):
        super().__init__(tables)
        self.source = source

    def unpersist(self) -> None:
        self.source.unpersist()


READ_MODEL_TABLES = ("panel", "histogram", "box", "top", "paths")


def read_model(df: DataFrame, days: int | None = None, levels=None, now=None, planets: DataFrame | None = None,
               k: int = K.TOP_K_TABLE, persist: bool = True, tables=READ_MODEL_TABLES) -> ReadModel:
    """Q5: F34 -> F35 -> {panel (A6), histogram (A7), box (A8), top (W4), paths (J2)};
    ``tables`` picks which ones to build (the box statistics are computed eagerly).

    The filtered rows feed five tables, so they are persisted once (memory and
    disk: a lost executor recomputes only its own blocks) instead of being
    recomputed from the scan for each table."""
    cur = df
    if days is not None:
        cur = AL.filter_recent(cur, days, now)
    if levels is not None:
        cur = AL.filter_risk(cur, levels)
    if persist:
        cur = cur.persist(StorageLevel.MEMORY_AND_DISK)
    ties = [c for c in ("id", "event_id") if c in cur.columns]
    build = {"panel": lambda: A.panel_stats(cur), "histogram": lambda: A.probability_histogram(cur),
             "box": lambda: A.size_box_stats(cur), "top": lambda: W.top_risk(cur, k, tie_breakers=ties),
             "paths": lambda: J.collision_paths(cur, planets)}
    out = {name: build[name]() for name in tables if name != "paths" or planets is not None}
    return ReadModel(cur, out)


def landed_split(labelled: DataFrame) -> DataFrame:
    """M4 as a written table in the checkpoint folder, a folder per part: every pass of a training, the
    evaluation and the caller read it, and none computes the split again."""
    spark = labelled.sparkSession
    path = scratch_path(spark, "split")
    T.write_table(M.stratified_split(labelled), path, partition_by="split")
    return spark.read.parquet(path)


def train(training: DataFrame, model_path: str | None = None, iterations: int = 300) -> dict:
    """Q6: F33 -> A13 -> M4 -> M5/M6 -> M7 -> M9.  ``training`` holds the ten
    features (and ``noise``) keyed by ``event_id``.  Returns metrics, the model
    and the test predictions (over the written split, a table in the checkpoint folder)."""
    split = landed_split(A.percentile_label(M.training_risk(training), "collision_risk"))
    tr = split.where(F.col("split") == "train")
    va = split.where(F.col("split") == "validation")
    te = split.where(F.col("split") == "test")
    model = M.train_classifier(tr, va, iterations=iterations)
    pred = model.transform(te)
    metrics = M.evaluate(pred)
    if model_path:
        M.save_model(model, model_path)
    return {"model": model, "predictions": pred, **metrics}


def prediction_report(results: DataFrame) -> dict[str, DataFrame]:
    """Q7: F38, A10-A12, A15 over prediction result records."""
    checked = AL.risk_consistency(results)
    return {"checked": checked, "stats": A.prediction_stats(checked),
            "distribution": A.risk_distribution(checked), "success": A.success_rate(checked),
            "high_risk": A.high_risk_list(checked), "failures": A.failure_list(checked)}
