"""The reference's test flow: fixed records -> model scoring -> prediction report (Q7)."""

import math

import pytest
from pyspark.sql import functions as F

from neo import schemas as S
from neo.operators import aggregates as A
from neo.operators import ml as M
from neo.plans import pipelines as P
from neo.sources import domain as DM
from tests.conftest import SF_SMALL
from tests.fixtures import AU, SCENARIOS, asteroid_df, scenarios_df


def _results(scored):
    """Prediction result records (as the scenario runner builds them) from scored rows."""
    d_au = F.sqrt((F.col("position.x") - F.lit(AU)) ** 2 + F.col("position.y") ** 2 + F.col("position.z") ** 2) / F.lit(AU)
    speed = F.sqrt(F.col("velocity.vx") ** 2 + F.col("velocity.vy") ** 2 + F.col("velocity.vz") ** 2)
    return scored.select(
        F.regexp_replace("id", "^test_asteroid_", "").alias("scenario"), F.col("id").alias("asteroid_id"), "size",
        d_au.alias("distance_au"), speed.alias("velocity_magnitude"), "potentially_hazardous", "ml_probability",
        "ml_risk_level", F.lit(0.5).alias("prediction_time_ms"), F.lit(None).cast("boolean").alias("risk_level_match"),
        F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))


def test_smoke_record_scores(spark):
    df = asteroid_df(spark, [{"id": "smoke", "timestamp": "2024-01-01T00:00:00",
                              "position": {"x": 345000.0, "y": -120000.0, "z": 50700.0},
                              "velocity": {"vx": 25.0, "vy": -40.0, "vz": 10.0}, "size": 1.5, "mass": 2.5e12}])
    r = M.score(df, None).first()
    speed = math.sqrt(25 ** 2 + 40 ** 2 + 10 ** 2)
    assert r["ml_probability"] == pytest.approx(min(1.5 / 10, 1) * min(speed / 50, 1) * 0.01)
    assert r["ml_risk_level"] == "HIGH"


def test_scenarios_through_fallback_report(spark):
    scored = M.score(scenarios_df(spark), None)
    rep = P.prediction_report(_results(scored))
    s = rep["success"].first()
    assert (s["total"], s["successes"], s["grade"]) == (len(SCENARIOS), len(SCENARIOS), "EXCELLENT")
    dist = {r["risk_level"]: r["count"] for r in rep["distribution"].collect()}
    assert sum(dist.values()) == len(SCENARIOS)
    stats = rep["stats"].first()
    assert 0 <= stats["min_probability"] <= stats["mean_probability"] <= stats["max_probability"] <= 1
    high = {r["scenario"] for r in rep["high_risk"].collect()}
    assert high == {r["scenario"] for r in rep["checked"].collect() if r["ml_probability"] > 1e-4}
    assert rep["failures"].count() == 0


def test_scenarios_through_trained_model(spark):
    ev = DM.table(spark, SF_SMALL, "events")
    split = M.stratified_split(A.percentile_label(M.training_risk(DM.training_rows(ev)), "collision_risk"))
    model = M.train_classifier(split.where("split = 'train'"), None, iterations=30)
    feats = M.model_features(DM.with_model_inputs(scenarios_df(spark).withColumn("event_id", F.monotonically_increasing_id())))
    scored = M.score(feats, model)
    rows = scored.select("ml_probability", "ml_risk_level").collect()
    assert len(rows) == len(SCENARIOS) and all(0.0 <= r[0] <= 1.0 for r in rows)
    assert set(S.TRAINING_FEATURES) <= set(feats.columns)
