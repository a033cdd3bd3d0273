"""Risk ladders (strict thresholds), probabilities, alerts, read-model filters."""

import pytest
from pyspark.sql import functions as F

from neo.functions.risk import risk_ladder
from neo.operators import aggregates as A
from neo.operators import alerts as AL
from neo.operators import collision as C
from neo.operators import windows as W
from tests.fixtures import AU, asteroid_df


@pytest.mark.parametrize("preset,expected", [
    ("batch", ["HIGH", "HIGH", "HIGH", "MEDIUM", "LOW", "LOW"]),
    ("generator", ["HIGH", "MEDIUM", "LOW", "VERY_LOW", "SAFE", "SAFE"]),
    ("model", ["HIGH", "MEDIUM", "LOW", "MINIMAL", "MINIMAL", "MINIMAL"]),
    ("test", ["HIGH", "MEDIUM", "LOW", "SAFE", "SAFE", "SAFE"]),
    ("alert", ["HIGH", "MEDIUM", "MEDIUM", "MEDIUM", "MEDIUM", "MEDIUM"]),
])
def test_ladders_are_strict(spark, preset, expected):
    # values just above each threshold, then the thresholds themselves
    vals = [2e-3, 1e-3, 1e-4, 1e-5, 1e-6, None]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r[0] for r in df.select(risk_ladder(F.col("p"), preset)).collect()]
    assert got == expected


def test_heuristic_probability_bounds(spark):
    df = asteroid_df(spark, [
        {"id": "near", "position": {"x": AU * 1.001, "y": 0.0, "z": 0.0}, "velocity": {"vx": 40000.0, "vy": 0.0, "vz": 0.0},
         "size": 12.0},
        {"id": "far", "position": {"x": 3 * AU, "y": 0.0, "z": 0.0}, "velocity": {"vx": 1.0, "vy": 0.0, "vz": 0.0},
         "size": 1.0}]).withColumn("factor", F.lit(2.0))
    got = {r["id"]: r["collision_probability"] for r in C.heuristic_probability(df, factor_col="factor").collect()}
    d = 0.001 * AU
    expect = max(0, 1 - d / (0.05 * AU)) * min(12 / 5, 2) * min(40000 / 50000, 1.5) * 0.01 * 2
    assert got["near"] == pytest.approx(expect) and got["far"] == 0.0


def test_model_fallback_defaults(spark):
    df = asteroid_df(spark, [{"id": "n", "size": None, "velocity": None}, {"id": "b", "size": 20.0,
                              "velocity": {"vx": 100.0, "vy": 0.0, "vz": 0.0}}])
    got = {r["id"]: r["collision_probability"] for r in C.model_fallback_probability(df).collect()}
    assert got["n"] == 0.0 and got["b"] == pytest.approx(0.01)


def test_make_alerts_and_eta(spark):
    df = asteroid_df(spark, [
        {"id": "hot", "timestamp": "2024-01-01T00:00:00", "position": {"x": 3.0, "y": 4.0, "z": 0.0},
         "velocity": {"vx": 1.0, "vy": 0.0, "vz": 0.0}, "collision_probability": 2e-3},
        {"id": "warm", "timestamp": "2024-01-01T00:00:00", "position": {"x": 1.0, "y": 0.0, "z": 0.0},
         "velocity": {"vx": 0.0, "vy": 0.0, "vz": 0.0}, "collision_probability": 5e-4},
        {"id": "edge", "timestamp": "2024-01-01T00:00:00", "collision_probability": 1e-4},
        {"id": "none", "timestamp": "2024-01-01T00:00:00", "collision_probability": None}])
    alerts = AL.make_alerts(df, alert_time=F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    got = {r["asteroid_id"]: r for r in alerts.collect()}
    assert set(got) == {"hot", "warm"}
    assert got["hot"]["alert_level"] == "HIGH" and got["warm"]["alert_level"] == "MEDIUM"
    assert got["hot"]["alert_id"] == "alert_hot_1704067200"
    assert got["hot"]["estimated_impact_time"] == "2024-01-01T00:00:05.000000"
    assert got["warm"]["estimated_impact_time"] == "Unknown"
    assert got["hot"]["asteroid_data"]["id"] == "hot"


def test_filters_and_missing_level(spark):
    df = asteroid_df(spark, [
        {"id": "a", "timestamp": "2024-01-10T00:00:00Z", "risk_level": "HIGH", "size": 1.0},
        {"id": "b", "timestamp": "2024-01-02T00:00:00+00:00", "risk_level": None, "size": 3.0},
        {"id": "c", "timestamp": "2024-01-09T12:00:00", "risk_level": "MEDIUM", "size": 2.0}])
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    recent = sorted(r["id"] for r in AL.filter_recent(df, 2, now).collect())
    assert recent == ["a", "c"]
    low = sorted(r["id"] for r in AL.filter_risk(df, ["LOW"]).collect())
    assert low == ["b"]
    panel = A.panel_stats(df).first()
    assert (panel["total"], panel["high"], panel["medium"], panel["low"]) == (3, 1, 1, 0)
    assert panel["avg_size"] == pytest.approx(2.0) and panel["max_probability"] == 0.0
    top = W.top_risk(df).collect()
    assert [r["risk_level"] for r in top][0] in ("HIGH", "LOW", "MEDIUM")
    assert {r["risk_level"] for r in top} == {"HIGH", "LOW", "MEDIUM"}


def test_panel_on_empty_input(spark):
    empty = asteroid_df(spark, [])
    p = A.panel_stats(empty).first()
    assert (p["total"], p["avg_size"], p["max_probability"]) == (0, 0.0, 0.0)


def test_display_fields(spark):
    df = asteroid_df(spark, [{"id": "x", "size": 1.23456, "distance_from_earth": 12345.6,
                              "enhanced_collision_probability": 1.5e-6}])
    r = AL.display_fields(df).first()
    assert (r["size_text"], r["distance_text"], r["probability_text"]) == ("1.23", "12346", "0.00000150")


def test_risk_consistency_minimal_never_matches(spark):
    df = spark.createDataFrame([(1e-6, "MINIMAL"), (2e-3, "HIGH")], "ml_probability double, ml_risk_level string")
    got = [(r["expected_risk_level"], r["risk_level_match"]) for r in AL.risk_consistency(df).collect()]
    assert got == [("SAFE", False), ("HIGH", True)]


def test_heuristic_probability_forced_floor(spark):
    df = asteroid_df(spark, [{"id": "f", "position": {"x": 3 * AU, "y": 0.0, "z": 0.0},
                              "velocity": {"vx": 1.0, "vy": 0.0, "vz": 0.0}, "size": 1.0},
                             {"id": "n", "position": {"x": 3 * AU, "y": 0.0, "z": 0.0},
                              "velocity": {"vx": 1.0, "vy": 0.0, "vz": 0.0}, "size": 1.0}])
    df = df.withColumn("floor", F.when(F.col("id") == "f", F.lit(0.004)))
    got = {r["id"]: r["collision_probability"] for r in C.heuristic_probability(df, floor_col="floor").collect()}
    assert got == {"f": 0.004, "n": 0.0}


def test_level_and_color_operators(spark):
    df = spark.createDataFrame([(2e-3,), (5e-4,), (None,)], "p double")
    out = C.with_risk_color(C.with_risk_level(df, "p", "generator")).collect()
    assert [(r["risk_level"], r["color"]) for r in out] == [("HIGH", "red"), ("MEDIUM", "orange"), ("SAFE", "green")]
