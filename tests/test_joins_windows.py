"""Reference-body attachment and latest-per-key operators."""

import pytest
from pyspark.sql import functions as F

from neo import schemas as S
from neo.operators import joins as J
from neo.operators import windows as W
from tests.fixtures import AU, asteroid_df


def planets_df(spark, rows):
    return spark.createDataFrame(rows, S.PLANET)


def _p(name, ts, x, proc=None):
    return (name, ts, (x, 0.0, 0.0), (0.0, 0.0, 0.0), 1.0, 365.0, proc)


def test_reference_body_latest_and_default(spark):
    ast = asteroid_df(spark, [{"id": "a"}])
    pl = planets_df(spark, [_p("Earth", "2024-01-01T00:00:00.000000", 1.0), _p("Earth", "2024-01-02T00:00:00.000000", 2.0),
                            _p("Mars", "2024-01-03T00:00:00.000000", 9.0)])
    r = J.attach_reference_body(ast, pl).first()
    assert (r["earth_x"], r["earth_y"], r["earth_z"]) == (2.0, 0.0, 0.0)
    none = J.attach_reference_body(ast, pl.where(F.col("planet") == "Mars")).first()
    assert none["earth_x"] == pytest.approx(AU)


def test_equal_timestamps_break_by_processed_time(spark):
    ast = asteroid_df(spark, [{"id": "a"}])
    ts = "2024-01-01T00:00:00.000000"
    pl = planets_df(spark, [_p("Earth", ts, 1.0, "2024-01-01T00:00:05"), _p("Earth", ts, 7.0, "2024-01-01T00:00:09")])
    assert J.attach_reference_body(ast, pl).first()["earth_x"] == 7.0


def test_reference_body_plan_has_no_join(spark):
    ast = asteroid_df(spark, [{"id": "a"}])
    pl = planets_df(spark, [_p("Earth", "2024-01-01T00:00:00.000000", 1.0)])
    plan = J.attach_reference_body(ast, pl)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Subquery" in plan


def test_collision_paths(spark):
    ast = asteroid_df(spark, [{"id": "h", "risk_level": "HIGH", "position": {"x": 1.0, "y": 2.0, "z": 3.0}},
                              {"id": "l", "risk_level": "LOW", "position": {"x": 1.0, "y": 2.0, "z": 3.0}}])
    pl = planets_df(spark, [_p("Earth", "2024-01-01T00:00:00.000000", 5.0)])
    rows = J.collision_paths(ast, pl).collect()
    assert len(rows) == 1 and rows[0]["end_x"] == 5.0 and rows[0]["start_z"] == 3.0


def test_latest_per_key_and_last_n(spark):
    df = spark.createDataFrame([(i, f"k{i % 3}", float(i)) for i in range(30)], "event_id long, id string, v double")
    latest = {r["id"]: r["event_id"] for r in W.latest_per_asteroid(df).collect()}
    assert latest == {"k0": 27, "k1": 28, "k2": 29}
    assert [r["event_id"] for r in W.last_n(df, 3).collect()] == [29, 28, 27]


def test_latest_per_key_handles_hot_key(spark):
    # one key holds most rows: the aggregate still returns one row per key
    rows = [(i, "hot" if i % 10 else f"c{i}", float(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "event_id long, id string, v double").repartition(16)
    out = W.latest_per_key(df, "id", ["event_id"])
    got = {r["id"]: r["event_id"] for r in out.collect()}
    assert got["hot"] == 4999 and len(got) == 501
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_recent_alerts(spark):
    df = spark.createDataFrame([(f"a{i}", f"2024-01-0{i}T00:00:00") for i in range(1, 9)], "alert_id string, timestamp string")
    assert [r["alert_id"] for r in W.recent_alerts(df).collect()] == ["a8", "a7", "a6", "a5", "a4"]


def _latest_by_hand(rows):
    best = {}
    for key, number, v in rows:
        rank = (number is not None, number or 0)
        if key not in best or rank > best[key][0]:
            best[key] = (rank, v)
    return {k: v for k, (_, v) in best.items()}


@pytest.mark.parametrize("limit", [W.BROADCAST_BYTES, 0])
def test_latest_by_number(spark, limit):
    rows = [(f"k{i % 7}" if i % 11 else None, i * 37 % 1009, f"v{i}") for i in range(500)]
    rows += [("hot", i, "h" * 50 + str(i)) for i in range(500)] + [("none", None, "only"), ("some", None, "a"), ("some", -5, "b")]
    df = spark.createDataFrame(rows, "id string, event_id long, v string").repartition(5)
    out = W.latest_by_number(df, "id", "event_id", limit)
    assert out.columns == df.columns
    assert {r["id"]: r["v"] for r in out.collect()} == _latest_by_hand(rows) and out.count() == 11
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and ("BroadcastHashJoin" in plan) == (limit > 0)


def test_latest_by_number_of_repeated_records(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", 3, "p"), ("b", 3, "q"), ("c", None, None), ("c", None, None)]
    df = spark.createDataFrame(rows, "id string, event_id long, `v.w` string")
    got = {r[0]: r[2] for r in W.latest_by_number(df, "id", "event_id").collect()}
    assert got == {"a": "y", "b": got["b"], "c": None} and got["b"] in ("p", "q")
    assert W.latest_by_number(df.limit(0), "id", "event_id").count() == 0
