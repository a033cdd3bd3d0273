"""Property checks (hypothesis): motion invariants and probability bounds."""

import math

from hypothesis import assume, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from neo.operators import collision as C
from neo.operators import motion as MO
from neo.plans import pipelines as P
from tests.fixtures import AU, asteroid_df

coord = st.floats(min_value=-6 * AU, max_value=6 * AU, allow_nan=False)
speed = st.floats(min_value=-60.0, max_value=60.0, allow_nan=False)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(coord, coord, coord, speed, speed, speed), min_size=1, max_size=20))
def test_propagate_conserves_angular_momentum(spark, states):
    # bodies at least 0.1 AU from the Sun (closer in, one hour is no longer a small step)
    states = [s for s in states if math.sqrt(s[0] ** 2 + s[1] ** 2 + s[2] ** 2) > 0.1 * AU]
    assume(states)
    rows = [{"id": str(i), "position": {"x": x, "y": y, "z": z}, "velocity": {"vx": a, "vy": b, "vz": c}}
            for i, (x, y, z, a, b, c) in enumerate(states)]
    before = {r["id"]: r for r in asteroid_df(spark, rows).collect()}
    after = MO.propagate(asteroid_df(spark, rows), 3600.0).collect()

    def h(r):
        p, v = r["position"], r["velocity"]
        return (p["y"] * v["vz"] - p["z"] * v["vy"], p["z"] * v["vx"] - p["x"] * v["vz"],
                p["x"] * v["vy"] - p["y"] * v["vx"])

    for r in after:
        h0, h1 = h(before[r["id"]]), h(r)
        p, v = r["position"], r["velocity"]
        # round-off of a cross product scales with |p| |v|
        scale = math.sqrt(p["x"] ** 2 + p["y"] ** 2 + p["z"] ** 2) * math.sqrt(v["vx"] ** 2 + v["vy"] ** 2 + v["vz"] ** 2)
        assert all(abs(a - b) <= 1e-12 * max(scale, 1.0) for a, b in zip(h0, h1))


def test_propagate_keeps_origin_body(spark):
    df = asteroid_df(spark, [{"id": "o", "position": {"x": 0.0, "y": 0.0, "z": 0.0},
                              "velocity": {"vx": 1.0, "vy": 2.0, "vz": 3.0}}])
    r = MO.propagate(df, 10.0).first()
    assert (r["position"]["x"], r["velocity"]["vz"]) == (0.0, 3.0)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(coord, coord, coord, speed, speed, speed,
                          st.floats(min_value=0.01, max_value=200)), min_size=1, max_size=20))
def test_enhanced_probability_bounds(spark, rows):
    data = [{"id": str(i), "timestamp": "2024-01-01T00:00:00", "position": {"x": x, "y": y, "z": z},
             "velocity": {"vx": a, "vy": b, "vz": c}, "size": s, "mass": 1.0}
            for i, (x, y, z, a, b, c, s) in enumerate(rows)]
    out = C.collision_risk(P.features(asteroid_df(spark, data)))
    for r in out.select("enhanced_collision_probability").collect():
        assert 0.0 <= r[0] <= 0.001


def test_horizons_single_step_not_chained(spark):
    df = asteroid_df(spark, [{"id": "a", "timestamp": "2024-01-01T00:00:00",
                              "position": {"x": AU, "y": 0.0, "z": 0.0}, "velocity": {"vx": 0.0, "vy": 30.0, "vz": 0.0},
                              "size": 1.0, "mass": 1.0}])
    r = MO.propagate_horizons(P.features(df)).first()
    acc = 1.327e11 / AU ** 2
    for n in (1, 7, 30, 365):
        dt = n * 86400.0
        assert math.isclose(r[f"acc_x_{n}d"], -acc, rel_tol=1e-12)
        vx = 0.0 - acc * dt
        assert math.isclose(r[f"vel_x_{n}d"], vx, rel_tol=1e-12)
        assert math.isclose(r[f"pos_x_{n}d"], AU + vx * dt, rel_tol=1e-12)
    assert len([c for c in r.asDict() if c.endswith("d") and c[-2].isdigit()]) >= 44


def test_refresh_state_moves_time(spark):
    df = asteroid_df(spark, [{"id": "a", "timestamp": "2024-01-01T23:30:00", "position": {"x": AU, "y": 0.0, "z": 0.0},
                              "velocity": {"vx": 0.0, "vy": 0.0, "vz": 0.0}, "size": 1.0}])
    r = MO.refresh_state(df, 3600.0).select(F.col("timestamp").cast("string").alias("t"), "potentially_hazardous").first()
    assert r["t"].startswith("2024-01-02 00:30:00") and r["potentially_hazardous"] is True


def test_planet_positions_circular(spark):
    times = spark.createDataFrame([("2024-01-01 00:00:00",)], "t string").selectExpr(
        "cast(t as timestamp_ntz) as timestamp")
    rows = {r["planet"]: r for r in MO.planet_positions(times).collect()}
    assert len(rows) == 6
    e = rows["Earth"]
    t = 1704067200.0
    ang = t / (365 * 86400) * 2 * math.pi
    assert math.isclose(e["position"]["x"], AU * math.cos(ang), rel_tol=1e-9)
    assert math.isclose(math.hypot(e["position"]["x"], e["position"]["y"]), AU, rel_tol=1e-12)


def test_planet_positions_with_given_dimension(spark):
    from neo.sources import domain as DM
    times = spark.createDataFrame([("2024-01-01 00:00:00",)], "t string").selectExpr(
        "cast(t as timestamp_ntz) as timestamp")
    dim = DM.planet_dimension(spark).where("planet IN ('Earth', 'Mars')")
    got = {r["planet"]: r["position"]["x"] for r in MO.planet_positions(times, planets=dim).collect()}
    default = {r["planet"]: r["position"]["x"] for r in MO.planet_positions(times).collect()}
    assert set(got) == {"Earth", "Mars"} and got["Mars"] == default["Mars"]
