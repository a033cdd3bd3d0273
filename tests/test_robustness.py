"""Imperfect records: they get a defined result and never end a job."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from neo import schemas as S
from neo.functions.timefn import to_ntz
from neo.operators import alerts as AL
from neo.operators import collision as C
from neo.operators import ml as M
from neo.operators import motion as MO
from neo.plans import pipelines as P
from neo.sources import tables as T

STATE = ("id string, timestamp string, size double, position struct<x:double,y:double,z:double>, "
         "velocity struct<vx:double,vy:double,vz:double>")
NEAR = (149597870.7, 1000.0, 0.0)


def states(spark, *rows):
    return spark.createDataFrame([(f"a{i}", "2024-01-01T00:00:00.000000", *r) for i, r in enumerate(rows)], STATE)


def test_missing_inputs_never_score_high(spark):
    df = states(spark, (1.0, NEAR, (20.0, 5.0, 1.0)), (None, NEAR, (20.0, 5.0, 1.0)), (1.0, NEAR, (None, 5.0, 1.0)),
                (1.0, (None, 0.0, 0.0), (20.0, 5.0, 1.0)), (1.0, NEAR, None))
    p = [r.collision_probability for r in C.heuristic_probability(df).orderBy("id").collect()]
    assert p[0] > 0 and p[1:] == [0.0] * 4
    enriched = AL.publish_enrich(df).orderBy("id").collect()
    assert [r.collision_probability for r in enriched[1:]] == [0.0] * 4
    assert AL.make_alerts(AL.publish_enrich(df.where("id != 'a0'")), threshold=0.0).count() == 0


def test_forced_minimum_through_the_publisher(spark):
    df = states(spark, (1.0, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), (None, NEAR, (1.0, 1.0, 1.0))).withColumn("f", F.lit(0.02))
    assert [r.collision_probability for r in AL.publish_enrich(df, floor_col="f").collect()] == [0.02, 0.02]


def test_slow_bodies_have_no_impact_time(spark):
    df = states(spark, (1.0, NEAR, (1e-7, 0.0, 0.0)), (1.0, NEAR, (0.0, 0.0, 0.0)), (1.0, NEAR, None),
                (1.0, NEAR, (30.0, 0.0, 0.0)))
    eta = [r.estimated_impact_time for r in C.impact_eta(df).orderBy("id").collect()]
    assert eta[:3] == ["Unknown"] * 3 and eta[3].startswith("2024-02-")
    alerts = AL.make_alerts(df.withColumn("collision_probability", F.lit(0.5)),
                            alert_time=F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).collect()
    assert sorted(a.estimated_impact_time for a in alerts)[1:] == ["Unknown"] * 3


def test_a_missing_feature_gets_the_fallback(spark):
    cols = ["x", "y"]
    rows = [(i, float(i % 7), float(i % 5), float(i % 2), 1.0, 10.0) for i in range(200)]
    df = spark.createDataFrame(rows + [(999, None, 1.0, 1.0, 1.0, 10.0)],
                               "event_id long, x double, y double, label double, size double, velocity_km_s double")
    model = M.train_classifier(df, None, cols=cols, layers=(2, 4, 2), iterations=20)
    got = {r.event_id: r for r in M.score(df, model).collect()}
    want = M.score(df, None).where("event_id = 999").first()
    assert got[999].ml_probability == want.ml_probability and got[999].ml_risk_level == want.ml_risk_level
    assert len(got) == 201 and all(r.ml_probability is not None for r in got.values())


def test_split_orders_by_the_whole_digest_with_large_ids(spark):
    ids = [2 ** 60 + i for i in range(301)]
    df = spark.createDataFrame([(i, 1) for i in ids], "event_id long, label int")
    got = {r.event_id: r.split for r in M.stratified_split(df, fractions=(0.7, 0.15, 0.15)).collect()}
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{i}{M.K.SPLIT_SEED}".encode()).hexdigest(), i))
    a, b = int(0.7 * 301), int((0.7 + 0.15) * 301)
    assert got == {i: "train" if k < a else "validation" if k < b else "test" for k, i in enumerate(order)}


def test_custom_planets_keep_fractional_periods(spark):
    times = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "timestamp timestamp_ntz")
    planets = spark.createDataFrame([(f"p{i}", 1.0, 365.25, 1.0) for i in range(1200)],
                                    "planet string, distance_au double, period_days double, mass double")
    got = MO.planet_positions(times, planets=planets)
    assert got.count() == 1200 and {r.orbital_period for r in got.collect()} == {365.25}


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_offsets_are_converted_to_utc(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-01-01T00:00:00", "2024-01-01T00:00:00Z", "2024-01-01T05:00:00+05:00", "2023-12-31T21:30:00.0-0230",
                 "no time", None]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = [r[0] for r in df.orderBy("i").select(to_ntz(df, "t").cast("string")).collect()]
        assert got == ["2024-01-01 00:00:00"] * 4 + [None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_batch_reads_integer_typed_planets(spark, tmp_dir):
    asteroid = {"id": "a", "timestamp": "2024-01-01T00:00:00.000000", "size": 1.0, "mass": 2.0}
    rows = [(f"a{i}", asteroid["timestamp"], 1.0 + i / 9, 2.0, (1.5e8 + i, float(i), 1.0), (20.0 + i, 5.0, 1.0))
            for i in range(12)]
    df = spark.createDataFrame(rows, "id string, timestamp string, size double, mass double, "
                                     "position struct<x:double,y:double,z:double>, velocity struct<vx:double,vy:double,vz:double>")
    T.write_table(df, f"{tmp_dir}/a")
    planets = spark.createDataFrame([("Earth", "2024-01-01T00:00:00.000000", (1.5e8, 0.0, 0), (0.0, 30.0, 0), 1.0, 365)],
                                    "planet string, timestamp string, position struct<x:double,y:double,z:int>, "
                                    "velocity struct<vx:double,vy:double,vz:int>, mass double, orbital_period int")
    T.write_table(planets, f"{tmp_dir}/p")
    got = P.run_batch(spark, f"{tmp_dir}/a", f"{tmp_dir}/p", f"{tmp_dir}/out", f"{tmp_dir}/ml", method="exact")
    assert got.first().total_asteroids > 0
    assert set(S.PLANET.fieldNames()) >= {"planet", "position"}


def test_listing_helpers(spark, tmp_dir):
    assert T.children(spark, f"{tmp_dir}/none") == [] and T.partition_values(spark, f"{tmp_dir}/none", "batch") == []
    for b in (1, 2, 10):
        spark.range(b).write.parquet(f"{tmp_dir}/x/batch={b}")
    assert T.partition_values(spark, f"{tmp_dir}/x", "batch") == ["1", "10", "2"]
    T.remove(spark, f"{tmp_dir}/x/batch=2")
    assert T.partition_values(spark, f"{tmp_dir}/x", "batch") == ["1", "10"]
