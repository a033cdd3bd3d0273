"""Sources, sinks, message parsing and streaming jobs (file streams, availableNow)."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from neo import schemas as S
from neo.sources import domain as DM
from neo.sources import messages as MS
from neo.sources import tables as TB
from neo.streaming import enrich as SE
from neo.streaming import landing as SL
from tests.conftest import SF_SMALL
from tests.fixtures import asteroid_df


def test_read_table_missing_path_is_empty(spark, tmp_dir):
    df = TB.read_table(spark, f"{tmp_dir}/nothing/*.parquet", S.ASTEROID)
    assert df.count() == 0 and df.schema == S.ASTEROID


def test_read_table_conforms_integer_planet_columns(spark, tmp_dir):
    # a writer that stored z, vz and orbital_period as integers
    t = pa.table({"planet": ["Earth"], "timestamp": ["2024-01-01T00:00:00"],
                  "position": [{"x": 1.5, "y": 2.5, "z": 0}], "velocity": [{"vx": 1.0, "vy": 2.0, "vz": 0}],
                  "mass": [5.972e24], "orbital_period": [365]})
    os.makedirs(f"{tmp_dir}/planets")
    pq.write_table(t, f"{tmp_dir}/planets/p.parquet")
    df = TB.read_table(spark, f"{tmp_dir}/planets", S.PLANET, conform_types=True)
    r = df.first()
    assert df.schema["orbital_period"].dataType.typeName() == "double"
    assert r["position"]["z"] == 0.0 and r["orbital_period"] == 365.0 and r["processed_timestamp"] is None


def test_write_and_read_latest_file(spark, tmp_dir):
    for i in range(3):
        spark.createDataFrame([(i,)], "v int").coalesce(1).write.mode("overwrite").parquet(f"{tmp_dir}/t/part{i}")
    src = f"{tmp_dir}/flat"
    os.makedirs(src)
    for i in range(3):
        f = [x for x in os.listdir(f"{tmp_dir}/t/part{i}") if x.endswith(".parquet")][0]
        os.link(f"{tmp_dir}/t/part{i}/{f}", f"{src}/asteroids_2024010{i}_000000.parquet")
    assert [r["v"] for r in TB.read_latest_file(spark, src).collect()] == [2]


def test_parse_quarantine_encode_roundtrip(spark):
    ev = DM.table(spark, SF_SMALL, "events")
    msgs = MS.encode_messages(DM.wire_asteroids(ev), "id", offset_col="event_id")
    broken = msgs.union(spark.createDataFrame([(-1, "k", '{"id": "x", "size": ')], "offset long, key string, value string"))
    good, bad = MS.quarantine(MS.parse_messages(broken, S.ASTEROID_LANDING))
    assert bad.count() == 1 and bad.first()["offset"] == -1
    assert good.count() == ev.count()
    first = good.where("offset = 0").first()
    src = DM.asteroids(ev).where("event_id = 0").first()
    assert first["position"]["x"] == src["position"]["x"] and first["size"] == src["size"]
    assert len(first["timestamp"]) == 26


def test_stamp_processed(spark):
    df = asteroid_df(spark, [{"id": "a"}])
    r = MS.stamp_processed(df, F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")).first()
    assert r["processed_timestamp"] == "2024-05-06T07:08:09.000000"


def _json_source(spark, tmp_dir):
    ev = DM.table(spark, SF_SMALL, "events")
    src = f"{tmp_dir}/incoming"
    MS.encode_messages(DM.wire_asteroids(ev), "id", offset_col="event_id").repartition(7).write.json(src)
    schema = "offset long, key string, value string"
    return ev, spark.readStream.schema(schema).json(src)


def test_landing_stream_equals_batch(spark, tmp_dir):
    ev, stream = _json_source(spark, tmp_dir)
    topic = SL.Topic("asteroid-data", S.ASTEROID_LANDING)
    qs = SL.continuous_landing({"asteroid-data": stream}, {"asteroid-data": topic}, f"{tmp_dir}/out",
                               f"{tmp_dir}/ck", trigger="availableNow")
    for q in qs:
        q.awaitTermination()
    landed = spark.read.parquet(f"{tmp_dir}/out/asteroid-data/raw")
    batch = DM.wire_asteroids(ev)
    assert landed.count() == batch.count()
    cols = ["id", "timestamp", "size"]
    assert landed.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert "ingest_date" in landed.columns
    # restart: nothing is landed twice
    qs = SL.continuous_landing({"asteroid-data": stream}, {"asteroid-data": topic}, f"{tmp_dir}/out", f"{tmp_dir}/ck", trigger="availableNow")
    for q in qs:
        q.awaitTermination()
    assert spark.read.parquet(f"{tmp_dir}/out/asteroid-data/raw").count() == batch.count()


def _land(spark, source, base, now, topic):
    stream = spark.readStream.schema("offset long, key string, value string").json(source)
    q = SL.land_topic(stream, topic, f"{base}/out", f"{base}/ck", "availableNow", F.lit(now).cast("timestamp_ntz"))
    q.awaitTermination()


def test_landing_by_arrival_quarantine_and_compaction(spark, tmp_dir):
    topic, source = SL.Topic("planet-data", S.PLANET), f"{tmp_dir}/in"
    raw = f"{tmp_dir}/out/planet-data/raw"
    sent = 0
    for batch, day in enumerate(["2024-01-01", "2024-01-01", "2024-01-01", "2024-01-02"]):
        good = [(None, "k", json.dumps({"planet": f"p{batch}{i}", "timestamp": "2020-02-02T00:00:00"})) for i in range(5)]
        spark.createDataFrame([*good, (None, "k", '{"planet": ')], "offset long, key string, value string").repartition(3) \
            .write.mode("append").json(source)
        _land(spark, source, tmp_dir, f"{day} 10:00:00", topic)
        sent += 5
        if batch in (1, 2):
            assert SL.compact(spark, f"{tmp_dir}/out", topic, f"{tmp_dir}/ck", "2024-01-01") == batch
        landed = SL.read_landed(spark, raw, S.PLANET)
        assert landed.count() == landed.select("planet").distinct().count() == sent
    assert SL.compact(spark, f"{tmp_dir}/out", topic, f"{tmp_dir}/ck", "2024-01-01") is None  # nothing new
    days = {str(r[0]): r[1] for r in landed.groupBy("ingest_date").count().collect()}
    assert days == {"2024-01-01": 15, "2024-01-02": 5}  # by arrival, not by observation
    assert TB.read_json(spark, f"{tmp_dir}/out/planet-data/quarantine", S.PLANET).count() == 4
    # what the first compaction had covered is gone; one compacted file serves the day
    assert TB.partition_values(spark, f"{raw}/ingest_date=2024-01-01", "batch") == ["2"]
    files = [n for n, _ in TB.children(spark, f"{raw}-compacted/ingest_date=2024-01-01/upto=2") if n.endswith(".parquet")]
    assert len(files) == 1


def test_uncommitted_batch_is_not_compacted(spark, tmp_dir):
    topic = SL.Topic("planet-data", S.PLANET)
    rows = spark.createDataFrame([("k", "Mars", None)], "key string, planet string, _corrupt_record string")
    rows = rows.withColumn("ingest_date", F.lit("2024-01-01").cast("date"))
    rows = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in S.PLANET.fields if f.name != "planet"])
    SL._land_batch(rows, 0, f"{tmp_dir}/out/planet-data")
    assert SL.compact(spark, f"{tmp_dir}/out", topic, f"{tmp_dir}/ck", "2024-01-01") is None
    SL._land_batch(rows, 0, f"{tmp_dir}/out/planet-data")  # the batch runs again: nothing twice
    assert SL.read_landed(spark, f"{tmp_dir}/out/planet-data/raw", S.PLANET).count() == 1


def test_enrich_alert_stream(spark, tmp_dir):
    ev = DM.table(spark, SF_SMALL, "events")
    stream = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)
    recs = DM.asteroids(stream)
    scored = recs.withColumn("p", F.lit(5e-4))
    _enr, alerts = SE.enrich_and_alert(scored, alert_time=F.col("timestamp"), probability=F.col("p"))
    q = SL.land_stream(alerts.select("alert_id", "alert_level"), f"{tmp_dir}/alerts", f"{tmp_dir}/ck2",
                       "availableNow", partition_by=None)
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_dir}/alerts")
    assert got.count() == ev.count() and {r[0] for r in got.select("alert_level").distinct().collect()} == {"MEDIUM"}


def test_json_sink(spark, tmp_dir):
    df = asteroid_df(spark, [{"id": "a", "size": 1.5}])
    TB.write_json(df.select("id", "size"), f"{tmp_dir}/j")
    lines = [ln for f in sorted(os.listdir(f"{tmp_dir}/j")) if f.endswith(".json")
             for ln in open(os.path.join(f"{tmp_dir}/j", f)) if ln.strip()]
    assert [json.loads(ln) for ln in lines] == [{"id": "a", "size": 1.5}]


def test_enrich_alert_dedupe_within_watermark(spark, tmp_dir):
    ev = DM.table(spark, SF_SMALL, "events")
    stream = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)
    recs = DM.asteroids(stream).withColumn("p", F.lit(5e-3))
    _enr, alerts = SE.enrich_and_alert(recs, alert_time=F.col("timestamp"), probability=F.col("p"),
                                       dedupe_watermark="365 days")
    q = SL.land_stream(alerts.select("alert_id", "asteroid_id"), f"{tmp_dir}/dedup", f"{tmp_dir}/ck6",
                       "availableNow", partition_by=None)
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_dir}/dedup")
    # one alert per body inside the watermark, every body present
    assert got.count() == got.select("asteroid_id").distinct().count() == ev.select("user_id").distinct().count()


def test_run_batch_on_missing_input_returns_none(spark, tmp_dir):
    from neo.plans import pipelines as P
    assert P.run_batch(spark, f"{tmp_dir}/none/asteroids", f"{tmp_dir}/none/planets", f"{tmp_dir}/p",
                       f"{tmp_dir}/m") is None


def test_run_batch_end_to_end(spark, tmp_dir):
    from neo.plans import pipelines as P
    ev = DM.table(spark, SF_SMALL, "events")
    TB.write_table(DM.wire_asteroids(ev).drop("event_id"), f"{tmp_dir}/a")
    s = P.run_batch(spark, f"{tmp_dir}/a", f"{tmp_dir}/no_planets", f"{tmp_dir}/p", f"{tmp_dir}/m").first()
    processed = spark.read.parquet(f"{tmp_dir}/p")
    assert s["total_asteroids"] == processed.count() > 0
    assert "earth_distance_365d" in processed.columns
    assert spark.read.parquet(f"{tmp_dir}/m").schema["scaled_features"].dataType.typeName() == "array"


def test_read_latest_partition_prunes(spark, tmp_dir):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-02")], "v int, d string") \
        .selectExpr("v", "cast(d as date) as ingest_date")
    TB.write_table(df, f"{tmp_dir}/p", partition_by="ingest_date")
    got = TB.read_latest_partition(spark, f"{tmp_dir}/p")
    assert sorted(r["v"] for r in got.collect()) == [2, 3]
    assert "PartitionFilters: [isnotnull(ingest_date" in got._jdf.queryExecution().executedPlan().toString()


def test_default_topics():
    topics = SL.default_topics()
    assert set(topics) == {"asteroid-data", "planet-data", "collision-alerts"}
    assert topics["collision-alerts"].schema["asteroid_data"].dataType["position"] is not None


def test_parse_keeps_partition_and_offset(spark):
    df = spark.createDataFrame([(b"k", b'{"id": "a", "size": 1.0}', 3, 17)],
                               "key binary, value binary, partition int, offset long")
    r = MS.parse_messages(df, S.ASTEROID_LANDING).first()
    assert (r["key"], r["partition"], r["offset"], r["id"], r["size"]) == ("k", 3, 17, "a", 1.0)


def test_alert_topic_roundtrip_with_default_topics(spark, tmp_dir):
    from neo.operators import alerts as AL
    ev = DM.table(spark, SF_SMALL, "events")
    recs = DM.wire_asteroids(ev).withColumn("collision_probability", F.lit(2e-3))
    alerts = AL.make_alerts(recs, alert_time=F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    MS.encode_messages(alerts.withColumn("offset", F.monotonically_increasing_id()), None,
                       offset_col="offset").write.json(f"{tmp_dir}/alerts_in")
    src = spark.readStream.schema("offset long, key string, value string").json(f"{tmp_dir}/alerts_in")
    qs = SL.continuous_landing({"collision-alerts": src}, None, f"{tmp_dir}/land", f"{tmp_dir}/ck8",
                               trigger="availableNow")
    for q in qs:
        q.awaitTermination()
    landed = spark.read.parquet(f"{tmp_dir}/land/collision-alerts/raw")
    assert landed.count() == alerts.count()
    r = landed.where(F.col("asteroid_id") == "asteroid_8").first()
    assert r["alert_level"] == "HIGH" and r["asteroid_data"]["id"] == "asteroid_8"
    assert r["estimated_impact_time"].startswith("20") and r["processed_timestamp"] is not None
