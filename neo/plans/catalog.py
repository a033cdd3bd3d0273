"""Query catalog: one entry per operator of the inventory, run on the given tables.

Every query reads the parquet tables of ``sf_dir`` (through the domain views of
:mod:`neo.sources.domain`) and returns flat scalar columns.  Columns computed
with trigonometry, ``pow`` or floating-point aggregation are rounded (the last
bit of those differs between engines); everything else is compared exactly.
The matching SQL is in :mod:`neo.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neo import constants as K
from neo import schemas as S
from neo.functions.risk import map_marker_color, map_marker_size, risk_color, risk_ladder
from neo.functions.timefn import iso_string
from neo.functions.vector import norm3
from neo.operators import aggregates as A
from neo.operators import alerts as AL
from neo.operators import collision as C
from neo.operators import features as FE
from neo.operators import joins as J
from neo.operators import ml as M
from neo.operators import motion as MO
from neo.operators import sketches as SK
from neo.operators import windows as W
from neo.plans import pipelines as P
from neo.session import scratch_path
from neo.sources import domain as DM
from neo.sources import files as FI
from neo.sources import messages as MS
from neo.sources import tables as TB
from neo.streaming import enrich as SE
from neo.streaming import landing as SL
from neo.streaming import modelstore as SM
from neo.streaming import readmodel as SR
from neo.streaming import state as ST

FIXED = C.FIXED_EARTH
# atan2 may differ in its last bit between engines: angles are compared at nanoradian precision
ANGLE_DIGITS = 9
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def rnd(c, n: int) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# --- shared inputs ----------------------------------------------------------
def events(spark, sf) -> DataFrame:
    return DM.table(spark, sf, "events")


def ast(spark, sf) -> DataFrame:
    return DM.asteroids(events(spark, sf))


def feat(spark, sf) -> DataFrame:
    return P.features(ast(spark, sf))


def planets(spark, sf) -> DataFrame:
    return DM.planets(DM.table(spark, sf, "events"))


def risk_fixed(spark, sf) -> DataFrame:
    """F1-F18 with Earth fixed at (AU, 0, 0): the batch scoring of the reference."""
    return C.collision_risk(feat(spark, sf), earth=FIXED)


def results(spark, sf) -> DataFrame:
    return DM.prediction_results(events(spark, sf))


def training(spark, sf) -> DataFrame:
    return DM.training_rows(events(spark, sf))


def labelled(spark, sf) -> DataFrame:
    return A.percentile_label(M.training_risk(training(spark, sf)), "collision_risk")


def messages(spark, sf) -> DataFrame:
    """Wire messages (offset = event_id, key, value) of the asteroid records."""
    return MS.encode_messages(DM.wire_asteroids(events(spark, sf)), "id", offset_col="event_id")


MESSAGE_SCHEMA = "offset long, key string, value string"


def landed_messages(spark, sf, errors: bool = False) -> str:
    """Write the wire messages to a fresh folder under the shared checkpoint
    directory, as a topic would deliver them, and return the folder."""
    path = scratch_path(spark, "messages")
    (messages_with_errors(spark, sf) if errors else messages(spark, sf)).write.parquet(path)
    return path


def messages_with_errors(spark, sf) -> DataFrame:
    """As :func:`messages`, but events of type ``error`` arrive truncated (one projection, no join)."""
    m = MS.encode_messages(DM.wire_asteroids(events(spark, sf), keep=("event_type",)), "id",
                           offset_col="event_id", carry=("event_type",))
    bad = F.coalesce(F.col("event_type") == F.lit("error"), F.lit(False))
    return m.select("offset", "key", F.when(bad, F.substring("value", 1, 40)).otherwise(F.col("value")).alias("value"))


# --- 2.1 sources and sinks --------------------------------------------------
EVENTS_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                              T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                              T.StructField("value", T.DoubleType())])


@query("s1_read_table")
def s1(spark, sf):
    df = TB.read_table(spark, f"{sf}/events.parquet", EVENTS_SCHEMA)
    return df.select("event_id", iso_string(F.col("ts")).alias("ts"), "user_id", "event_type", "value")


@query("s1_read_checked")
def s1_checked(spark, sf):
    """The events as a folder of files by several writers: as agreed, with 32-bit users, with text
    values (wrong type), and no parquet at all."""
    folder, ev = scratch_path(spark, "events"), events(spark, sf).select(*EVENTS_SCHEMA.names)
    kind = F.coalesce(F.col("event_type"), F.lit(""))
    ev.where(~kind.isin("click", "error", "signup")).write.parquet(folder)
    ev.where(kind == "click").withColumn("user_id", F.col("user_id").cast("int")).write.mode("append").parquet(folder)
    ev.where(kind == "error").withColumn("value", F.col("value").cast("string")).write.mode("append").parquet(folder)
    ev.where(kind == "signup").select(F.to_json(F.struct("event_id", "value"))).write.mode("append").text(folder)
    rows, bad = FI.read_checked(spark, folder, EVENTS_SCHEMA)
    return (rows.select(F.lit("row").alias("status"), "event_id", "user_id", "value")
            .unionByName(bad.select(F.col("reason").alias("status")).distinct().select(
                "status", F.lit(-1).alias("event_id"), F.lit(-1).alias("user_id"), F.lit(None).cast("double").alias("value"))))


@query("s2_parse_messages")
def s2(spark, sf):
    p = MS.parse_messages(messages(spark, sf), S.ASTEROID_LANDING)
    return p.select(F.col("offset").alias("event_id"), "id", "timestamp", F.col("position.x").alias("pos_x"),
                    F.col("position.y").alias("pos_y"), F.col("velocity.vz").alias("vel_z"), "size", "mass",
                    "classification", "potentially_hazardous", "risk_level", "distance_from_earth")


@query("s3_quarantine")
def s3(spark, sf):
    landed = spark.read.schema(MESSAGE_SCHEMA).parquet(landed_messages(spark, sf, errors=True))
    good, bad = MS.quarantine(MS.parse_messages(landed, S.ASTEROID_LANDING))
    return good.select(F.col("offset").alias("event_id"), F.lit("good").alias("status")).unionByName(
        bad.select(F.col("offset").alias("event_id"), F.lit("bad").alias("status")))


@query("s4_land_stream")
def s4(spark, sf):
    base = scratch_path(spark, "s4")
    msgs = spark.readStream.schema(MESSAGE_SCHEMA).parquet(landed_messages(spark, sf))
    good, _bad = MS.quarantine(MS.parse_messages(msgs, S.ASTEROID_LANDING))
    q = SL.land_stream(SL.with_ingest_date(good), f"{base}/data", f"{base}/_checkpoint", "availableNow")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/data").select(F.col("offset").alias("event_id"), "id",
                                                     F.col("ingest_date").cast("string").alias("ingest_date"))


@query("s5_stamp_processed")
def s5(spark, sf):
    ev = events(spark, sf)
    now = ev.agg(F.max("ts")).scalar()
    return MS.stamp_processed(ast(spark, sf), now).select("event_id", "processed_timestamp")


@query("s6_write_table")
def s6(spark, sf):
    path = scratch_path(spark, "s6")
    TB.write_table(feat(spark, sf).select("event_id", "distance_from_sun", "velocity_magnitude"), path)
    return TB.read_table(spark, path, T.StructType([T.StructField("event_id", T.LongType()),
                                                    T.StructField("distance_from_sun", T.DoubleType()),
                                                    T.StructField("velocity_magnitude", T.DoubleType())]))


@query("s7_write_json")
def s7(spark, sf):
    path = scratch_path(spark, "s7")
    TB.write_json(ast(spark, sf).select("event_id", "id", "size", "risk_level"), path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("id", T.StringType()),
                           T.StructField("size", T.DoubleType()), T.StructField("risk_level", T.StringType())])
    return TB.read_json(spark, path, schema)


@query("s8_read_latest_file")
def s8(spark, sf):
    path = scratch_path(spark, "s8")
    df = ast(spark, sf).select("event_id", "id", F.to_date("timestamp").alias("day"))
    TB.write_table(df.repartition("day"), path, partition_by="day")
    return TB.read_latest_file(spark, path).select("event_id", "id")


@query("s8_read_latest_partition")
def s8_partition(spark, sf):
    path = scratch_path(spark, "s8p")
    TB.write_table(ast(spark, sf).select("event_id", "id", F.to_date("timestamp").alias("ingest_date")), path,
                   partition_by="ingest_date")
    return TB.read_latest_partition(spark, path, "ingest_date").select("event_id", "id")


@query("s9_encode_messages")
def s9(spark, sf):
    wire = DM.wire_asteroids(events(spark, sf))
    enc = MS.encode_messages(wire.drop("event_id"), "id")
    v = F.col("value")
    return enc.select("key", F.get_json_object(v, "$.id").alias("json_id"),
                      F.get_json_object(v, "$.timestamp").alias("json_timestamp"),
                      F.get_json_object(v, "$.size").cast("double").alias("json_size"),
                      F.get_json_object(v, "$.position.x").cast("double").alias("json_pos_x"),
                      F.get_json_object(v, "$.potentially_hazardous").alias("json_hazardous"))


# --- 2.2 projections, filters, scalar features --------------------------------
@query("f1_drop_incomplete")
def f1(spark, sf):
    return FE.drop_incomplete(ast(spark, sf)).select("event_id", "id")


@query("f2_flatten_state")
def f2(spark, sf):
    return FE.flatten_state(ast(spark, sf)).select("event_id", "pos_x", "pos_y", "pos_z", "vel_x", "vel_y", "vel_z")


def _flat(spark, sf):
    return FE.flatten_state(FE.drop_incomplete(ast(spark, sf)))


@query("f3_distance_from_sun")
def f3(spark, sf):
    return FE.distance_from_sun(_flat(spark, sf)).select("event_id", "distance_from_sun")


@query("f4_velocity_magnitude")
def f4(spark, sf):
    return FE.velocity_magnitude(_flat(spark, sf)).select("event_id", "velocity_magnitude")


@query("f5_distance_from_earth")
def f5(spark, sf):
    return FE.distance_from_earth(_flat(spark, sf)).select("event_id", "distance_from_earth")


@query("f6_orbital_energy")
def f6(spark, sf):
    df = FE.orbital_energy(FE.velocity_magnitude(FE.distance_from_sun(_flat(spark, sf))))
    return df.select("event_id", "orbital_energy")


@query("f7_angular_momentum")
def f7(spark, sf):
    return FE.angular_momentum(_flat(spark, sf)).select(
        "event_id", "angular_momentum_x", "angular_momentum_y", "angular_momentum_z", "angular_momentum_magnitude")


@query("f8_semi_major_axis")
def f8(spark, sf):
    return feat(spark, sf).select("event_id", "semi_major_axis")


@query("f9_timestamp_unix")
def f9(spark, sf):
    return FE.time_features(ast(spark, sf)).select("event_id", "timestamp_unix")


@query("f10_hour_of_day")
def f10(spark, sf):
    return FE.time_features(ast(spark, sf)).select("event_id", "hour_of_day")


@query("f11_day_of_year")
def f11(spark, sf):
    return FE.time_features(ast(spark, sf)).select("event_id", "day_of_year")


@query("f12_earth_distance")
def f12(spark, sf):
    earth = J.reference_body(planets(spark, sf))
    return _flat(spark, sf).select("event_id", rnd(C.earth_distance_col(earth), 3).alias("earth_distance"))


@query("f13_relative_velocity")
def f13(spark, sf):
    return _flat(spark, sf).select("event_id", C.relative_velocity_col().alias("relative_velocity"))


@query("f14_approach_angle")
def f14(spark, sf):
    return _flat(spark, sf).select("event_id", rnd(C.approach_angle_col(FIXED), ANGLE_DIGITS).alias("approach_angle"))


@query("f15_size_factor")
def f15(spark, sf):
    return _flat(spark, sf).select("event_id", C.size_factor_col(F.col("size")).alias("size_factor"))


@query("f16_distance_factor")
def f16(spark, sf):
    return risk_fixed(spark, sf).select("event_id", "distance_factor")


@query("f17_enhanced_probability")
def f17(spark, sf):
    return risk_fixed(spark, sf).select("event_id", "velocity_factor", "enhanced_collision_probability")


@query("f18_risk_ladder")
def f18(spark, sf):
    p = F.col("enhanced_collision_probability")
    return risk_fixed(spark, sf).select(
        "event_id", *[risk_ladder(p, preset).alias(f"risk_{preset}")
                      for preset in ("batch", "generator", "model", "test", "alert")])


@query("f19_risk_color")
def f19(spark, sf):
    lv = risk_ladder(F.col("enhanced_collision_probability"), "generator")
    return risk_fixed(spark, sf).select("event_id", risk_color(lv).alias("color"),
                                        map_marker_color(F.col("risk_level")).alias("marker_color"),
                                        map_marker_size(F.col("risk_level")).alias("marker_size"))


@query("f20_propagate")
def f20(spark, sf):
    return MO.propagate(ast(spark, sf), 3600.0).select(
        "event_id", F.col("position.x").alias("x"), F.col("position.y").alias("y"), F.col("position.z").alias("z"),
        F.col("velocity.vx").alias("vx"), F.col("velocity.vy").alias("vy"), F.col("velocity.vz").alias("vz"))


HORIZON_COLS = [f"{p}_{n}d" for n in K.HORIZONS_DAYS for p in (
    "acc_magnitude", "acc_x", "acc_y", "acc_z", "vel_x", "vel_y", "vel_z", "pos_x", "pos_y", "pos_z",
    "earth_distance")]


@query("f21_propagate_horizons")
def f21(spark, sf):
    return MO.propagate_horizons(feat(spark, sf)).select("event_id", *HORIZON_COLS)


@query("f22_classify_orbit")
def f22(spark, sf):
    return C.classify(feat(spark, sf)).select("event_id", "classification")


@query("f23_orbital_period")
def f23(spark, sf):
    return C.classify(feat(spark, sf)).select("event_id", "orbital_period")


@query("f24_potentially_hazardous")
def f24(spark, sf):
    return C.flag_hazardous(ast(spark, sf)).select("event_id", "potentially_hazardous")


@query("f25_refresh_state")
def f25(spark, sf):
    df = MO.refresh_state(ast(spark, sf), 3600.0)
    return df.select("event_id", iso_string(F.col("timestamp")).alias("timestamp"), "potentially_hazardous",
                     F.col("position.x").alias("x"), F.col("position.y").alias("y"))


@query("f26_body_mass")
def f26(spark, sf):
    return C.with_body_mass(ast(spark, sf)).select("event_id", "mass")


@query("f27_heuristic_probability")
def f27(spark, sf):
    df = ast(spark, sf).withColumn("factor", DM.random_factor())
    return C.heuristic_probability(df, FIXED, "factor").select("event_id", "collision_probability")


@query("f28_model_fallback_probability")
def f28(spark, sf):
    df = ast(spark, sf).withColumn("factor", DM.random_factor())
    return C.model_fallback_probability(df, "factor").select("event_id", "collision_probability")


@query("f29_impact_eta")
def f29(spark, sf):
    df = C.impact_eta(C.impact_eta(ast(spark, sf), "sun", out="eta_sun"), "earth", out="eta_earth")
    return df.select("event_id", "eta_sun", "eta_earth")


@query("f30_planet_positions")
def f30(spark, sf):
    days = events(spark, sf).select(F.to_date("ts").cast("timestamp_ntz").alias("timestamp")).distinct()
    p = MO.planet_positions(days)
    return p.select("planet", iso_string(F.col("timestamp")).alias("timestamp"),
                    rnd("position.x", 3).alias("x"), rnd("position.y", 3).alias("y"),
                    rnd("velocity.vx", 9).alias("vx"), rnd("velocity.vy", 9).alias("vy"), "mass")


@query("f31_model_features")
def f31(spark, sf):
    df = M.model_features(DM.with_model_inputs(ast(spark, sf)))
    return df.select("event_id", *[rnd(c, ANGLE_DIGITS).alias(c) if c == "approach_angle" else F.col(c)
                                   for c in S.TRAINING_FEATURES])


@query("f32_row_zscore")
def f32(spark, sf):
    emb = DM.table(spark, sf, "embeddings")
    z = M.row_zscore(emb, "embedding", "z")
    return z.select("vec_id", F.posexplode("z").alias("pos", "z")).select("vec_id", "pos", rnd("z", 9).alias("z"))


@query("f33_training_risk")
def f33(spark, sf):
    return M.training_risk(training(spark, sf)).select("event_id", rnd("collision_risk", 12).alias("collision_risk"))


@query("f34_filter_recent")
def f34(spark, sf):
    now = events(spark, sf).agg(F.max("ts")).scalar()
    return AL.filter_recent(ast(spark, sf), 7, now).select("event_id")


@query("f35_filter_risk")
def f35(spark, sf):
    return AL.filter_risk(risk_fixed(spark, sf), ["HIGH", "MEDIUM"]).select("event_id", "risk_level")


def alerts(spark, sf) -> DataFrame:
    df = risk_fixed(spark, sf)
    return AL.make_alerts(df, alert_time=F.col("timestamp"), prob_col="enhanced_collision_probability")


@query("f36_make_alerts")
def f36(spark, sf):
    return alerts(spark, sf).select("alert_id", "timestamp", "asteroid_id", "collision_probability", "alert_level",
                                    "estimated_impact_time", F.col("asteroid_data.event_id").alias("event_id"))


@query("f37_publish_enrich")
def f37(spark, sf):
    df = AL.publish_enrich(ast(spark, sf))
    return df.select("event_id", rnd("collision_probability", 12).alias("collision_probability"),
                     "risk_level", "color", rnd("distance_from_earth", 3).alias("distance_from_earth"))


@query("f38_risk_consistency")
def f38(spark, sf):
    # the match flag is null for failed predictions: shown as text so both engines print nulls alike
    return AL.risk_consistency(results(spark, sf)).select(
        "event_id", "expected_risk_level", F.col("risk_level_match").cast("string").alias("risk_level_match"))


@query("f39_display_fields")
def f39(spark, sf):
    return AL.display_fields(ast(spark, sf)).select("event_id", "size_text", "distance_text", "probability_text")


# --- 2.3 joins -----------------------------------------------------------------
@query("j1_attach_reference_body")
def j1(spark, sf):
    df = J.attach_reference_body(feat(spark, sf), planets(spark, sf))
    return df.select("event_id", rnd("earth_x", 3).alias("earth_x"), rnd("earth_y", 3).alias("earth_y"),
                     rnd("earth_z", 3).alias("earth_z"))


@query("j2_collision_paths")
def j2(spark, sf):
    df = J.collision_paths(risk_fixed(spark, sf), planets(spark, sf))
    return df.select("id", "start_x", "start_y", "start_z", rnd("end_x", 3).alias("end_x"),
                     rnd("end_y", 3).alias("end_y"), rnd("end_z", 3).alias("end_z"))


# --- 2.4 aggregations ------------------------------------------------------------
@query("a1_risk_counts")
def a1(spark, sf):
    return A.risk_counts(risk_fixed(spark, sf))


@query("a2_classification_counts")
def a2(spark, sf):
    return A.classification_counts(feat(spark, sf))


@query("a3_size_stats")
def a3(spark, sf):
    s = A.size_stats(feat(spark, sf))
    return s.select(rnd("avg_size", 9).alias("avg_size"), rnd("stddev_size", 9).alias("stddev_size"),
                    "min_size", "max_size")


@query("a4_distance_stats")
def a4(spark, sf):
    s = A.distance_stats(feat(spark, sf))
    return s.select(rnd("avg_earth_distance", 3).alias("avg_earth_distance"), "min_earth_distance",
                    "max_earth_distance")


def _summary_rounded(s: DataFrame) -> DataFrame:
    return s.select("total_asteroids", "high_risk_asteroids", "medium_risk_asteroids",
                    rnd("avg_size", 9).alias("avg_size"), rnd("stddev_size", 9).alias("stddev_size"),
                    "min_size", "max_size", rnd("avg_earth_distance", 3).alias("avg_earth_distance"),
                    "min_earth_distance", "max_earth_distance")


@query("a5_summary")
def a5(spark, sf):
    return _summary_rounded(A.summary(risk_fixed(spark, sf)))


@query("a6_panel_stats")
def a6(spark, sf):
    s = A.panel_stats(risk_fixed(spark, sf))
    return s.select("total", "high", "medium", "low", rnd("avg_size", 9).alias("avg_size"), "max_probability")


@query("a7_probability_histogram")
def a7(spark, sf):
    return A.probability_histogram(risk_fixed(spark, sf))


def _box(df: DataFrame) -> DataFrame:
    return df.select("risk_level", "n", "min", *[rnd(c, 9).alias(c) for c in
                                                ("q1", "median", "q3", "lower_fence", "upper_fence")],
                     "max", "whisker_low", "whisker_high")


@query("a8_size_box_stats")
def a8(spark, sf):
    return _box(A.size_box_stats(risk_fixed(spark, sf)))


@query("a9_iqr_outliers")
def a9(spark, sf):
    return A.iqr_outliers(feat(spark, sf), method="exact").select("event_id")


@query("a9_iqr_outliers_approx")
def a9_approx(spark, sf):
    df = feat(spark, sf)
    return A.iqr_checked(df, A.iqr_steps(df, method="approx"))


@query("a8_size_box_sketch")
def a8_sketch(spark, sf):
    df = risk_fixed(spark, sf)
    box = A.size_box_sketch(df)
    both = df.select(F.coalesce("risk_level", F.lit("LOW")).alias("risk_level"), "size").join(
        box.select("risk_level", "q1", "median", "q3"), "risk_level")
    checks = both.groupBy("risk_level").agg(*[
        SK.rank_within("size", p, F.col(c), 2 * SK.RANK_ERROR).alias(f"{c}_within") for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    return box.select("risk_level", "n", "min", "max").join(checks, "risk_level")


@query("a10_prediction_stats")
def a10(spark, sf):
    s = A.prediction_stats(results(spark, sf))
    return s.select("successful", "min_probability", "max_probability",
                    rnd("mean_probability", 12).alias("mean_probability"),
                    rnd("mean_prediction_time_ms", 9).alias("mean_prediction_time_ms"))


@query("a11_risk_distribution")
def a11(spark, sf):
    d = A.risk_distribution(results(spark, sf))
    return d.select("risk_level", "count", rnd("percentage", 9).alias("percentage"))


@query("a12_success_rate")
def a12(spark, sf):
    s = A.success_rate(results(spark, sf))
    return s.select("total", "successes", "failures", rnd("success_rate", 9).alias("success_rate"), "grade")


@query("a13_percentile_label")
def a13(spark, sf):
    return labelled(spark, sf).select("event_id", "label")


@query("a14_class_balance")
def a14(spark, sf):
    return A.class_balance(labelled(spark, sf))


@query("a15_high_risk_list")
def a15(spark, sf):
    return A.high_risk_list(results(spark, sf))


@query("a15_failure_list")
def a15_fail(spark, sf):
    return A.failure_list(results(spark, sf))


# --- 2.5 windows, sort, limit, top-k --------------------------------------------
@query("w1_latest_per_planet")
def w1(spark, sf):
    df = W.latest_per_planet(planets(spark, sf))
    return df.select("planet", iso_string(F.col("timestamp")).alias("timestamp"),
                     rnd("position.x", 3).alias("x"), rnd("position.y", 3).alias("y"))


@query("w2_last_n")
def w2(spark, sf):
    return W.last_n(ast(spark, sf), K.RECENT_ASTEROIDS).select("event_id", "id")


@query("w3_latest_per_asteroid")
def w3(spark, sf):
    df = W.latest_per_asteroid(ast(spark, sf))
    return df.select("id", "event_id", "size", iso_string(F.col("timestamp")).alias("timestamp"))


@query("w3_latest_record")
def w3_record(spark, sf):
    """W3 over records as they were delivered, some of them twice; the whole record is fetched."""
    sent = DM.wire_asteroids(events(spark, sf), keep=("event_type",))
    path = scratch_path(spark, "delivered")
    sent.unionByName(sent.where("event_type = 'error'")).write.parquet(path)
    df = W.latest_per_asteroid(spark.read.schema(sent.schema).parquet(path))
    return df.select("id", "event_id", "event_type", "timestamp", "size", "classification", "risk_level",
                     "potentially_hazardous", F.col("position.x").alias("pos_x"))


@query("w4_top_risk")
def w4(spark, sf):
    return W.top_risk(risk_fixed(spark, sf), tie_breakers=("id", "event_id"))


@query("w5_recent_alerts")
def w5(spark, sf):
    return W.recent_alerts(alerts(spark, sf)).select("alert_id", "timestamp", "asteroid_id",
                                                     "collision_probability", "alert_level")


@query("w6_latest_row")
def w6(spark, sf):
    pl = planets(spark, sf).where(F.col("planet") == "Earth")
    row = J.latest_row(pl, F.struct("timestamp", "position"))
    return row.select(iso_string(F.col("latest.timestamp")).alias("timestamp"),
                      rnd("latest.position.x", 3).alias("x"), rnd("latest.position.y", 3).alias("y"))


# --- 2.6 machine learning ------------------------------------------------------
def traj_fixed(spark, sf) -> DataFrame:
    return MO.propagate_horizons(risk_fixed(spark, sf))


def _ml_cols(df: DataFrame, prefix: str = "") -> list:
    out = []
    for c in S.ML_FEATURES:
        col = F.col(f"{prefix}{c}")
        out.append((rnd(col, ANGLE_DIGITS) if c == "approach_angle" else col).alias(c))
    return out


@query("m1_fill_features")
def m1(spark, sf):
    return M.fill_features(traj_fixed(spark, sf)).select("event_id", *_ml_cols(None))


@query("m2_assemble")
def m2(spark, sf):
    df = M.assemble(M.fill_features(risk_fixed(spark, sf)))
    names = [f"f_{c}" for c in S.ML_FEATURES]
    un = M.unpack(df, "features", names)
    return un.select("event_id", *[rnd(n, ANGLE_DIGITS).alias(n) if n == "f_approach_angle" else F.col(n) for n in names])


@query("m3_scale")
def m3(spark, sf):
    df, _ = M.scale(M.assemble(M.fill_features(risk_fixed(spark, sf))))
    names = [f"s_{c}" for c in S.ML_FEATURES]
    return M.unpack(df, "scaled_features", names).select("event_id", *[rnd(n, 6).alias(n) for n in names])


@query("m4_stratified_split")
def m4(spark, sf):
    return M.stratified_split(labelled(spark, sf)).select("event_id", "label", "split")


@query("m5_fit_scaler")
def m5(spark, sf):
    split = P.landed_split(labelled(spark, sf))
    model = M.fit_scaler(split.where(F.col("split") == "train"))
    names = [f"z_{c}" for c in S.TRAINING_FEATURES]
    out = M.unpack(model.transform(split), "scaled", names)
    return out.select("event_id", *[rnd(n, 6).alias(n) for n in names])


@query("m6_train_classifier")
def m6(spark, sf):
    split = P.landed_split(labelled(spark, sf))
    model = M.train_classifier(split.where(F.col("split") == "train"), split.where(F.col("split") == "validation"))
    test = model.transform(split.where(F.col("split") == "test"))
    got = M.evaluate(test)
    return test.agg(F.count(F.lit(1)).alias("n_test")).withColumns({
        "accurate": F.lit(got["accuracy"] > 0.85), "separates": F.lit(got["auc"] > 0.90)})


def predictions(spark, sf) -> DataFrame:
    """A written table of predictions: the noise-free risk, to three digits so that scores tie,
    against the label of the noisy one."""
    path = scratch_path(spark, "predictions")
    df = M.training_risk(labelled(spark, sf), noise_col=None, out="risk")
    p = F.round("risk", 3)
    df.select("event_id", "label", p.alias("probability"), (p > 0.7).cast("int").alias("prediction")).write.parquet(path)
    return spark.read.parquet(path)


@query("m7_evaluate")
def m7(spark, sf):
    t = M.per_class_metrics(predictions(spark, sf))
    return t.select("class", rnd("precision", 12).alias("precision"), rnd("recall", 12).alias("recall"),
                    rnd("f1", 12).alias("f1"), "support")


@query("m7_accuracy")
def m7_acc(spark, sf):
    return M.accuracy(predictions(spark, sf)).select("n", rnd("accuracy", 12).alias("accuracy"))


@query("m7_roc_auc")
def m7_auc(spark, sf):
    return M.roc_auc(predictions(spark, sf)).select(rnd("auc", 12).alias("auc"))


@query("m8_score")
def m8(spark, sf):
    df = ast(spark, sf).withColumn("factor", DM.random_factor())
    return M.score(df, None, factor_col="factor").select("event_id", "ml_probability", "ml_risk_level")


@query("m8_score_model")
def m8_model(spark, sf):
    split = P.landed_split(labelled(spark, sf))
    model = M.train_classifier(split.where(F.col("split") == "train"), split.where(F.col("split") == "validation"))
    df = M.model_features(DM.with_model_inputs(ast(spark, sf)))
    # the level is recomputed from the probability; every fifth body lacks a feature
    lacking = F.col("event_id") % 5 == 0
    df = df.withColumn("albedo", F.when(~lacking, F.col("albedo")))
    got = M.score(df, model).select("event_id", "ml_probability", "ml_risk_level")
    plain = M.score(df, None).select("event_id", F.col("ml_probability").alias("fallback"))
    # both sides hold every body: a file that compresses well must not make Spark broadcast one of them
    both = got.join(plain.hint("merge"), "event_id")
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ml_probability").between(0.0, 1.0)).alias("n_valid"),
        F.count_if(lacking & (F.col("ml_probability") == F.col("fallback"))).alias("n_fallback"),
        F.count_if(risk_ladder(F.col("ml_probability"), "model") == F.col("ml_risk_level")).alias("n_level"))


@query("m8_score_unscaled")
def m8_unscaled(spark, sf):
    split = P.landed_split(labelled(spark, sf))
    network = M.train_classifier(split.where(F.col("split") == "train"), None, iterations=10).stages[-1]
    df = M.model_features(DM.with_model_inputs(ast(spark, sf)))
    lacking = F.col("event_id") % 5 == 0
    df = df.withColumn("albedo", F.when(~lacking, F.col("albedo")))
    # F32 forgets the scale of a record: doubling all its features changes nothing (but for the 1e-8)
    twice = df.withColumns({c: 2 * F.col(c) for c in S.TRAINING_FEATURES})
    got = M.score(df, network).select("event_id", "ml_probability")
    again = M.score(twice, network).select("event_id", F.col("ml_probability").alias("again"))
    plain = M.score(df, None).select("event_id", F.col("ml_probability").alias("fallback"))
    both = got.join(plain, "event_id").join(again, "event_id")
    return both.agg(F.count(F.lit(1)).alias("n"),
                    F.count_if(lacking & (F.col("ml_probability") == F.col("fallback"))).alias("n_fallback"),
                    F.count_if(~lacking & (F.abs(F.col("ml_probability") - F.col("again")) < 1e-9)).alias("n_same"))


@query("m9_save_load")
def m9(spark, sf):
    path = scratch_path(spark, "model")
    split = P.landed_split(labelled(spark, sf))
    model = M.train_classifier(split.where(F.col("split") == "train"), split.where(F.col("split") == "validation"))
    M.save_model(model, path)
    loaded = M.load_model(path)
    test = split.where(F.col("split") == "test")
    p = M.vector_to_array(F.col("probability"))[1]
    first = model.transform(test).select("event_id", p.alias("p"))
    again = loaded.transform(test).select("event_id", p.alias("q"))
    both = first.join(again.hint("merge"), "event_id")  # as in m8_score_model
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") == F.col("q")).alias("n_equal"))


@query("m9_model_refresh")
def m9_refresh(spark, sf):
    """One running stream that scores without a model, then with one, then with the next."""
    base = scratch_path(spark, "m9")
    rows = M.model_features(DM.with_model_inputs(ast(spark, sf))).withColumn("turn", F.col("event_id") % 3)
    rows.write.partitionBy("turn").parquet(f"{base}/rows")
    schema = rows.drop("turn").schema
    split = P.landed_split(labelled(spark, sf))
    train = split.where(F.col("split") == "train")
    models = [None, *[M.train_classifier(train, None, iterations=n) for n in (5, 10)]]
    names = [SM.NO_MODEL, "v1", "v2"]
    spark.createDataFrame([], schema).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(schema).parquet(f"{base}/in")
    q = SM.score_stream(stream, f"{base}/store", f"{base}/out", f"{base}/_checkpoint", "1 second")
    try:
        for turn, (name, model) in enumerate(zip(names, models)):
            if model:
                SM.publish_model(spark, model, f"{base}/store", name)
            spark.read.schema(schema).parquet(f"{base}/rows/turn={turn}").write.mode("append").parquet(f"{base}/in")
            q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.parquet(f"{base}/out").select("event_id", "model_version", "ml_probability")
    want = None
    for turn, (name, model) in enumerate(zip(names, models)):
        part = M.score(rows.where(F.col("turn") == turn), model).select(
            "event_id", F.lit(name).alias("expected"), F.col("ml_probability").alias("p"))
        want = part if want is None else want.unionByName(part)
    same = (F.col("model_version") == F.col("expected")) & (F.col("ml_probability") == F.col("p"))
    return got.join(want, "event_id").groupBy("model_version").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_equal"))


# --- 2.9 pipelines -----------------------------------------------------------------
@query("q1_clean")
def q1(spark, sf):
    return P.clean(ast(spark, sf), method="exact").select(
        "event_id", "distance_from_sun", "velocity_magnitude", "orbital_energy", "semi_major_axis",
        "angular_momentum_magnitude", "timestamp_unix", "hour_of_day", "day_of_year")


@query("q1_clean_approx")
def q1_approx(spark, sf):
    rows = feat(spark, sf)
    within = A.iqr_checked(rows, A.iqr_steps(rows, method="approx")).agg(
        F.count(F.lit(1)).alias("steps"), F.bool_and(F.col("q1_within") & F.col("q3_within")).alias("within"))
    kept = P.clean(ast(spark, sf), method="approx").select("event_id", F.lit(True).alias("kept"))
    exact = P.clean(ast(spark, sf), method="exact").select("event_id", F.lit(True).alias("exact"))
    both = rows.select("event_id").join(kept, "event_id", "left").join(exact, "event_id", "left")
    same = F.count_if(F.col("kept").isNull() == F.col("exact").isNull())
    return both.agg(F.count(F.lit(1)).alias("n"), (same >= F.lit(0.95) * F.count(F.lit(1))).alias("agrees")).crossJoin(within)


@query("q2_trajectories")
def q2(spark, sf):
    df = P.trajectories(P.clean(ast(spark, sf), method="exact"), planets(spark, sf))
    return df.select("event_id", rnd("earth_distance", 3).alias("earth_distance"), "relative_velocity",
                     rnd("approach_angle", ANGLE_DIGITS).alias("approach_angle"), "size_factor", "distance_factor",
                     "velocity_factor", "enhanced_collision_probability", "risk_level", *HORIZON_COLS)


@query("q3_ml_ready")
def q3(spark, sf):
    cleaned = P.clean(ast(spark, sf), method="exact")
    df, _ = P.ml_ready(C.collision_risk(cleaned, earth=FIXED))
    names = [f"s_{c}" for c in S.ML_FEATURES]
    return M.unpack(df, "scaled_features", names).select("event_id", *[rnd(n, 6).alias(n) for n in names])


#: Columns of the processed table whose range Q4 reports.
Q4_COLS = ("relative_velocity", "size_factor", "velocity_factor", "enhanced_collision_probability")


def long_form(name: str, df: DataFrame, key=None) -> DataFrame:
    """A report table as rows ``tbl, row_key, metric, num, txt``, so that tables of
    different shapes are one result."""
    cells = []
    for c, kind in df.dtypes:
        text = kind in ("string", "boolean")
        cells.append(F.struct(F.lit(c).alias("metric"),
                              (F.lit(None) if text else F.col(c)).cast("double").alias("num"),
                              (F.col(c) if text else F.lit(None)).cast("string").alias("txt")))
    row_key = F.lit("") if key is None else key.cast("string")
    return df.select(F.lit(name).alias("tbl"), row_key.alias("row_key"), F.explode(F.array(*cells)).alias("m")).select(
        "tbl", "row_key", "m.*")


def _union(frames) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def _box_rounded(df: DataFrame) -> DataFrame:
    rounded = ("q1", "median", "q3", "lower_fence", "upper_fence")
    return df.select(*[rnd(c, 9).alias(c) if c in rounded else F.col(c) for c in df.columns])


def _read_model_long(m: dict) -> list:
    panel = m["panel"].select("total", "high", "medium", "low", rnd("avg_size", 9).alias("avg_size"), "max_probability")
    return [long_form("panel", panel), long_form("histogram", m["histogram"], F.col("bin")),
            long_form("box", _box_rounded(m["box"]), F.col("risk_level")), long_form("top", m["top"], F.col("id"))]


@query("q4_run_batch")
def q4(spark, sf):
    base = scratch_path(spark, "q4")
    ev = events(spark, sf)
    TB.write_table(DM.wire_asteroids(ev).drop("event_id"), f"{base}/asteroid_data/raw")
    # the publisher stores whole numbers in some planet fields as integers
    whole = {"position": F.col("position").withField("z", F.col("position.z").cast("int")),
             "velocity": F.col("velocity").withField("vz", F.col("velocity.vz").cast("int")),
             "orbital_period": F.col("orbital_period").cast("int"), "timestamp": iso_string(F.col("timestamp"))}
    TB.write_table(DM.planets(ev).withColumns(whole), f"{base}/planet_data/raw")
    s = P.run_batch(spark, f"{base}/asteroid_data/raw", f"{base}/planet_data/raw",
                    f"{base}/asteroid_data/processed", f"{base}/ml_training_data", method="exact")
    written, ready = (spark.read.parquet(f"{base}/{p}") for p in ("asteroid_data/processed", "ml_training_data"))
    spans = [f(c).alias(f"{n}_{c}") for c in Q4_COLS for n, f in (("min", F.min), ("max", F.max))]
    largest = [rnd(F.max(F.col("scaled_features")[i]), 6).alias(f"max_{c}") for i, c in enumerate(S.ML_FEATURES)]
    return _union([long_form("summary", _summary_rounded(s)),
                   long_form("classes", P.batch_classes(written), F.col("classification")),
                   long_form("processed", written.agg(F.count(F.lit(1)).alias("n"), *spans)),
                   long_form("features", ready.agg(F.count(F.lit(1)).alias("n"), *largest))])


@query("q5_read_model")
def q5(spark, sf):
    now = events(spark, sf).agg(F.max("ts")).scalar()
    # the tables are one lazy result, so nothing is persisted (and no cache outlives the call)
    m = P.read_model(risk_fixed(spark, sf), days=7, levels=["HIGH", "MEDIUM"], now=now, planets=planets(spark, sf),
                     persist=False)
    paths = m["paths"].select("id", "start_x", "start_y", "start_z", rnd("end_x", 3).alias("end_x"),
                              rnd("end_y", 3).alias("end_y"), rnd("end_z", 3).alias("end_z"))
    return _union([*_read_model_long(m), long_form("paths", paths, F.col("id"))])


@query("q6_train")
def q6(spark, sf):
    out = P.train(training(spark, sf))
    return out["predictions"].agg(F.count(F.lit(1)).alias("n_test")).withColumns({
        "accurate": F.lit(out["accuracy"] > 0.85), "separates": F.lit(out["auc"] > 0.90)})


@query("q7_prediction_report")
def q7(spark, sf):
    rep = P.prediction_report(results(spark, sf))
    who = F.concat_ws("/", "scenario", "asteroid_id")
    stats = rep["stats"].withColumns({"mean_probability": rnd("mean_probability", 12),
                                      "mean_prediction_time_ms": rnd("mean_prediction_time_ms", 9)})
    shares = rep["distribution"].withColumn("percentage", rnd("percentage", 9))
    success = rep["success"].withColumn("success_rate", rnd("success_rate", 9))
    checked = rep["checked"].select("event_id", "expected_risk_level", "risk_level_match")
    return _union([long_form("checked", checked, F.col("event_id")), long_form("stats", stats),
                   long_form("distribution", shares, F.col("risk_level")), long_form("success", success),
                   long_form("high_risk", rep["high_risk"], who), long_form("failures", rep["failures"], who)])


# --- 2.7 streaming -------------------------------------------------------------------
def _event_stream(spark, sf) -> DataFrame:
    return spark.readStream.schema(events(spark, sf).schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _message_stream(spark, sf) -> DataFrame:
    """The asteroid topic as a file stream of landed wire messages."""
    return spark.readStream.schema(MESSAGE_SCHEMA).parquet(landed_messages(spark, sf))


@query("st1_continuous_landing")
def st1(spark, sf):
    """Three topics with truncated messages, landed by the day of arrival and compacted."""
    base = scratch_path(spark, "st1")
    records = DM.planets(events(spark, sf)).withColumn("timestamp", iso_string(F.col("timestamp")))
    sent = {"asteroid-data": messages_with_errors(spark, sf), "planet-data": MS.encode_messages(records, "planet"),
            "collision-alerts": MS.encode_messages(alerts(spark, sf), "asteroid_id")}
    for name, msgs in sent.items():
        msgs.write.parquet(f"{base}/sent/{name}")
    streams = {name: spark.readStream.schema(MESSAGE_SCHEMA).parquet(f"{base}/sent/{name}") for name in sent}
    arrived = events(spark, sf).agg(F.max("ts")).first()[0]
    for q in SL.continuous_landing(streams, None, f"{base}/data", f"{base}/_checkpoints", "availableNow", F.lit(arrived)):
        q.awaitTermination()
    found = None
    for (name, topic), ident in zip(SL.default_topics().items(), ("id", "planet", "alert_id")):
        SL.compact(spark, f"{base}/data", topic, f"{base}/_checkpoints", str(arrived.date()))
        good = SL.read_landed(spark, f"{base}/data/{name}/raw", topic.schema).select(
            F.lit(name).alias("topic"), F.col(ident).alias("ident"), F.lit("good").alias("status"),
            F.col("ingest_date").cast("string").alias("ingest_date"))
        bad = TB.read_json(spark, f"{base}/data/{name}/quarantine", T.StructType.fromDDL("key string, raw string")).select(
            F.lit(name).alias("topic"), F.col("key").alias("ident"), F.lit("bad").alias("status"),
            F.lit(None).cast("string").alias("ingest_date"))
        both = good.unionByName(bad)
        found = both if found is None else found.unionByName(both)
    return found


@query("st2_enrich_alert")
def st2(spark, sf):
    base = scratch_path(spark, "st2")
    recs = DM.asteroids(_event_stream(spark, sf)).withColumn("factor", DM.random_factor())
    speed = F.sqrt(F.col("velocity.vx") * F.col("velocity.vx") + F.col("velocity.vy") * F.col("velocity.vy")
                   + F.col("velocity.vz") * F.col("velocity.vz"))
    scored = recs.withColumn("model_probability", C.model_fallback_probability_col(F.col("size"), speed,
                                                                                   F.col("factor")))
    _enriched, alerts_df = SE.enrich_and_alert(scored, alert_time=F.col("timestamp"),
                                               probability=F.col("model_probability"))
    q = SL.land_stream(alerts_df.select("alert_id", "asteroid_id", "collision_probability", "alert_level"),
                       f"{base}/alerts", f"{base}/_checkpoint", "availableNow", partition_by=None)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/alerts")


@query("st3_live_state")
def st3(spark, sf):
    base = scratch_path(spark, "st3")
    # planet messages arrive out of the order of their timestamps
    arrival = F.pmod(F.col("event_id") * F.lit(7919), F.lit(1000003)).alias("arrival")
    days = _event_stream(spark, sf).select(arrival, F.to_date("ts").cast("timestamp_ntz").alias("timestamp"))
    planet_rows = MO.planet_positions(days, keep=["arrival"]).select("arrival", "planet", "timestamp", "position")
    recs = DM.asteroids(_event_stream(spark, sf)).withColumn("factor", DM.random_factor())
    asteroid_rows = recs.select(F.col("event_id").alias("arrival"), "id", "timestamp", "size")
    _enriched, alerts_df = SE.enrich_and_alert(recs, alert_time=F.col("timestamp"), probability=C.model_fallback_probability_col(
        F.col("size"), norm3(F.col("velocity.vx"), F.col("velocity.vy"), F.col("velocity.vz")), F.col("factor")))
    alert_rows = alerts_df.select(F.col("asteroid_data.event_id").alias("arrival"), "alert_id", "timestamp", "collision_probability")
    for q in ST.live_lists(planet_rows, asteroid_rows, alert_rows, f"{base}/state", ["arrival"], trigger="availableNow"):
        q.awaitTermination()
    p = ST.read_state(spark, f"{base}/state/planets", planet_rows.schema, 1, keyed=True)
    a = ST.read_state(spark, f"{base}/state/asteroids", asteroid_rows.schema, K.RECENT_ASTEROIDS)
    w = ST.read_state(spark, f"{base}/state/alerts", alert_rows.schema, K.RECENT_ALERTS)

    def rows(name, df, label, at, value):
        return df.select(F.lit(name).alias("list"), F.col(label).alias("name"), F.col("arrival").cast("long").alias("arrival"),
                         at.alias("timestamp"), value.alias("value"))

    return _union([rows("planet", p, "planet", iso_string(F.col("timestamp")), rnd("position.x", 3)),
                   rows("asteroid", a, "id", iso_string(F.col("timestamp")), F.col("size")),
                   rows("alert", w, "alert_id", F.col("timestamp"), F.col("collision_probability"))])


@query("st4_live_read_model")
def st4(spark, sf):
    base = scratch_path(spark, "st4")
    recs = C.collision_risk(P.features(DM.asteroids(_event_stream(spark, sf))), earth=FIXED)
    SR.live_read_model(recs, f"{base}/model", f"{base}/_checkpoint", trigger="availableNow").awaitTermination()
    m = SR.read_live_model(spark, f"{base}/model", days=7, levels=["HIGH", "MEDIUM"])
    whole = SR.read_live_model(spark, f"{base}/model")
    rows = risk_fixed(spark, sf).select(F.coalesce("risk_level", F.lit("LOW")).alias("risk_level"), "size", F.to_date("timestamp").alias("d"))
    rows = rows.where(F.col("d") > F.date_sub(rows.agg(F.max("d")).scalar(), 7)).drop("d")
    # the sketched quartiles must stand within the sketch's error of their ranks
    both = rows.join(m["box"].select("risk_level", "q1", "median", "q3"), "risk_level")
    checks = both.groupBy("risk_level").agg(*[
        SK.rank_within("size", p, F.col(c), 2 * SK.RANK_ERROR).alias(f"{c}_within") for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    sketched = m["box"].select("risk_level", "n", "min", "max").join(checks, "risk_level")
    panel = m["panel"].select("total", "high", "medium", "low", rnd("avg_size", 9).alias("avg_size"), "max_probability")
    everything = _read_model_long({"panel": whole["panel"], "histogram": whole["exact_histogram"], "box": whole["exact_box"],
                                   "top": whole["top"]})
    return _union([long_form("panel", panel), long_form("histogram", m["exact_histogram"], F.col("bin")),
                   long_form("live_histogram", m["histogram"], F.col("bin")),
                   long_form("box", _box_rounded(m["exact_box"]), F.col("risk_level")),
                   long_form("live_box", sketched, F.col("risk_level")), long_form("top", m["top"], F.col("id")),
                   *[df.withColumn("tbl", F.concat(F.lit("all_"), "tbl")) for df in everything]])


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
