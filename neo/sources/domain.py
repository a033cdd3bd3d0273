"""Domain views derived from the given tables.

The test tables carry no asteroid data, so observations are derived from
``events`` with integer arithmetic on ``event_id`` (the mapping in FIXTURES.md):
every event becomes one observation of asteroid ``asteroid_<user_id>``.  Planet
rows are the six-planet dimension at the start of every distinct event day,
training rows and prediction results are further columns of the same events.
All of it is a few staged projections over a scan (no shuffle), so it partitions
like the scan; tiny single-split scans are spread over the cores first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neo import constants as K
from neo.functions.hashing import mod_mul, signed_unit, unit
from neo.functions.risk import classify_orbit, risk_color, risk_ladder
from neo.functions.timefn import epoch_seconds, iso_string
from neo.functions.vector import distance3, norm3


# FIXED VALUES: multipliers / moduli of the derivation (FIXTURES.md section 4)
TYPE_HASH = (7919, 1000)
A_HASH = (104729, 2001)
B_HASH = (15485863, 2003)
G_HASH = (32452843, 1999)
S_HASH = (6151, 997)
# further derived columns (ours): eccentricity, model inputs, timing, noise
ECC_HASH = (48271, 1009)
INCL_HASH = (69621, 1013)
ANGLE_HASH = (16807, 1019)
ALBEDO_HASH = (39373, 1021)
ROT_HASH = (40692, 1031)
TEMP_HASH = (40014, 1033)
FACTOR_HASH = (53668, 1039)
MS_HASH = (12211, 1049)
NOISE_HASH = (3791, 1051)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hash_units(k: Column) -> list[Column]:
    """The five hash units of a key, as named columns (computed once per row)."""
    return [mod_mul(k, *TYPE_HASH).alias("__h"), signed_unit(k, *A_HASH).alias("__a"),
            signed_unit(k, *B_HASH).alias("__b"), signed_unit(k, *G_HASH).alias("__g"),
            unit(k, *S_HASH).alias("__s")]


def _asteroid_columns(k: Column) -> dict[str, Column]:
    """Body state from the hash-unit columns ``__h __a __b __g __s`` (see ``_hash_units``)."""
    h, a, b, g, s = (F.col(c) for c in ("__h", "__a", "__b", "__g", "__s"))
    AU = F.lit(K.AU_KM)
    kind = (F.when(h < 250, "near_earth").when(h < 850, "main_belt").when(h < 950, "trojan").otherwise("outer"))
    x = AU * (F.when(h < 250, F.lit(1.0) + F.lit(0.02) * a)
              .when(h < 850, F.lit(2.75) + F.lit(0.75) * a)
              .when(h < 950, F.lit(5.15) + F.lit(0.35) * a)
              .otherwise(F.lit(6.5) + F.lit(1.5) * a))
    y = AU * F.when(h < 250, F.lit(0.02) * b).otherwise(F.lit(0.5) * b)
    z = AU * F.lit(0.01) * g
    size = (F.when(s < 0.5, F.lit(0.1) + F.lit(1.8) * s)
            .when(s < 0.8, F.lit(1.0) + (s - F.lit(0.5)) * F.lit(13.333333))
            .when(s < 0.95, F.lit(5.0) + (s - F.lit(0.8)) * F.lit(100.0))
            .otherwise(F.lit(20.0) + (s - F.lit(0.95)) * F.lit(1600.0)))
    size_cat = (F.when(s < 0.5, "small").when(s < 0.8, "medium").when(s < 0.95, "large").otherwise("very_large"))
    density = F.lit(1500.0) + F.lit(6500.0) * F.abs(b)
    return dict(kind=kind, x=x, y=y, z=z, vx=F.lit(12.0) * b, vy=F.lit(30.0) + F.lit(8.0) * a,
                vz=F.lit(5.0) * g, size=size, size_cat=size_cat, density=density,
                ecc=F.lit(0.05) + F.lit(0.25) * unit(k, *ECC_HASH))


def _state(events: DataFrame, *keep: str) -> DataFrame:
    """Stage 1 and 2 of every view: hash units once, then the body state columns."""
    k = F.col("event_id")
    units = events.select(*keep, *_hash_units(k))
    c = _asteroid_columns(k)
    return units.select(
        *keep, c["kind"].alias("asteroid_type"), c["x"].alias("_x"), c["y"].alias("_y"), c["z"].alias("_z"),
        c["vx"].alias("_vx"), c["vy"].alias("_vy"), c["vz"].alias("_vz"), c["size"].alias("size"),
        c["size_cat"].alias("size_category"), c["density"].alias("density"), c["ecc"].alias("eccentricity"))


def asteroids(events: DataFrame, keep=()) -> DataFrame:
    """One asteroid observation per event, landing-shaped (see ``schemas.ASTEROID_LANDING``)
    plus ``event_id`` as arrival order."""
    from neo.operators.collision import body_mass_col, heuristic_probability_col, orbital_period_col

    stage = _state(events, "event_id", "ts", "user_id", *keep)
    # each derived quantity once, as a column, so CASE branches refer to a value
    # instead of repeating its expression
    stage = stage.withColumns({"_r": norm3("_x", "_y", "_z"),
                               "_de": distance3("_x", "_y", "_z", K.AU_KM, 0.0, 0.0),
                               "_sp": norm3("_vx", "_vy", "_vz")})
    stage = stage.withColumn("_p", heuristic_probability_col(F.col("_de"), F.col("size"), F.col("_sp")))
    stage = stage.withColumn("_lvl", risk_ladder(F.col("_p"), "generator"))
    out = stage.select(
        "event_id",
        F.concat(F.lit("asteroid_"), F.col("user_id").cast("string")).alias("id"),
        F.col("ts").alias("timestamp"),
        F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_z").alias("z")).alias("position"),
        F.struct(F.col("_vx").alias("vx"), F.col("_vy").alias("vy"), F.col("_vz").alias("vz")).alias("velocity"),
        "size",
        body_mass_col(F.col("size"), F.col("density")).alias("mass"),
        "density",
        classify_orbit(F.col("_r")).alias("classification"),
        orbital_period_col(F.col("_r")).alias("orbital_period"),
        "eccentricity",
        ((F.col("_de") < F.lit(K.PHO_DISTANCE_AU * K.AU_KM)) & (F.col("size") > F.lit(K.PHO_MIN_SIZE_KM)))
        .alias("potentially_hazardous"),
        F.col("_p").alias("collision_probability"),
        iso_string(F.col("ts")).alias("processed_timestamp"),
        "asteroid_type", "size_category",
        iso_string(F.col("ts")).alias("discovery_date"),
        F.col("_p").alias("enhanced_collision_probability"),
        F.col("_lvl").alias("risk_level"),
        risk_color(F.col("_lvl")).alias("color"),
        F.col("_de").alias("distance_from_earth"),
        *keep,
    )
    return out


def planet_dimension(spark: SparkSession) -> DataFrame:
    """The six-planet dimension (fixed, six rows)."""
    return spark.createDataFrame(
        [(n, d, p, m) for n, d, p, m in K.PLANETS],
        "planet string, distance_au double, period_days int, mass double")


def planets(events: DataFrame) -> DataFrame:
    """Planet rows at the start of every distinct event day (circular orbits).

    The planets are attached with ``explode`` over a six-element literal array,
    not a join, so each day row fans out to exactly six rows.
    """
    from neo.operators.motion import planet_state_cols

    days = events.select(F.to_date("ts").alias("day")).where(F.col("day").isNotNull()).distinct()
    dim = F.array(*[F.struct(F.lit(n).alias("planet"), F.lit(d).alias("distance_au"),
                             F.lit(p).alias("period_days"), F.lit(m).alias("mass"))
                    for n, d, p, m in K.PLANETS])
    rows = days.select(F.col("day").cast("timestamp_ntz").alias("timestamp"), F.explode(dim).alias("p"))
    t = epoch_seconds(F.col("timestamp")).cast("double")
    st = planet_state_cols(t, F.col("p.distance_au"), F.col("p.period_days"))
    return rows.select(
        F.col("p.planet").alias("planet"), "timestamp",
        F.struct(st["x"].alias("x"), st["y"].alias("y"), st["z"].alias("z")).alias("position"),
        F.struct(st["vx"].alias("vx"), st["vy"].alias("vy"), st["vz"].alias("vz")).alias("velocity"),
        F.col("p.mass").alias("mass"), F.col("p.period_days").cast("double").alias("orbital_period"),
        iso_string(F.col("timestamp")).alias("processed_timestamp"),
    )


def training_rows(events: DataFrame) -> DataFrame:
    """Training table (ten double features + ``noise``) keyed by ``event_id``."""
    from neo.operators.collision import body_mass_col

    k = F.col("event_id")
    st = _state(events, "event_id")
    return st.select(
        "event_id",
        F.col("size").alias("diameter_km"),
        norm3("_vx", "_vy", "_vz").alias("velocity_km_s"),
        (distance3("_x", "_y", "_z", K.AU_KM, 0.0, 0.0) / F.lit(K.AU_KM)).alias("distance_earth_au"),
        body_mass_col(F.col("size"), F.col("density")).alias("mass_kg"),
        (F.lit(0.05) + F.lit(0.25) * unit(k, *ECC_HASH)).alias("orbital_eccentricity"),
        (F.lit(10.0) + F.lit(20.0) * signed_unit(k, *INCL_HASH)).alias("inclination_deg"),
        (F.lit(2 * math.pi) * unit(k, *ANGLE_HASH)).alias("approach_angle"),
        (F.lit(0.05) + F.lit(0.45) * unit(k, *ALBEDO_HASH)).alias("albedo"),
        (F.lit(1.0) + F.lit(23.0) * unit(k, *ROT_HASH)).alias("rotation_period_h"),
        (F.lit(200.0) + F.lit(60.0) * signed_unit(k, *TEMP_HASH)).alias("surface_temp_k"),
        (F.lit(0.05) * signed_unit(k, *NOISE_HASH)).alias("noise"),
    )


def prediction_results(events: DataFrame) -> DataFrame:
    """Prediction result records (one per event): fallback-model probability with a
    derived random factor; events of type ``error`` are failed predictions."""
    from neo.operators.collision import model_fallback_probability_col

    k = F.col("event_id")
    st = _state(events, "event_id", "user_id", "event_type")
    c = {"kind": F.col("asteroid_type"), "size": F.col("size")}
    speed = norm3("_vx", "_vy", "_vz")
    d_au = distance3("_x", "_y", "_z", K.AU_KM, 0.0, 0.0) / F.lit(K.AU_KM)
    prob = model_fallback_probability_col(c["size"], speed, F.lit(0.1) + F.lit(1.9) * unit(k, *FACTOR_HASH))
    ok = F.coalesce(F.col("event_type") != F.lit("error"), F.lit(True))
    level = risk_ladder(prob, "model")
    expected = risk_ladder(prob, "test")
    return st.select(
        "event_id",
        c["kind"].alias("scenario"),
        F.concat(F.lit("asteroid_"), F.col("user_id").cast("string")).alias("asteroid_id"),
        F.when(ok, c["size"]).alias("size"),
        F.when(ok, d_au).alias("distance_au"),
        F.when(ok, speed).alias("velocity_magnitude"),
        F.when(ok, (d_au < F.lit(K.PHO_DISTANCE_AU)) & (c["size"] > F.lit(K.PHO_MIN_SIZE_KM)))
        .alias("potentially_hazardous"),
        F.when(ok, prob).alias("ml_probability"),
        F.when(ok, level).alias("ml_risk_level"),
        F.when(ok, F.lit(0.2) + F.lit(4.8) * unit(k, *MS_HASH)).alias("prediction_time_ms"),
        F.when(ok, level == expected).alias("risk_level_match"),
        ok.alias("success"),
        F.when(~ok, F.concat(F.lit("prediction failed: event "), k.cast("string"))).alias("error"),
    )


def with_model_inputs(df: DataFrame, key: str = "event_id") -> DataFrame:
    """The five unobserved model inputs as extra columns of ``df`` (same
    projection, computed from the row's own key: no join)."""
    k = F.col(key)
    return df.withColumns({
        "orbital_eccentricity": F.lit(0.05) + F.lit(0.25) * unit(k, *ECC_HASH),
        "inclination_deg": F.lit(10.0) + F.lit(20.0) * signed_unit(k, *INCL_HASH),
        "albedo": F.lit(0.05) + F.lit(0.45) * unit(k, *ALBEDO_HASH),
        "rotation_period_h": F.lit(1.0) + F.lit(23.0) * unit(k, *ROT_HASH),
        "surface_temp_k": F.lit(200.0) + F.lit(60.0) * signed_unit(k, *TEMP_HASH),
    })


def random_factor(key: str = "event_id") -> Column:
    """The publisher's random factor in [0.1, 2.0) as a column of the key."""
    return F.lit(0.1) + F.lit(1.9) * unit(F.col(key), *FACTOR_HASH)


def wire_asteroids(events: DataFrame, keep=()) -> DataFrame:
    """Asteroid records as the publisher sends them: ISO text timestamps."""
    ast = asteroids(events, keep)
    return ast.withColumn("timestamp", iso_string(F.col("timestamp")))
