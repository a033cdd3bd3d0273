"""Collision risk relative to a reference body.

The reference body is given as three columns (a fixed literal, or the scalar
subquery of J1), so the same code serves every Earth convention.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neo import constants as K
from neo.functions.risk import classify_orbit, risk_color, risk_ladder
from neo.functions.timefn import add_seconds, iso_string, to_ntz
from neo.functions.vector import _c, distance3, norm3

FIXED_EARTH = (K.AU_KM, 0.0, 0.0)


# --- column builders -------------------------------------------------------
def earth_distance_col(earth) -> Column:
    """F12."""
    return distance3("pos_x", "pos_y", "pos_z", *earth)


def relative_velocity_col() -> Column:
    """speed relative to Earth moving at its mean orbital speed along x."""
    return distance3("vel_x", "vel_y", "vel_z", K.EARTH_ORBITAL_SPEED, 0.0, 0.0)


def approach_angle_col(earth) -> Column:
    """|atan2(y - ye, x - xe)|, in [0, pi]."""
    return F.abs(F.atan2(F.col("pos_y") - _c(earth[1]), F.col("pos_x") - _c(earth[0])))


def size_factor_col(size: Column) -> Column:
    """F15; a missing size gives a missing factor (``least`` alone would skip the null)."""
    return F.when(size.isNotNull(), F.least(size / F.lit(10.0), F.lit(1.0)))


def distance_factor_col(distance: Column, soi_au: float = K.SOI_BATCH_AU) -> Column:
    """F16."""
    soi = F.lit(soi_au * K.AU_KM)
    return F.when(distance > soi, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - distance / soi))


def velocity_factor_col(rel_speed: Column) -> Column:
    """F17 (first half)."""
    return F.lit(1.0) / (F.lit(1.0) + rel_speed / F.lit(K.TYPICAL_IMPACT_SPEED))


def body_mass_col(size: Column, density: Column) -> Column:
    """density * 4/3 pi (size*500 m)^3."""
    r = size * F.lit(500.0)
    return density * (F.lit((4 / 3) * math.pi) * (r * r * r))


def orbital_period_col(distance_km: Column) -> Column:
    """Kepler's third law, days."""
    d = distance_km / F.lit(K.AU_KM)
    return F.sqrt(d * d * d) * F.lit(K.YEAR_DAYS)


def potentially_hazardous_col(x, y, z, size, earth=FIXED_EARTH) -> Column:
    """closer than 0.05 AU to the (fixed) Earth and larger than 0.14 km."""
    d = distance3(x, y, z, *earth)
    return (d < F.lit(K.PHO_DISTANCE_AU * K.AU_KM)) & (_c(size) > F.lit(K.PHO_MIN_SIZE_KM))


def heuristic_probability_col(distance: Column, size: Column, speed: Column,
                              factor: Column | None = None, soi_au: float = K.SOI_GENERATOR_AU,
                              floor: Column | None = None) -> Column:
    """max(0, 1-d/SOI) * min(size/5, 2) * min(v/50000, 1.5) * 0.01 * factor, capped at 1.

    A record without distance, size or speed scores 0.  The publisher's random draws are
    input columns: ``factor`` (default 1) and ``floor``, the forced minimum some records get
    (default none)."""
    factor = F.lit(1.0) if factor is None else factor
    soi = F.lit(soi_au * K.AU_KM)
    base = (F.greatest(F.lit(0.0), F.lit(1.0) - distance / soi)
            * F.least(size / F.lit(5.0), F.lit(2.0))
            * F.least(speed / F.lit(50000.0), F.lit(1.5)))
    known = distance.isNotNull() & size.isNotNull() & speed.isNotNull()
    prob = F.coalesce(F.when(known, base * factor * F.lit(0.01)), F.lit(0.0))
    if floor is not None:
        prob = F.greatest(prob, F.coalesce(floor, F.lit(0.0)))
    return F.least(prob, F.lit(1.0))


def model_fallback_probability_col(size: Column, speed: Column, factor: Column | None = None) -> Column:
    """min(size/10, 1) * min(v/50, 1) * 0.01 * factor, clipped to [0, 1]."""
    factor = F.lit(1.0) if factor is None else factor
    size = F.coalesce(size, F.lit(K.DEFAULT_ASTEROID_SIZE_KM))
    speed = F.coalesce(speed, F.lit(0.0))
    base = F.least(size / F.lit(10.0), F.lit(1.0)) * F.least(speed / F.lit(50.0), F.lit(1.0))
    return F.least(F.greatest(base * factor * F.lit(0.01), F.lit(0.0)), F.lit(1.0))


# --- operators -------------------------------------------------------------
def collision_risk(df: DataFrame, earth=FIXED_EARTH, soi_au: float = K.SOI_BATCH_AU,
                   ladder: str = "batch") -> DataFrame:
    """F12-F18 on flat state columns: earth_distance, relative_velocity,
    approach_angle, size_factor, distance_factor, velocity_factor,
    enhanced_collision_probability, risk_level.  ``earth`` is a triple of
    numbers or columns (e.g. from :func:`neo.operators.joins.reference_body`)."""
    stage = df.withColumns({
        "earth_distance": earth_distance_col(earth),
        "relative_velocity": relative_velocity_col(),
        "approach_angle": approach_angle_col(earth),
        "size_factor": size_factor_col(F.col("size")),
    })
    stage = stage.withColumns({
        "distance_factor": distance_factor_col(F.col("earth_distance"), soi_au),
        "velocity_factor": velocity_factor_col(F.col("relative_velocity")),
    })
    prob = F.col("size_factor") * F.col("distance_factor") * F.col("velocity_factor") * F.lit(K.PROBABILITY_SCALE)
    stage = stage.withColumn("enhanced_collision_probability", prob)
    return stage.withColumn("risk_level", risk_ladder(F.col("enhanced_collision_probability"), ladder))


def with_risk_level(df: DataFrame, prob_col: str, preset: str, out: str = "risk_level") -> DataFrame:
    """F18 as an operator."""
    return df.withColumn(out, risk_ladder(F.col(prob_col), preset))


def with_risk_color(df: DataFrame, level_col: str = "risk_level", out: str = "color") -> DataFrame:
    """F19."""
    return df.withColumn(out, risk_color(F.col(level_col)))


def classify(df: DataFrame, distance_col: str = "distance_from_sun") -> DataFrame:
    """F22 + F23 from the distance to the Sun (km)."""
    d = F.col(distance_col)
    return df.withColumns({"classification": classify_orbit(d), "orbital_period": orbital_period_col(d)})


def flag_hazardous(df: DataFrame, earth=FIXED_EARTH) -> DataFrame:
    """F24 on nested ``position`` and ``size``."""
    return df.withColumn("potentially_hazardous", potentially_hazardous_col(
        F.col("position.x"), F.col("position.y"), F.col("position.z"), F.col("size"), earth))


def with_body_mass(df: DataFrame, size: str = "size", density: str = "density") -> DataFrame:
    """F26."""
    return df.withColumn("mass", body_mass_col(F.col(size), F.col(density)))


def heuristic_probability(df: DataFrame, earth=FIXED_EARTH, factor_col: str | None = None,
                          out: str = "collision_probability", floor_col: str | None = None) -> DataFrame:
    """F27 on nested ``position``/``velocity``."""
    d = distance3(F.col("position.x"), F.col("position.y"), F.col("position.z"), *earth)
    speed = norm3(F.col("velocity.vx"), F.col("velocity.vy"), F.col("velocity.vz"))
    factor = F.col(factor_col) if factor_col else None
    floor = F.col(floor_col) if floor_col else None
    return df.withColumn(out, heuristic_probability_col(d, F.col("size"), speed, factor, floor=floor))


def model_fallback_probability(df: DataFrame, factor_col: str | None = None,
                               out: str = "collision_probability") -> DataFrame:
    """F28 on nested ``velocity`` (missing velocity counts as zero)."""
    speed = norm3(F.coalesce(F.col("velocity.vx"), F.lit(0.0)), F.coalesce(F.col("velocity.vy"), F.lit(0.0)),
                  F.coalesce(F.col("velocity.vz"), F.lit(0.0)))
    factor = F.col(factor_col) if factor_col else None
    return df.withColumn(out, model_fallback_probability_col(F.col("size"), speed, factor))


def impact_eta(df: DataFrame, origin: str = "sun", earth=FIXED_EARTH, ts_col: str = "timestamp",
               out: str = "estimated_impact_time") -> DataFrame:
    """observation time + distance / speed.

    ``origin="sun"`` divides the distance from the Sun (the reference's formula),
    ``origin="earth"`` the distance to ``earth``.  Adds ``impact_time`` (null when
    the speed is zero or missing, or the time lies beyond the year 9999) and ``out`` (ISO text,
    "Unknown" then)."""
    x, y, z = F.col("position.x"), F.col("position.y"), F.col("position.z")
    dist = norm3(x, y, z) if origin == "sun" else distance3(x, y, z, *earth)
    speed = norm3(F.col("velocity.vx"), F.col("velocity.vy"), F.col("velocity.vz"))
    ts = to_ntz(df, ts_col)
    eta = F.when(speed > 0, add_seconds(ts, dist / speed))
    return df.withColumn("impact_time", eta).withColumn(
        out, F.coalesce(iso_string(F.col("impact_time")), F.lit("Unknown")))
