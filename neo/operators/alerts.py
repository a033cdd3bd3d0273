"""Publishing, alerting and read-model filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neo import constants as K
from neo.functions.risk import risk_color, risk_ladder
from neo.functions.timefn import add_seconds, epoch_seconds, iso_string, to_ntz
from neo.functions.vector import distance3, norm3
from neo.operators.collision import heuristic_probability_col
from neo.operators.motion import planet_state_cols


def filter_recent(df: DataFrame, days: int, now: Column | None = None, ts_col: str = "timestamp") -> DataFrame:
    """rows observed at or after ``now - days`` (``now`` defaults to the
    current time; pass a column, e.g. a scalar subquery, to pin it)."""
    now = F.localtimestamp() if now is None else now
    return df.where(to_ntz(df, ts_col) >= F.timestamp_add("DAY", F.lit(-int(days)), now))


def filter_risk(df: DataFrame, levels, level_col: str = "risk_level") -> DataFrame:
    """keep rows whose level (missing = LOW) is in ``levels``."""
    return df.where(F.coalesce(F.col(level_col), F.lit("LOW")).isin(list(levels)))


def ephemeris_earth(t_seconds: Column) -> tuple[Column, Column, Column]:
    """Earth on its circular orbit at epoch seconds ``t``."""
    name, dist, period, _m = next(p for p in K.PLANETS if p[0] == "Earth")
    st = planet_state_cols(t_seconds, F.lit(dist), F.lit(period))
    return st["x"], st["y"], st["z"]


def publish_enrich(df: DataFrame, ts_col: str = "timestamp", factor_col: str | None = None,
                   probability: Column | None = None, floor_col: str | None = None) -> DataFrame:
    """what the publisher adds to a record: collision probability (F27
    against Earth on its orbit at the observation time, or a given
    ``probability`` column such as a model score; ``floor_col`` is the forced minimum), its duplicate
    ``enhanced_collision_probability``, the generator ladder level, its colour
    and the distance to that Earth position."""
    t = epoch_seconds(to_ntz(df, ts_col)).cast("double")
    ex, ey, ez = ephemeris_earth(t)
    x, y, z = F.col("position.x"), F.col("position.y"), F.col("position.z")
    d = distance3(x, y, z, ex, ey, ez)
    if probability is None:
        speed = norm3(F.col("velocity.vx"), F.col("velocity.vy"), F.col("velocity.vz"))
        probability = heuristic_probability_col(d, F.col("size"), speed,
                                                F.col(factor_col) if factor_col else None,
                                                floor=F.col(floor_col) if floor_col else None)
    out = df.withColumns({"collision_probability": probability, "distance_from_earth": d})
    out = out.withColumns({"enhanced_collision_probability": F.col("collision_probability"),
                           "risk_level": risk_ladder(F.col("collision_probability"), "generator")})
    return out.withColumn("color", risk_color(F.col("risk_level")))


def make_alerts(df: DataFrame, alert_time: Column | None = None, threshold: float = K.ALERT_THRESHOLD,
                prob_col: str = "collision_probability", origin: str = "sun") -> DataFrame:
    """one alert per record above ``threshold`` (missing probability = 0).

    alert_id = ``alert_<id>_<epoch seconds of the alert time>``; level from the
    alert ladder; estimated impact time = alert time + distance / speed (distance
    from the Sun by default, as the reference; "Unknown" at zero speed); the
    record itself nested as ``asteroid_data``.  ``alert_time`` defaults to now."""
    at = F.localtimestamp() if alert_time is None else alert_time
    p = F.coalesce(F.col(prob_col), F.lit(0.0))
    x, y, z = F.col("position.x"), F.col("position.y"), F.col("position.z")
    dist = norm3(x, y, z) if origin == "sun" else distance3(x, y, z, K.AU_KM, 0.0, 0.0)
    speed = norm3(F.col("velocity.vx"), F.col("velocity.vy"), F.col("velocity.vz"))
    hot = df.where(p > F.lit(threshold)).withColumn("__at", at)
    return hot.select(
        F.concat(F.lit("alert_"), F.col("id"), F.lit("_"), epoch_seconds(F.col("__at")).cast("string"))
        .alias("alert_id"),
        iso_string(F.col("__at")).alias("timestamp"),
        F.col("id").alias("asteroid_id"),
        p.alias("collision_probability"),
        risk_ladder(p, "alert").alias("alert_level"),
        F.coalesce(iso_string(F.when(speed > 0, add_seconds(F.col("__at"), dist / speed))),
                   F.lit("Unknown")).alias("estimated_impact_time"),
        F.struct(*[F.col(c) for c in df.columns]).alias("asteroid_data"))


def risk_consistency(results: DataFrame, prob: str = "ml_probability", level: str = "ml_risk_level") -> DataFrame:
    """expected level by the test ladder and whether the given level matches.
    The model ladder says MINIMAL where the test ladder says SAFE, so those rows
    never match (as in the reference)."""
    exp = risk_ladder(F.col(prob), "test")
    return results.withColumns({"expected_risk_level": exp,
                                "risk_level_match": F.col(level) == exp})


def display_fields(df: DataFrame) -> DataFrame:
    """table strings: size with 2 decimals, distance with none, probability
    with 8 (missing distance / probability shown as 0)."""
    return df.withColumns({
        "size_text": F.format_string("%.2f", F.col("size")),
        "distance_text": F.format_string("%.0f", F.coalesce(F.col("distance_from_earth"), F.lit(0.0))),
        "probability_text": F.format_string("%.8f", F.coalesce(F.col("enhanced_collision_probability"),
                                                                 F.lit(0.0))),
    })
