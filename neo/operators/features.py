"""Cleaning and orbital features.

Each operator adds its columns in ONE projection (``withColumns``/``select``),
never a chain of ``withColumn`` layers, and the null filter comes first so it is
pushed into the parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neo import constants as K
from neo.functions.timefn import epoch_seconds, to_ntz
from neo.functions.vector import cross3, distance3, norm3



def drop_incomplete(df: DataFrame, required=("position", "velocity", "size", "mass")) -> DataFrame:
    """keep rows whose required columns are non-null.  A struct whose fields
    are null is itself non-null and is kept, as in the reference."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required]))


def flatten_state(df: DataFrame, position: str = "position", velocity: str = "velocity") -> DataFrame:
    """``pos_x..z`` and ``vel_x..z`` from the nested structs."""
    return df.withColumns({
        "pos_x": F.col(f"{position}.x"), "pos_y": F.col(f"{position}.y"), "pos_z": F.col(f"{position}.z"),
        "vel_x": F.col(f"{velocity}.vx"), "vel_y": F.col(f"{velocity}.vy"), "vel_z": F.col(f"{velocity}.vz"),
    })


# --- column builders -------------------------------------------------------
def distance_from_sun_col() -> Column:
    return norm3("pos_x", "pos_y", "pos_z")


def velocity_magnitude_col() -> Column:
    return norm3("vel_x", "vel_y", "vel_z")


def distance_from_earth_col(earth=(K.AU_KM, 0.0, 0.0)) -> Column:
    return distance3("pos_x", "pos_y", "pos_z", *earth)


def orbital_energy_col(speed: Column, r: Column) -> Column:
    """v^2/2 - GM/r; null when r = 0 (``try_divide``, ANSI stays on)."""
    return speed * speed / F.lit(2.0) - F.try_divide(F.lit(K.GM_SUN), r)


def semi_major_axis_col(energy: Column) -> Column:
    """-GM / (2E) for bound orbits (E < 0), else null."""
    return F.when(energy < 0, -F.lit(K.GM_SUN) / (F.lit(2.0) * energy))


# --- operators -------------------------------------------------------------
def distance_from_sun(df: DataFrame) -> DataFrame:
    """F3."""
    return df.withColumn("distance_from_sun", distance_from_sun_col())


def velocity_magnitude(df: DataFrame) -> DataFrame:
    """F4."""
    return df.withColumn("velocity_magnitude", velocity_magnitude_col())


def distance_from_earth(df: DataFrame, earth=(K.AU_KM, 0.0, 0.0)) -> DataFrame:
    """distance to a fixed Earth position (default (AU, 0, 0))."""
    return df.withColumn("distance_from_earth", distance_from_earth_col(earth))


def orbital_energy(df: DataFrame) -> DataFrame:
    """F6 (needs F3, F4)."""
    return df.withColumn("orbital_energy", orbital_energy_col(F.col("velocity_magnitude"), F.col("distance_from_sun")))


def angular_momentum(df: DataFrame) -> DataFrame:
    """r x v and its norm."""
    hx, hy, hz = cross3("pos_x", "pos_y", "pos_z", "vel_x", "vel_y", "vel_z")
    df = df.withColumns({"angular_momentum_x": hx, "angular_momentum_y": hy, "angular_momentum_z": hz})
    return df.withColumn("angular_momentum_magnitude",
                         norm3("angular_momentum_x", "angular_momentum_y", "angular_momentum_z"))


def semi_major_axis(df: DataFrame) -> DataFrame:
    """F8 (needs F6)."""
    return df.withColumn("semi_major_axis", semi_major_axis_col(F.col("orbital_energy")))


def time_features(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """``timestamp_unix`` (whole seconds), ``hour_of_day``, ``day_of_year``;
    null when the timestamp is unreadable.  Accepts string, NTZ or timestamp."""
    ts = to_ntz(df, ts_col)
    return df.withColumns({
        "timestamp_unix": epoch_seconds(ts), "hour_of_day": F.hour(ts), "day_of_year": F.dayofyear(ts),
    })


def orbital_features(df: DataFrame, ts_col: str = "timestamp", earth=(K.AU_KM, 0.0, 0.0)) -> DataFrame:
    """F3-F11 in three staged projections (each stage reads the previous one's
    columns, so no expression is repeated inside another).

    Input needs F2's flat columns.  Output columns, in order: distance_from_sun,
    velocity_magnitude, distance_from_earth, orbital_energy, angular_momentum_x/y/z,
    angular_momentum_magnitude, semi_major_axis, timestamp_unix, hour_of_day, day_of_year.
    """
    hx, hy, hz = cross3("pos_x", "pos_y", "pos_z", "vel_x", "vel_y", "vel_z")
    ts = to_ntz(df, ts_col)
    first = df.withColumns({
        "distance_from_sun": distance_from_sun_col(),
        "velocity_magnitude": velocity_magnitude_col(),
        "distance_from_earth": distance_from_earth_col(earth),
        "angular_momentum_x": hx, "angular_momentum_y": hy, "angular_momentum_z": hz,
    })
    second = first.withColumns({
        "orbital_energy": orbital_energy_col(F.col("velocity_magnitude"), F.col("distance_from_sun")),
        "angular_momentum_magnitude": norm3("angular_momentum_x", "angular_momentum_y", "angular_momentum_z"),
        "timestamp_unix": epoch_seconds(ts), "hour_of_day": F.hour(ts), "day_of_year": F.dayofyear(ts),
    })
    out = second.withColumn("semi_major_axis", semi_major_axis_col(F.col("orbital_energy")))
    order = [c for c in df.columns] + [
        "distance_from_sun", "velocity_magnitude", "distance_from_earth", "orbital_energy",
        "angular_momentum_x", "angular_momentum_y", "angular_momentum_z", "angular_momentum_magnitude",
        "semi_major_axis", "timestamp_unix", "hour_of_day", "day_of_year"]
    seen, cols = set(), []
    for c in order:
        if c not in seen:
            seen.add(c)
            cols.append(c)
    return out.select(*cols)
