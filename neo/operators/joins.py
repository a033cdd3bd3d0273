"""Reference-body attachment.

The reference collects the latest Earth row to the driver and pastes it into the
plan as literals.  Here the latest row is a one-row global aggregate
(``max_by`` with partial aggregation: every map task keeps one candidate) used
as a *scalar subquery*: Spark runs it once and binds its value into the
projection of the big side, so there is no join, no shuffle of the big side and
nothing collected by our code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neo import constants as K

DEFAULT_POSITION = (K.AU_KM, 0.0, 0.0)


def latest_row(df: DataFrame, value: Column, order_cols=("timestamp", "processed_timestamp")) -> DataFrame:
    """One-row frame with the ``value`` of the newest row (by ``order_cols``
    descending, later columns break ties).  Null when ``df`` is empty."""
    order = F.struct(*[F.col(c) for c in order_cols])
    return df.agg(F.max_by(value, order).alias("latest"))


def reference_body(planets: DataFrame, name: str = "Earth", default=DEFAULT_POSITION,
                   order_cols=("timestamp", "processed_timestamp")) -> tuple[Column, Column, Column]:
    """Position of the newest row of planet ``name`` as three scalar columns, or
    ``default`` when there is no such row."""
    pos = F.struct(F.col("position.x").alias("x"), F.col("position.y").alias("y"), F.col("position.z").alias("z"))
    one = latest_row(planets.where(F.col("planet") == F.lit(name)), pos, order_cols)
    body = one.select("latest").scalar()
    dflt = F.struct(*[F.lit(float(v)).alias(a) for v, a in zip(default, "xyz")])
    body = F.coalesce(body, dflt)
    return body.getField("x"), body.getField("y"), body.getField("z")


def attach_reference_body(df: DataFrame, planets: DataFrame, name: str = "Earth",
                          default=DEFAULT_POSITION, prefix: str = "earth") -> DataFrame:
    """Add ``earth_x/y/z`` (prefix configurable) = latest position of ``name``."""
    x, y, z = reference_body(planets, name, default)
    return df.withColumns({f"{prefix}_x": x, f"{prefix}_y": y, f"{prefix}_z": z})


def collision_paths(df: DataFrame, planets: DataFrame, name: str = "Earth", level: str = "HIGH",
                    default=DEFAULT_POSITION) -> DataFrame:
    """For rows at risk ``level``, the segment from the body to the planet:
    ``id, start_x/y/z, end_x/y/z`` (the 2-D view uses the x/y part)."""
    x, y, z = reference_body(planets, name, default)
    return df.where(F.col("risk_level") == F.lit(level)).select(
        "id",
        F.col("position.x").alias("start_x"), F.col("position.y").alias("start_y"),
        F.col("position.z").alias("start_z"),
        x.alias("end_x"), y.alias("end_y"), z.alias("end_z"))
