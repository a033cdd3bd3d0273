"""Motion: Euler propagation, multi-horizon projection, planet ephemeris."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neo import constants as K
from neo.functions.timefn import add_seconds, to_ntz
from neo.functions.vector import _c, distance3, norm3



def propagate(df: DataFrame, seconds: float = 3600.0, position: str = "position",
              velocity: str = "velocity") -> DataFrame:
    """one semi-implicit Euler step under the Sun's gravity.

    a = -GM p / r^3, v' = v + a dt, p' = p + v' dt.  Rows with r = 0 (or a null
    component) keep their state.  Returns the same columns with new structs."""
    x, y, z = (F.col(f"{position}.{c}") for c in "xyz")
    vx, vy, vz = (F.col(f"{velocity}.{c}") for c in ("vx", "vy", "vz"))
    dt = F.lit(float(seconds))
    r = norm3(x, y, z)
    acc = F.try_divide(F.lit(K.GM_SUN), r * r)
    ok = r > 0
    nvx, nvy, nvz = (v + (-acc * p / r) * dt for v, p in ((vx, x), (vy, y), (vz, z)))
    new_vel = F.when(ok, F.struct(nvx.alias("vx"), nvy.alias("vy"), nvz.alias("vz"))).otherwise(F.col(velocity))
    new_pos = F.when(ok, F.struct((x + nvx * dt).alias("x"), (y + nvy * dt).alias("y"),
                                  (z + nvz * dt).alias("z"))).otherwise(F.col(position))
    return df.withColumns({position: new_pos, velocity: new_vel})


def refresh_state(df: DataFrame, seconds: float = 3600.0, ts_col: str = "timestamp") -> DataFrame:
    """F20, then the observation time moves by ``seconds`` and the
    hazardous flag (F24) is evaluated again on the new position."""
    from neo.operators.collision import flag_hazardous

    moved = propagate(df, seconds)
    ts = to_ntz(moved, ts_col)
    moved = moved.withColumn(ts_col, add_seconds(ts, F.lit(float(seconds))))
    return flag_hazardous(moved)


def propagate_horizons(df: DataFrame, horizons=K.HORIZONS_DAYS, earth=(K.AU_KM, 0.0, 0.0)) -> DataFrame:
    """one Euler step from t0 for every horizon (not chained).

    Per horizon ``n`` adds ``acc_magnitude_nd, acc_x/y/z_nd, vel_x/y/z_nd,
    pos_x/y/z_nd, earth_distance_nd`` (44 columns for four horizons).  The
    acceleration does not depend on the horizon, so it is computed once and the
    per-horizon acceleration columns are aliases of it.  Needs F2 and F3; r = 0
    gives nulls (``try_divide``).  Three narrow projections in all (no shuffle)."""
    r = F.col("distance_from_sun")
    acc_mag = F.try_divide(F.lit(K.GM_SUN), r * r)
    stage = df.withColumn("__acc", acc_mag)
    stage = stage.withColumns({
        "__ax": F.try_divide(-F.col("__acc") * F.col("pos_x"), r),
        "__ay": F.try_divide(-F.col("__acc") * F.col("pos_y"), r),
        "__az": F.try_divide(-F.col("__acc") * F.col("pos_z"), r),
    })
    cols: list[Column] = [F.col(c) for c in df.columns]
    for n in horizons:
        dt = F.lit(float(n * K.DAY_SECONDS))
        v = {a: F.col(f"vel_{a}") + F.col(f"__a{a}") * dt for a in "xyz"}
        p = {a: F.col(f"pos_{a}") + v[a] * dt for a in "xyz"}
        cols += [F.col("__acc").alias(f"acc_magnitude_{n}d")]
        cols += [F.col(f"__a{a}").alias(f"acc_{a}_{n}d") for a in "xyz"]
        cols += [v[a].alias(f"vel_{a}_{n}d") for a in "xyz"]
        cols += [p[a].alias(f"pos_{a}_{n}d") for a in "xyz"]
        cols += [distance3(p["x"], p["y"], p["z"], *earth).alias(f"earth_distance_{n}d")]
    return stage.select(*cols)


def planet_state_cols(t_seconds: Column, distance_au, period_days) -> dict[str, Column]:
    """circular-orbit state at epoch seconds ``t``.

    angle = t / (period * 86400) * 2 * pi; position (d cos, d sin, 0);
    velocity speed * (-sin, cos, 0) with speed = 2 pi d / (period * 86400)."""
    d = _c(distance_au) * F.lit(K.AU_KM)
    period_s = _c(period_days) * F.lit(24 * 3600)
    angle = t_seconds / period_s * F.lit(2.0) * F.lit(math.pi)
    speed = F.lit(2.0) * F.lit(math.pi) * d / period_s
    return {"x": d * F.cos(angle), "y": d * F.sin(angle), "z": F.lit(0.0),
            "vx": -speed * F.sin(angle), "vy": speed * F.cos(angle), "vz": F.lit(0.0)}


def planet_positions(times: DataFrame, time_col: str = "timestamp", planets: DataFrame | None = None, keep=()) -> DataFrame:
    """F30 as an operator: every row of ``times`` gets the state of each planet; columns in ``keep`` stay.

    The planet dimension is a fixed six-row literal exploded per time row (no
    join); pass ``planets`` (planet, distance_au, period_days, mass) to use
    another dimension, which becomes one scalar subquery (an array of its rows) and is
    exploded likewise."""
    from neo.functions.timefn import epoch_seconds

    ts = to_ntz(times, time_col)
    if planets is None:
        dim = F.array(*[F.struct(F.lit(n).alias("planet"), F.lit(d).alias("distance_au"),
                                 F.lit(p).alias("period_days"), F.lit(m).alias("mass"))
                        for n, d, p, m in K.PLANETS])
        rows = times.select(*keep, ts.alias("__t"), F.explode(dim).alias("p")).select(*keep, "__t", "p.*")
    else:
        row = F.struct("planet", F.col("distance_au").cast("double").alias("distance_au"),
                       F.col("period_days").cast("double").alias("period_days"), F.col("mass").cast("double").alias("mass"))
        dim = planets.agg(F.collect_list(row)).scalar()
        rows = times.select(*keep, ts.alias("__t"), F.explode(dim).alias("p")).select(*keep, "__t", "p.*")
    st = planet_state_cols(epoch_seconds(F.col("__t")).cast("double"), F.col("distance_au"), F.col("period_days"))
    return rows.select(
        *keep, "planet", F.col("__t").alias("timestamp"),
        F.struct(st["x"].alias("x"), st["y"].alias("y"), st["z"].alias("z")).alias("position"),
        F.struct(st["vx"].alias("vx"), st["vy"].alias("vy"), st["vz"].alias("vz")).alias("velocity"),
        "mass", F.col("period_days").cast("double").alias("orbital_period"))
