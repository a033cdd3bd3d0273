"""Risk ladders, colours and orbit classes as chained ``CASE WHEN`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from neo import constants as K
from neo.functions.vector import _c


def risk_ladder(col, preset: str = "batch", thresholds=None, default: str | None = None) -> Column:
    """Map a probability to a level with strict ``>`` comparisons, top rung first.

    Presets (``batch``, ``generator``, ``model``, ``test``, ``alert``) hold the
    five ladders in use; pass ``thresholds=[(t, level), ...]`` for a custom one.
    A null probability falls through to the default level.
    """
    rungs = thresholds if thresholds is not None else K.RISK_LADDERS[preset]
    dflt = default if default is not None else K.RISK_LADDERS.get(f"{preset}_default", "LOW")
    p = _c(col)
    expr = None
    for t, level in rungs:
        cond = p > F.lit(float(t))
        expr = F.when(cond, F.lit(level)) if expr is None else expr.when(cond, F.lit(level))
    return F.lit(dflt) if expr is None else expr.otherwise(F.lit(dflt))


def _lookup(col, mapping: dict, default) -> Column:
    level = _c(col)
    expr = None
    for k, v in mapping.items():
        cond = level == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(default))


def risk_color(level_col) -> Column:
    """Generator colour per level (unknown level -> green)."""
    return _lookup(level_col, K.RISK_COLORS, "green")


def map_marker_color(level_col) -> Column:
    """Map-view colour: HIGH red, MEDIUM orange, anything else (or missing) green."""
    return _lookup(level_col, {k: v[0] for k, v in K.MAP_MARKERS.items()}, K.MAP_MARKER_DEFAULT[0])


def map_marker_size(level_col) -> Column:
    return _lookup(level_col, {k: v[1] for k, v in K.MAP_MARKERS.items()}, K.MAP_MARKER_DEFAULT[1])


def classify_orbit(distance_km) -> Column:
    """Orbit class from distance to the Sun in km (strict ``<`` per rung)."""
    d = _c(distance_km)
    expr = None
    for limit_au, name in K.ORBIT_CLASSES:
        cond = d < F.lit(limit_au * K.AU_KM)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.when(d.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(K.ORBIT_CLASS_DEFAULT)))
