"""SQL text of the domain views, for the independent DuckDB oracle.

Written by hand, not generated from the Spark code: the oracle must be an
independent statement of the same arithmetic.  Double literals are cast from
their shortest decimal text, so both engines start from identical constants.
"""

from __future__ import annotations

import math

from neo import constants as K
from neo.sources import domain as DM


def D(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


AU = D(K.AU_KM)


def mm(k: str, mult: int, mod: int) -> str:
    return f"((({k} % {mod}) * {mult % mod}) % {mod})"


def unit(k: str, h) -> str:
    mult, mod = h
    return f"(CAST({mm(k, mult, mod)} AS DOUBLE) / {D(mod)})"


def sunit(k: str, h) -> str:
    mult, mod = h
    half = (mod - 1) // 2
    return f"(CAST({mm(k, mult, mod)} - {half} AS DOUBLE) / {D(half)})"


def norm3(x, y, z) -> str:
    return f"sqrt(({x}) * ({x}) + ({y}) * ({y}) + ({z}) * ({z}))"


def dist3(x, y, z, ox, oy, oz) -> str:
    return norm3(f"({x}) - ({ox})", f"({y}) - ({oy})", f"({z}) - ({oz})")


def ladder(p: str, preset: str) -> str:
    rungs = K.RISK_LADDERS[preset]
    d = K.RISK_LADDERS[f"{preset}_default"]
    whens = " ".join(f"WHEN {p} > {D(t)} THEN '{lvl}'" for t, lvl in rungs)
    return f"(CASE {whens} ELSE '{d}' END)"


def color(level: str) -> str:
    whens = " ".join(f"WHEN {level} = '{k}' THEN '{v}'" for k, v in K.RISK_COLORS.items())
    return f"(CASE {whens} ELSE 'green' END)"


def classify(d: str) -> str:
    whens = " ".join(f"WHEN {d} < {D(lim * K.AU_KM)} THEN '{n}'" for lim, n in K.ORBIT_CLASSES)
    return f"(CASE WHEN {d} IS NULL THEN NULL {whens} ELSE '{K.ORBIT_CLASS_DEFAULT}' END)"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f')"


def mass(size: str, density: str) -> str:
    r = f"(({size}) * {D(500.0)})"
    return f"(({density}) * ({D((4 / 3) * math.pi)} * ({r} * {r} * {r})))"


def heuristic(d: str, size: str, speed: str, factor: str = None) -> str:
    soi = D(K.SOI_GENERATOR_AU * K.AU_KM)
    base = (f"(greatest({D(0.0)}, {D(1.0)} - ({d}) / {soi}) * least(({size}) / {D(5.0)}, {D(2.0)})"
            f" * least(({speed}) / {D(50000.0)}, {D(1.5)}))")
    f = factor if factor is not None else D(1.0)
    return f"least({base} * ({f}) * {D(0.01)}, {D(1.0)})"


def fallback(size: str, speed: str, factor: str) -> str:
    base = f"(least(({size}) / {D(10.0)}, {D(1.0)}) * least(({speed}) / {D(50.0)}, {D(1.0)}))"
    return f"least(greatest({base} * ({factor}) * {D(0.01)}, {D(0.0)}), {D(1.0)})"


def epoch_s(ts: str) -> str:
    return f"CAST(floor(epoch({ts})) AS BIGINT)"


# the asteroid state (no derived physics yet), one row per event
_RAW = f"""
SELECT event_id, ts, user_id, event_type,
  {mm('event_id', *DM.TYPE_HASH)} AS h,
  {sunit('event_id', DM.A_HASH)} AS a, {sunit('event_id', DM.B_HASH)} AS b,
  {sunit('event_id', DM.G_HASH)} AS g, {unit('event_id', DM.S_HASH)} AS s,
  {unit('event_id', DM.ECC_HASH)} AS ue
FROM events"""

ASTEROID_STATE = f"""
SELECT event_id, ts, user_id, event_type,
  CASE WHEN h < 250 THEN 'near_earth' WHEN h < 850 THEN 'main_belt' WHEN h < 950 THEN 'trojan' ELSE 'outer' END
    AS asteroid_type,
  {AU} * (CASE WHEN h < 250 THEN {D(1.0)} + {D(0.02)} * a WHEN h < 850 THEN {D(2.75)} + {D(0.75)} * a
               WHEN h < 950 THEN {D(5.15)} + {D(0.35)} * a ELSE {D(6.5)} + {D(1.5)} * a END) AS x,
  {AU} * (CASE WHEN h < 250 THEN {D(0.02)} * b ELSE {D(0.5)} * b END) AS y,
  {AU} * {D(0.01)} * g AS z,
  {D(12.0)} * b AS vx, {D(30.0)} + {D(8.0)} * a AS vy, {D(5.0)} * g AS vz,
  CASE WHEN s < {D(0.5)} THEN {D(0.1)} + {D(1.8)} * s
       WHEN s < {D(0.8)} THEN {D(1.0)} + (s - {D(0.5)}) * {D(13.333333)}
       WHEN s < {D(0.95)} THEN {D(5.0)} + (s - {D(0.8)}) * {D(100.0)}
       ELSE {D(20.0)} + (s - {D(0.95)}) * {D(1600.0)} END AS size,
  CASE WHEN s < {D(0.5)} THEN 'small' WHEN s < {D(0.8)} THEN 'medium' WHEN s < {D(0.95)} THEN 'large'
       ELSE 'very_large' END AS size_category,
  {D(1500.0)} + {D(6500.0)} * abs(b) AS density,
  {D(0.05)} + {D(0.25)} * ue AS eccentricity
FROM ({_RAW}) raw"""

_R_SUN = norm3("x", "y", "z")
_D_EARTH = dist3("x", "y", "z", AU, D(0.0), D(0.0))
_SPEED = norm3("vx", "vy", "vz")
_PROB = heuristic(_D_EARTH, "size", _SPEED)

# flat asteroid view: same rows and values as neo.sources.domain.asteroids, with
# the nested structs as pos_x..vel_z
ASTEROIDS = f"""
SELECT event_id, 'asteroid_' || CAST(user_id AS VARCHAR) AS id, ts AS timestamp, event_type,
  x AS pos_x, y AS pos_y, z AS pos_z, vx AS vel_x, vy AS vel_y, vz AS vel_z,
  size, {mass('size', 'density')} AS mass, density,
  {classify(_R_SUN)} AS classification,
  sqrt(({_R_SUN} / {AU}) * ({_R_SUN} / {AU}) * ({_R_SUN} / {AU})) * {D(K.YEAR_DAYS)} AS orbital_period,
  eccentricity,
  ({_D_EARTH} < {D(K.PHO_DISTANCE_AU * K.AU_KM)} AND size > {D(K.PHO_MIN_SIZE_KM)}) AS potentially_hazardous,
  {_PROB} AS collision_probability,
  {iso('ts')} AS processed_timestamp, asteroid_type, size_category, {iso('ts')} AS discovery_date,
  {_PROB} AS enhanced_collision_probability,
  {ladder(_PROB, 'generator')} AS risk_level,
  {color(ladder(_PROB, 'generator'))} AS color,
  {_D_EARTH} AS distance_from_earth
FROM ({ASTEROID_STATE}) st"""


def _planet_rows() -> str:
    vals = ", ".join(f"('{n}', {D(d)}, {p}, {D(m)})" for n, d, p, m in K.PLANETS)
    return f"(VALUES {vals}) AS dim(planet, distance_au, period_days, mass)"


def planet_state(t: str, dist_au: str, period: str) -> dict:
    d = f"(({dist_au}) * {AU})"
    ps = f"(CAST({period} AS DOUBLE) * {D(24 * 3600)})"
    ang = f"(({t}) / {ps} * {D(2.0)} * {D(math.pi)})"
    spd = f"({D(2.0)} * {D(math.pi)} * {d} / {ps})"
    return {"x": f"{d} * cos({ang})", "y": f"{d} * sin({ang})", "z": D(0.0),
            "vx": f"-{spd} * sin({ang})", "vy": f"{spd} * cos({ang})", "vz": D(0.0)}


_PS = planet_state(f"CAST({epoch_s('day')} AS DOUBLE)", "distance_au", "period_days")
PLANETS = f"""
SELECT planet, day AS timestamp,
  {_PS['x']} AS pos_x, {_PS['y']} AS pos_y, {_PS['z']} AS pos_z,
  {_PS['vx']} AS vel_x, {_PS['vy']} AS vel_y, {_PS['vz']} AS vel_z,
  mass, CAST(period_days AS DOUBLE) AS orbital_period, {iso('day')} AS processed_timestamp
FROM (SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM events WHERE ts IS NOT NULL) days,
     {_planet_rows()}"""


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the named views as CTEs (in dependency order)."""
    views = {"asteroids": ASTEROIDS, "planets": PLANETS}
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in names)
    return f"WITH {ctes}\n{body}"
