"""Independent SQL statements (DuckDB dialect) for the query catalog.

Each entry states the same result as the Spark query of the same name in
:mod:`neo.plans.catalog`, over the given tables (``events``, ``embeddings``,
``labels`` registered as views).  Column names, types and rounding follow the
Spark side.  Queries that are not expressible in SQL (approximate quantiles,
model training and scoring) have no entry and are checked by row count only.
"""

from __future__ import annotations

import math

from neo import constants as K
from neo import schemas as S
from neo.plans import sqlviews as V
from neo.plans.sqlviews import AU, D, dist3, iso, ladder, norm3
from neo.sources import domain as DM

GM = D(K.GM_SUN)
SOI = D(K.SOI_BATCH_AU * K.AU_KM)
EOS = D(K.EARTH_ORBITAL_SPEED)
Z = D(0.0)
ANGLE_DIGITS = 9   # same rounding as the Spark side for atan2 results

ORACLE: dict[str, str] = {}


def _bigint_counts(text: str) -> str:
    """``count_if(x)`` -> ``count(*) FILTER (WHERE x)``: DuckDB types the former
    HUGEINT, Spark's ``count_if`` is BIGINT."""
    out, i = [], 0
    while True:
        j = text.find("count_if(", i)
        if j < 0:
            out.append(text[i:])
            return "".join(out)
        k, depth = j + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        out.append(text[i:j] + f"count(*) FILTER (WHERE {text[j + len('count_if('):k - 1]})")
        i = k


def sql(name: str, body: str, *views: str, ctes: str = "") -> None:
    """Register ``body`` with the named domain views (and extra CTEs) in front."""
    head = V.with_views("", *views).rstrip() if views else "WITH "
    extra = ctes.strip()
    if views and extra:
        head += ",\n" + extra
    elif extra:
        head += extra
    elif not views:
        head = ""
    ORACLE[name] = _bigint_counts(f"{head}\n{body}".strip())


def r(expr: str, n: int) -> str:
    return f"round({expr}, {n})"


# --- shared CTE text -------------------------------------------------------------
FEAT = f"""
feat0 AS (
  SELECT *,
    {norm3('pos_x', 'pos_y', 'pos_z')} AS distance_from_sun,
    {norm3('vel_x', 'vel_y', 'vel_z')} AS velocity_magnitude,
    pos_y * vel_z - pos_z * vel_y AS angular_momentum_x,
    pos_z * vel_x - pos_x * vel_z AS angular_momentum_y,
    pos_x * vel_y - pos_y * vel_x AS angular_momentum_z
  FROM asteroids WHERE size IS NOT NULL AND mass IS NOT NULL),
feat1 AS (
  SELECT *,
    velocity_magnitude * velocity_magnitude / {D(2.0)} - {GM} / NULLIF(distance_from_sun, {Z}) AS orbital_energy,
    {norm3('angular_momentum_x', 'angular_momentum_y', 'angular_momentum_z')} AS angular_momentum_magnitude,
    CAST(floor(epoch(timestamp)) AS BIGINT) AS timestamp_unix,
    CAST(hour(timestamp) AS INTEGER) AS hour_of_day,
    CAST(dayofyear(timestamp) AS INTEGER) AS day_of_year
  FROM feat0),
feat AS (
  SELECT *, CASE WHEN orbital_energy < 0 THEN (-{GM}) / ({D(2.0)} * orbital_energy) END AS semi_major_axis
  FROM feat1)"""


def risk_ctes(src: str, name: str, ex: str, ey: str, ez: str) -> str:
    """F12-F18 over CTE ``src`` with the reference body at (ex, ey, ez)."""
    return f"""
{name}0 AS (
  SELECT * EXCLUDE (enhanced_collision_probability, risk_level),
    {dist3('pos_x', 'pos_y', 'pos_z', ex, ey, ez)} AS earth_distance,
    {dist3('vel_x', 'vel_y', 'vel_z', EOS, Z, Z)} AS relative_velocity,
    abs(atan2(pos_y - ({ey}), pos_x - ({ex}))) AS approach_angle,
    least(size / {D(10.0)}, {D(1.0)}) AS size_factor
  FROM {src}),
{name}1 AS (
  SELECT *,
    CASE WHEN earth_distance > {SOI} THEN {Z} ELSE greatest({Z}, {D(1.0)} - earth_distance / {SOI}) END
      AS distance_factor,
    {D(1.0)} / ({D(1.0)} + relative_velocity / {D(30.0)}) AS velocity_factor
  FROM {name}0),
{name}2 AS (
  SELECT *, size_factor * distance_factor * velocity_factor * {D(K.PROBABILITY_SCALE)}
    AS enhanced_collision_probability
  FROM {name}1),
{name} AS (SELECT *, {ladder('enhanced_collision_probability', 'batch')} AS risk_level FROM {name}2)"""


RISK = risk_ctes("feat", "risk", AU, Z, Z)

LATEST_EARTH = """
earth AS (
  SELECT pos_x AS ex, pos_y AS ey, pos_z AS ez FROM planets WHERE planet = 'Earth'
  ORDER BY timestamp DESC, processed_timestamp DESC LIMIT 1),
earth_or_default AS (
  SELECT coalesce((SELECT ex FROM earth), {au}) AS ex, coalesce((SELECT ey FROM earth), {z}) AS ey,
         coalesce((SELECT ez FROM earth), {z}) AS ez)""".format(au=AU, z=Z)

EX = "(SELECT ex FROM earth_or_default)"
EY = "(SELECT ey FROM earth_or_default)"
EZ = "(SELECT ez FROM earth_or_default)"


def horizons_ctes(src: str, name: str) -> str:
    cols = []
    for n in K.HORIZONS_DAYS:
        dt = D(float(n * K.DAY_SECONDS))
        v = {a: f"(vel_{a} + __a{a} * {dt})" for a in "xyz"}
        p = {a: f"(pos_{a} + {v[a]} * {dt})" for a in "xyz"}
        cols.append(f"__acc AS acc_magnitude_{n}d")
        cols += [f"__a{a} AS acc_{a}_{n}d" for a in "xyz"]
        cols += [f"{v[a]} AS vel_{a}_{n}d" for a in "xyz"]
        cols += [f"{p[a]} AS pos_{a}_{n}d" for a in "xyz"]
        cols.append(f"{dist3(p['x'], p['y'], p['z'], AU, Z, Z)} AS earth_distance_{n}d")
    body = ",\n    ".join(cols)
    return f"""
{name}0 AS (SELECT *, {GM} / NULLIF(distance_from_sun * distance_from_sun, {Z}) AS __acc FROM {src}),
{name}1 AS (
  SELECT *,
    (-__acc) * pos_x / NULLIF(distance_from_sun, {Z}) AS __ax,
    (-__acc) * pos_y / NULLIF(distance_from_sun, {Z}) AS __ay,
    (-__acc) * pos_z / NULLIF(distance_from_sun, {Z}) AS __az
  FROM {name}0),
{name} AS (SELECT *,
    {body}
  FROM {name}1)"""


HORIZON_COLS = ", ".join(f"{p}_{n}d" for n in K.HORIZONS_DAYS for p in (
    "acc_magnitude", "acc_x", "acc_y", "acc_z", "vel_x", "vel_y", "vel_z", "pos_x", "pos_y", "pos_z",
    "earth_distance"))


def iqr_ctes(src: str, name: str, features=K.IQR_FEATURES) -> str:
    """A9 (exact): sequential IQR filters; ``name`` is the final CTE."""
    parts, cur = [], src
    for i, f in enumerate(features):
        b, nxt = f"{name}_b{i}", (name if i == len(features) - 1 else f"{name}_s{i}")
        parts.append(f"{b} AS (SELECT quantile_cont({f}, 0.25) AS q1, quantile_cont({f}, 0.75) AS q3 FROM {cur})")
        parts.append(f"""{nxt} AS (
  SELECT {cur}.* FROM {cur}, {b}
  WHERE {b}.q1 IS NULL OR ({f} >= {b}.q1 - {D(1.5)} * ({b}.q3 - {b}.q1)
                           AND {f} <= {b}.q3 + {D(1.5)} * ({b}.q3 - {b}.q1)))""")
        cur = nxt
    return ",\n".join(parts)


def _training_cte() -> str:
    u = V.unit
    su = V.sunit
    st = V.ASTEROID_STATE
    return f"""
training AS (
  SELECT event_id,
    size AS diameter_km,
    {norm3('vx', 'vy', 'vz')} AS velocity_km_s,
    {dist3('x', 'y', 'z', AU, Z, Z)} / {AU} AS distance_earth_au,
    {V.mass('size', 'density')} AS mass_kg,
    {D(0.05)} + {D(0.25)} * {u('event_id', DM.ECC_HASH)} AS orbital_eccentricity,
    {D(10.0)} + {D(20.0)} * {su('event_id', DM.INCL_HASH)} AS inclination_deg,
    {D(2 * math.pi)} * {u('event_id', DM.ANGLE_HASH)} AS approach_angle,
    {D(0.05)} + {D(0.45)} * {u('event_id', DM.ALBEDO_HASH)} AS albedo,
    {D(1.0)} + {D(23.0)} * {u('event_id', DM.ROT_HASH)} AS rotation_period_h,
    {D(200.0)} + {D(60.0)} * {su('event_id', DM.TEMP_HASH)} AS surface_temp_k,
    {D(0.05)} * {su('event_id', DM.NOISE_HASH)} AS noise
  FROM ({st}) st)"""


def clip(x: str) -> str:
    return f"least(greatest({x}, {Z}), {D(1.0)})"


ws, wv, wd, we, wa = (D(w) for w in K.TRAINING_RISK_WEIGHTS)
TRAIN_RISK = f"""
scored AS (
  SELECT *, {clip(f'''{ws} * {clip(f"(diameter_km - {D(0.5)}) / {D(2.0)}")} + {wv} * {clip(f"(velocity_km_s - {D(15.0)}) / {D(20.0)}")} + {wd} * {clip(f"{D(2.0)} / (distance_earth_au + {D(0.1)})")} + {we} * orbital_eccentricity + {wa} * abs(sin(approach_angle)) + noise''')} AS collision_risk
  FROM training),
labelled AS (
  SELECT *, CAST(CASE WHEN collision_risk > (SELECT quantile_cont(collision_risk, {D(K.PERCENTILE_LABEL)}) FROM scored)
                 THEN 1 ELSE 0 END AS INTEGER) AS label
  FROM scored)"""

f1, f2 = K.SPLIT_FRACTIONS[0], K.SPLIT_FRACTIONS[0] + K.SPLIT_FRACTIONS[1]
SPLIT = f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label
                               ORDER BY md5(concat(CAST(event_id AS VARCHAR), '{K.SPLIT_SEED}')),
                                        event_id) - 1 AS rnk,
         count(*) OVER (PARTITION BY label) AS n_label
  FROM labelled),
split AS (
  SELECT *, CASE WHEN rnk < floor({D(f1)} * n_label) THEN 'train'
                 WHEN rnk < floor({D(f2)} * n_label) THEN 'validation' ELSE 'test' END AS split
  FROM ranked)"""

FACTOR = f"({D(0.1)} + {D(1.9)} * {V.unit('event_id', DM.FACTOR_HASH)})"


def _results_cte() -> str:
    st = V.ASTEROID_STATE
    speed = norm3('vx', 'vy', 'vz')
    d_au = f"({dist3('x', 'y', 'z', AU, Z, Z)} / {AU})"
    prob = V.fallback("size", speed, FACTOR)
    ok = "coalesce(event_type <> 'error', true)"
    return f"""
res0 AS (
  SELECT event_id, asteroid_type AS scenario, 'asteroid_' || CAST(user_id AS VARCHAR) AS asteroid_id,
    {ok} AS ok, size AS s_size, {d_au} AS s_dau, {speed} AS s_speed, {prob} AS s_prob,
    {D(0.2)} + {D(4.8)} * {V.unit('event_id', DM.MS_HASH)} AS s_ms
  FROM ({st}) st),
results AS (
  SELECT event_id, scenario, asteroid_id,
    CASE WHEN ok THEN s_size END AS size,
    CASE WHEN ok THEN s_dau END AS distance_au,
    CASE WHEN ok THEN s_speed END AS velocity_magnitude,
    CASE WHEN ok THEN (s_dau < {D(K.PHO_DISTANCE_AU)} AND s_size > {D(K.PHO_MIN_SIZE_KM)}) END AS potentially_hazardous,
    CASE WHEN ok THEN s_prob END AS ml_probability,
    CASE WHEN ok THEN {ladder('s_prob', 'model')} END AS ml_risk_level,
    CASE WHEN ok THEN s_ms END AS prediction_time_ms,
    CASE WHEN ok THEN {ladder('s_prob', 'model')} = {ladder('s_prob', 'test')} END AS risk_level_match,
    ok AS success,
    CASE WHEN NOT ok THEN 'prediction failed: event ' || CAST(event_id AS VARCHAR) END AS error
  FROM res0)"""


RESULTS = _results_cte()
TRAINING = _training_cte()

# --- 2.1 sources and sinks ----------------------------------------------------
sql("s1_read_table", f"SELECT event_id, {iso('ts')} AS ts, user_id, event_type, value FROM events")
sql("s1_read_checked", """
SELECT 'row' AS status, event_id, user_id, value FROM events
WHERE coalesce(event_type, '') NOT IN ('error', 'signup')
UNION ALL SELECT 'value: string, not double', -1, -1, NULL WHERE EXISTS (FROM events WHERE event_type = 'error')
UNION ALL SELECT 'unreadable', -1, -1, NULL WHERE EXISTS (FROM events WHERE event_type = 'signup')""")
sql("s2_parse_messages", f"""
SELECT event_id, id, {iso('timestamp')} AS timestamp, pos_x, pos_y, vel_z, size, mass, classification,
       potentially_hazardous, risk_level, distance_from_earth
FROM asteroids""", "asteroids")
sql("s3_quarantine", """
SELECT event_id, CASE WHEN coalesce(event_type = 'error', false) THEN 'bad' ELSE 'good' END AS status
FROM events""")
sql("s4_land_stream", "SELECT event_id, id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS ingest_date FROM asteroids",
    "asteroids")
sql("s5_stamp_processed",
    f"SELECT event_id, {iso('(SELECT max(ts) FROM events)')} AS processed_timestamp FROM asteroids", "asteroids")
sql("s6_write_table", "SELECT event_id, distance_from_sun, velocity_magnitude FROM feat", "asteroids", ctes=FEAT)
sql("s7_write_json", "SELECT event_id, id, size, risk_level FROM asteroids", "asteroids")
sql("s8_read_latest_file", """
SELECT event_id, id FROM asteroids
WHERE CAST(timestamp AS DATE) = (SELECT max(CAST(timestamp AS DATE)) FROM asteroids)""", "asteroids")
sql("s8_read_latest_partition", """
SELECT event_id, id FROM asteroids
WHERE CAST(timestamp AS DATE) = (SELECT max(CAST(timestamp AS DATE)) FROM asteroids)""", "asteroids")
sql("s9_encode_messages", f"""
SELECT id AS key, id AS json_id, {iso('timestamp')} AS json_timestamp, size AS json_size, pos_x AS json_pos_x,
       CASE WHEN potentially_hazardous THEN 'true' ELSE 'false' END AS json_hazardous
FROM asteroids""", "asteroids")

# --- 2.2 scalar features --------------------------------------------------------
sql("f1_drop_incomplete", "SELECT event_id, id FROM asteroids WHERE size IS NOT NULL AND mass IS NOT NULL",
    "asteroids")
sql("f2_flatten_state", "SELECT event_id, pos_x, pos_y, pos_z, vel_x, vel_y, vel_z FROM asteroids", "asteroids")
sql("f3_distance_from_sun", "SELECT event_id, distance_from_sun FROM feat", "asteroids", ctes=FEAT)
sql("f4_velocity_magnitude", "SELECT event_id, velocity_magnitude FROM feat", "asteroids", ctes=FEAT)
sql("f5_distance_from_earth",
    f"SELECT event_id, {dist3('pos_x', 'pos_y', 'pos_z', AU, Z, Z)} AS distance_from_earth FROM asteroids",
    "asteroids")
sql("f6_orbital_energy", "SELECT event_id, orbital_energy FROM feat", "asteroids", ctes=FEAT)
sql("f7_angular_momentum", """SELECT event_id, angular_momentum_x, angular_momentum_y, angular_momentum_z,
angular_momentum_magnitude FROM feat""", "asteroids", ctes=FEAT)
sql("f8_semi_major_axis", "SELECT event_id, semi_major_axis FROM feat", "asteroids", ctes=FEAT)
sql("f9_timestamp_unix", "SELECT event_id, CAST(floor(epoch(timestamp)) AS BIGINT) AS timestamp_unix FROM asteroids",
    "asteroids")
sql("f10_hour_of_day", "SELECT event_id, CAST(hour(timestamp) AS INTEGER) AS hour_of_day FROM asteroids",
    "asteroids")
sql("f11_day_of_year", "SELECT event_id, CAST(dayofyear(timestamp) AS INTEGER) AS day_of_year FROM asteroids",
    "asteroids")
sql("f12_earth_distance", f"""
SELECT event_id, {r(dist3('pos_x', 'pos_y', 'pos_z', EX, EY, EZ), 3)} AS earth_distance FROM asteroids""",
    "asteroids", "planets", ctes=LATEST_EARTH)
sql("f13_relative_velocity",
    f"SELECT event_id, {dist3('vel_x', 'vel_y', 'vel_z', EOS, Z, Z)} AS relative_velocity FROM asteroids",
    "asteroids")
sql("f14_approach_angle",
    f"SELECT event_id, {r(f'abs(atan2(pos_y - {Z}, pos_x - {AU}))', ANGLE_DIGITS)} AS approach_angle FROM asteroids",
    "asteroids")
sql("f15_size_factor", f"SELECT event_id, least(size / {D(10.0)}, {D(1.0)}) AS size_factor FROM asteroids",
    "asteroids")
sql("f16_distance_factor", "SELECT event_id, distance_factor FROM risk", "asteroids", ctes=FEAT + "," + RISK)
sql("f17_enhanced_probability", "SELECT event_id, velocity_factor, enhanced_collision_probability FROM risk",
    "asteroids", ctes=FEAT + "," + RISK)
_P = "enhanced_collision_probability"
sql("f18_risk_ladder", f"""
SELECT event_id, {ladder(_P, 'batch')} AS risk_batch, {ladder(_P, 'generator')} AS risk_generator,
       {ladder(_P, 'model')} AS risk_model, {ladder(_P, 'test')} AS risk_test, {ladder(_P, 'alert')} AS risk_alert
FROM risk""", "asteroids", ctes=FEAT + "," + RISK)
sql("f19_risk_color", f"""
SELECT event_id, {V.color(ladder(_P, 'generator'))} AS color,
  CASE WHEN risk_level = 'HIGH' THEN 'red' WHEN risk_level = 'MEDIUM' THEN 'orange' ELSE 'green' END AS marker_color,
  CAST(CASE WHEN risk_level = 'HIGH' THEN 8 WHEN risk_level = 'MEDIUM' THEN 6 ELSE 4 END AS INTEGER) AS marker_size
FROM risk""", "asteroids", ctes=FEAT + "," + RISK)

_DT = D(3600.0)
sql("f20_propagate", f"""
WITH s AS (SELECT event_id, pos_x AS x, pos_y AS y, pos_z AS z, vel_x AS vx, vel_y AS vy, vel_z AS vz,
                  {norm3('pos_x', 'pos_y', 'pos_z')} AS rr FROM ({V.with_views('SELECT * FROM asteroids', 'asteroids')})),
a AS (SELECT *, {GM} / (rr * rr) AS acc FROM s),
v AS (SELECT *, vx + ((-acc) * x / rr) * {_DT} AS nvx, vy + ((-acc) * y / rr) * {_DT} AS nvy,
                vz + ((-acc) * z / rr) * {_DT} AS nvz FROM a)
SELECT event_id,
  CASE WHEN rr > 0 THEN x + nvx * {_DT} ELSE x END AS x, CASE WHEN rr > 0 THEN y + nvy * {_DT} ELSE y END AS y,
  CASE WHEN rr > 0 THEN z + nvz * {_DT} ELSE z END AS z,
  CASE WHEN rr > 0 THEN nvx ELSE vx END AS vx, CASE WHEN rr > 0 THEN nvy ELSE vy END AS vy,
  CASE WHEN rr > 0 THEN nvz ELSE vz END AS vz
FROM v""")
sql("f21_propagate_horizons", f"SELECT event_id, {HORIZON_COLS} FROM hz", "asteroids",
    ctes=FEAT + "," + horizons_ctes("feat", "hz"))
sql("f22_classify_orbit", f"SELECT event_id, {V.classify('distance_from_sun')} AS classification FROM feat",
    "asteroids", ctes=FEAT)
sql("f23_orbital_period", f"""
SELECT event_id, sqrt((distance_from_sun / {AU}) * (distance_from_sun / {AU}) * (distance_from_sun / {AU}))
  * {D(K.YEAR_DAYS)} AS orbital_period FROM feat""", "asteroids", ctes=FEAT)
sql("f24_potentially_hazardous", f"""
SELECT event_id, ({dist3('pos_x', 'pos_y', 'pos_z', AU, Z, Z)} < {D(K.PHO_DISTANCE_AU * K.AU_KM)}
  AND size > {D(K.PHO_MIN_SIZE_KM)}) AS potentially_hazardous FROM asteroids""", "asteroids")
sql("f25_refresh_state", f"""
WITH p AS (SELECT event_id, timestamp, size, x1, y1, z1 FROM (
  SELECT *, CASE WHEN rr > 0 THEN pos_x + (vel_x + ((-acc) * pos_x / rr) * {_DT}) * {_DT} ELSE pos_x END AS x1,
            CASE WHEN rr > 0 THEN pos_y + (vel_y + ((-acc) * pos_y / rr) * {_DT}) * {_DT} ELSE pos_y END AS y1,
            CASE WHEN rr > 0 THEN pos_z + (vel_z + ((-acc) * pos_z / rr) * {_DT}) * {_DT} ELSE pos_z END AS z1
  FROM (SELECT *, {GM} / (rr * rr) AS acc FROM (
    SELECT *, {norm3('pos_x', 'pos_y', 'pos_z')} AS rr FROM ({V.with_views('SELECT * FROM asteroids', 'asteroids')})))))
SELECT event_id, {iso("timestamp + INTERVAL 3600 SECOND")} AS timestamp,
  ({dist3('x1', 'y1', 'z1', AU, Z, Z)} < {D(K.PHO_DISTANCE_AU * K.AU_KM)} AND size > {D(K.PHO_MIN_SIZE_KM)})
    AS potentially_hazardous, x1 AS x, y1 AS y
FROM p""")
sql("f26_body_mass", f"SELECT event_id, {V.mass('size', 'density')} AS mass FROM asteroids", "asteroids")
sql("f27_heuristic_probability", f"""
SELECT event_id, {V.heuristic(dist3('pos_x', 'pos_y', 'pos_z', AU, Z, Z), 'size', norm3('vel_x', 'vel_y', 'vel_z'),
                              FACTOR)} AS collision_probability FROM asteroids""", "asteroids")
sql("f28_model_fallback_probability", f"""
SELECT event_id, {V.fallback('size', norm3('vel_x', 'vel_y', 'vel_z'), FACTOR)} AS collision_probability
FROM asteroids""", "asteroids")


def _eta(dist: str) -> str:
    spd = norm3('vel_x', 'vel_y', 'vel_z')
    t = f"timestamp + to_microseconds(CAST(floor(({dist}) / ({spd}) * {D(1000000.0)}) AS BIGINT))"
    return f"coalesce(CASE WHEN {spd} > 0 THEN {iso(t)} END, 'Unknown')"


sql("f29_impact_eta", f"""
SELECT event_id, {_eta(norm3('pos_x', 'pos_y', 'pos_z'))} AS eta_sun,
       {_eta(dist3('pos_x', 'pos_y', 'pos_z', AU, Z, Z))} AS eta_earth FROM asteroids""", "asteroids")
sql("f30_planet_positions", f"""
SELECT planet, {iso('timestamp')} AS timestamp, {r('pos_x', 3)} AS x, {r('pos_y', 3)} AS y,
       {r('vel_x', 9)} AS vx, {r('vel_y', 9)} AS vy, mass FROM planets""", "planets")

_MI = {
    "orbital_eccentricity": f"{D(0.05)} + {D(0.25)} * {V.unit('event_id', DM.ECC_HASH)}",
    "inclination_deg": f"{D(10.0)} + {D(20.0)} * {V.sunit('event_id', DM.INCL_HASH)}",
    "albedo": f"{D(0.05)} + {D(0.45)} * {V.unit('event_id', DM.ALBEDO_HASH)}",
    "rotation_period_h": f"{D(1.0)} + {D(23.0)} * {V.unit('event_id', DM.ROT_HASH)}",
    "surface_temp_k": f"{D(200.0)} + {D(60.0)} * {V.sunit('event_id', DM.TEMP_HASH)}",
}
sql("f31_model_features", f"""
SELECT event_id, coalesce(size, {D(1.0)}) AS diameter_km, {norm3('vel_x', 'vel_y', 'vel_z')} AS velocity_km_s,
  {dist3('pos_x', 'pos_y', 'pos_z', AU, Z, Z)} / {AU} AS distance_earth_au,
  coalesce(mass, {D(K.DEFAULT_ASTEROID_MASS_KG)}) AS mass_kg,
  {_MI['orbital_eccentricity']} AS orbital_eccentricity, {_MI['inclination_deg']} AS inclination_deg,
  {r('atan2(vel_y, vel_x)', ANGLE_DIGITS)} AS approach_angle, {_MI['albedo']} AS albedo,
  {_MI['rotation_period_h']} AS rotation_period_h, {_MI['surface_temp_k']} AS surface_temp_k
FROM asteroids""", "asteroids")
sql("f32_row_zscore", f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings),
m AS (SELECT vec_id, a, list_reduce(a, lambda acc, x: acc + x) / CAST(len(a) AS DOUBLE) AS mean FROM e),
s AS (SELECT vec_id, a, mean,
        sqrt(list_reduce(list_transform(a, lambda x: (x - mean) * (x - mean)), lambda acc, y: acc + y)
             / CAST(len(a) AS DOUBLE)) AS sd FROM m),
z AS (SELECT vec_id, list_transform(a, lambda x: (x - mean) / (sd + {D(K.ZSCORE_EPSILON)})) AS zs FROM s)
SELECT vec_id, CAST(generate_subscripts(zs, 1) - 1 AS INTEGER) AS pos, round(unnest(zs), 9) AS z FROM z""")
sql("f33_training_risk", f"SELECT event_id, {r('collision_risk', 12)} AS collision_risk FROM scored",
    ctes=TRAINING + "," + TRAIN_RISK.split(",\nlabelled")[0])
sql("f34_filter_recent",
    "SELECT event_id FROM asteroids WHERE timestamp >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY", "asteroids")
sql("f35_filter_risk", "SELECT event_id, risk_level FROM risk WHERE coalesce(risk_level, 'LOW') IN ('HIGH', 'MEDIUM')",
    "asteroids", ctes=FEAT + "," + RISK)

_AP = f"coalesce(enhanced_collision_probability, {Z})"
ALERTS = f"""
alerts AS (
  SELECT 'alert_' || id || '_' || CAST(CAST(floor(epoch(timestamp)) AS BIGINT) AS VARCHAR) AS alert_id,
    {iso('timestamp')} AS timestamp, id AS asteroid_id, {_AP} AS collision_probability,
    CASE WHEN {_AP} > {D(1e-3)} THEN 'HIGH' ELSE 'MEDIUM' END AS alert_level,
    {_eta('distance_from_sun')} AS estimated_impact_time, event_id
  FROM risk WHERE {_AP} > {D(K.ALERT_THRESHOLD)})"""
sql("f36_make_alerts", """SELECT alert_id, timestamp, asteroid_id, collision_probability, alert_level,
estimated_impact_time, event_id FROM alerts""", "asteroids", ctes=FEAT + "," + RISK + "," + ALERTS)

_EPH = V.planet_state("CAST(CAST(floor(epoch(timestamp)) AS BIGINT) AS DOUBLE)", D(1.0), "365")
_DE = dist3("pos_x", "pos_y", "pos_z", f"({_EPH['x']})", f"({_EPH['y']})", Z)
sql("f37_publish_enrich", f"""
WITH p AS (SELECT event_id, {V.heuristic(_DE, 'size', norm3('vel_x', 'vel_y', 'vel_z'))} AS prob, {_DE} AS d
           FROM ({V.with_views('SELECT * FROM asteroids', 'asteroids')}))
SELECT event_id, {r('prob', 12)} AS collision_probability, {ladder('prob', 'generator')} AS risk_level,
  {V.color(ladder('prob', 'generator'))} AS color, {r('d', 3)} AS distance_from_earth FROM p""")
sql("f38_risk_consistency", f"""
SELECT event_id, {ladder('ml_probability', 'test')} AS expected_risk_level,
  CAST(ml_risk_level = {ladder('ml_probability', 'test')} AS VARCHAR) AS risk_level_match FROM results""",
    ctes=RESULTS)
sql("f39_display_fields", f"""
SELECT event_id, printf('%.2f', size) AS size_text, printf('%.0f', coalesce(distance_from_earth, {Z})) AS distance_text,
  printf('%.8f', coalesce(enhanced_collision_probability, {Z})) AS probability_text FROM asteroids""", "asteroids")

# --- 2.3 joins --------------------------------------------------------------------
sql("j1_attach_reference_body", f"""
SELECT event_id, {r(EX, 3)} AS earth_x, {r(EY, 3)} AS earth_y, {r(EZ, 3)} AS earth_z FROM feat""",
    "asteroids", "planets", ctes=FEAT + "," + LATEST_EARTH)
sql("j2_collision_paths", f"""
SELECT id, pos_x AS start_x, pos_y AS start_y, pos_z AS start_z, {r(EX, 3)} AS end_x, {r(EY, 3)} AS end_y,
  {r(EZ, 3)} AS end_z FROM risk WHERE risk_level = 'HIGH'""",
    "asteroids", "planets", ctes=FEAT + "," + RISK + "," + LATEST_EARTH)

# --- 2.4 aggregations ----------------------------------------------------------------
RF = FEAT + "," + RISK
sql("a1_risk_counts", """
SELECT count(*) AS total_asteroids, count_if(risk_level = 'HIGH') AS high_risk_asteroids,
       count_if(risk_level = 'MEDIUM') AS medium_risk_asteroids FROM risk""", "asteroids", ctes=RF)
sql("a2_classification_counts", "SELECT classification, count(*) AS count FROM feat GROUP BY classification",
    "asteroids", ctes=FEAT)
sql("a3_size_stats", """
SELECT round(avg(size), 9) AS avg_size, round(stddev_samp(size), 9) AS stddev_size, min(size) AS min_size,
       max(size) AS max_size FROM feat""", "asteroids", ctes=FEAT)
sql("a4_distance_stats", """
SELECT round(avg(distance_from_earth), 3) AS avg_earth_distance, min(distance_from_earth) AS min_earth_distance,
       max(distance_from_earth) AS max_earth_distance FROM feat""", "asteroids", ctes=FEAT)
SUMMARY = """
SELECT count(*) AS total_asteroids, count_if(risk_level = 'HIGH') AS high_risk_asteroids,
  count_if(risk_level = 'MEDIUM') AS medium_risk_asteroids, round(avg(size), 9) AS avg_size,
  round(stddev_samp(size), 9) AS stddev_size, min(size) AS min_size, max(size) AS max_size,
  round(avg(distance_from_earth), 3) AS avg_earth_distance, min(distance_from_earth) AS min_earth_distance,
  max(distance_from_earth) AS max_earth_distance FROM {src}"""
sql("a5_summary", SUMMARY.format(src="risk"), "asteroids", ctes=RF)
PANEL = f"""
SELECT count(*) AS total, count_if(risk_level = 'HIGH') AS high, count_if(risk_level = 'MEDIUM') AS medium,
  count_if(risk_level = 'LOW') AS low, round(coalesce(avg(size), {Z}), 9) AS avg_size,
  coalesce(max(coalesce(enhanced_collision_probability, {Z})), {Z}) AS max_probability FROM {{src}}"""
sql("a6_panel_stats", PANEL.format(src="risk"), "asteroids", ctes=RF)
_W = f"((hi - lo) / {D(float(K.HISTOGRAM_BINS))})"
sql("a7_probability_histogram", f"""
SELECT bin, lo + bin * {_W} AS bin_start, CASE WHEN hi = lo THEN hi ELSE lo + (bin + 1) * {_W} END AS bin_end,
       count(*) AS count
FROM (SELECT CASE WHEN hi = lo THEN 0
                  ELSE CAST(least(floor((p - lo) / {_W}), {K.HISTOGRAM_BINS - 1}) AS INTEGER) END AS bin, lo, hi
      FROM (SELECT coalesce(enhanced_collision_probability, {Z}) AS p FROM risk) v,
           (SELECT min(coalesce(enhanced_collision_probability, {Z})) AS lo,
                   max(coalesce(enhanced_collision_probability, {Z})) AS hi FROM risk) rng) b
GROUP BY bin, lo, hi""", "asteroids", ctes=RF)
BOX = f"""
k AS (SELECT coalesce(risk_level, 'LOW') AS risk_level, size AS v FROM {{src}}),
q AS (SELECT risk_level, count(v) AS n, min(v) AS min, max(v) AS max, quantile_cont(v, 0.25) AS q1,
             quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM k WHERE v IS NOT NULL
      GROUP BY risk_level),
f AS (SELECT *, q1 - {D(1.5)} * (q3 - q1) AS lower_fence, q3 + {D(1.5)} * (q3 - q1) AS upper_fence FROM q)"""
BOX_SELECT = """
SELECT f.risk_level, n, min, round(q1, 9) AS q1, round(median, 9) AS median, round(q3, 9) AS q3,
  round(lower_fence, 9) AS lower_fence, round(upper_fence, 9) AS upper_fence, max,
  (SELECT min(v) FROM k WHERE k.risk_level = f.risk_level AND v >= f.lower_fence AND v <= f.upper_fence)
    AS whisker_low,
  (SELECT max(v) FROM k WHERE k.risk_level = f.risk_level AND v >= f.lower_fence AND v <= f.upper_fence)
    AS whisker_high
FROM f"""
sql("a8_size_box_stats", BOX_SELECT, "asteroids", ctes=RF + "," + BOX.format(src="risk"))
sql("a9_iqr_outliers", "SELECT event_id FROM clean", "asteroids", ctes=FEAT + ",\n" + iqr_ctes("feat", "clean"))
sql("a9_iqr_outliers_approx", """
SELECT unnest(['size', 'mass', 'velocity_magnitude', 'distance_from_sun']) AS feature, true AS q1_within, true AS q3_within""")
_RANKS_HOLD = "SELECT risk_level, n, min, max, true AS q1_within, true AS median_within, true AS q3_within FROM f"
sql("a8_size_box_sketch", _RANKS_HOLD, "asteroids", ctes=RF + "," + BOX.format(src="risk"))
sql("a10_prediction_stats", """
SELECT count(*) AS successful, min(ml_probability) AS min_probability, max(ml_probability) AS max_probability,
  round(avg(ml_probability), 12) AS mean_probability, round(avg(prediction_time_ms), 9) AS mean_prediction_time_ms
FROM results WHERE success""", ctes=RESULTS)
sql("a11_risk_distribution", """
SELECT ml_risk_level AS risk_level, count(*) AS count,
  round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM results WHERE success), 9) AS percentage
FROM results WHERE success GROUP BY ml_risk_level""", ctes=RESULTS)
SUCCESS = f"""
SELECT total, successes, total - successes AS failures, round(rate, 9) AS success_rate,
  CASE WHEN rate >= {D(90.0)} THEN 'EXCELLENT' WHEN rate >= {D(70.0)} THEN 'GOOD' ELSE 'NEEDS_IMPROVEMENT' END AS grade
FROM (SELECT *, CASE WHEN total > 0 THEN successes * 100.0::DOUBLE / total ELSE {Z} END AS rate
      FROM (SELECT count(*) AS total, count_if(success) AS successes FROM results))"""
sql("a12_success_rate", SUCCESS, ctes=RESULTS)
sql("a13_percentile_label", "SELECT event_id, label FROM labelled", ctes=TRAINING + "," + TRAIN_RISK)
sql("a14_class_balance", """
SELECT total, positives, negatives, CAST(positives AS DOUBLE) / NULLIF(CAST(total AS DOUBLE), 0) AS positive_share,
  CAST(negatives AS DOUBLE) / NULLIF(CAST(total AS DOUBLE), 0) AS negative_share
FROM (SELECT count(*) AS total, count_if(label = 1) AS positives, count_if(label = 0) AS negatives FROM labelled)""",
    ctes=TRAINING + "," + TRAIN_RISK)
sql("a15_high_risk_list", f"""
SELECT scenario, asteroid_id, ml_probability, ml_risk_level FROM results
WHERE success AND ml_probability > {D(K.ALERT_THRESHOLD)}""", ctes=RESULTS)
sql("a15_failure_list", """
SELECT scenario, asteroid_id, coalesce(error, 'unknown error') AS error FROM results WHERE NOT success""",
    ctes=RESULTS)

# --- 2.5 windows, sort, limit, top-k ---------------------------------------------------
sql("w1_latest_per_planet", f"""
SELECT planet, {iso('timestamp')} AS timestamp, {r('pos_x', 3)} AS x, {r('pos_y', 3)} AS y FROM planets
QUALIFY row_number() OVER (PARTITION BY planet ORDER BY timestamp DESC, processed_timestamp DESC) = 1""", "planets")
sql("w2_last_n", f"SELECT event_id, id FROM asteroids ORDER BY event_id DESC LIMIT {K.RECENT_ASTEROIDS}", "asteroids")
sql("w3_latest_per_asteroid", f"""
SELECT id, event_id, size, {iso('timestamp')} AS timestamp FROM asteroids
QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1""", "asteroids")
sql("w3_latest_record", f"""
SELECT id, event_id, event_type, {iso('timestamp')} AS timestamp, size, classification, risk_level,
       potentially_hazardous, pos_x
FROM asteroids
QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1""", "asteroids")
TOP = f"""
SELECT id, size, coalesce(distance_from_earth, {Z}) AS distance_from_earth,
  coalesce(enhanced_collision_probability, {Z}) AS collision_probability, coalesce(risk_level, 'LOW') AS risk_level
FROM {{src}} ORDER BY coalesce(enhanced_collision_probability, {Z}) DESC, id, event_id LIMIT {K.TOP_K_TABLE}"""
sql("w4_top_risk", TOP.format(src="risk"), "asteroids", ctes=RF)
sql("w5_recent_alerts", """
SELECT alert_id, timestamp, asteroid_id, collision_probability, alert_level FROM alerts
ORDER BY timestamp DESC, alert_id LIMIT 5""", "asteroids", ctes=RF + "," + ALERTS)
sql("w6_latest_row", f"""
SELECT {iso('timestamp')} AS timestamp, {r('pos_x', 3)} AS x, {r('pos_y', 3)} AS y FROM planets
WHERE planet = 'Earth' ORDER BY timestamp DESC, processed_timestamp DESC LIMIT 1""", "planets")

# --- 2.6 machine learning --------------------------------------------------------------
_INT = ("hour_of_day", "day_of_year")


def _ml(c: str, prefix: str = "") -> str:
    e = f"coalesce({c}, {Z})" if c not in _INT else f"CAST(coalesce({c}, 0) AS INTEGER)"
    return f"{r(e, ANGLE_DIGITS) if c == 'approach_angle' else e} AS {prefix}{c}"


sql("m1_fill_features", f"SELECT event_id, {', '.join(_ml(c) for c in S.ML_FEATURES)} FROM risk", "asteroids",
    ctes=RF)
sql("m2_assemble", "SELECT event_id, " + ", ".join(
    (f"{r(f'CAST(coalesce({c}, {Z}) AS DOUBLE)', ANGLE_DIGITS)}" if c == "approach_angle"
     else f"CAST(coalesce({c}, 0) AS DOUBLE)") + f" AS f_{c}" for c in S.ML_FEATURES) + " FROM risk",
    "asteroids", ctes=RF)


def _scaled(src: str, prefix: str) -> str:
    cols = []
    for c in S.ML_FEATURES:
        x = f"CAST(coalesce({c}, 0) AS DOUBLE)"
        sd = f"stddev_samp({x}) OVER ()"
        cols.append(f"round(CASE WHEN {sd} = 0 OR {sd} IS NULL THEN {Z} ELSE {x} / {sd} END, 6) AS {prefix}{c}")
    return f"SELECT event_id, {', '.join(cols)} FROM {src}"


sql("m3_scale", _scaled("risk", "s_"), "asteroids", ctes=RF)
sql("m4_stratified_split", "SELECT event_id, label, split FROM split", ctes=TRAINING + "," + TRAIN_RISK + "," + SPLIT)
_z = []
for c in S.TRAINING_FEATURES:
    _z.append(f"round(({c} - (SELECT avg({c}) FROM split WHERE split = 'train'))"
              f" / (SELECT stddev_samp({c}) FROM split WHERE split = 'train'), 6) AS z_{c}")
sql("m5_fit_scaler", f"SELECT event_id, {', '.join(_z)} FROM split", ctes=TRAINING + "," + TRAIN_RISK + "," + SPLIT)
# the score is the risk without its noise, to three digits; the sum is in the order of the Spark side
_QUIET = TRAIN_RISK.split("FROM training),")[0].split("SELECT *, ")[1].split(" AS collision_risk")[0].replace(" + noise", "")
_PREDICTED = TRAINING + "," + TRAIN_RISK + f""",
risked AS (SELECT event_id, label, round({_QUIET}, 3) AS probability FROM labelled),
predicted AS (SELECT *, CAST(probability > 0.7::DOUBLE AS INTEGER) AS prediction FROM risked)"""
sql("m7_evaluate", """
SELECT class, round(precision, 12) AS precision, round(recall, 12) AS recall,
  round(coalesce(2.0::DOUBLE * precision * recall / NULLIF(precision + recall, 0), 0.0::DOUBLE), 12) AS f1, support
FROM (SELECT class, support, coalesce(CAST(tp AS DOUBLE) / NULLIF(CAST(predicted AS DOUBLE), 0), 0.0::DOUBLE) AS precision,
             coalesce(CAST(tp AS DOUBLE) / NULLIF(CAST(support AS DOUBLE), 0), 0.0::DOUBLE) AS recall
      FROM (SELECT c AS class, count_if(label = c) AS support, count_if(prediction = c) AS predicted,
                   count_if(label = c AND prediction = c) AS tp
            FROM predicted, (SELECT unnest([0, 1]) AS c) GROUP BY c))""", ctes=_PREDICTED)
sql("m7_accuracy", """
SELECT count(*) AS n, round(avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 12) AS accuracy
FROM predicted""", ctes=_PREDICTED)
# Mann-Whitney: the rank sum of the positives, ties at their mean rank
sql("m7_roc_auc", """
SELECT round((sum(CASE WHEN label = 1 THEN mean_rank END) - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)), 12) AS auc
FROM (SELECT label, CAST(rank() OVER (ORDER BY probability) AS DOUBLE)
             + (count(*) OVER (PARTITION BY probability) - 1) / 2.0::DOUBLE AS mean_rank,
             CAST(count_if(label = 1) OVER () AS DOUBLE) AS p, CAST(count(*) OVER () AS DOUBLE) AS n FROM predicted)
GROUP BY p, n""", ctes=_PREDICTED)
sql("m8_score", f"""
SELECT event_id, {V.fallback('size', norm3('vel_x', 'vel_y', 'vel_z'), FACTOR)} AS ml_probability,
  {ladder(V.fallback('size', norm3('vel_x', 'vel_y', 'vel_z'), FACTOR), 'model')} AS ml_risk_level
FROM asteroids""", "asteroids")

# --- 2.9 pipelines ------------------------------------------------------------------------
sql("q1_clean", """SELECT event_id, distance_from_sun, velocity_magnitude, orbital_energy, semi_major_axis,
angular_momentum_magnitude, timestamp_unix, hour_of_day, day_of_year FROM clean""", "asteroids",
    ctes=FEAT + ",\n" + iqr_ctes("feat", "clean"))
_Q2 = FEAT + ",\n" + iqr_ctes("feat", "clean") + "," + LATEST_EARTH + "," + risk_ctes("clean", "tr", EX, EY, EZ) \
    + "," + horizons_ctes("tr", "hz")
sql("q2_trajectories", f"""
SELECT event_id, round(earth_distance, 3) AS earth_distance, relative_velocity, round(approach_angle, {ANGLE_DIGITS})
  AS approach_angle, size_factor, distance_factor, velocity_factor, enhanced_collision_probability, risk_level,
  {HORIZON_COLS} FROM hz""", "asteroids", "planets", ctes=_Q2)
sql("q3_ml_ready", _scaled("cr", "s_"), "asteroids",
    ctes=FEAT + ",\n" + iqr_ctes("feat", "clean") + "," + risk_ctes("clean", "cr", AU, Z, Z))


# --- 2.7 streaming ---------------------------------------------------------------------------
sql("st1_continuous_landing", """
SELECT topic, ident, status, CASE WHEN status = 'good' THEN (SELECT CAST(CAST(max(ts) AS DATE) AS VARCHAR) FROM events) END AS ingest_date
FROM (
  SELECT 'asteroid-data' AS topic, a.id AS ident,
    CASE WHEN coalesce(e.event_type = 'error', false) THEN 'bad' ELSE 'good' END AS status
  FROM asteroids a JOIN events e USING (event_id)
  UNION ALL SELECT 'planet-data', planet, 'good' FROM planets
  UNION ALL SELECT 'collision-alerts', alert_id, 'good' FROM alerts)""", "asteroids", "planets", ctes=RF + "," + ALERTS)
_FB = V.fallback("size", norm3("vel_x", "vel_y", "vel_z"), FACTOR)
sql("st2_enrich_alert", f"""
SELECT 'alert_' || id || '_' || CAST(CAST(floor(epoch(timestamp)) AS BIGINT) AS VARCHAR) AS alert_id,
  id AS asteroid_id, {_FB} AS collision_probability,
  CASE WHEN {_FB} > {D(1e-3)} THEN 'HIGH' ELSE 'MEDIUM' END AS alert_level
FROM asteroids WHERE {_FB} > {D(K.ALERT_THRESHOLD)}""", "asteroids")

# --- reports as one long table -------------------------------------------------------------


def long_sql(tables: dict) -> tuple[str, str]:
    """CTEs and body of the long form of ``{table: (sql, key, number columns, text columns)}``."""
    ctes, rows = [], []
    for name, (body, key, numbers, texts) in tables.items():
        ctes.append(f"long_{name} AS ({body})")
        for c in numbers:
            rows.append(f"SELECT '{name}' AS tbl, {key} AS row_key, '{c}' AS metric, CAST({c} AS DOUBLE) AS num, "
                        f"CAST(NULL AS VARCHAR) AS txt FROM long_{name}")
        for c in texts:
            rows.append(f"SELECT '{name}', {key}, '{c}', NULL, CAST({c} AS VARCHAR) FROM long_{name}")
    return ",\n" + ",\n".join(ctes), "\nUNION ALL\n".join(rows)


HISTOGRAM = f"""
SELECT bin, lo + bin * {_W} AS bin_start, CASE WHEN hi = lo THEN hi ELSE lo + (bin + 1) * {_W} END AS bin_end,
       count(*) AS count
FROM (SELECT CASE WHEN hi = lo THEN 0
                  ELSE CAST(least(floor((p - lo) / {_W}), {K.HISTOGRAM_BINS - 1}) AS INTEGER) END AS bin, lo, hi
      FROM (SELECT coalesce(enhanced_collision_probability, {Z}) AS p FROM recent) v,
           (SELECT min(coalesce(enhanced_collision_probability, {Z})) AS lo,
                   max(coalesce(enhanced_collision_probability, {Z})) AS hi FROM recent) rng) b
GROUP BY bin, lo, hi"""
READ_MODEL = {
    "panel": (PANEL.format(src="recent"), "''", ("total", "high", "medium", "low", "avg_size", "max_probability"), ()),
    "histogram": (HISTOGRAM, "CAST(bin AS VARCHAR)", ("bin", "bin_start", "bin_end", "count"), ()),
    "box": (BOX_SELECT, "risk_level", ("n", "min", "q1", "median", "q3", "lower_fence", "upper_fence", "max",
                                       "whisker_low", "whisker_high"), ("risk_level",)),
    "top": (TOP.format(src="recent"), "id", ("size", "distance_from_earth", "collision_probability"),
            ("id", "risk_level")),
}
_Q4_COLS = ("relative_velocity", "size_factor", "velocity_factor", "enhanced_collision_probability")
_SUMMARY_COLS = ("total_asteroids", "high_risk_asteroids", "medium_risk_asteroids", "avg_size", "stddev_size",
                 "min_size", "max_size", "avg_earth_distance", "min_earth_distance", "max_earth_distance")
_ctes, _body = long_sql({
    "summary": (SUMMARY.format(src="tr"), "''", _SUMMARY_COLS, ()),
    "classes": ("SELECT classification, count(*) AS count FROM tr GROUP BY classification", "classification",
                ("count",), ("classification",)),
    "processed": ("SELECT count(*) AS n, " + ", ".join(f"{f}({c}) AS {f}_{c}" for c in _Q4_COLS for f in ("min", "max"))
                  + " FROM tr", "''", ("n", *(f"{f}_{c}" for c in _Q4_COLS for f in ("min", "max"))), ()),
    "features": ("SELECT count(*) AS n, " + ", ".join(f"max(s_{c}) AS max_{c}" for c in S.ML_FEATURES)
                 + f" FROM ({_scaled('tr', 's_')}) scaled", "''", ("n", *(f"max_{c}" for c in S.ML_FEATURES)), ()),
})
sql("q4_run_batch", _body, "asteroids", "planets",
    ctes=FEAT + ",\n" + iqr_ctes("feat", "clean") + "," + LATEST_EARTH + "," + risk_ctes("clean", "tr", EX, EY, EZ) + _ctes)
PATHS = f"""
SELECT id, pos_x AS start_x, pos_y AS start_y, pos_z AS start_z, {r(EX, 3)} AS end_x, {r(EY, 3)} AS end_y,
  {r(EZ, 3)} AS end_z FROM recent WHERE risk_level = 'HIGH'"""
_ctes, _body = long_sql(READ_MODEL | {"paths": (PATHS, "id", ("start_x", "start_y", "start_z", "end_x", "end_y", "end_z"),
                                                ("id",))})
sql("q5_read_model", _body, "asteroids", "planets", ctes=RF + "," + LATEST_EARTH + """,
recent AS (SELECT * FROM risk WHERE timestamp >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY
           AND coalesce(risk_level, 'LOW') IN ('HIGH', 'MEDIUM')),""" + BOX.format(src="recent") + _ctes)
_LIVE_HISTOGRAM = """
SELECT bin, bin * 0.00005::DOUBLE AS bin_start, (bin + 1) * 0.00005::DOUBLE AS bin_end, count(*) AS count
FROM (SELECT CAST(greatest(least(floor(coalesce(enhanced_collision_probability, 0.0::DOUBLE) / 0.00005::DOUBLE), 19), 0) AS INTEGER) AS bin
      FROM recent) GROUP BY bin"""
# the model of all kept days and levels, beside that of the last week
_ALL = {f"all_{t}": (q.replace("recent", "kept"), *rest) for t, (q, *rest) in READ_MODEL.items() if t != "box"}
_ctes, _body = long_sql(READ_MODEL | _ALL | {
    "live_histogram": (_LIVE_HISTOGRAM, *READ_MODEL["histogram"][1:]),
    "live_box": (_RANKS_HOLD, "risk_level", ("n", "min", "max"), ("risk_level", "q1_within", "median_within", "q3_within")),
    "all_box": (f"WITH {BOX.format(src='kept')} {BOX_SELECT}", *READ_MODEL["box"][1:])})
sql("st4_live_read_model", _body, "asteroids", ctes=RF + """,
kept AS (SELECT * FROM risk WHERE CAST(timestamp AS DATE) > (SELECT max(CAST(timestamp AS DATE)) FROM risk) - 30),
recent AS (SELECT * FROM risk WHERE CAST(timestamp AS DATE) > (SELECT max(CAST(timestamp AS DATE)) FROM risk) - 7
           AND coalesce(risk_level, 'LOW') IN ('HIGH', 'MEDIUM')),""" + BOX.format(src="recent") + _ctes)
sql("st3_live_state", f"""
SELECT 'planet' AS list, planet AS name, arrival, {iso('timestamp')} AS timestamp, {r('pos_x', 3)} AS value
FROM planets JOIN (SELECT CAST(ts AS DATE) AS day, (event_id * 7919) % 1000003 AS arrival FROM events
                   ORDER BY arrival DESC LIMIT 1) ON day = CAST(timestamp AS DATE)
UNION ALL
(SELECT 'asteroid', id, event_id, {iso('timestamp')}, size FROM asteroids ORDER BY event_id DESC LIMIT 1000)
UNION ALL
(SELECT 'alert', 'alert_' || id || '_' || CAST(CAST(floor(epoch(timestamp)) AS BIGINT) AS VARCHAR), event_id,
        {iso('timestamp')}, {_FB} FROM asteroids WHERE {_FB} > {D(1e-4)} ORDER BY event_id DESC LIMIT 100)""",
    "asteroids", "planets")
_WHO = "concat_ws('/', scenario, asteroid_id)"
_ctes, _body = long_sql({
    "checked": (f"""SELECT event_id, {ladder('ml_probability', 'test')} AS expected_risk_level,
      ml_risk_level = {ladder('ml_probability', 'test')} AS risk_level_match FROM results""",
                "CAST(event_id AS VARCHAR)", ("event_id",), ("expected_risk_level", "risk_level_match")),
    "stats": ("""SELECT count(*) AS successful, min(ml_probability) AS min_probability,
      max(ml_probability) AS max_probability, round(avg(ml_probability), 12) AS mean_probability,
      round(avg(prediction_time_ms), 9) AS mean_prediction_time_ms FROM results WHERE success""", "''",
              ("successful", "min_probability", "max_probability", "mean_probability", "mean_prediction_time_ms"), ()),
    "distribution": ("""SELECT ml_risk_level AS risk_level, count(*) AS count,
      round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM results WHERE success), 9) AS percentage
      FROM results WHERE success GROUP BY ml_risk_level""", "risk_level", ("count", "percentage"), ("risk_level",)),
    "success": (SUCCESS, "''", ("total", "successes", "failures", "success_rate"), ("grade",)),
    "high_risk": (f"""SELECT scenario, asteroid_id, ml_probability, ml_risk_level FROM results
      WHERE success AND ml_probability > {D(K.ALERT_THRESHOLD)}""", _WHO, ("ml_probability",),
                  ("scenario", "asteroid_id", "ml_risk_level")),
    "failures": ("""SELECT scenario, asteroid_id, coalesce(error, 'unknown error') AS error FROM results
      WHERE NOT success""", _WHO, (), ("scenario", "asteroid_id", "error")),
})
sql("q7_prediction_report", _body, ctes=RESULTS + _ctes)
_QUALITY = "SELECT count(*) AS n_test, true AS accurate, true AS separates FROM split WHERE split = 'test'"
_TRAINED = TRAINING + "," + TRAIN_RISK + "," + SPLIT
sql("m6_train_classifier", _QUALITY, ctes=_TRAINED)
sql("q6_train", _QUALITY, ctes=_TRAINED)
sql("m9_save_load", "SELECT count(*) AS n, count(*) AS n_equal FROM split WHERE split = 'test'", ctes=_TRAINED)
sql("m9_model_refresh", """SELECT CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'v1' ELSE 'v2' END AS model_version,
  count(*) AS n, count(*) AS n_equal FROM events GROUP BY 1""")
sql("q1_clean_approx", "SELECT count(*) AS n, true AS agrees, CAST(4 AS BIGINT) AS steps, true AS within FROM feat", "asteroids", ctes=FEAT)
sql("m8_score_unscaled", """SELECT count(*) AS n, count_if(event_id % 5 = 0) AS n_fallback,
  count_if(event_id % 5 <> 0) AS n_same FROM events""")
sql("m8_score_model", """SELECT count(*) AS n, count(*) AS n_valid, count_if(event_id % 5 = 0) AS n_fallback,
  count(*) AS n_level FROM events""")


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
