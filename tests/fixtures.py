"""Fixed records used by the tests (named scenarios, smoke record, edge rows)."""

import math

from pyspark.sql import DataFrame, SparkSession

from neo import schemas as S

AU = 149597870.7

# FIXED VALUES: the eight named scenarios (position in AU, velocity, size km,
# density kg/m3, hazardous flag as given)
SCENARIOS = [
    ("high_risk_near_earth", (0.95, 0.1, 0.05), (-25000, 15000, 5000), 2.5, 3500, True),
    ("medium_risk_crossing", (1.1, 0.3, 0.1), (-20000, 10000, 2000), 1.2, 2800, True),
    ("low_risk_distant", (2.5, 1.8, 0.2), (-15000, 12000, 1000), 0.3, 2000, False),
    ("very_high_risk_impact", (1.0001, 0.001, 0.0001), (-30000, -5000, -1000), 5.0, 5000, True),
    ("safe_outer_belt", (4.2, 3.1, 0.5), (-8000, 6000, 500), 0.8, 1800, False),
    ("jupiter_trojan", (5.2, 0.8, 0.1), (-10000, 8000, 200), 1.5, 2200, False),
    ("fast_small_neo", (0.98, 0.2, 0.03), (-35000, 20000, 8000), 0.15, 4000, True),
    ("slow_large_mba", (2.8, 1.5, 0.3), (-12000, 8000, 1500), 8.0, 2500, False),
]


def mass_of(size, density):
    return density * ((4 / 3) * math.pi * (size * 500) ** 3)


def scenario_rows():
    rows = []
    for i, (name, p, v, size, dens, haz) in enumerate(SCENARIOS):
        rows.append(dict(
            id=f"test_asteroid_{name}", timestamp=f"2024-01-0{1 + i % 9}T10:00:00.000000",
            position=dict(x=p[0] * AU, y=p[1] * AU, z=p[2] * AU), velocity=dict(vx=float(v[0]), vy=float(v[1]), vz=float(v[2])),
            size=size, mass=mass_of(size, dens), density=float(dens), classification="NEA", orbital_period=365.25,
            eccentricity=0.15, potentially_hazardous=haz, collision_probability=None, processed_timestamp=None,
            asteroid_type="near_earth", size_category="medium", discovery_date=None,
            enhanced_collision_probability=None, risk_level=None, color=None, distance_from_earth=None))
    return rows


def scenarios_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(scenario_rows(), S.ASTEROID_LANDING)


def asteroid_df(spark: SparkSession, rows) -> DataFrame:
    """Landing-schema rows from partial dicts (missing keys are null)."""
    names = [f.name for f in S.ASTEROID_LANDING.fields]
    return spark.createDataFrame([{n: r.get(n) for n in names} for r in rows], S.ASTEROID_LANDING)
