"""Explicit schemas for every record kind (no inference on read)."""

from pyspark.sql import types as T

_D, _S, _B = T.DoubleType(), T.StringType(), T.BooleanType()

POSITION = T.StructType([T.StructField(n, _D) for n in ("x", "y", "z")])
VELOCITY = T.StructType([T.StructField(n, _D) for n in ("vx", "vy", "vz")])


def _fields(*pairs):
    return [T.StructField(n, t) for n, t in pairs]


# batch schema of an asteroid observation
ASTEROID = T.StructType(_fields(
    ("id", _S), ("timestamp", _S), ("position", POSITION), ("velocity", VELOCITY),
    ("size", _D), ("mass", _D), ("density", _D), ("classification", _S),
    ("orbital_period", _D), ("eccentricity", _D), ("potentially_hazardous", _B),
    ("collision_probability", _D), ("processed_timestamp", _S),
))

# landing schema: batch schema plus every field the publisher adds, so a
# schema-driven read keeps them
ASTEROID_LANDING = T.StructType(ASTEROID.fields + _fields(
    ("asteroid_type", _S), ("size_category", _S), ("discovery_date", _S),
    ("enhanced_collision_probability", _D), ("risk_level", _S), ("color", _S),
    ("distance_from_earth", _D),
))

PLANET = T.StructType(_fields(
    ("planet", _S), ("timestamp", _S), ("position", POSITION), ("velocity", VELOCITY),
    ("mass", _D), ("orbital_period", _D), ("processed_timestamp", _S),
))

ALERT = T.StructType(_fields(
    ("alert_id", _S), ("timestamp", _S), ("asteroid_id", _S), ("collision_probability", _D),
    ("alert_level", _S), ("estimated_impact_time", _S), ("asteroid_data", ASTEROID_LANDING),
    ("processed_timestamp", _S),
))

TRAINING_FEATURES = (
    "diameter_km", "velocity_km_s", "distance_earth_au", "mass_kg", "orbital_eccentricity",
    "inclination_deg", "approach_angle", "albedo", "rotation_period_h", "surface_temp_k",
)
TRAINING = T.StructType([T.StructField(n, _D) for n in TRAINING_FEATURES]
                        + [T.StructField("label", T.IntegerType())])

# columns of the batch feature vector, in assembly order
ML_FEATURES = (
    "size", "mass", "density", "velocity_magnitude", "distance_from_sun",
    "distance_from_earth", "orbital_energy", "angular_momentum_magnitude", "eccentricity",
    "relative_velocity", "approach_angle", "hour_of_day", "day_of_year",
)

PREDICTION_RESULT = T.StructType(_fields(
    ("scenario", _S), ("asteroid_id", _S), ("size", _D), ("distance_au", _D),
    ("velocity_magnitude", _D), ("potentially_hazardous", _B), ("ml_probability", _D),
    ("ml_risk_level", _S), ("prediction_time_ms", _D), ("risk_level_match", _B),
    ("success", _B), ("error", _S),
))
