"""Physical constants and fixed lookup values.

FIXED VALUES - these must equal the values of the system we reproduce, so that
results agree.  Units: km, s, kg, days.
"""

import math

# --- fixed values -----------------------------------------------------------
AU_KM = 149597870.7                 # one astronomical unit in km
EARTH_RADIUS_KM = 6371.0
GM_SUN = 1.327e11                   # km^3 / s^2
SOI_BATCH_AU = 0.01                 # Earth sphere of influence, batch scoring
SOI_GENERATOR_AU = 0.05             # Earth sphere of influence, heuristic scoring
PHO_DISTANCE_AU = 0.05              # potentially hazardous: closer than this ...
PHO_MIN_SIZE_KM = 0.14              # ... and larger than this
YEAR_DAYS = 365.25
TYPICAL_IMPACT_SPEED = 30.0         # km/s, velocity factor normaliser
PROBABILITY_SCALE = 0.001           # enhanced probability upper bound
ALERT_THRESHOLD = 1e-4
HORIZONS_DAYS = (1, 7, 30, 365)
IQR_FEATURES = ("size", "mass", "velocity_magnitude", "distance_from_sun")
IQR_RELATIVE_ERROR = 0.05
IQR_MULTIPLIER = 1.5
DEFAULT_ASTEROID_SIZE_KM = 1.0
DEFAULT_ASTEROID_MASS_KG = 1e12
ZSCORE_EPSILON = 1e-8
TOP_K_TABLE = 20
HISTOGRAM_BINS = 20
RECENT_ASTEROIDS = 1000
RECENT_ALERTS = 100
RECENT_ALERT_PANEL = 5
PERCENTILE_LABEL = 0.85
SPLIT_SEED = "42"
SPLIT_FRACTIONS = (0.6, 0.2, 0.2)   # train / validation / test

# planet dimension: name, orbital distance in AU, period in days, mass in kg
PLANETS = (
    ("Mercury", 0.39, 88, 3.3011e23),
    ("Venus", 0.72, 225, 4.8675e24),
    ("Earth", 1.0, 365, 5.972e24),
    ("Mars", 1.52, 687, 6.4171e23),
    ("Jupiter", 5.20, 4333, 1.8982e27),
    ("Saturn", 9.54, 10759, 5.6834e26),
)

# risk ladders: ordered (strictly-greater-than threshold, level) pairs + default
RISK_LADDERS = {
    "batch": ((1e-5, "HIGH"), (1e-6, "MEDIUM")), "batch_default": "LOW",
    "generator": ((1e-3, "HIGH"), (1e-4, "MEDIUM"), (1e-5, "LOW"), (1e-6, "VERY_LOW")),
    "generator_default": "SAFE",
    "model": ((1e-3, "HIGH"), (1e-4, "MEDIUM"), (1e-5, "LOW")), "model_default": "MINIMAL",
    "test": ((1e-3, "HIGH"), (1e-4, "MEDIUM"), (1e-5, "LOW")), "test_default": "SAFE",
    "alert": ((1e-3, "HIGH"),), "alert_default": "MEDIUM",
}

# colour per risk level (generator) and map-view marker colour / size
RISK_COLORS = {"HIGH": "red", "MEDIUM": "orange", "LOW": "yellow", "VERY_LOW": "blue", "SAFE": "green"}
MAP_MARKERS = {"HIGH": ("red", 8), "MEDIUM": ("orange", 6)}
MAP_MARKER_DEFAULT = ("green", 4)

# orbit classes by distance from the Sun in AU (strictly less than)
ORBIT_CLASSES = ((1.3, "NEA"), (2.5, "MBA_Inner"), (3.3, "MBA_Outer"))
ORBIT_CLASS_DEFAULT = "Outer"

# training risk score weights: size, velocity, distance, eccentricity, angle
TRAINING_RISK_WEIGHTS = (0.3, 0.25, 0.25, 0.1, 0.1)

# success-rate grades: (minimum percentage, grade)
SUCCESS_GRADES = ((90.0, "EXCELLENT"), (70.0, "GOOD"))
SUCCESS_GRADE_DEFAULT = "NEEDS_IMPROVEMENT"
# --- end of fixed values ----------------------------------------------------

# derived values
EARTH_ORBITAL_SPEED = 2 * math.pi * AU_KM / (YEAR_DAYS * 24 * 3600)   # km/s
DAY_SECONDS = 86400
