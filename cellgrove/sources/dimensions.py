"""Small dimensions: profiles, classes, rule limits and feature ranges. Each has a fixed number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROFILES = ("a_pe", "motorizada", "mecanizada", "blindada")
MODELS = ("gnn", "rule", "rf", "mlp")
CLASSES = {1: "unrestricted", 2: "restricted", 3: "severely restricted"}

# Slope (degrees) and index thresholds of the full rules, by profile.
LIMITS = (
    ("a_pe", 30.0, 45.0, 1.5, 0.7, 0.85, 0.3, 0.1),
    ("motorizada", 15.0, 30.0, 0.5, 0.5, 0.7, 0.3, 0.15),
    ("mecanizada", 20.0, 35.0, 1.2, 0.6, 0.75, 0.3, 0.12),
    ("blindada", 15.0, 30.0, 1.5, 0.5, 0.7, 0.3, 0.15),
)
LIMIT_COLUMNS = "profile string, slope_1 double, slope_2 double, ford_max double, ndvi_1 double, ndvi_2 double, ndwi_water double, ndwi_wet double"
# Normalised slope and index thresholds of the reduced rules.
BASELINE_LIMITS = (
    ("a_pe", 0.33, 0.5, 0.7),
    ("motorizada", 0.17, 0.33, 0.5),
    ("mecanizada", 0.22, 0.39, 0.6),
    ("blindada", 0.17, 0.33, 0.5),
)
BASELINE_COLUMNS = "profile string, slope_1 double, slope_2 double, ndvi_1 double"
# The range that each feature should keep to.
RANGES = (
    ("elevation_m", -500.0, 9000.0),
    ("slope", 0.0, 1.0),
    ("tpi", -5.0, 5.0),
    ("tri", 0.0, 5.0),
    ("ndvi", -1.0, 1.0),
    ("ndwi", -1.0, 1.0),
    ("water_mask", 0.0, 1.0),
    ("lidar_available", 0.0, 1.0),
)


def limits(spark: SparkSession, rows=LIMITS) -> DataFrame:
    """Thresholds of the full rules; a profile without its slope and index limits is refused."""
    for row in rows:
        if len(row) != 8 or any(row[i] is None for i in (0, 1, 2, 4, 6)):
            raise ValueError(f"limits of {row[0]!r} are incomplete")
    return spark.createDataFrame(list(rows), LIMIT_COLUMNS)


def baseline_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BASELINE_LIMITS), BASELINE_COLUMNS)


def all_limits(spark: SparkSession, orders: dict[str, str]) -> DataFrame:
    """One row a profile, nothing null: the full limits, the baseline's as base_<name>, and first, second and third, places of abg in its order."""
    base = {row[0]: row[1:] for row in BASELINE_LIMITS}
    rows = [(*row, *base[row[0]], *("abg".index(x) for x in orders[row[0]])) for row in LIMITS]
    names = [*LIMIT_COLUMNS.split(", "), *[f"base_{c}" for c in BASELINE_COLUMNS.split(", ")[1:]], "first int", "second int", "third int"]
    return spark.createDataFrame(rows, ", ".join(f"{c} NOT NULL" for c in names))


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLASSES.items()), "y int, description string")


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PROFILES], "profile string")


def ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RANGES), "feature string, low double, high double")
