"""Threshold rules: class 1 (Go), 2 (Slow-Go), 3 (No-Go) of a cell for each vehicle profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.functions.scalar import above, clip


def full_class(limit: dict[str, Column] | None = None) -> Column:
    """Of a row with a cell's columns the most severe test that it meets; limits are columns of the row or given by name."""
    lim = limit or {c: F.col(c) for c in ("slope_1", "slope_2", "ndvi_1", "ndvi_2", "ndwi_water", "ndwi_wet")}
    degrees = F.col("slope") * 90.0
    severe = above(degrees, lim["slope_2"]) | above(F.col("ndwi"), lim["ndwi_water"]) | above(F.col("water_mask").cast("double"), 0.5) | above(F.col("ndvi"), lim["ndvi_2"])
    slow = above(degrees, lim["slope_1"]) | above(F.col("ndvi"), lim["ndvi_1"]) | above(F.col("ndwi"), lim["ndwi_wet"])
    return F.when(severe, 3).when(slow, 2).otherwise(1)


def baseline_class() -> Column:
    """The reduced rules on normalised slope; no test for very dense vegetation or wet soil."""
    steep = above(F.col("slope"), F.col("slope_2"))
    severe = steep | above(F.col("ndwi"), 0.3) | above(F.col("water_mask").cast("double"), 0.5)
    return F.when(severe, 3).when(above(F.col("slope"), F.col("slope_1")) | above(F.col("ndvi"), F.col("ndvi_1")), 2).otherwise(1)


LOWEST = float("-inf")


def cleaned(cells: DataFrame, keep: list[str]) -> DataFrame:
    """What the rules compare, once a cell: degrees, slope, ndvi, ndwi (NaN and null as the lowest value, which exceeds nothing) and wet; and other columns."""
    def number(c: Column) -> Column:
        return F.coalesce(F.nanvl(c, F.lit(LOWEST)), F.lit(LOWEST))

    wet = F.coalesce(F.col("water_mask").cast("double") > 0.5, F.lit(False))
    return cells.select(*keep, number(F.col("slope") * 90.0).alias("degrees"), *[number(F.col(c)).alias(c) for c in ("slope", "ndvi", "ndwi")], wet.alias("wet"))


def class_of_cleaned() -> Column:
    """full_class of a row of cleaned cells and limits."""
    severe = F.col("wet") | (F.col("degrees") > F.col("slope_2")) | (F.col("ndwi") > F.col("ndwi_water")) | (F.col("ndvi") > F.col("ndvi_2"))
    slow = (F.col("degrees") > F.col("slope_1")) | (F.col("ndvi") > F.col("ndvi_1")) | (F.col("ndwi") > F.col("ndwi_wet"))
    return F.when(severe, 3).when(slow, 2).otherwise(1)


def baseline_of_cleaned() -> Column:
    """baseline_class of a row of cleaned cells and baseline limits, which are named base_."""
    severe = F.col("wet") | (F.col("slope") > F.col("base_slope_2")) | (F.col("ndwi") > 0.3)
    return F.when(severe, 3).when((F.col("slope") > F.col("base_slope_1")) | (F.col("ndvi") > F.col("base_ndvi_1")), 2).otherwise(1)


def classify(cells: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per cell and profile with its class y; limits is a dimension of one row per profile."""
    return cells.crossJoin(F.broadcast(limits)).withColumn("y", full_class())


def class_columns(cells: DataFrame, limits: tuple) -> DataFrame:
    """The classes of all profiles as one column each (rows of limits start with the profile's name): no row is multiplied."""
    from cellgrove.sources.dimensions import LIMIT_COLUMNS

    names = [c.split()[0] for c in LIMIT_COLUMNS.split(", ")]
    return cells.withColumns({row[0]: full_class(dict(zip(names[1:], map(F.lit, row[1:]), strict=True))) for row in limits})


def classify_baseline(cells: DataFrame, limits: DataFrame) -> DataFrame:
    return cells.crossJoin(F.broadcast(limits)).withColumn("y", baseline_class())


def movement_indicators(cells: DataFrame) -> DataFrame:
    """0/1 columns steep, very_steep, dense, water, rugged."""
    def flag(c: Column) -> Column:
        return F.when(c, 1.0).otherwise(0.0)

    degrees = F.col("slope") * 90.0
    return cells.withColumns({
        "steep": flag(above(degrees, 30.0)),
        "very_steep": flag(above(degrees, 45.0)),
        "dense": flag(above(F.col("ndvi"), 0.5)),
        "water": flag(above(F.col("ndwi"), 0.3) | above(F.col("water_mask").cast("double"), 0.5)),
        "rugged": flag(above(F.col("tri"), 0.5)),
    })


def difficulty(cells: DataFrame) -> DataFrame:
    """difficulty: 0.4 slope + 0.2 vegetation + 0.2 water + 0.2 ruggedness, each within 0 and 1."""
    index = 0.4 * clip(F.col("slope"), 0.0, 1.0) + 0.2 * F.col("dense") + 0.2 * F.col("water") + 0.2 * (clip(F.col("tri"), -1.0, 1.0) + 1) / 2
    return movement_indicators(cells).withColumn("difficulty", index)
