"""Zone diagnostics: where models fail, by vegetation and slope band, gradient, basin, isolation and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ndvi_zone(ndvi: Column, limit: Column) -> Column:
    """close (within 0.02 of the limit), near (within 0.05), far."""
    d = F.abs(ndvi - limit)
    return F.when(d <= 0.02, "close").when(d <= 0.05, "near").otherwise("far")


def slope_zone(slope: Column, limit: float = 0.35, margin: float = 0.05) -> Column:
    return F.when(slope < limit - margin, "flat").when(slope > limit + margin, "steep").otherwise("transition")


def wide_models(preds: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """One row per cell and profile with a column per model: an aggregation with partial maxima, no self-join."""
    return preds.groupBy("node_id", "profile").agg(F.max("y").alias("y"), *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(m) for m in models])


def agreement(wide: DataFrame, a: str, b: str, extra: list[str]) -> DataFrame:
    """By profile: disagreement of models a and b, its direction, and means of the extra columns there."""
    differ = F.col(a) != F.col(b)
    return wide.groupBy("profile").agg(
        F.count("*").alias("n"), F.count_if(differ).alias("differ"), (100.0 * F.count_if(differ) / F.count("*")).alias("differ_pct"),
        F.count_if(F.col(a) > F.col(b)).alias("more_restrictive"), F.count_if(F.col(a) < F.col(b)).alias("less_restrictive"),
        *[F.avg(F.when(differ, F.col(c))).alias(f"{c}_there") for c in extra],
    )


def disagreement_profile(wide: DataFrame, a: str, b: str, columns: list[str]) -> DataFrame:
    """Of each feature: mean overall, mean and population deviation where models differ, and the standardised shift."""
    long = wide.select("profile", (F.col(a) != F.col(b)).alias("differ"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["profile", "differ"], columns, "feature", "value")
    there = F.when(F.col("differ"), F.col("value"))
    out = long.groupBy("profile", "feature").agg(F.avg("value").alias("mean_all"), F.stddev_pop("value").alias("std_all"), F.avg(there).alias("mean_differ"), F.stddev_pop(there).alias("std_differ"))
    return out.select("profile", "feature", "mean_all", "mean_differ", "std_differ", ((F.col("mean_differ") - F.col("mean_all")) / (F.col("std_all") + 1e-8)).alias("z"))


def isolated(near: DataFrame, keys: list[str]) -> DataFrame:
    """Cells most of whose neighbours have another class: count, percent and mean discordance by keys."""
    cell = near.groupBy(*keys, "dst").agg(F.count("*").alias("degree"), F.count_if(F.col("y_src") != F.col("y_dst")).alias("other"))
    alone = 2 * F.col("other") > F.col("degree")
    return cell.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(alone).alias("isolated"), (100.0 * F.count_if(alone) / F.count("*")).alias("pct"), F.avg(F.col("other") / F.col("degree")).alias("mean_discordance"))


def basins(near: DataFrame) -> DataFrame:
    """Cells in a hollow (tpi below 0) next to a ridge (tpi above 0)."""
    return near.where((F.col("tpi_dst") < 0) & (F.col("tpi_src") > 0)).select(F.col("dst").alias("node_id")).distinct()


def correlations(labels: DataFrame, cells: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r and r squared of every feature with the class, by profile."""
    joined = labels.join(cells.select("node_id", *[F.col(c).cast("double").alias(c) for c in columns]), "node_id")
    wide = joined.groupBy("profile").agg(*[F.corr(c, F.col("y").cast("double")).alias(c) for c in columns])
    return wide.unpivot(["profile"], columns, "feature", "r").withColumn("r2", F.col("r") * F.col("r"))


def top_features(corr: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy("profile").orderBy(F.abs("r").desc(), "feature")
    return corr.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("profile", "rank", "feature", "r")


def outcome(wide: DataFrame, a: str, b: str) -> DataFrame:
    """1: only a right, 2: both, 3: only b, 4: none; counts by profile, and a's advantage in percent."""
    ra, rb = F.col(a) == F.col("y"), F.col(b) == F.col("y")
    kind = F.when(ra & ~rb, 1).when(ra & rb, 2).when(~ra & rb, 3).otherwise(4)
    out = wide.withColumn("kind", kind).groupBy("profile").agg(*[F.count_if(F.col("kind") == i).alias(f"n{i}") for i in range(1, 5)])
    return out.withColumn("advantage_pct", 100.0 * (F.col("n1") - F.col("n3")) / F.greatest(F.col("n1") + F.col("n2") + F.col("n3") + F.col("n4"), F.lit(1)))


def above_quantile(counts: DataFrame, value: str, count: str, q: float) -> DataFrame:
    """Of the distinct values with their counts: whether each lies above the interpolated q-quantile of all rows.

    Values are ranked inside ranges of a fixed width and the ranges' totals are summed before, so no task sees more than
    one range; both rows around the quantile are found by rank.
    """
    at = F.floor(F.col(value) * 1024)
    ranged = counts.withColumn("range", at)
    totals = ranged.groupBy("range").agg(F.sum(count).alias("of_range"))  # as many rows as ranges have values
    all_before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", F.coalesce(F.sum("of_range").over(all_before), F.lit(0)).alias("before"), F.sum("of_range").over(Window.partitionBy()).alias("n"))
    own = Window.partitionBy("range").orderBy(value)
    ranked = ranged.join(totals, "range").withColumn("upto", F.col("before") + F.sum(count).over(own))
    place = (F.col("n") - 1) * q  # between the rows floor(place) and ceil(place), from 0
    first = F.min(F.when(F.col("upto") > F.floor(place), F.col(value)))
    second = F.min(F.when(F.col("upto") > F.ceil(place), F.col(value)))
    cut = ranked.agg(first.alias("lo"), second.alias("hi"), F.max(place - F.floor(place)).alias("part"))  # one row
    cut = cut.select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("cut"))
    return counts.crossJoin(F.broadcast(cut)).select(value, (F.col(value) > F.col("cut")).alias("above"))


def window_shares(rows: DataFrame, width: int, tile: int, keys: list[str], signs: dict[str, Column]) -> DataFrame:
    """By keys and map window of tile by tile cells: rows, and the percentage for which each sign holds."""
    row, col = F.floor(F.col("node_id") / width), F.col("node_id") % width
    at = [F.floor(row / tile).cast("bigint").alias("window_row"), F.floor(col / tile).cast("bigint").alias("window_col")]
    return rows.groupBy(*keys, *at).agg(F.count("*").alias("n"), *[(100.0 * F.count_if(c) / F.count("*")).alias(f"{name}_pct") for name, c in signs.items()])
