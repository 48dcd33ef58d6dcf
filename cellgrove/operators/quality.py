"""Feature and label validation. Checks are rows: check, passed, level, message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, value) with the columns as doubles."""
    wide = df.select(*(keys or []), *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(keys or [], columns, "feature", "value")


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """minimum, maximum, mean and sample deviation of every column."""
    return unpivot(df, columns).groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls, NaN, infinities, share of zeros, distinct values, and statistics over finite values."""
    v, finite = F.col("value"), ~F.isnan("value") & (F.abs("value") != float("inf"))
    fin = F.when(finite, v)
    return unpivot(df, columns).groupBy("feature").agg(
        F.count("*").alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_if(F.isnan(v)).alias("nans"), F.count_if(F.abs(v) == float("inf")).alias("infs"),
        F.min(fin).alias("low"), F.max(fin).alias("high"), F.avg(fin).alias("mean"), F.stddev_samp(fin).alias("std"), (100.0 * F.count_if(v == 0) / F.count("*")).alias("zero_pct"),
    )


def range_checks(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """One check per feature: its values within the expected range; ranges is a small dimension."""
    names = [r["feature"] for r in ranges.collect()]
    stats = unpivot(df, names).groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return stats.join(F.broadcast(ranges), "feature").select("feature", "lo", "hi", ((F.col("lo") >= F.col("low")) & (F.col("hi") <= F.col("high"))).alias("passed"))


def graph_checks(edges: DataFrame, nodes: int, expected: float, tolerance: float) -> DataFrame:
    """Ends within the node ids, and the mean degree within tolerance of what is expected."""
    one = edges.agg(F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high"), (F.count("*") / F.lit(nodes)).alias("degree"))
    checks = F.array(
        F.struct(F.lit("ids_not_negative").alias("check"), (F.col("low") >= 0).alias("passed"), F.col("low").cast("double").alias("value")),
        F.struct(F.lit("ids_below_n").alias("check"), (F.col("high") < nodes).alias("passed"), F.col("high").cast("double").alias("value")),
        F.struct(F.lit("mean_degree").alias("check"), (F.abs(F.col("degree") - expected) <= tolerance).alias("passed"), F.col("degree").alias("value")),
    )
    return one.select(F.inline(checks))


def class_distribution(labels: DataFrame, profiles: DataFrame, classes: DataFrame) -> DataFrame:
    """Count and percent of every class of every profile, zeros included."""
    counts = labels.groupBy("profile", "y").agg(F.count("*").alias("n"))
    total = counts.groupBy("profile").agg(F.sum("n").alias("total"))
    dense = profiles.crossJoin(classes.select("y"))  # profiles x classes: twelve rows
    out = dense.join(counts, ["profile", "y"], "left").join(total, "profile", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("profile", "y", n.alias("n"), F.coalesce(100.0 * n / F.col("total"), F.lit(0.0)).alias("pct"))


def class_weights(distribution: DataFrame) -> DataFrame:
    """N / (3 n) for each class, 1 where it is empty."""
    total = distribution.groupBy("profile").agg(F.sum("n").alias("total"))
    return distribution.join(total, "profile").select("profile", "y", F.when(F.col("n") == 0, 1.0).otherwise(F.col("total") / (3 * F.col("n"))).alias("weight"))


def label_checks(labels: DataFrame) -> DataFrame:
    """Values within 1..3, by profile: the one label check whose failure is an error."""
    return labels.groupBy("profile").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.countDistinct("y").alias("kinds")).select("profile", "low", "high", "kinds", ((F.col("low") >= 1) & (F.col("high") <= 3)).alias("passed"))


def bounds_checks(distribution: DataFrame, low: float = 1.0, high: float = 95.0) -> DataFrame:
    """Classes that are rarer or more frequent than the bounds (percent) are flagged as warnings."""
    return distribution.select("profile", "y", "pct", F.when(F.col("pct") < low, "rare").when(F.col("pct") > high, "dominant").otherwise("ok").alias("level"))


def consistency(labels: DataFrame, easy: str = "a_pe", hard: str = "motorizada") -> DataFrame:
    """Percent of cells where the profile that should move more easily has the worse class."""
    wide = labels.where(F.col("profile").isin(easy, hard)).groupBy("node_id").agg(F.max(F.when(F.col("profile") == easy, F.col("y"))).alias("a"), F.max(F.when(F.col("profile") == hard, F.col("y"))).alias("b"))
    return wide.agg(F.count("*").alias("n"), F.count_if(F.col("a") > F.col("b")).alias("worse"), (100.0 * F.count_if(F.col("a") > F.col("b")) / F.count("*")).alias("pct"))


def missing_classes(labels: DataFrame, profiles: DataFrame, classes: DataFrame) -> DataFrame:
    return profiles.crossJoin(classes.select("y")).join(labels.select("profile", "y").distinct(), ["profile", "y"], "left_anti")


def coherence(near: DataFrame) -> DataFrame:
    """Share of edges whose ends have one class, by profile; near has y_src and y_dst."""
    return near.groupBy("profile").agg(F.count("*").alias("edges"), F.avg(F.when(F.col("y_src") == F.col("y_dst"), 1.0).otherwise(0.0)).alias("coherence"))


def roll_up(checks: list[DataFrame]) -> DataFrame:
    """passed, total and the success rate of tables with a passed column; 0 without checks."""
    every = reduce(DataFrame.union, [c.select("passed") for c in checks])
    return every.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), F.coalesce(F.try_divide(100.0 * F.count_if("passed"), F.count("*")), F.lit(0.0)).alias("success_rate"))


def schema_check(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """A row for each required column: whether the table has it with that type. Only the schema is read."""
    have = dict(df.dtypes)
    return df.sparkSession.createDataFrame([(c, t, have.get(c) == t) for c, t in required.items()], "column string, type string, passed boolean")


def require_schema(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """df itself; an error that names the columns if some are missing or of another type."""
    have = dict(df.dtypes)
    bad = sorted(c for c, t in required.items() if have.get(c) != t)
    if bad:
        raise ValueError(f"columns {bad} are missing or of another type")
    return df


def label_cardinality(cells: DataFrame, labels: DataFrame, profiles: DataFrame) -> DataFrame:
    """By profile: cells with a label, cells without, labels of unknown cells, and labels beyond the first of a cell."""
    each = labels.groupBy("profile", "node_id").agg(F.count("*").alias("k"))
    known = cells.select("node_id", F.lit(1).alias("known"))
    per = each.join(known, "node_id", "left").groupBy("profile").agg(F.count("known").alias("labelled"), F.count_if(F.col("known").isNull()).alias("unknown"), F.sum(F.col("k") - 1).alias("repeated"))
    n = cells.agg(F.count("*").alias("n"))  # one row
    out = profiles.crossJoin(F.broadcast(n)).join(per, "profile", "left").select("profile", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("labelled", "unknown", "repeated")], "n")
    missing = F.col("n") - F.col("labelled")
    return out.select("profile", "labelled", missing.alias("missing"), "unknown", "repeated", ((missing == 0) & (F.col("unknown") == 0) & (F.col("repeated") == 0)).alias("passed"))
