"""Predictive entropy: transition zones, reconnaissance classes, confidence of right and wrong predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.functions import scalar as S


def with_entropy(probs: DataFrame, kind: str = "normalized") -> DataFrame:
    """Adds entropy: raw, normalized, log2, or normalized_d (a smaller epsilon)."""
    p = [F.col(c) for c in ("p1", "p2", "p3")]
    forms = {"raw": S.entropy_raw(p), "normalized": S.entropy_normalized(p), "log2": S.entropy_log2(p), "normalized_d": S.entropy_normalized(p, 1e-9)}
    return probs.withColumn("entropy", forms[kind])


def summary(df: DataFrame, threshold: float) -> DataFrame:
    """Mean, median, 95th percentile, maximum of the entropy by profile, and the share from the threshold on."""
    q = F.percentile("entropy", F.array(F.lit(0.5), F.lit(0.95)))
    return df.groupBy("profile").agg(F.avg("entropy").alias("mean"), q.alias("q"), F.max("entropy").alias("top"), F.avg(F.when(F.col("entropy") >= threshold, 1.0).otherwise(0.0)).alias("share")).select("profile", "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), "top", "share")


def quantile_zone(df: DataFrame, q: float = 0.85) -> DataFrame:
    """Adds in_zone: entropy at or above the profile's q-quantile, which is computed once and broadcast."""
    cut = df.groupBy("profile").agg(F.percentile("entropy", q).alias("threshold"))  # one row per profile
    return df.join(F.broadcast(cut), "profile").withColumn("in_zone", F.col("entropy") >= F.col("threshold"))


def reclassify(df: DataFrame, threshold: float) -> DataFrame:
    """pred3 (argmax) and pred4 (with the reconnaissance class)."""
    p3 = S.first_argmax([F.col("p1"), F.col("p2"), F.col("p3")])
    return df.withColumn("pred3", p3).withColumn("pred4", S.transition_class(F.col("entropy"), F.col("pred3"), threshold))


def confidence(df: DataFrame, high: float = 0.8) -> DataFrame:
    """Mean top probability of right and of wrong predictions, and the share of wrong ones above high."""
    top = F.greatest("p1", "p2", "p3")
    right = F.col("pred3") == F.col("y")
    return df.groupBy("profile").agg(
        F.count_if(right).alias("right"), F.count_if(~right).alias("wrong"), F.avg(F.when(right, top)).alias("confidence_right"), F.avg(F.when(~right, top)).alias("confidence_wrong"),
        (100.0 * F.count_if(~right & (top > high)) / F.nullif(F.count_if(~right), F.lit(0))).alias("sure_wrong_pct"),
    )


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins of [low, high); the last bin is closed."""
    b = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).between(low, high)).groupBy("profile", b.alias("bin")).agg(F.count("*").alias("n"))


def density(df: DataFrame, x: str, y: str, nx: int, ny: int, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Counts in rectangular bins of two columns."""
    def at(c: str, lo: float, hi: float, n: int):
        return F.least(F.floor((F.col(c) - lo) / ((hi - lo) / n)), F.lit(n - 1)).cast("int")

    return df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1)).groupBy(at(x, x0, x1, nx).alias("bx"), at(y, y0, y1, ny).alias("by")).agg(F.count("*").alias("n"))
