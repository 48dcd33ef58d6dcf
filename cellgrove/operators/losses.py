"""Training losses as aggregates, and one attention layer, over tables of probabilities and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.functions.scalar import leaky_relu, relu


def rule_penalties(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Mean probability of Go on steep, dense and wet cells, weighted by the excess; by profile."""
    joined = rows.join(F.broadcast(limits.select("profile", F.col("ndvi_1").alias("limit"))), "profile")  # four rows
    water = F.when((F.col("ndwi") > 0.3) | (F.col("water_mask") > 0.5), 1.0).otherwise(0.0)
    return joined.groupBy("profile").agg(F.avg(F.col("p1") * relu(F.col("slope") - 0.35)).alias("slope"), F.avg(F.col("p1") * relu(F.col("ndvi") - F.col("limit"))).alias("vegetation"), F.avg(F.col("p1") * water).alias("water"))


def _true_probability():
    return F.when(F.col("y") == 1, F.col("p1")).when(F.col("y") == 2, F.col("p2")).otherwise(F.col("p3"))


def smoothed_cross_entropy(smoothing: float):
    """Cross entropy of a row with its label smoothed over the three classes."""
    every = F.ln("p1") + F.ln("p2") + F.ln("p3")
    return -(1 - smoothing) * F.ln(_true_probability()) - smoothing / 3 * every


def cross_entropy(rows: DataFrame, smoothing: float = 0.1) -> DataFrame:
    return rows.groupBy("profile").agg(F.avg(smoothed_cross_entropy(smoothing)).alias("loss"))


def focal(rows: DataFrame, gamma: float = 2.0, smoothing: float = 0.05) -> DataFrame:
    ce = smoothed_cross_entropy(smoothing)
    return rows.groupBy("profile").agg(F.avg(F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce).alias("loss"))


def task_weighting(losses: DataFrame, log_variances: DataFrame) -> DataFrame:
    """Sum over tasks of exp(-s) L + s: a few rows."""
    return losses.join(F.broadcast(log_variances), "profile").agg(F.sum(F.exp(-F.col("s")) * F.col("loss") + F.col("s")).alias("total"))


def attention(near: DataFrame, source: str, target: str, a: float, b: float) -> DataFrame:
    """One-head attention: scores leaky_relu(a x_src + b x_dst), softmax over each cell's edges, weighted mean.

    The softmax needs the largest score of a cell first; both sums are partial aggregates on one key.
    """
    e = near.select("dst", F.col(source).cast("double").alias("x"), leaky_relu(a * F.col(source) + b * F.col(target)).alias("e"))
    top = e.groupBy("dst").agg(F.max("e").alias("top"))
    w = F.exp(F.col("e") - F.col("top"))
    return e.join(top, "dst").groupBy(F.col("dst").alias("node_id")).agg((F.sum(w * F.col("x")) / F.sum(w)).alias("h"))
