"""Scalar column functions of the terrain analyses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def above(x: Column, limit: Column | float) -> Column:
    """x > limit as IEEE has it: NaN exceeds nothing (Spark orders NaN above every number); null counts as no."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return F.coalesce(~F.isnan(x) & (x > limit), F.lit(False))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


#: terms of erf's series and the end beyond which it is 1 in double precision
ERF_TERMS, ERF_END = 110, 6.0


def erf(x: Column) -> Column:
    """The error function: 2 x exp(-x^2) / sqrt(pi) times the sum of (2 x^2)^n / (2n + 1)!!, within 1e-14 of the true value.

    All terms have one sign, so no digits are lost; the sum is nested, from the last term inwards.
    """
    z = clip(x, -ERF_END, ERF_END)
    t, s = 2.0 * z * z, F.lit(1.0)
    for n in range(ERF_TERMS, 0, -1):
        s = 1.0 + t / float(2 * n + 1) * s
    return 2 / math.sqrt(math.pi) * z * F.exp(-z * z) * s


def gelu(x: Column) -> Column:
    """x times the normal distribution function of x."""
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2)))


def sanitize(x: Column) -> Column:
    """NaN and infinities become 0; null stays null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits)
    e = [F.exp(x - top) for x in logits]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def first_argmax(values: list[Column]) -> Column:
    """1-based position of the largest value; of equal ones the first."""
    return F.array_position(F.array(*values), F.greatest(*values)).cast("int")


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) within [-1, 1]; null where the sum is 0."""
    return clip(F.try_divide(a - b, a + b), -1.0, 1.0)


def entropy_raw(p: list[Column], eps: float = 1e-8) -> Column:
    """-sum p ln(p + eps), in nats."""
    return sum((-x * F.ln(x + eps) for x in p[1:]), -p[0] * F.ln(p[0] + eps))


def entropy_normalized(p: list[Column], eps: float = 1e-8) -> Column:
    """entropy_raw over ln of the number of classes."""
    return entropy_raw(p, eps) / math.log(len(p))


def entropy_log2(p: list[Column], floor: float = 1e-10) -> Column:
    """Base-2 entropy of probabilities cut off below floor, over log2 of the number of classes."""
    q = [F.greatest(x, F.lit(floor)) for x in p]
    return sum((-x * F.log2(x) for x in q[1:]), -q[0] * F.log2(q[0])) / math.log2(len(p))


def transition_class(entropy: Column, predicted: Column, threshold: float) -> Column:
    """Four classes: 3 (reconnaissance) from the threshold on, else Go 1, Slow-Go 2, No-Go 4."""
    return F.when(entropy >= threshold, 3).when(predicted == 3, 4).otherwise(predicted).cast("int")


def half_window(scale: float, width_in: float, height_in: float, latitude: float) -> tuple[float, float]:
    """Half extents in degrees (lon, lat) of a map window of a scale and a paper size in inches."""
    meters = 111_320.0
    return round(scale * width_in * 0.0254 / (meters * math.cos(math.radians(latitude))) / 2, 6), round(scale * height_in * 0.0254 / meters / 2, 6)


def half_windows(scale: float, width_in: float, height_in: float, latitude: Column) -> tuple[Column, Column]:
    """half_window around a column of latitudes, not rounded."""
    meters = 111_320.0
    return scale * width_in * 0.0254 / (meters * F.cos(F.radians(latitude))) / 2, F.lit(scale * height_in * 0.0254 / meters / 2)


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Of two arrays of doubles; null if their lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
