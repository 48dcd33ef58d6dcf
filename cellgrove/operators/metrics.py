"""Model evaluation from a confusion cube: counts by keys, truth y and prediction pred.

The cube is the one heavy aggregation (with partial sums before the shuffle); every score is arithmetic on
its few rows. Scores average over the classes that occur in truth or prediction of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = (1, 2, 3)


def cube(preds: DataFrame, keys: list[str]) -> DataFrame:
    return preds.groupBy(*keys, "y", "pred").agg(F.count("*").alias("n"))


def cube_of_models(wide: DataFrame, keys: list[str], models: tuple[str, ...]) -> DataFrame:
    """The cube by keys, model among them, from a column of predictions for each model.

    Rows are counted by all models' classes at once (a few hundred combinations for each of the other keys) and only the
    counts are spread over the models.
    """
    others = [k for k in keys if k != "model"]
    counted = wide.groupBy(*others, "y", *models).agg(F.count("*").alias("n"))
    spread = counted.select(*others, "y", "n", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in models])))
    return spread.groupBy(*keys, "y", "pred").agg(F.sum("n").alias("n"))


def dense_confusion(cube: DataFrame, keys: list[str]) -> DataFrame:
    """All nine cells of each group's matrix, zeros included."""
    one = cube.groupBy(*keys).agg(*[F.sum(F.when((F.col("y") == a) & (F.col("pred") == b), F.col("n")).otherwise(0)).alias(f"n{a}{b}") for a in CLASSES for b in CLASSES])
    cells = F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("pred"), F.col(f"n{a}{b}").alias("n")) for a in CLASSES for b in CLASSES])
    return one.select(*keys, F.inline(cells))


def _counts(cube: DataFrame, keys: list[str]) -> DataFrame:
    """t: hits, s: support, q: predicted, of each class; n in all."""
    def total(c: Column) -> Column:
        return F.sum(F.when(c, F.col("n")).otherwise(0))

    parts = [F.sum("n").alias("n")]
    for c in CLASSES:
        y, p = F.col("y") == c, F.col("pred") == c
        parts += [total(y & p).alias(f"t{c}"), total(y).alias(f"s{c}"), total(p).alias(f"q{c}")]
    return cube.groupBy(*keys).agg(*parts)


def _add(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def scores(cube: DataFrame, keys: list[str]) -> DataFrame:
    """n, accuracy, macro_f1 and weighted_f1 of each group."""
    f1 = [F.when(F.col(f"s{c}") + F.col(f"q{c}") > 0, 2.0 * F.col(f"t{c}") / (F.col(f"s{c}") + F.col(f"q{c}"))).otherwise(0.0) for c in CLASSES]
    present = _add([F.when(F.col(f"s{c}") + F.col(f"q{c}") > 0, 1).otherwise(0) for c in CLASSES])
    hits, support = _add([F.col(f"t{c}") for c in CLASSES]), _add([F.col(f"s{c}") for c in CLASSES])
    return _counts(cube, keys).select(*keys, "n", (hits / F.col("n")).alias("accuracy"), (_add(f1) / present).alias("macro_f1"), (_add([x * F.col(f"s{c}") for x, c in zip(f1, CLASSES, strict=True)]) / support).alias("weighted_f1"))


def per_class(cube: DataFrame, keys: list[str], eps: float = 1e-9) -> DataFrame:
    """precision, recall and f1 of every class of each group."""
    t, s, q = F.col("t"), F.col("s"), F.col("q")
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"t{c}").alias("t"), F.col(f"s{c}").alias("s"), F.col(f"q{c}").alias("q")) for c in CLASSES])
    flat = _counts(cube, keys).select(*keys, F.inline(rows))
    both = flat.withColumns({"precision": F.when(q > 0, t / (q + eps)).otherwise(0.0), "recall": F.when(s > 0, t / (s + eps)).otherwise(0.0)})
    total = F.col("precision") + F.col("recall")
    return both.select(*keys, "class", "precision", "recall", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / (total + eps)).otherwise(0.0).alias("f1"))


def asymmetric(cube: DataFrame, keys: list[str]) -> DataFrame:
    """Dangerous (predicted Go where it is not) and conservative (not Go where it is) errors, and underestimates."""
    def total(c: Column) -> Column:
        return F.sum(F.when(c, F.col("n")).otherwise(0))

    y, p = F.col("y"), F.col("pred")
    out = cube.groupBy(*keys).agg(F.sum("n").alias("n"), total((p == 1) & (y > 1)).alias("dangerous"), total((p > 1) & (y == 1)).alias("conservative"), total(p < y).alias("under"), total(p > y).alias("over"))
    return out.withColumns({"dangerous_pct": 100.0 * F.col("dangerous") / F.col("n"), "conservative_pct": 100.0 * F.col("conservative") / F.col("n"), "ratio": F.col("dangerous") / (F.col("conservative") + 1e-8)})


def pivot_models(scored: DataFrame, models: tuple[str, ...], value: str = "macro_f1") -> DataFrame:
    """One row per profile, one column per model."""
    return scored.groupBy("profile").pivot("model", list(models)).agg(F.first(value))


def valid(preds: DataFrame, classes: int = 3) -> DataFrame:
    """Rows that may be scored: a class of 1 to classes, in the covered area."""
    return preds.where(F.col("y").between(1, classes) & F.col("covered"))
