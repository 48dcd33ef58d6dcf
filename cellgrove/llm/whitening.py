"""Embedding whitening: covariance from one aggregation of generated SQL expressions, decomposed by LAPACK.

Each component of a vector becomes a whole number, floor(256 c). The fit list holds each distinct vector of such numbers
once. Its means come from one aggregation; a second one sums the centred products of every pair of dimensions in the
upper triangle, each as a SQL expression: a vector takes part once for every pair of tiles of ``TILE`` dimensions, with a
column for each pair of dimensions there, so the aggregation has few enough columns to be compiled whatever the vectors'
length. The covariance, of the size of dimensions squared, is decomposed on the driver; rows are then projected by
expressions again. Covariances of what was whitened come from the data, as another aggregation.

Vectors that are null or hold null or non-finite entries are left out, and so are vectors of another length than the commonest
one (of equally common ones the longest) and empty ones. Repeated rows are rows of their own; equal vectors are fitted once. ``deviation``
is null where it does not fit into a long. Components whose variance is 0 (within rounding) have no whitened values: null; ``explained`` is
null where all vectors are equal, and ``identity_error`` if no component has a variance. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cellgrove.llm.common import col, stage

#: dimensions of a tile: Spark compiles aggregations of up to 100 columns, so at most 9
TILE = 8
SCALE = 256


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, the components as whole numbers, of the rows that take part."""
    c = F.col("c")
    rows = vectors.select(col(id_col).alias("vec_id"), col(vector_col).cast("array<double>").alias("c"))
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(c.isNotNull() & finite).select("vec_id", F.transform(c, lambda v: F.floor(v * SCALE) + F.lit(0).cast("long")).alias("x"))


def _literals(values: np.ndarray) -> str:
    return f"array({', '.join(repr(float(v)) + 'D' for v in values)})"


def covariance(fit: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """The covariance (divisor n) of fit's vectors x about a mean: a sum of centred products for every dimension pair of the upper triangle."""
    dim = len(mean)
    tiles = [(lo, min(lo + TILE, dim)) for lo in range(0, dim, TILE)]
    # each row once for every pair of tiles, with its centred components there; beyond a short last tile they are null, which sums skip
    pairs = ", ".join(f"named_struct('a', {a}, 'b', {b})" for a in range(len(tiles)) for b in range(a, len(tiles)))
    centred = fit.selectExpr(f"zip_with(x, {_literals(mean)}, (v, m) -> v - m) AS d").selectExpr("d", f"explode(array({pairs})) AS p")
    sides = [f"get(d, p.{side} * {TILE} + {i}) AS {name}{i}" for side, name in (("a", "u"), ("b", "v")) for i in range(TILE)]
    products = [F.expr(f"sum(u{i} * v{j})") for i in range(TILE) for j in range(TILE)]
    sums = centred.selectExpr("p.a", "p.b", *sides).groupBy("a", "b").agg(*products).toArrow()  # a row for each pair of tiles
    out = np.zeros((dim, dim))
    for row in range(sums.num_rows):
        (al, ah), (bl, bh) = tiles[sums.column(0)[row].as_py()], tiles[sums.column(1)[row].as_py()]
        block = np.array([sums.column(2 + k)[row].as_py() or 0.0 for k in range(TILE * TILE)]).reshape(TILE, TILE)[: ah - al, : bh - bl] / n
        out[al:ah, bl:bh] = block
        out[bl:bh, al:ah] = block.T
    return out


def _sum(terms: list[str]) -> str:
    """A sum as a balanced tree of parentheses, so its expression is not as deep as it is long."""
    while len(terms) > 1:
        terms = [f"({' + '.join(terms[i : i + 2])})" for i in range(0, len(terms), 2)]
    return terms[0]


def _projection(mean: np.ndarray, weights: np.ndarray) -> str:
    if not np.isfinite(weights).all():
        return "CAST(NULL AS DOUBLE)"
    return _sum([f"(x[{i}] - {float(m)!r}D) * {float(w)!r}D" for i, (m, w) in enumerate(zip(mean, weights, strict=True))])


def _deviation(n: int, sums: list[int]) -> str:
    """The exact sum of (n x - S)^2; null beyond a long."""
    parts = [f"try_subtract(try_multiply({n}L, x[{i}]), {s}L)" for i, s in enumerate(sums)]
    terms = [f"try_multiply({p}, {p})" for p in parts]
    while len(terms) > 1:
        terms = [f"try_add({terms[i]}, {terms[i + 1]})" if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("k")).where("dim > 0")
    most = lengths.orderBy(F.desc("k"), F.desc("dim")).limit(1).toArrow()  # one row
    kind = vectors.schema[id_col].dataType
    schema = StructType([StructField(id_col, kind), *spark.createDataFrame([], "component int, n long, deviation long, whitened double, explained double, identity_error double").schema.fields])
    if not most.num_rows:
        return spark.createDataFrame([], schema)
    dim = most.column("dim")[0].as_py()
    rows = rows.where(F.size("x") == dim)
    fit = stage(rows.select("x").distinct(), "whitening-fit")
    sums = fit.selectExpr("count(*)", *[f"sum(x[{i}])" for i in range(dim)]).toArrow()  # one row
    n, *totals = (c[0].as_py() for c in sums.columns)
    mean = np.array([t / n for t in totals])
    v = covariance(fit, mean, n)
    values, vectors_ = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    e, trace = values[order], float(np.trace(v))
    # a variance that rounding alone can give counts as none
    e = np.where(e > np.finfo(float).eps * dim * max(trace, 0.0), e, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = vectors_[:, order] / np.sqrt(e)
    names = [f"w{k}" for k in range(len(order))]
    projected = [f"{_projection(mean, weights[:, k])} AS w{k}" for k in range(len(order))]
    some = [k for k in range(len(order)) if e[k] > 0]
    error = None
    if some:
        pairs = [(i, j) for i in some for j in some if i <= j]
        again = fit.selectExpr(*projected).selectExpr(*[f"covar_pop(w{i}, w{j})" for i, j in pairs]).toArrow()  # one row, centred about the means of the whitened
        error = float(max(abs(c[0].as_py() - (i == j)) for (i, j), c in zip(pairs, again.columns, strict=True)))
    out = rows.selectExpr("vec_id", f"{_deviation(n, totals)} AS deviation", *projected)
    shares = [float(x / trace) if trace > 0 else None for x in e]

    def one(k: int) -> Column:
        return F.struct(F.lit(k + 1).alias("component"), F.col(names[k]).alias("whitened"), F.lit(shares[k]).cast("double").alias("explained"))

    out = out.select("vec_id", "deviation", F.inline(F.array(*[one(k) for k in range(len(order))])))
    return out.select(F.col("vec_id").alias(id_col), F.col("component").cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
