"""One layer of a graph network with given weights over any relations between nodes, as DataFrames.

Node states are arrays of a small fixed width. A layer is a join of the edges with the sources' states and grouped
sums by target. Weights are numpy arrays, (outputs, inputs), and become literals of the plan. A
raster's neighbours go tile by tile instead (``models.AttentionNet``, ``models.RelationNet``), where cells travel once, not with every edge.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.functions import scalar as S


def linear(x: Column, weight: np.ndarray, bias: np.ndarray | None = None) -> Column:
    """weight @ x + bias of an array column."""
    rows = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weight])
    out = F.transform(rows, lambda row: S.dot(row, x))
    return out if bias is None else F.zip_with(out, F.array(*[F.lit(float(b)) for b in bias]), lambda a, b: a + b)


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """To mean 0 and variance 1 over an array's elements."""
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    square = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x)
    return F.transform(x, lambda v: (v - mean) / F.sqrt(square - mean * mean + eps))


def gelu(x: Column) -> Column:
    return F.transform(x, S.gelu)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _summed(rows: DataFrame, vector: Column, width: int) -> DataFrame:
    """Sums of an array column by dst, element by element: partial sums."""
    out = rows.groupBy("dst").agg(*[F.sum(vector[i]).alias(f"v{i}") for i in range(width)])
    return out.select(F.col("dst").alias("node_id"), F.array(*[F.col(f"v{i}") for i in range(width)]).alias("m"))


def relation_layer(nodes: DataFrame, relations: dict[str, DataFrame], weights: dict[str, np.ndarray]) -> DataFrame:
    """Sum of linear messages over the edges of every relation, residual, LayerNorm and GELU over (node_id, h)."""
    parts, width = None, len(next(iter(weights.values())))
    for name, edges in relations.items():
        src = nodes.select(F.col("node_id").alias("src"), linear(F.col("h"), weights[name]).alias("sent"))
        one = edges.select("src", "dst").join(src, "src").select("dst", "sent")
        parts = one if parts is None else parts.unionByName(one)
    return _updated(nodes, _summed(parts, F.col("sent"), width), width)


def _updated(nodes: DataFrame, message: DataFrame, width: int) -> DataFrame:
    nothing = F.array(*[F.lit(0.0)] * width)
    return nodes.join(message, "node_id", "left").select("node_id", gelu(layer_norm(add(F.col("h"), F.coalesce("m", nothing)))).alias("h"))


def encode(cells: DataFrame, columns: list[str], weight: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(node_id, h): a linear map of feature columns and GELU."""
    return cells.select("node_id", gelu(linear(F.array(*[F.col(c).cast("double") for c in columns]), weight, bias)).alias("h"))
