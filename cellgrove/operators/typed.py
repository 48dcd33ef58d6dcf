"""Embeddings of cells from nodes of several types: each type has a table and features of its own, and all relations end in cells.

Neighbouring cells and the nodes that belong to a cell (pixels, points) each send a message by attention with their own
weights; a layer adds them up, then residual, LayerNorm and GELU. Cells go by tiles with a halo of as many cells as there
are layers, and other nodes travel with their cell, so a task holds one tile and its nodes and goes through all layers. What
a task holds is bounded by the tile as long as the nodes of a cell are: take smaller tiles where cells have very many.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.operators import dense, tiles
from cellgrove.operators.descent import Weights


@dataclass(frozen=True)
class TypedNet:
    """features: the columns of the cells; others: the columns of each further type."""

    features: tuple[str, ...]
    others: dict[str, tuple[str, ...]]
    layers: int = 2

    def start(self, width: int, seed: int = 7) -> Weights:
        rng, out = np.random.default_rng(seed), {}
        for kind, names in {"cell": self.features, **self.others}.items():
            out |= {f"{kind}/encoder": rng.normal(size=(width, len(names))) / 2, f"{kind}/bias": rng.normal(size=width) / 4}
            for k in range(self.layers):
                out |= {f"{kind}/left{k}": rng.normal(size=(width, width)) / 3, f"{kind}/right{k}": rng.normal(size=(width, width)) / 3, f"{kind}/scorer{k}": rng.normal(size=width)}
        return out

    def encoded(self, w: Weights, kind: str, x: np.ndarray) -> np.ndarray:
        return dense.gelu(dense.layer_norm(x @ w[f"{kind}/encoder"].T + w[f"{kind}/bias"])[0])[0]

    def forward(self, w: Weights, x: np.ndarray, there: np.ndarray, nodes: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """States of a raster's cells; nodes: for each type its features and the flat number of each node's cell."""
        h = self.encoded(w, "cell", x) * there[..., None]
        sources = {kind: (self.encoded(w, kind, v), at) for kind, (v, at) in nodes.items()}
        for k in range(self.layers):
            message, _ = dense.neighbour_message(h, there, *[w[f"cell/{p}{k}"] for p in ("left", "right", "scorer")])
            flat = h.reshape(-1, h.shape[-1])
            for kind, (v, at) in sources.items():
                message = message + dense.source_message(flat, v, at, *[w[f"{kind}/{p}{k}"] for p in ("left", "right", "scorer")]).reshape(h.shape)
            h = dense.gelu(dense.layer_norm(h + message)[0])[0] * there[..., None]
        return h

    def embed(self, w: Weights, cells: DataFrame, others: dict[str, DataFrame], height: int, width: int, tile: int = 64) -> DataFrame:
        """node_id and h (an array) of every cell. cells: node_id, row, col and features; others: node_id of the cell they belong to, and features."""
        t = tiles.Tiling(height, width, tile, self.layers)
        shared = cells.sparkSession.sparkContext.broadcast(w)
        kinds, net = list(self.others), self

        def numbers(names: tuple[str, ...]):
            return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])

        rows = cells.select("node_id", "row", "col", F.lit(-1).alias("kind"), numbers(self.features).alias("x"))
        places = cells.select("node_id", "row", "col")
        for i, kind in enumerate(kinds):
            one = others[kind].select("node_id", numbers(self.others[kind]).alias("x"))
            rows = rows.unionByName(one.join(places, "node_id").select("node_id", "row", "col", F.lit(i).alias("kind"), "x"))

        def run(table: pa.Table) -> pa.Table:
            kind = table.column("kind").to_numpy()
            own = table.filter(pa.array(kind == -1))
            size = len(net.features)
            flat = own.column("x").combine_chunks()
            x = flat.flatten().to_numpy().reshape(-1, size)
            named = {f"f{i}": pa.array(np.ascontiguousarray(x[:, i])) for i in range(size)}
            tile_ = tiles.dense(pa.table({c: own.column(c) for c in ("tr", "tc", "row", "col", "node_id")} | named), t)
            r0, c0, across = tile_.tr * t.tile - t.halo, tile_.tc * t.tile - t.halo, tile_.there.shape[1]
            nodes = {}
            for i, name in enumerate(kinds):
                some = table.filter(pa.array(kind == i))
                at = (some.column("row").to_numpy() - r0) * across + some.column("col").to_numpy() - c0
                nodes[name] = (some.column("x").combine_chunks().flatten().to_numpy().reshape(some.num_rows, len(net.others[name])), at.astype(np.int64))
            h = net.forward(shared.value, tile_.stack([f"f{i}" for i in range(size)]), tile_.there, nodes)
            return pa.table({"node_id": tile_.ids[tile_.inner], "h": tiles.column_of(h[tile_.inner])})

        return tiles.spread(rows, t).groupBy("tr", "tc").applyInArrow(run, "node_id long, h array<double>")
