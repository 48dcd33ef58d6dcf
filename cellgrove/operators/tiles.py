"""A raster's cells as tiles with a halo: whole tiles are computed in one bounded step, borders included.

A tile has ``tile`` x ``tile`` cells of its own and, around them, a halo of as many rows and columns as a computation looks
outwards (a layer of a network over neighbours looks one further). A cell is sent once to every tile in whose
rectangle or halo it lies: one shuffle of (1 + 2 halo / tile)^2 of the cells, whatever the number of layers, and a task never
holds more than (tile + 2 halo)^2 cells. Results are those of the whole raster, as every cell sees all that it depends on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.sources.shipping import ship


@dataclass(frozen=True)
class Tiling:
    height: int
    width: int
    tile: int = 128
    halo: int = 0

    def rows(self) -> int:
        return -(-self.height // self.tile)

    def columns(self) -> int:
        return -(-self.width // self.tile)


@dataclass
class Tile:
    """Dense arrays of one tile with its halo: there (which cells exist), inner (its own cells), ids and columns by name."""

    there: np.ndarray
    inner: np.ndarray
    ids: np.ndarray
    values: dict[str, np.ndarray]
    tr: int
    tc: int

    def stack(self, names: list[str]) -> np.ndarray:
        return np.stack([self.values[n] for n in names], axis=-1)


def spread(cells: DataFrame, t: Tiling) -> DataFrame:
    """Cells (node_id, row, col and others) with tr and tc, once for each tile that holds them or has them in its halo."""
    ship(cells.sparkSession)

    def reach(at: str, last: int) -> Column:
        low, high = F.floor((F.col(at) - t.halo) / t.tile), F.floor((F.col(at) + t.halo) / t.tile)
        return F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(last)).cast("int"))

    rows = cells.select("*", F.explode(reach("row", t.rows() - 1)).alias("tr"))
    return rows.select("*", F.explode(reach("col", t.columns() - 1)).alias("tc"))


def dense(table: pa.Table, t: Tiling) -> Tile:
    """The rows of one tile as dense arrays."""
    tr, tc = table.column("tr")[0].as_py(), table.column("tc")[0].as_py()
    r0, c0 = tr * t.tile - t.halo, tc * t.tile - t.halo
    size = t.tile + 2 * t.halo
    r, c = table.column("row").to_numpy().astype(np.int64) - r0, table.column("col").to_numpy().astype(np.int64) - c0
    there, ids = np.zeros((size, size), bool), np.full((size, size), -1, np.int64)
    there[r, c], ids[r, c] = True, table.column("node_id").to_numpy()
    values = {}
    for name in table.column_names:
        if name not in ("tr", "tc", "row", "col", "node_id"):
            x = table.column(name).to_numpy()
            full = np.zeros((size, size), x.dtype)
            full[r, c] = x
            values[name] = full
    inner = np.zeros_like(there)
    inner[t.halo : t.halo + t.tile, t.halo : t.halo + t.tile] = True
    return Tile(there, inner & there, ids, values, tr, tc)


def per_tile(cells: DataFrame, columns: list[str], t: Tiling, fn: Callable[[Tile], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """node_id and fn's arrays (over the tile with its halo) for every cell; schema names and types the arrays."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(table: pa.Table) -> pa.Table:
        tile = dense(table, t)
        out = fn(tile)
        return pa.table({"node_id": tile.ids[tile.inner]} | {n: column_of(out[n][tile.inner]) for n in names})

    picked = spread(cells.select("node_id", "row", "col", *columns), t)
    return picked.groupBy("tr", "tc").applyInArrow(run, f"node_id long, {schema}")


def column_of(x: np.ndarray) -> pa.Array:
    if x.ndim == 1:
        return pa.array(x)
    flat = pa.array(np.ascontiguousarray(x, np.float64).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, x.shape[1], dtype=np.int32)), flat)
