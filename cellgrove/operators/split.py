"""Spatially blocked splits into train, val and test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def block_ids(cells: DataFrame, km: float = 5.0, km_per_deg_lat: float = 111.0, km_per_deg_lon: float = 85.0) -> DataFrame:
    """block_id of each cell: a thousand times its block row plus its block column, from the south-west corner."""
    corner = cells.agg(F.min("lat").alias("lat0"), F.min("lon").alias("lon0"))  # one row
    at = cells.crossJoin(F.broadcast(corner))
    row, col = F.floor((F.col("lat") - F.col("lat0")) / (km / km_per_deg_lat)), F.floor((F.col("lon") - F.col("lon0")) / (km / km_per_deg_lon))
    return at.withColumn("block_id", (row * 1000 + col).cast("bigint")).drop("lat0", "lon0")


def assign(blocks: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """(block_id, split): blocks in a fixed pseudo-random order, the first share to train, the next to val.

    The window runs over the distinct blocks, of which an area has a few per 25 square kilometres.
    """
    ids = blocks.select("block_id").distinct()
    order = Window.orderBy((F.col("block_id") * 7919 + seed) % 10007, "block_id")
    ranked = ids.withColumn("rn", F.row_number().over(order)).withColumn("nb", F.count("*").over(Window.partitionBy()))
    first, second = F.floor(F.col("nb") * train), F.floor(F.col("nb") * val)
    return ranked.select("block_id", F.when(F.col("rn") <= first, "train").when(F.col("rn") <= first + second, "val").otherwise("test").alias("split"))


def attach(blocks: DataFrame, splits: DataFrame) -> DataFrame:
    return blocks.join(splits, "block_id").select("node_id", "block_id", "split")


def purity(blocks: DataFrame, splits: DataFrame) -> DataFrame:
    """Per split: blocks, and blocks all of whose cells are in one split."""
    each = blocks.join(splits, "node_id").groupBy("block_id").agg(F.countDistinct("split").alias("kinds"), F.min("split").alias("split"))
    return each.groupBy("split").agg(F.count("*").alias("blocks"), F.sum(F.when(F.col("kinds") == 1, 1).otherwise(0)).alias("pure"))


def buffered(cell_splits: DataFrame, cells: DataFrame, radius: int) -> DataFrame:
    """Cells of val and test with no train cell within radius rows and columns: a keyed join on offsets."""
    span = list(range(-radius, radius + 1))
    around = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in span for c in span])
    at = cells.select("node_id", "row", "col").join(cell_splits, "node_id")
    reach = at.where("split = 'train'").select("row", "col", F.inline(around)).select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col")).distinct()
    return at.where("split <> 'train'").join(reach, ["row", "col"], "left_anti").select("node_id", "split")
