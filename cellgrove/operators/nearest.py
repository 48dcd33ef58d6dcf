"""Nearest occupied cells at any distance: one of them line by line, k of them from a pyramid of how many cells are occupied.

Most points have their neighbours at hand: a small square around them, looked up in tiles, decides them. The others
go down a pyramid of blocks of 2^k x 2^k cells with the number of occupied ones in each. On every level a point keeps the blocks
that can still hold one of its k nearest cells: those no farther than the distance within which the kept blocks surely hold k.
So what is listed for a point is a few blocks a level, however far its neighbours are and however many cells the raster has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.operators import tiles
from cellgrove.sources import files
from cellgrove.sources.shipping import ship

#: rows and columns of the tiles in which places look around; no id
TILE, NONE = 128, np.iinfo(np.int64).max
#: places of the columns that go to a task together
COLUMN_PLACES = 1 << 18


def _square(points: DataFrame, cells: DataFrame, k: int, reach: int) -> DataFrame:
    """id, row, col, best: of every point up to k nearest (d2, cell_id) within reach rows and columns.

    The places where points lie meet the cells in tiles with a halo of reach, so a cell travels about once and a place once,
    whatever the number of points there; points then take their place's list.
    """
    t = tiles.Tiling(TILE << 30, TILE << 30, TILE, reach)  # cells beyond the raster count too
    near = sorted((r * r + c * c, r, c) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1))

    def run(table: pa.Table) -> pa.Table:
        tr, tc = table.column("tr")[0].as_py(), table.column("tc")[0].as_py()
        r = table.column("row").to_numpy() - (tr * TILE - reach)
        c = table.column("col").to_numpy() - (tc * TILE - reach)
        number = table.column("cell_id")
        given = number.is_valid().to_numpy()
        size = TILE + 2 * reach
        ids = np.full((size, size), NONE, np.int64)
        ids[r[given], c[given]] = number.drop_null().to_numpy()
        r, c = r[~given], c[~given]
        at = np.stack([ids[r + dr, c + dc] for _, dr, dc in near], axis=1)  # columns in order of d2
        d2 = np.where(at == NONE, NONE, np.array([d for d, _, _ in near], np.int64))
        order = np.lexsort((at, d2), axis=1)[:, :k]
        at, d2 = np.take_along_axis(at, order, axis=1), np.take_along_axis(d2, order, axis=1)
        found = d2 != NONE
        begin = np.concatenate([[0], np.cumsum(found.sum(axis=1))]).astype(np.int32)
        best = pa.StructArray.from_arrays([pa.array(d2[found]), pa.array(at[found])], names=["d2", "cell_id"])
        return pa.table({"row": r + (tr * TILE - reach), "col": c + (tc * TILE - reach), "best": pa.ListArray.from_arrays(pa.array(begin), best)})

    own = [F.floor(F.col(x) / TILE).cast("int").alias(n) for x, n in (("row", "tr"), ("col", "tc"))]
    places = points.select("row", "col").distinct().select(F.lit(None).cast("long").alias("cell_id"), "row", "col", *own)
    rows = tiles.spread(cells.select("cell_id", "row", "col"), t).unionByName(places)
    lists = rows.groupBy("tr", "tc").applyInArrow(run, "row long, col long, best array<struct<d2: long, cell_id: long>>")
    return points.join(lists.hint("merge"), ["row", "col"]).select("id", "row", "col", "best")


def _levels(cells: DataFrame, top: int) -> list[DataFrame]:
    """For every level the occupied blocks (br, bc) and n, how many cells they hold: partial counts of all levels in one pass, written."""
    spark, path = cells.sparkSession, files.work_path(cells.sparkSession, "pyramid")
    each = cells.select("row", "col", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level"))
    size = F.pow(F.lit(2), F.col("level"))
    counted = each.groupBy("level", F.floor(F.col("row") / size).alias("br"), F.floor(F.col("col") / size).alias("bc")).agg(F.count("*").alias("n"))
    counted.write.partitionBy("level").parquet(path)
    found = spark.read.schema("br long, bc long, n long, level int").parquet(path)
    return [found.where(F.col("level") == k).select("br", "bc", "n") for k in range(top + 1)]


def _gap(at: Column, block: Column, size: int, far: bool) -> Column:
    """Rows (or columns) from a cell to the nearest or the farthest line of a block."""
    low, high = block * size - at, at - (block * size + size - 1)
    return F.greatest(F.abs(low), F.abs(high)) if far else F.greatest(low, high, F.lit(0))


def _descend(points: DataFrame, cells: DataFrame, k: int, top: int) -> DataFrame:
    spark = cells.sparkSession
    levels = _levels(cells, top)
    held = points.select("id", "row", "col", F.lit(0).cast("long").alias("br"), F.lit(0).cast("long").alias("bc"))
    mine = Window.partitionBy("id")
    for level in range(top, -1, -1):
        size = 1 << level
        blocks = held.join(levels[level], ["br", "bc"])
        near, far = ([_gap(F.col(x), F.col(b), size, f) for x, b in (("row", "br"), ("col", "bc"))] for f in (False, True))
        blocks = blocks.withColumns({"near": near[0] * near[0] + near[1] * near[1], "far": far[0] * far[0] + far[1] * far[1]})
        sure = blocks.withColumn("within", F.sum("n").over(mine.orderBy("far")))  # of equal distances all count
        bound = F.min(F.when(F.col("within") >= k, F.col("far"))).over(mine)
        kept = sure.withColumn("bound", bound).where(F.col("bound").isNull() | (F.col("near") <= F.col("bound")))
        if level:
            two = F.array(F.lit(0), F.lit(1))
            half = kept.select("id", "row", "col", (F.col("br") * 2).alias("br"), (F.col("bc") * 2).alias("bc"), F.explode(two).alias("i"))
            held = half.select("id", "row", "col", (F.col("br") + F.col("i")).alias("br"), "bc", F.explode(two).alias("j")).select("id", "row", "col", "br", (F.col("bc") + F.col("j")).alias("bc"))
            if level % 4 == 0:  # keeps the plan short
                path = files.work_path(spark, "nearest")
                held.write.parquet(path)
                held = spark.read.schema(held.schema).parquet(path)
    at = kept.select("id", F.col("br").alias("row"), F.col("bc").alias("col"), F.col("near").alias("d2")).join(cells, ["row", "col"])
    place = F.row_number().over(mine.orderBy("d2", "cell_id"))
    return at.withColumn("place", place).where(F.col("place") <= k).select("id", F.col("d2").cast("long").alias("d2"), "cell_id")


def k_nearest(points: DataFrame, cells: DataFrame, height: int, width: int, k: int, reach: int = 2) -> DataFrame:
    """id, cell_id, d2: the k nearest of cells (cell_id, row, col) to each point (id, row, col), ties to the smaller id.

    Fewer only where there are fewer cells. What the square finds is written once.
    """
    spark, top = cells.sparkSession, max(0, max(height, width) - 1).bit_length()
    points = points.select("id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    cells = cells.select("cell_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    path = files.work_path(spark, "nearest")
    # cells outside the square are at least reach + 1 away
    sure = (F.size("best") == k) & (F.get("best", F.lit(k - 1))["d2"] < (reach + 1) ** 2)
    _square(points, cells, k, reach).withColumn("sure", sure).write.parquet(path)
    seen = spark.read.schema("id long, row long, col long, best array<struct<d2: long, cell_id: long>>, sure boolean").parquet(path)
    done, left = seen.where("sure").select("id", F.inline("best")).select("id", "cell_id", "d2"), seen.where("not sure").select("id", "row", "col")
    return done if left.isEmpty() else done.unionByName(_descend(left, cells, k, top).select("id", "cell_id", "d2"))


def _line(rows: list[int], ids: list[int], at: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a line the giver of the least (distance squared, id), of givers beside the line: where they stand, square of the gap, id.

    Of two givers the later one wins from one place on, ties included, so a stack of winners and their first places will do.
    """
    won: list[tuple[int, int]] = []  # giver, its first place
    last = int(at[-1])
    for j, (x, g, i) in enumerate(zip(rows, square.tolist(), ids, strict=True)):
        begin = int(at[0])
        while won:
            top, first = won[-1]
            above, below = x * x + g - rows[top] * rows[top] - int(square[top]), 2 * (x - rows[top])
            begin = -(-above // below) if i < ids[top] else above // below + 1
            if begin > first:
                break
            won.pop()
            begin = first
        if begin <= last:
            won.append((j, begin))
    winner = np.array([j for j, _ in won])[np.searchsorted([b for _, b in won], at, side="right") - 1]
    return winner, (at - np.array(rows)[winner]) ** 2 + square[winner]


def nearest_one(gaps: DataFrame, givers: DataFrame, height: int, width: int) -> DataFrame:
    """id, cell_id, d2: the nearest of givers (cell_id, row, col) to each gap (id, row, col), ties to the smaller id; at any distance.

    First along columns, then along rows: the nearest giver of each column to every row that has gaps, and of those the nearest to each gap. Two
    shuffles of at most a row a place of the raster, however far givers are. A task holds some whole columns, or one row, of it.
    """
    ship(gaps.sparkSession)
    block = max(1, COLUMN_PLACES // max(1, height))

    def upright(table: pa.Table) -> pa.Table:
        row, col, ids = (table.column(c).to_numpy() for c in ("row", "col", "cell_id"))
        wanted = np.unique(row[ids == NONE])
        given = ids != NONE
        row, ids = row[given], ids[given]
        names, col = np.unique(col[given], return_inverse=True)
        if not len(names):
            return pa.table({"row": pa.array([], pa.int64()), "col": pa.array([], pa.int64()), "cell_id": pa.array([], pa.int64()), "gap": pa.array([], pa.int64())})
        order = np.lexsort((row, col))
        row, col, ids = row[order], col[order], ids[order]
        begin, end = np.searchsorted(col, np.arange(len(names))), np.searchsorted(col, np.arange(len(names)), side="right")
        out = []
        for name, b, e in zip(names, begin, end, strict=True):
            r, i = row[b:e], ids[b:e]
            after = np.searchsorted(r, wanted)
            low, high = np.maximum(after - 1, 0), np.minimum(after, e - b - 1)
            to_low, to_high = np.abs(wanted - r[low]), np.abs(wanted - r[high])
            up = (to_low < to_high) | ((to_low == to_high) & (i[low] < i[high]))
            best = np.where(up, low, high)
            out.append((wanted, np.full(len(wanted), name), i[best], np.abs(wanted - r[best])))
        return pa.table(dict(zip(("row", "col", "cell_id", "gap"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    def across(table: pa.Table) -> pa.Table:
        asked = table.column("id").is_valid().to_numpy()
        some = table.filter(pa.array(~asked)).sort_by("col")
        gap = table.filter(pa.array(asked)).sort_by("col")
        if not (some.num_rows and gap.num_rows):
            return pa.table({"id": pa.array([], pa.int64()), "cell_id": pa.array([], pa.int64()), "d2": pa.array([], pa.int64())})
        ids = some.column("cell_id").to_numpy()
        winner, d2 = _line(some.column("col").to_pylist(), ids.tolist(), gap.column("col").to_numpy(), some.column("gap").to_numpy() ** 2)
        return pa.table({"id": gap.column("id"), "cell_id": ids[winner], "d2": d2})

    parts = -(-width // block)
    rows = gaps.select(F.col("row").cast("long").alias("row")).distinct().select("row", F.lit(-1).cast("long").alias("col"), F.lit(int(NONE)).alias("cell_id"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    given = givers.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "cell_id", F.floor(F.col("col") / block).cast("int").alias("part"))
    columns = given.unionByName(rows).groupBy("part").applyInArrow(upright, "row long, col long, cell_id long, gap long")
    none = F.lit(None).cast("long")
    asked = gaps.select("id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), none.alias("cell_id"), none.alias("gap"))
    return asked.unionByName(columns.select(none.alias("id"), "row", "col", "cell_id", "gap")).groupBy("row").applyInArrow(across, "id long, cell_id long, d2 long")
