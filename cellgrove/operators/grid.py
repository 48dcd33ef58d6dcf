"""Grid arithmetic and neighbours. Neighbours are exploded from offsets and joined by key, never by range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrove.operators import nearest

CELL_M = 30.0


def _offsets(self_loops: bool) -> Column:
    near = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if self_loops or r or c]
    return F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(CELL_M * math.sqrt(abs(r) + abs(c))).alias("dist")) for r, c in near])


def edges(cells: DataFrame, height: int, width: int, self_loops: bool = True) -> DataFrame:
    """(src, dst, dist) and cells' other columns of the source, for the 8 neighbours (and the cell itself)."""
    keep = [c for c in cells.columns if c not in ("node_id", "row", "col")]
    near = cells.select("node_id", "row", "col", *keep, F.inline(_offsets(self_loops)))
    r, c = F.col("row") + F.col("dr"), F.col("col") + F.col("dc")
    inside = (r >= 0) & (r < height) & (c >= 0) & (c < width)
    return near.where(inside).select(F.col("node_id").alias("src"), (r * width + c).alias("dst"), "dist", *keep)


def neighbours(cells: DataFrame, columns: list[str], height: int, width: int, self_loops: bool = True) -> DataFrame:
    """Edges with the columns of both ends as <name>_src and <name>_dst: one join, on dst.

    A sort-merge join at any size: Spark counts the exploded edges as no larger than the file of the cells and would broadcast them.
    """
    left = edges(cells.select("node_id", "row", "col", *[F.col(c).alias(f"{c}_src") for c in columns]), height, width, self_loops)
    right = cells.select(F.col("node_id").alias("dst"), *[F.col(c).alias(f"{c}_dst") for c in columns])
    return left.join(right.hint("merge"), "dst")


def edge_count(height: int, width: int, self_loops: bool = True) -> int:
    h, w = height, width
    return 2 * (h * (w - 1) + w * (h - 1) + 2 * (h - 1) * (w - 1)) + (h * w if self_loops else 0)


def mean_gradient(near: DataFrame, column: str) -> DataFrame:
    """Per cell the mean absolute difference to its neighbours."""
    return near.groupBy(F.col("dst").alias("node_id")).agg(F.avg(F.abs(F.col(f"{column}_src") - F.col(f"{column}_dst"))).alias("gradient"))


def focal(near: DataFrame, column: str) -> DataFrame:
    """3 x 3 mean, low, high, position index and roughness of each cell (near has self-loops)."""
    v = F.col(f"{column}_src")
    stats = near.groupBy(F.col("dst").alias("node_id"), F.col(f"{column}_dst").alias("value")).agg(F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))
    return stats.select("node_id", "value", "mean", "low", "high", (F.col("value") - F.col("mean")).alias("position"), (F.col("high") - F.col("low")).alias("roughness"))


def place_truncate(df: DataFrame, height: int, width: int, north: float, west: float, step: float) -> DataFrame:
    """row and col by truncation, clipped to the raster."""
    def within(x: Column, n: int) -> Column:
        return F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(n - 1)).cast("bigint")

    return df.withColumns({"r": within((north - F.col("lat")) / step, height), "c": within((F.col("lon") - west) / step, width)})


def place_round(df: DataFrame, height: int, width: int, north: float, west: float, step: float) -> DataFrame:
    """row and col by rounding half to even; rows outside the raster are dropped."""
    out = df.withColumns({"r": F.bround((north - F.col("lat")) / step, 0).cast("bigint"), "c": F.bround((F.col("lon") - west) / step, 0).cast("bigint")})
    return out.where((F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width))


def tiles_of(boxes: DataFrame) -> DataFrame:
    """lat, lon and name of the one-degree tiles that each box (south, west, north, east) needs, beside its other columns."""
    keep = [c for c in boxes.columns if c not in ("south", "west", "north", "east")]

    def degrees(low: str, high: str) -> Column:
        a, z = F.floor(low).cast("int"), (F.ceil(high) - 1).cast("int")
        return F.explode(F.when(a <= z, F.sequence(a, z)))

    both = boxes.select(*keep, "west", "east", degrees("south", "north").alias("lat")).select(*keep, "lat", degrees("west", "east").alias("lon"))
    ns = F.concat(F.when(F.col("lat") >= 0, "N").otherwise("S"), F.lpad(F.abs("lat").cast("string"), 2, "0"))
    ew = F.concat(F.when(F.col("lon") >= 0, "E").otherwise("W"), F.lpad(F.abs("lon").cast("string"), 3, "0"))
    return both.select(*keep, "lat", "lon", F.concat(ns, ew).alias("tile"))


def required_tiles(spark: SparkSession, south: float, west: float, north: float, east: float) -> DataFrame:
    """One-degree tiles that a bounding box needs, with their names."""
    return tiles_of(spark.createDataFrame([(float(south), float(west), float(north), float(east))], "south double, west double, north double, east double"))


def chunk_rectangles(spark: SparkSession, height: int, width: int, size: int, overlap: int, crop: int) -> DataFrame:
    """Overlapping chunks (r0, c0, r1, c1) and the rectangle of each that is kept after cropping borders."""
    def axis(n: int, name: str) -> DataFrame:
        step, starts, at = size - overlap, [], 0
        while True:
            starts.append(at)
            if at + size >= n:
                break
            at += step
        rows = [(s, min(s + size, n), s + crop if s else s, min(s + size, n) - crop if min(s + size, n) < n else n) for s in starts]
        return spark.createDataFrame(rows, f"{name}0 int, {name}1 int, {name}v0 int, {name}v1 int")

    both = axis(height, "r").crossJoin(axis(width, "c"))  # a chunk plan: a few hundred rows from two small lists
    return both.where("rv0 < rv1 and cv0 < cv1")


def nearest_points(points: DataFrame, cells: DataFrame, width: int, height: int, k: int = 8, reach: int = 2) -> DataFrame:
    """The k nearest cells (node_id) of each point (event_id, node_id of its own place), ties to the smaller id; fewer only where there are fewer cells."""
    def at(df: DataFrame, name: str, alias: str) -> DataFrame:
        return df.select(F.col(name).cast("long").alias(alias), F.floor(F.col("node_id") / width).alias("row"), (F.col("node_id") % width).alias("col"))

    found = nearest.k_nearest(at(points, "event_id", "id"), at(cells, "node_id", "cell_id"), height, width, k, reach)
    return found.select("cell_id", F.col("id").alias("event_id"), "d2")


def chunked(cells: DataFrame, height: int, width: int, size: int, overlap: int, crop: int) -> DataFrame:
    """Cells once for every overlapping chunk (cr, cc) that holds them: id, their number in it, and kept, whether the cropped chunk has them.

    Chunks start every size - overlap rows and columns, the last one where it reaches the border; each cell is kept by at least one chunk, and by
    one alone where 2 crop = overlap. A chunk has size x size cells at most, so its cells are ranked in one task.
    """
    step = size - overlap

    def starts(n: int) -> int:
        return 0 if n <= size else -(-(n - size) // step)  # number of the last chunk

    def of(at: str, n: int) -> Column:
        low = F.greatest(F.ceil((F.col(at) - size + 1) / step), F.lit(0))
        return F.sequence(low.cast("int"), F.least(F.floor(F.col(at) / step), F.lit(starts(n))).cast("int"))

    rows = cells.select("*", F.explode(of("row", height)).alias("cr"))
    both = rows.select("*", F.explode(of("col", width)).alias("cc"))

    def inside(at: str, chunk: str, n: int) -> Column:
        first, last = F.col(chunk) == 0, F.col(chunk) == starts(n)
        begin = F.col(chunk) * step
        return (first | (F.col(at) >= begin + crop)) & (last | (F.col(at) < begin + size - crop))

    number = F.row_number().over(Window.partitionBy("cr", "cc").orderBy("node_id")) - 1
    return both.withColumns({"id": number.cast("bigint"), "kept": inside("row", "cr", height) & inside("col", "cc", width)})


def chunked_edges(chunks: DataFrame, height: int, width: int, self_loops: bool = True) -> DataFrame:
    """cr, cc, src, dst, dist: the edges between neighbours of one chunk, ends as numbers in it; they come along by target, one sort-merge join for all chunks, whatever size Spark takes them for."""
    near = chunks.select("cr", "cc", "row", "col", F.col("id").alias("src"), F.inline(_offsets(self_loops)))
    r, c = F.col("row") + F.col("dr"), F.col("col") + F.col("dc")
    out = near.where((r >= 0) & (r < height) & (c >= 0) & (c < width)).select("cr", "cc", "src", r.alias("row"), c.alias("col"), "dist")
    ends = chunks.select("cr", "cc", "row", "col", F.col("id").alias("dst"))
    return out.join(ends.hint("merge"), ["cr", "cc", "row", "col"]).select("cr", "cc", "src", "dst", "dist")


def chunked_points(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """cr, cc, cell (its number there) and the columns of points, once for each chunk that holds their cell."""
    return points.join(chunks.select("node_id", "cr", "cc", F.col("id").alias("cell")).hint("merge"), "node_id")


def uncropped(chunks: DataFrame, values: DataFrame) -> DataFrame:
    """The way back: node_id and the columns of values (by cr, cc and id) from the chunks that keep the cell; of several the first chunk's."""
    names = [c for c in values.columns if c not in ("cr", "cc", "id")]
    kept = chunks.where("kept").select("node_id", "cr", "cc", "id").join(values.hint("merge"), ["cr", "cc", "id"])
    return kept.groupBy("node_id").agg(F.min(F.struct("cr", "cc", *names)).alias("v")).select("node_id", *[F.col(f"v.{n}").alias(n) for n in names])


def renumbered(nodes: DataFrame) -> DataFrame:
    """node_id and its number from 0 in a chunk; a chunk has a fixed number of cells, so one task may rank them."""
    return nodes.select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).cast("bigint").alias("id"))


def subgraph(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Edges with both ends in a chunk, ends renumbered."""
    ids = renumbered(inside)
    src, dst = ids.toDF("src", "src_id"), ids.toDF("dst", "dst_id")
    return edges.join(src, "src").join(dst, "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "dist")


def merged_edges(parts: list[DataFrame]) -> DataFrame:
    """The distinct edges of several sources."""
    out = parts[0].select("src", "dst")
    for p in parts[1:]:
        out = out.union(p.select("src", "dst"))
    return out.distinct()


def derivatives(cells: DataFrame, column: str, height: int, width: int, step: float = CELL_M) -> DataFrame:
    """slope_deg (Horn), tpi, tri, roughness and curvature (Laplacian) of 3 x 3 windows whose border is repeated outwards.

    A cell sends its value to every window it lies in, which at the border is once for each place it stands for:
    one shuffle, and all sums are partial.
    """
    def served(at: str, n: int):
        # (offset of the window, place in it) along one axis: a border cell also stands for the one beyond
        x = F.col(at)
        plain = F.filter(F.array(*[F.struct(F.lit(-d).alias("to"), F.lit(d).alias("place")) for d in (-1, 0, 1)]), lambda s: (x + s["to"] >= 0) & (x + s["to"] < n))
        beyond = F.array_compact(F.array(F.when(x == 0, F.struct(F.lit(0).alias("to"), F.lit(-1).alias("place"))), F.when(x == n - 1, F.struct(F.lit(0).alias("to"), F.lit(1).alias("place")))))
        return F.concat(plain, beyond)

    rows = cells.select("row", "col", F.col(column).cast("double").alias("z"), F.explode(served("row", height)).alias("r"))
    both = rows.select("row", "col", "z", "r", F.explode(served("col", width)).alias("c"))
    at = both.select(((F.col("row") + F.col("r.to")) * width + F.col("col") + F.col("c.to")).alias("node_id"), F.col("r.place").alias("dr"), F.col("c.place").alias("dc"), "z")

    def z(dr: int, dc: int) -> Column:
        return F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col("z")))

    own = (F.col("dr") == 0) & (F.col("dc") == 0)
    d = at.groupBy("node_id").agg(
        ((z(-1, 1) + 2 * z(0, 1) + z(1, 1) - z(-1, -1) - 2 * z(0, -1) - z(1, -1)) / (8 * step)).alias("zx"), ((z(1, -1) + 2 * z(1, 0) + z(1, 1) - z(-1, -1) - 2 * z(-1, 0) - z(-1, 1)) / (8 * step)).alias("zy"),
        z(0, 0).alias("z"), F.avg(F.when(~own, F.col("z"))).alias("around"), (F.max("z") - F.min("z")).alias("roughness"), ((z(0, 1) + z(0, -1) + z(1, 0) + z(-1, 0) - 4 * z(0, 0)) / (step * step)).alias("curvature"),
        F.sum(F.col("z") * F.col("z")).alias("zz"), F.sum("z").alias("zs"),
    )
    tri = F.sqrt(F.col("zz") - 2 * F.col("z") * F.col("zs") + 9 * F.col("z") * F.col("z"))
    return d.select("node_id", F.degrees(F.atan(F.sqrt(F.col("zx") * F.col("zx") + F.col("zy") * F.col("zy")))).alias("slope_deg"), (F.col("z") - F.col("around")).alias("tpi"), tri.alias("tri"), "roughness", "curvature")
