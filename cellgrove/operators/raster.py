"""Scenes and rasters as long tables: search, mosaics, coverage, gap filling and stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.functions.scalar import clip
from cellgrove.operators import nearest
from cellgrove.sources import files


def scene_search(scenes: DataFrame, max_cloud: int, limit: int) -> DataFrame:
    """Scenes up to a cloud cover, clearest first."""
    return scenes.groupBy("scene_id", "cloud").agg(F.count_if(F.col("dn") > 0).alias("valid")).where(F.col("cloud") <= max_cloud).orderBy("cloud", "scene_id").limit(limit)


def scene_catalogue(observed: DataFrame) -> DataFrame:
    """One row a scene from its pixels (scene_id, taken, cloud, lat, lon): first and last time, cloud cover, bounding box and pixels."""
    return observed.groupBy("scene_id").agg(F.min("taken").alias("first"), F.max("taken").alias("last"), F.max("cloud").alias("cloud"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.count("*").alias("pixels"))


def search(catalogue: DataFrame, box: tuple[float, float, float, float], begin: str, end: str, max_cloud: int, limit: int = 1000) -> DataFrame:
    """Scenes whose box meets (west, south, east, north), taken between two days (both included), up to a cloud cover; clearest first.

    A border in common counts as meeting. Of equal cloud cover the earlier scene comes first, then the smaller id.
    """
    west, south, east, north = box
    meets = (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    taken = (F.col("first") < F.date_add(F.lit(end).cast("date"), 1)) & (F.col("last") >= F.lit(begin).cast("date"))
    return catalogue.where(meets & taken & (F.col("cloud") <= max_cloud)).orderBy("cloud", "first", "scene_id").limit(limit)


def reshaped(values: DataFrame, height: int, width: int) -> DataFrame:
    """node_id and value by row and col of a raster of height x width, row by row; refused unless each place has one value."""
    said = values.agg(F.count("*").alias("n"), F.countDistinct("node_id").alias("d"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi")).first()
    if (said["n"], said["d"]) != (height * width, height * width) or (said["n"] and (said["lo"], said["hi"]) != (0, height * width - 1)):
        raise ValueError(f"{said['n']} values of {said['d']} places for {height} x {width} pixels")
    return values.select(F.floor(F.col("node_id") / width).alias("row"), (F.col("node_id") % width).alias("col"), "value")


def scene_mean(scenes: DataFrame) -> DataFrame:
    """Mean reflectance of each pixel over the scenes where it is valid, within 0 and 1."""
    return scenes.groupBy("row", "col").agg(F.least(F.greatest(F.avg(F.when(F.col("dn") > 0, F.col("dn"))) / 10000.0, F.lit(0.0)), F.lit(1.0)).alias("value"), F.count_if(F.col("dn") > 0).alias("scenes"))


def coverage(scenes: DataFrame, pixels: int) -> DataFrame:
    """By scene in cloud order: pixels first seen there, and the covered share so far.

    The running sum is over scenes, a catalogue of hundreds of rows, after the pixels are counted.
    """
    first = scenes.where("dn > 0").groupBy("row", "col").agg(F.min(F.struct("cloud", "scene_id")).alias("f"))
    new = first.groupBy(F.col("f.cloud").alias("cloud"), F.col("f.scene_id").alias("scene_id")).agg(F.count("*").alias("fresh"))
    w = Window.orderBy("cloud", "scene_id").rowsBetween(Window.unboundedPreceding, 0)
    return new.withColumn("covered_pct", 100.0 * F.sum("fresh").over(w) / pixels)


def needed_scenes(covered: DataFrame, target: float) -> DataFrame:
    """The scenes up to the first that reaches the target share."""
    before = F.col("covered_pct") - F.lag("covered_pct", 1, 0.0).over(Window.orderBy("cloud", "scene_id"))
    return covered.withColumn("gain", before).where(F.col("covered_pct") - F.col("gain") < target)


def mosaic_last(pixels: DataFrame, order: str) -> DataFrame:
    """Of overlapping pixels the one of the highest order wins."""
    return pixels.groupBy("row", "col").agg(F.max(F.struct(order, "dn")).alias("m")).select("row", "col", F.col("m.dn").alias("dn"))


def merge_first(pixels: DataFrame, order: str) -> DataFrame:
    """Of overlapping valid pixels the one of the lowest order wins."""
    return pixels.where("dn > 0").groupBy("row", "col").agg(F.min(F.struct(order, "dn")).alias("m")).select("row", "col", F.col("m.dn").alias("dn"))


def nearest_fill(cells: DataFrame, values: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """Every cell with the value of the nearest giver of the raster and its squared distance; ties go to the smaller id.

    Givers keep their own value; only cells without one look for the nearest. Null only where no giver exists at all.
    The raster's shape is taken from the cells if it is not given.
    """
    if height is None or width is None:
        last = cells.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
        height, width = (0 if x is None else x + 1 for x in last)
    spark, path = cells.sparkSession, files.work_path(cells.sparkSession, "fill")
    have = cells.select("node_id", "row", "col").join(values.select("node_id", "value", F.lit(True).alias("given")), "node_id", "left")
    have.write.parquet(path)
    have = spark.read.schema(have.schema).parquet(path)  # read several times
    gaps = have.where("given is null").select(F.col("node_id").alias("id"), "row", "col")
    givers = have.where("given").select(F.col("node_id").alias("cell_id"), "row", "col", "value")
    near = nearest.nearest_one(gaps, givers, height, width)
    filled = near.join(givers.select("cell_id", "value").hint("merge"), "cell_id").select(F.col("id").alias("node_id"), F.col("value").alias("filled"), F.col("d2").alias("far"))
    out = have.join(filled.hint("merge"), "node_id", "left")
    return out.select("node_id", F.when(F.col("given"), F.col("value")).otherwise(F.col("filled")).alias("value"), F.when(F.col("given"), F.lit(0)).otherwise(F.col("far")).cast("bigint").alias("d2"))


def bilinear(pixels: DataFrame, column: str, shape: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """row, col and column of a raster of another shape over the same extent: each target pixel from the four source pixels around its centre.

    A source pixel sends its value to the target pixels that it has a weight for, so one keyed aggregation does it, without a
    join. Weights of null and missing pixels go to the others; target pixels that have none are left out. Centres beyond those of
    the outermost pixels take the outermost ones.
    """
    def weighed(at: str, n: int, m: int, name: str) -> Column:
        x = F.col(at)
        low = F.when(x == 0, F.lit(0)).otherwise(F.ceil((x - 0.5) * (m / n) - 0.5))
        high = F.when(x == n - 1, F.lit(m - 1)).otherwise(F.floor((x + 1.5) * (m / n) - 0.5))
        low, high = F.greatest(low.cast("int"), F.lit(0)), F.least(high.cast("int"), F.lit(m - 1))
        all_ = F.transform(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("at"), (1.0 - F.abs(clip((i + 0.5) * n / m - 0.5, 0.0, n - 1.0) - x)).alias("w")))
        return F.explode(F.filter(all_, lambda s: s["w"] > 0)).alias(name)

    rows = pixels.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select("row", "col", F.col(column).cast("double").alias("value"))
    rows = rows.select("col", "value", weighed("row", shape[0], target[0], "r"))
    both = rows.select("r", "value", weighed("col", shape[1], target[1], "c"))
    w = F.col("r.w") * F.col("c.w")
    out = both.groupBy(F.col("r.at").cast("long").alias("row"), F.col("c.at").cast("long").alias("col")).agg((F.sum(w * F.col("value")) / F.sum(w)).alias(column))
    return out


def stretch(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98, gamma: float = 0.95) -> DataFrame:
    """Percentile stretch to 0..1 with gamma; the two percentiles are one aggregate, broadcast as one row.

    Null where the value is null or the two percentiles are equal.
    """
    cut = df.agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("cut"))
    x = (F.col(column) - F.col("cut")[0]) / F.nullif(F.col("cut")[1] - F.col("cut")[0], F.lit(0.0))
    inside = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))  # greatest and least skip nulls
    return df.crossJoin(F.broadcast(cut)).withColumn("stretched", F.pow(inside, F.lit(gamma))).drop("cut")


def bands(values: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(row, col, profile, y) as one row per pixel with a column per band."""
    return values.groupBy("row", "col").pivot("profile", list(names)).agg(F.first("y"))


def border_columns(cells: DataFrame, column: str, share: float) -> DataFrame:
    """Columns where more than share of the rows differ from the column before."""
    w = Window.partitionBy("row").orderBy("col")
    moved = cells.withColumn("before", F.lag(column).over(w)).where("before is not null")
    return moved.groupBy("col").agg(F.avg(F.when(F.col(column) != F.col("before"), 1.0).otherwise(0.0)).alias("changed")).where(F.col("changed") > share)


def pixel_stats(pixels: DataFrame, column: str, values: tuple[int, ...]) -> DataFrame:
    """Count and percentage of each of the values (absent ones too), nodata among them."""
    counts = [F.count_if(F.col(column) == x).alias(f"v{x}") for x in values]
    one = pixels.agg(F.count("*").alias("total"), *counts)  # one row
    rows = F.array(*[F.struct(F.lit(x).alias("value"), F.col(f"v{x}").alias("n")) for x in values])
    return one.select("total", F.inline(rows)).select("value", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def in_metres(df: DataFrame, column: str, low: float = 800.0, span: float = 600.0) -> DataFrame:
    """Elevations that are stored within 0 and 1, or as scores below 10, in metres; others as they are. Nulls stay."""
    ends = F.broadcast(df.agg(F.min(column).alias("lo_"), F.max(column).alias("hi_")))  # one row
    x, lo, hi = F.col(column), F.col("lo_"), F.col("hi_")
    metres = F.when((lo >= 0) & (hi <= 1), x * span + low).when(hi < 10, low + (x - lo) / F.greatest(hi - lo, F.lit(1e-8)) * span).otherwise(x)
    return df.crossJoin(ends).withColumn(column, metres).drop("lo_", "hi_")


def band(pixels: DataFrame, values: DataFrame, column: str, nodata) -> DataFrame:
    """(row, col, column) of every pixel; nodata, in the band's own type, where there is no value."""
    kind = values.schema[column].dataType
    return pixels.join(values, "node_id", "left").select("row", "col", F.coalesce(column, F.lit(nodata).cast(kind)).alias(column))
