"""Every terrain query by name, with the DuckDB statement that gives the same rows.

A query is a thin call of operators over the views of a folder; doubles are rounded to six places, as the
last bits of sums and logarithms differ between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrove.functions import scalar as S
from cellgrove.operators import analysis, forest, grid, learn, losses, metrics, quality, raster, rules, split, uncertainty
from cellgrove.plans import oracle
from cellgrove.sources import dimensions, files
from cellgrove.sources.dimensions import MODELS, PROFILES
from cellgrove.sources.views import Views
from cellgrove.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FEATURES = ["elevation_m", "slope", "tpi", "tri", "ndvi", "ndwi", "water_mask", "lidar_available"]
VIEWS = oracle.views()


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Views; sql follows the oracle's views (more of them start with a comma)."""

    def add(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = f"{VIEWS}\n{sql}"
        return fn

    return add


def r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# rules ---------------------------------------------------------------------------------------------------

DIST = "dist AS (SELECT p.profile, c.y, count(l.node_id) AS n, CASE WHEN max(t.total) > 0 THEN 100.0E0 * count(l.node_id) / max(t.total) ELSE 0.0E0 END AS pct FROM limits p CROSS JOIN classes c LEFT JOIN labels_cell l ON l.profile = p.profile AND l.y = c.y CROSS JOIN (SELECT count(*) AS total FROM cells) t GROUP BY p.profile, c.y)"


def _distribution(v: Views) -> DataFrame:
    return quality.class_distribution(v.labels(), dimensions.profiles(v.spark), dimensions.classes(v.spark))


@query("class_distribution", f", {DIST} SELECT profile, y, n, ROUND(pct, 6) AS pct FROM dist")
def _(v):
    return r6(_distribution(v))


@query("class_weights", f", {DIST} SELECT profile, y, ROUND(CASE WHEN n = 0 THEN 1.0E0 ELSE sum(n) OVER (PARTITION BY profile) / (3 * n) END, 6) AS weight FROM dist")
def _(v):
    return r6(quality.class_weights(_distribution(v)))


def _classify_one(profile: str) -> None:
    @query(f"classify_profile_{profile}", f"SELECT node_id, y FROM labels_cell WHERE profile = '{profile}'")
    def _(v):
        return rules.classify(v.cells(), v.limits().where(F.col("profile") == profile)).select("node_id", "y")


for _profile in PROFILES:
    _classify_one(_profile)


@query("rule_baseline_labels", "SELECT node_id, profile, y FROM baseline_cell")
def _(v):
    return rules.classify_baseline(v.cells(), dimensions.baseline_limits(v.spark)).select("node_id", "profile", "y")


@query("rule_vs_baseline_agreement", "SELECT profile, count(*) AS n, count(*) FILTER (l.y = b.y) AS same, count(*) FILTER (l.y < b.y) AS less FROM labels_cell l JOIN baseline_cell b USING (node_id, profile) GROUP BY profile")
def _(v):
    both = rules.classify(v.cells(), v.limits()).select("node_id", "profile", "slope", "ndvi", "ndwi", "water_mask", "y").join(F.broadcast(dimensions.baseline_limits(v.spark)), "profile")
    b = rules.baseline_class()
    return both.select("profile", "y", b.alias("b")).groupBy("profile").agg(F.count("*").alias("n"), F.count_if(F.col("y") == F.col("b")).alias("same"), F.count_if(F.col("y") < F.col("b")).alias("less"))


INDICATORS = "SELECT node_id, slope, tri, CASE WHEN slope * 90.0E0 > 30 THEN 1.0E0 ELSE 0.0E0 END AS steep, CASE WHEN slope * 90.0E0 > 45 THEN 1.0E0 ELSE 0.0E0 END AS very_steep, CASE WHEN ndvi > 0.5E0 THEN 1.0E0 ELSE 0.0E0 END AS dense, CASE WHEN ndwi > 0.3E0 OR water_mask > 0.5E0 THEN 1.0E0 ELSE 0.0E0 END AS water, CASE WHEN tri > 0.5E0 THEN 1.0E0 ELSE 0.0E0 END AS rugged FROM cells"


@query("movement_indicators", f"SELECT node_id, steep, very_steep, dense, water, rugged FROM ({INDICATORS})")
def _(v):
    return rules.movement_indicators(v.cells()).select("node_id", "steep", "very_steep", "dense", "water", "rugged")


@query("difficulty_index", f"SELECT node_id, ROUND(0.4E0 * least(greatest(slope, 0.0E0), 1.0E0) + 0.2E0 * dense + 0.2E0 * water + 0.2E0 * (least(greatest(tri, -1.0E0), 1.0E0) + 1) / 2, 6) AS difficulty FROM ({INDICATORS})")
def _(v):
    return r6(rules.difficulty(v.cells()).select("node_id", "difficulty"))


@query("class_descriptions", "SELECT node_id, profile, description FROM labels_cell JOIN classes USING (y)")
def _(v):
    return v.labels().join(F.broadcast(dimensions.classes(v.spark)), "y").select("node_id", "profile", "description")


@query("sanitize_features", "SELECT node_id, CASE WHEN node_id % 10 IN (0, 1) THEN 0.0E0 ELSE slope END AS slope FROM cells")
def _(v):
    broken = v.cells().select("node_id", F.when(F.col("node_id") % 10 == 0, float("nan")).when(F.col("node_id") % 10 == 1, float("inf")).otherwise(F.col("slope")).alias("slope"))
    return broken.select("node_id", S.sanitize(F.col("slope")).alias("slope"))


@query("drop_lidar_features", "SELECT node_id, elevation_m, ROUND(slope, 6) AS slope, ROUND(ndvi, 6) AS ndvi, ROUND(ndwi, 6) AS ndwi, water_mask FROM cells")
def _(v):
    return r6(v.cells().select("node_id", "elevation_m", "slope", "ndvi", "ndwi", "water_mask", "lidar_available").drop("lidar_available"))


@query("critical_features", "SELECT node_id, ROUND(slope * 90.0E0, 6) AS slope_deg, ROUND(tpi, 6) AS tpi, ROUND(tri, 6) AS tri, ROUND(ndvi, 6) AS ndvi, ROUND(ndwi, 6) AS ndwi, water_mask, elevation_m, lidar_available FROM cells")
def _(v):
    return r6(v.cells().select("node_id", (F.col("slope") * 90.0).alias("slope_deg"), "tpi", "tri", "ndvi", "ndwi", "water_mask", "elevation_m", "lidar_available"))


@query("reflectance", "SELECT node_id, ROUND(least(greatest(b04 / 10000.0E0, 0.0E0), 1.0E0), 6) AS b04_norm, ROUND(CASE WHEN b08 + b04 = 0 THEN NULL ELSE least(greatest((b08 - b04) / (b08 + b04), -1.0E0), 1.0E0) END, 6) AS ndvi, CASE WHEN (b03 - b08) / NULLIF(b03 + b08, 0) > 0.15E0 THEN 1 ELSE 0 END AS wet FROM cells")
def _(v):
    ndwi = S.normalized_difference(F.col("b03").cast("double"), F.col("b08").cast("double"))
    return r6(v.cells().select("node_id", S.clip(F.col("b04") / 10000.0, 0.0, 1.0).alias("b04_norm"), S.normalized_difference(F.col("b08").cast("double"), F.col("b04").cast("double")).alias("ndvi"), F.when(ndwi > 0.15, 1).otherwise(0).alias("wet")))


# grid ----------------------------------------------------------------------------------------------------


@query("grid_shape", "SELECT n, h, w, count(DISTINCT \"row\") AS rows_seen, count(DISTINCT col) AS cols_seen, count(DISTINCT \"row\") * count(DISTINCT col) = n AS regular FROM cells, grid GROUP BY n, h, w")
def _(v):
    n, h, w = v.shape
    seen = v.cells().agg(F.countDistinct("row").alias("rows_seen"), F.countDistinct("col").alias("cols_seen"))
    return seen.select(long(F.lit(n)).alias("n"), long(F.lit(h)).alias("h"), long(F.lit(w)).alias("w"), "rows_seen", "cols_seen", (F.col("rows_seen") * F.col("cols_seen") == n).alias("regular"))


@query("edges_8n", "SELECT src, dst, ROUND(dist, 6) AS dist FROM edges WHERE src <> dst")
def _(v):
    return r6(v.edges(False).select("src", "dst", "dist"))


@query("edges_self_loops", "SELECT count(*) AS edges, count(*) FILTER (src = dst) AS loops, ROUND(sum(dist), 3) AS length FROM edges")
def _(v):
    return v.edges().agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.round(F.sum("dist"), 3).alias("length"))


@query("edge_attributes", "SELECT src, dst, ROUND(dist, 6) AS dist, b.elevation_m - a.elevation_m AS dz FROM edges JOIN cells a ON src = a.node_id JOIN cells b ON dst = b.node_id")
def _(v):
    near = v.neighbours(["elevation_m"])
    return r6(near.select("src", "dst", "dist", (F.col("elevation_m_dst") - F.col("elevation_m_src")).alias("dz")))


@query("degree_histogram", "SELECT degree, count(*) AS cells FROM (SELECT dst, count(*) AS degree FROM edges GROUP BY dst) GROUP BY degree")
def _(v):
    return v.edges().groupBy("dst").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("cells"))


@query("row_col_truncate", "SELECT node_id, least(greatest(CAST(FLOOR((4.9755E0 - lat) / 0.0005E0) AS BIGINT), 0), h - 1) AS r, least(greatest(CAST(FLOOR((lon - -61.6138E0) / 0.0005E0) AS BIGINT), 0), w - 1) AS c FROM cells, grid")
def _(v):
    _, h, w = v.shape
    return grid.place_truncate(v.cells(), h, w, 4.9755, -61.6138, 0.0005).select("node_id", "r", "c")


@query("row_col_round", "SELECT node_id, r, c FROM (SELECT node_id, CAST(round_even((4.97E0 - lat) / 0.0003E0, 0) AS BIGINT) AS r, CAST(round_even((lon - -61.61E0) / 0.0003E0, 0) AS BIGINT) AS c FROM cells), grid WHERE r >= 0 AND r < h AND c >= 0 AND c < w")
def _(v):
    _, h, w = v.shape
    return grid.place_round(v.cells(), h, w, 4.97, -61.61, 0.0003).select("node_id", "r", "c")


@query("dense_grid_fill", "SELECT \"row\", col, COALESCE(elevation, -9999) AS elevation FROM cells LEFT JOIN (SELECT node_id, max_by(elevation, event_id) AS elevation FROM points GROUP BY node_id) USING (node_id)")
def _(v):
    last = v.points().groupBy("node_id").agg(F.max_by("elevation", "event_id").alias("elevation"))
    return v.cells().select("node_id", "row", "col").join(last, "node_id", "left").select("row", "col", F.coalesce("elevation", F.lit(-9999)).alias("elevation"))


@query("required_tiles", ", boxes AS (SELECT split, min(lat) - 7.5E0 AS south, max(lat) + 1.5E0 AS north, min(lon) - 1.5E0 AS west, max(lon) + 63.5E0 AS east FROM cells JOIN cell_splits USING (node_id) GROUP BY split) SELECT split, CAST(lat AS INTEGER) AS lat, CAST(lon AS INTEGER) AS lon, (CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END) || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || (CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) || lpad(CAST(abs(lon) AS VARCHAR), 3, '0') AS tile FROM boxes, range(-10, 20) a(lat), range(-70, 10) b(lon) WHERE lat >= floor(south) AND lat < north AND lon >= floor(west) AND lon < east")
def _(v):
    """Tiles of the box around the cells of each split, with margins that reach over the equator and the meridian."""
    boxes = v.cells().join(v.cell_splits().select("node_id", "split"), "node_id").groupBy("split").agg((F.min("lat") - 7.5).alias("south"), (F.min("lon") - 1.5).alias("west"), (F.max("lat") + 1.5).alias("north"), (F.max("lon") + 63.5).alias("east"))
    return grid.tiles_of(boxes)


@query("chunk_rectangles", """, axis_r AS (SELECT s AS r0, least(s + 50, h) AS r1, CASE WHEN s > 0 THEN s + 5 ELSE 0 END AS rv0, CASE WHEN s + 50 < h THEN s + 45 ELSE h END AS rv1 FROM grid, range(0, 100000, 40) t(s) WHERE s = 0 OR s + 10 < h),
axis_c AS (SELECT s AS c0, least(s + 50, w) AS c1, CASE WHEN s > 0 THEN s + 5 ELSE 0 END AS cv0, CASE WHEN s + 50 < w THEN s + 45 ELSE w END AS cv1 FROM grid, range(0, 100000, 40) t(s) WHERE s = 0 OR s + 10 < w)
SELECT CAST(r0 AS INTEGER) AS r0, CAST(c0 AS INTEGER) AS c0, CAST(r1 AS INTEGER) AS r1, CAST(c1 AS INTEGER) AS c1, CAST(rv0 AS INTEGER) AS rv0, CAST(cv0 AS INTEGER) AS cv0, CAST(rv1 AS INTEGER) AS rv1, CAST(cv1 AS INTEGER) AS cv1 FROM axis_r, axis_c WHERE rv0 < rv1 AND cv0 < cv1""")
def _(v):
    _, h, w = v.shape
    return grid.chunk_rectangles(v.spark, h, w, 50, 10, 5).select("r0", "c0", "r1", "c1", "rv0", "cv0", "rv1", "cv1")


@query("focal_stats_3x3", "SELECT dst AS node_id, b.elevation_m AS value, ROUND(avg(a.elevation_m), 6) AS mean, min(a.elevation_m) AS low, max(a.elevation_m) AS high FROM edges JOIN cells a ON src = a.node_id JOIN cells b ON dst = b.node_id GROUP BY dst, b.elevation_m")
def _(v):
    return r6(grid.focal(v.neighbours(["elevation_m"]), "elevation_m").select("node_id", "value", "mean", "low", "high"))


@query("focal_topography", "SELECT dst AS node_id, ROUND(b.elevation_m - avg(a.elevation_m), 6) AS position, max(a.elevation_m) - min(a.elevation_m) AS roughness FROM edges JOIN cells a ON src = a.node_id JOIN cells b ON dst = b.node_id GROUP BY dst, b.elevation_m")
def _(v):
    return r6(grid.focal(v.neighbours(["elevation_m"]), "elevation_m").select("node_id", "position", "roughness"))


@query("pixel_to_cell", "SELECT CAST(FLOOR(\"row\" / 3) AS BIGINT) AS cell_row, CAST(FLOOR(col / 3) AS BIGINT) AS cell_col, count(*) AS pixels, ROUND(avg(b08), 6) AS b08 FROM cells GROUP BY 1, 2")
def _(v):
    return r6(v.cells().groupBy(F.floor(F.col("row") / 3).alias("cell_row"), F.floor(F.col("col") / 3).alias("cell_col")).agg(F.count("*").alias("pixels"), F.avg("b08").alias("b08")))


@query("lidar_knn", """, o5 AS (SELECT dr, dc FROM range(-2, 3) a(dr), range(-2, 3) b(dc)),
near AS (SELECT event_id, dr * dr + dc * dc AS d2, (CAST(FLOOR(node_id / w) AS BIGINT) + dr) * w + node_id % w + dc AS cell_id FROM points, grid, o5 WHERE CAST(FLOOR(node_id / w) AS BIGINT) + dr BETWEEN 0 AND h - 1 AND node_id % w + dc BETWEEN 0 AND w - 1)
SELECT event_id, cell_id, CAST(d2 AS INTEGER) AS d2 FROM near QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d2, cell_id) <= 8""")
def _(v):
    _, h, w = v.shape
    return grid.nearest_points(v.points(), v.cells(), w, h).select("event_id", "cell_id", "d2")


@query("fallback_positions", "SELECT node_id, node_id % s AS x, CAST(FLOOR(node_id / s) AS BIGINT) AS y FROM cells, (SELECT CAST(FLOOR(sqrt(n)) AS BIGINT) AS s FROM n0)")
def _(v):
    s = int(v.shape[0] ** 0.5)
    return v.cells().select("node_id", (F.col("node_id") % s).alias("x"), F.floor(F.col("node_id") / s).alias("y"))


@query("lat_lon_rank", "SELECT node_id, CAST(dense_rank() OVER (ORDER BY lat DESC) - 1 AS BIGINT) AS r, CAST(dense_rank() OVER (ORDER BY lon) - 1 AS BIGINT) AS c FROM cells")
def _(v):
    # the distinct coordinates of a raster's axes are ranked, not its cells
    cells = v.cells().select("node_id", "lat", "lon")
    lats = cells.select("lat").distinct().withColumn("r", long(F.row_number().over(Window.orderBy(F.desc("lat"))) - 1))
    lons = cells.select("lon").distinct().withColumn("c", long(F.row_number().over(Window.orderBy("lon")) - 1))
    return cells.join(lats, "lat").join(lons, "lon").select("node_id", "r", "c")


@query("pixel_size", "SELECT ROUND(median(d), 9) AS step FROM (SELECT lon - lag(lon) OVER (ORDER BY lon) AS d FROM (SELECT DISTINCT lon FROM cells)) WHERE d IS NOT NULL")
def _(v):
    lons = v.cells().select("lon").distinct()
    return lons.select((F.col("lon") - F.lag("lon").over(Window.orderBy("lon"))).alias("d")).agg(F.round(F.median("d"), 9).alias("step"))


@query("map_extent", "SELECT ROUND(min(lat), 6) AS south, ROUND(max(lat), 6) AS north, ROUND(min(lon), 6) AS west, ROUND(max(lon), 6) AS east, min(elevation_m) AS low, max(elevation_m) AS high, ROUND(avg(elevation_m), 6) AS mean, ROUND(median(elevation_m), 6) AS middle FROM cells")
def _(v):
    return r6(v.cells().agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("elevation_m").alias("low"), F.max("elevation_m").alias("high"), F.avg("elevation_m").alias("mean"), F.median("elevation_m").alias("middle")))


@query("quadrants", "SELECT CASE WHEN lat < 4.97E0 THEN 'S' ELSE 'N' END || CASE WHEN lon < -61.6E0 THEN 'W' ELSE 'E' END AS quadrant, count(*) AS n FROM cells GROUP BY 1")
def _(v):
    q = F.concat(F.when(F.col("lat") < 4.97, "S").otherwise("N"), F.when(F.col("lon") < -61.6, "W").otherwise("E"))
    return v.cells().groupBy(q.alias("quadrant")).agg(F.count("*").alias("n"))


@query("decimated", "SELECT \"row\", col, elevation_m FROM cells WHERE \"row\" % 4 = 0 AND col % 4 = 0")
def _(v):
    return v.cells().where("row % 4 = 0 and col % 4 = 0").select("row", "col", "elevation_m")


@query("middle_profile", "SELECT col, elevation_m FROM cells, grid WHERE \"row\" = CAST(FLOOR(h / 2) AS BIGINT)")
def _(v):
    return v.cells().where(F.col("row") == v.shape[1] // 2).orderBy("col").select("col", "elevation_m")


@query("window_class_share", "SELECT profile, y, count(*) AS n, ROUND(100.0E0 * count(*) / sum(count(*)) OVER (PARTITION BY profile), 6) AS pct FROM labels_all WHERE lon BETWEEN -61.6138E0 AND -61.6095E0 AND lat BETWEEN 4.9715E0 AND 4.9755E0 GROUP BY profile, y")
def _(v):
    at = rules.classify(v.cells().where(F.col("lon").between(-61.6138, -61.6095) & F.col("lat").between(4.9715, 4.9755)), v.limits())
    n = at.groupBy("profile", "y").agg(F.count("*").alias("n"))
    return r6(n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("profile"))))


# split ---------------------------------------------------------------------------------------------------


@query("block_ids", "SELECT block_id, count(*) AS cells FROM blocks GROUP BY block_id")
def _(v):
    return v.blocks().groupBy("block_id").agg(F.count("*").alias("cells"))


@query("block_split", "SELECT block_id, split FROM splits")
def _(v):
    return v.splits()


@query("split_counts", "SELECT split, count(*) AS cells, count(DISTINCT block_id) AS blocks FROM cell_splits GROUP BY split")
def _(v):
    return v.cell_splits().groupBy("split").agg(F.count("*").alias("cells"), F.countDistinct("block_id").alias("blocks"))


@query("split_class_distribution", "SELECT split, profile, count(*) FILTER (y = 1) AS go, count(*) FILTER (y = 2) AS slow, count(*) FILTER (y = 3) AS nogo FROM labels_cell JOIN cell_splits USING (node_id) GROUP BY split, profile")
def _(v):
    joined = v.labels().join(v.cell_splits(), "node_id")
    return joined.groupBy("split", "profile").agg(*[F.count_if(F.col("y") == i).alias(n) for i, n in enumerate(("go", "slow", "nogo"), 1)])


@query("cross_split_edges", "SELECT least(a.split, b.split) AS split_a, greatest(a.split, b.split) AS split_b, count(*) AS edges FROM edges JOIN cell_splits a ON src = a.node_id JOIN cell_splits b ON dst = b.node_id WHERE src < dst GROUP BY 1, 2")
def _(v):
    n, h, w = v.shape
    near = grid.neighbours(v.cells().select("node_id", "row", "col").join(v.cell_splits(), "node_id"), ["split"], h, w, False)
    a, b = F.least("split_src", "split_dst"), F.greatest("split_src", "split_dst")
    return near.where("src < dst").groupBy(a.alias("split_a"), b.alias("split_b")).agg(F.count("*").alias("edges"))


@query("block_purity", "SELECT split, count(*) AS blocks, count(*) FILTER (kinds = 1) AS pure FROM (SELECT block_id, min(split) AS split, count(DISTINCT split) AS kinds FROM cell_splits GROUP BY block_id) GROUP BY split")
def _(v):
    cs = v.cell_splits()
    return split.purity(cs.select("node_id", "block_id"), cs.select("node_id", "split")).select("split", "blocks", long("pure").alias("pure"))


@query("buffer_exclusion", "SELECT c.split, count(*) AS cells FROM cell_splits c JOIN cells x USING (node_id) WHERE c.split <> 'train' AND NOT EXISTS (SELECT 1 FROM cell_splits t JOIN cells y USING (node_id) WHERE t.split = 'train' AND abs(x.\"row\" - y.\"row\") <= 2 AND abs(x.col - y.col) <= 2) GROUP BY c.split")
def _(v):
    return split.buffered(v.cell_splits().select("node_id", "split"), v.cells(), 2).groupBy("split").agg(F.count("*").alias("cells"))


@query("block_borders", "SELECT col, ROUND(avg(CASE WHEN split <> before THEN 1.0E0 ELSE 0.0E0 END), 6) AS changed FROM (SELECT \"row\", col, split, lag(split) OVER (PARTITION BY \"row\" ORDER BY col) AS before FROM cells JOIN cell_splits USING (node_id)) WHERE before IS NOT NULL GROUP BY col HAVING avg(CASE WHEN split <> before THEN 1.0E0 ELSE 0.0E0 END) > 0.05E0")
def _(v):
    at = v.cells().select("node_id", "row", "col").join(v.cell_splits(), "node_id")
    return r6(raster.border_columns(at, "split", 0.05))


@query("mask_disjointness", "SELECT 'two_splits' AS \"check\", count(*) AS cells FROM (SELECT node_id FROM cell_splits WHERE split = 'train' INTERSECT SELECT node_id FROM cell_splits WHERE split <> 'train') UNION ALL SELECT 'uncovered', count(*) FROM (SELECT node_id FROM cells EXCEPT SELECT node_id FROM cell_splits)")
def _(v):
    cs = v.cell_splits()
    two = cs.where("split = 'train'").select("node_id").intersect(cs.where("split <> 'train'").select("node_id"))
    bare = v.cells().select("node_id").subtract(cs.select("node_id"))
    return two.agg(F.count("*").alias("cells")).select(F.lit("two_splits").alias("check"), "cells").union(bare.agg(F.count("*").alias("cells")).select(F.lit("uncovered"), "cells"))


# quality -------------------------------------------------------------------------------------------------

LONG = "flat AS (" + " UNION ALL ".join(f"SELECT node_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM cells" for c in FEATURES) + ")"


@query("feature_stats", f", {LONG} SELECT feature, ROUND(min(value), 6) AS low, ROUND(max(value), 6) AS high, ROUND(avg(value), 6) AS mean, ROUND(stddev_samp(value), 6) AS std FROM flat GROUP BY feature")
def _(v):
    return r6(quality.feature_stats(v.cells(), FEATURES))


@query("column_profile", f", {LONG} SELECT feature, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls, count(*) FILTER (isnan(value)) AS nans, ROUND(avg(value), 6) AS mean, ROUND(100.0E0 * count(*) FILTER (value = 0) / count(*), 6) AS zero_pct FROM flat GROUP BY feature")
def _(v):
    return r6(quality.column_profile(v.cells(), FEATURES).select("feature", "n", "nulls", "nans", "mean", "zero_pct"))


@query("nan_inf_counts", "SELECT count(*) FILTER (node_id % 7 = 0) AS nans, count(*) FILTER (node_id % 7 = 1) AS infs, count(*) FILTER (node_id % 7 > 1) AS finite FROM cells")
def _(v):
    x = v.cells().select(F.when(F.col("node_id") % 7 == 0, float("nan")).when(F.col("node_id") % 7 == 1, float("-inf")).otherwise(F.col("slope")).alias("x"))
    p = quality.column_profile(x, ["x"])
    return p.select("nans", "infs", (F.col("n") - F.col("nans") - F.col("infs")).alias("finite"))


@query("range_checks", f", {LONG} SELECT feature, ROUND(min(value), 6) AS lo, ROUND(max(value), 6) AS hi, min(value) >= min(low) AND max(value) <= max(high) AS passed FROM flat JOIN ranges USING (feature) GROUP BY feature")
def _(v):
    return r6(quality.range_checks(v.cells(), dimensions.ranges(v.spark)))


@query("graph_checks", "SELECT 'ids_not_negative' AS \"check\", min(least(src, dst)) >= 0 AS passed, CAST(min(least(src, dst)) AS DOUBLE) AS value FROM edges UNION ALL SELECT 'ids_below_n', max(greatest(src, dst)) < max(n), CAST(max(greatest(src, dst)) AS DOUBLE) FROM edges, n0 UNION ALL SELECT 'mean_degree', abs(count(*) / max(n) - 9) <= 2, ROUND(count(*) / max(n), 6) FROM edges, n0")
def _(v):
    return r6(quality.graph_checks(v.edges(), v.shape[0], 9.0, 2.0))


@query("label_value_check", "SELECT profile, min(y) AS low, max(y) AS high, count(DISTINCT y) AS kinds, min(y) >= 1 AND max(y) <= 3 AS passed FROM labels_cell GROUP BY profile")
def _(v):
    return quality.label_checks(v.labels())


@query("label_distribution_check", f", {DIST} SELECT profile, y, ROUND(pct, 6) AS pct, CASE WHEN pct < 1 THEN 'rare' WHEN pct > 95 THEN 'dominant' ELSE 'ok' END AS level FROM dist")
def _(v):
    return r6(quality.bounds_checks(_distribution(v)))


@query("label_consistency", "SELECT count(*) AS n, count(*) FILTER (a.y > b.y) AS worse, ROUND(100.0E0 * count(*) FILTER (a.y > b.y) / count(*), 6) AS pct FROM labels_cell a JOIN labels_cell b USING (node_id) WHERE a.profile = 'a_pe' AND b.profile = 'motorizada'")
def _(v):
    return r6(quality.consistency(v.labels()))


@query("label_coverage", "SELECT p.profile, c.y FROM limits p CROSS JOIN classes c WHERE NOT EXISTS (SELECT 1 FROM labels_cell l WHERE l.profile = p.profile AND l.y = c.y)")
def _(v):
    return quality.missing_classes(v.labels(), dimensions.profiles(v.spark), dimensions.classes(v.spark))


def _label_neighbours(v: Views, self_loops: bool = True) -> DataFrame:
    """Edges with both ends' classes by profile: the four classes are columns of the cell, so edges are joined once."""
    _, h, w = v.shape
    wide = v.cells().select("node_id", "row", "col", "slope", "ndvi", "ndwi", "water_mask")
    one = rules.class_columns(wide, dimensions.LIMITS).select("node_id", "row", "col", *PROFILES)
    near = grid.neighbours(one, list(PROFILES), h, w, self_loops)
    rows = F.array(*[F.struct(F.lit(p).alias("profile"), F.col(f"{p}_src").alias("y_src"), F.col(f"{p}_dst").alias("y_dst")) for p in PROFILES])
    return near.select("src", "dst", F.inline(rows))


LABEL_EDGES = "FROM edges JOIN labels_cell a ON src = a.node_id JOIN labels_cell b ON dst = b.node_id AND a.profile = b.profile"


@query("spatial_coherence", f"SELECT a.profile, count(*) AS edges, ROUND(avg(CASE WHEN a.y = b.y THEN 1.0E0 ELSE 0.0E0 END), 6) AS coherence {LABEL_EDGES} GROUP BY a.profile")
def _(v):
    return r6(quality.coherence(_label_neighbours(v)))


@query("validation_rollup", f", {LONG}, checks AS (SELECT min(y) >= 1 AND max(y) <= 3 AS passed FROM labels_cell GROUP BY profile UNION ALL SELECT min(value) >= min(low) AND max(value) <= max(high) FROM flat JOIN ranges USING (feature) GROUP BY feature) SELECT count(*) FILTER (passed) AS passed, count(*) AS total, ROUND(100.0E0 * count(*) FILTER (passed) / count(*), 6) AS success_rate FROM checks")
def _(v):
    return r6(quality.roll_up([quality.label_checks(v.labels()), quality.range_checks(v.cells(), dimensions.ranges(v.spark))]))


@query("node_edge_totals", "SELECT kind, name, count(*) AS n FROM (SELECT 'node' AS kind, 'cell' AS name FROM cells UNION ALL SELECT 'node', 'point' FROM points UNION ALL SELECT 'edge', CASE WHEN src = dst THEN 'loop' ELSE 'adjacent' END FROM edges) GROUP BY ROLLUP (kind, name)")
def _(v):
    def of(df: DataFrame, kind: str, name: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), name.alias("name"))

    rows = of(v.cells(), "node", F.lit("cell")).union(of(v.points(), "node", F.lit("point"))).union(of(v.edges(), "edge", F.when(F.col("src") == F.col("dst"), "loop").otherwise("adjacent")))
    return rows.rollup("kind", "name").agg(F.count("*").alias("n"))


@query("class_cube", "SELECT profile, split, y, count(*) AS n FROM labels_cell JOIN cell_splits USING (node_id) GROUP BY CUBE (profile, split, y)")
def _(v):
    return v.labels().join(v.cell_splits(), "node_id").cube("profile", "split", "y").agg(F.count("*").alias("n"))


@query("dataset_metadata", "SELECT 'cells' AS name, count(*) AS n FROM cells UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'points', count(*) FROM points UNION ALL SELECT 'labels', count(*) FROM labels_cell")
def _(v):
    parts = [("cells", v.cells()), ("edges", v.edges()), ("points", v.points()), ("labels", v.labels())]
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in parts]
    return out[0].union(out[1]).union(out[2]).union(out[3])


# metrics -------------------------------------------------------------------------------------------------

KEYS = ["profile", "model"]


def _cube(v: Views) -> DataFrame:
    return metrics.cube_of_models(v.wide(), KEYS, MODELS)


@query("confusion", "SELECT profile, model, CAST(a AS INTEGER) AS y, CAST(b AS INTEGER) AS pred, count(p.node_id) AS n FROM (SELECT DISTINCT profile, model FROM preds) k CROSS JOIN range(1, 4) t(a) CROSS JOIN range(1, 4) u(b) LEFT JOIN preds p USING (profile, model) WHERE p.y = a AND p.pred = b GROUP BY profile, model, a, b UNION ALL SELECT profile, model, CAST(a AS INTEGER), CAST(b AS INTEGER), 0 FROM (SELECT DISTINCT profile, model FROM preds) k CROSS JOIN range(1, 4) t(a) CROSS JOIN range(1, 4) u(b) WHERE NOT EXISTS (SELECT 1 FROM preds p WHERE p.profile = k.profile AND p.model = k.model AND p.y = a AND p.pred = b)")
def _(v):
    return metrics.dense_confusion(_cube(v), KEYS).select("profile", "model", "y", "pred", long("n").alias("n"))


@query("model_scores", oracle.scores("profile, model", "preds"))
def _(v):
    return r6(metrics.scores(_cube(v), KEYS))


@query("accuracy", "SELECT profile, model, ROUND(avg(CASE WHEN y = pred THEN 1.0E0 ELSE 0.0E0 END), 6) AS accuracy FROM preds GROUP BY profile, model")
def _(v):
    return r6(metrics.scores(_cube(v), KEYS).select(*KEYS, "accuracy"))


@query("macro_f1", oracle.scores("profile, model", "preds", columns="ROUND(macro_f1, 6) AS macro_f1"))
def _(v):
    return r6(metrics.scores(_cube(v), KEYS).select(*KEYS, "macro_f1"))


@query("weighted_f1", oracle.scores("profile, model", "preds", columns="ROUND(weighted_f1, 6) AS weighted_f1"))
def _(v):
    return r6(metrics.scores(_cube(v), KEYS).select(*KEYS, "weighted_f1"))


PRF = ", prf AS (SELECT profile, model, c AS class, count(*) FILTER (y = c AND pred = c) AS t, count(*) FILTER (y = c) AS s, count(*) FILTER (pred = c) AS q FROM preds, (VALUES (1), (2), (3)) AS k(c) GROUP BY profile, model, c), pr AS (SELECT *, CASE WHEN q > 0 THEN t / (q + {eps}) ELSE 0.0E0 END AS precision, CASE WHEN s > 0 THEN t / (s + {eps}) ELSE 0.0E0 END AS recall FROM prf) "


@query("per_class_prf", PRF.format(eps="1e-9") + "SELECT profile, model, class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall + 1e-9) ELSE 0.0E0 END, 6) AS f1 FROM pr")
def _(v):
    return r6(metrics.per_class(_cube(v), KEYS))


@query("slowgo_f1", PRF.format(eps="1e-8") + "SELECT profile, model, ROUND(2 * precision * recall / (precision + recall + 1e-8), 6) AS f1 FROM pr WHERE class = 2")
def _(v):
    return r6(metrics.per_class(_cube(v), KEYS, 1e-8).where("class = 2").select(*KEYS, "f1"))


@query("model_comparison_pivot", f"SELECT profile, {', '.join(f'''max(CASE WHEN model = '{m}' THEN macro_f1 END) AS {m}''' for m in MODELS)} FROM ({oracle.scores('profile, model', 'preds', columns='ROUND(macro_f1, 6) AS macro_f1')}) GROUP BY profile")
def _(v):
    return r6(metrics.pivot_models(metrics.scores(_cube(v), KEYS), MODELS))


ASYM = "n, dangerous, conservative, under, \"over\", ROUND(100.0E0 * dangerous / n, 6) AS dangerous_pct, ROUND(100.0E0 * conservative / n, 6) AS conservative_pct, ROUND(dangerous / (conservative + 1e-8), 6) AS ratio"


@query("asymmetric_error", f"SELECT profile, model, {ASYM} FROM (SELECT profile, model, count(*) AS n, count(*) FILTER (pred = 1 AND y > 1) AS dangerous, count(*) FILTER (pred > 1 AND y = 1) AS conservative, count(*) FILTER (pred < y) AS under, count(*) FILTER (pred > y) AS \"over\" FROM preds GROUP BY profile, model)")
def _(v):
    return r6(metrics.asymmetric(_cube(v), KEYS))


@query("error_types", "SELECT profile, model, CAST(sign(pred - y) AS INTEGER) AS kind, count(*) AS n FROM preds GROUP BY ALL")
def _(v):
    return _cube(v).groupBy(*KEYS, F.signum(F.col("pred") - F.col("y")).cast("int").alias("kind")).agg(F.sum("n").alias("n"))


@query("test_only_scores", oracle.scores("profile, model", "(SELECT p.* FROM preds p JOIN cell_splits s USING (node_id) WHERE s.split = 'test')"))
def _(v):
    tested = v.wide().join(v.cell_splits().where("split = 'test'").select("node_id"), "node_id", "left_semi")
    return r6(metrics.scores(metrics.cube_of_models(tested, KEYS, MODELS), KEYS))


# analysis ------------------------------------------------------------------------------------------------


def _zoned(v: Views) -> DataFrame:
    cells = v.cells().select("node_id", "ndvi", "slope")
    limits = F.broadcast(v.limits().select("profile", "ndvi_1"))  # four rows
    return v.wide().join(cells, "node_id").join(limits, "profile").withColumns({"zone": analysis.ndvi_zone(F.col("ndvi"), F.col("ndvi_1")), "slope_zone": analysis.slope_zone(F.col("slope"))})


@query("f1_by_ndvi_band", oracle.scores("profile, zone, model", "zones", columns="n, ROUND(macro_f1, 6) AS macro_f1"))
def _(v):
    keys = ["profile", "zone", "model"]
    return r6(metrics.scores(metrics.cube_of_models(_zoned(v), keys, MODELS), keys).select(*keys, "n", "macro_f1"))


@query("f1_by_slope_band", oracle.scores("profile, slope_zone, model", "zones", columns="n, ROUND(macro_f1, 6) AS macro_f1"))
def _(v):
    keys = ["profile", "slope_zone", "model"]
    return r6(metrics.scores(metrics.cube_of_models(_zoned(v), keys, MODELS), keys).select(*keys, "n", "macro_f1"))


@query("f1_cumulative_band", "SELECT * FROM (" + " UNION ALL ".join(oracle.scores("profile, model", "zones", w, f"'{b}' AS band, n, ROUND(macro_f1, 6) AS macro_f1") for b, w in (("far", "zone = 'far'"), ("transition", "zone <> 'far'"), ("core", "zone = 'close'"))) + ")")
def _(v):
    c = metrics.cube_of_models(_zoned(v), ["profile", "model", "zone"], MODELS)
    # a row counts in every band that it lies in: core is part of transition
    banded = c.select("*", F.explode(F.when(F.col("zone") == "far", F.array(F.lit("far"))).when(F.col("zone") == "close", F.array(F.lit("transition"), F.lit("core"))).otherwise(F.array(F.lit("transition")))).alias("band"))
    keys = ["profile", "model", "band"]
    return r6(metrics.scores(banded, keys).select(*keys, "n", "macro_f1"))


def _wide(v: Views) -> DataFrame:
    return v.wide().join(v.cells().select("node_id", *FEATURES), "node_id")


@query("model_agreement", "SELECT profile, count(*) AS n, count(*) FILTER (gnn <> rf) AS differ, ROUND(100.0E0 * count(*) FILTER (gnn <> rf) / count(*), 6) AS differ_pct, count(*) FILTER (gnn > rf) AS more_restrictive, count(*) FILTER (gnn < rf) AS less_restrictive, ROUND(avg(CASE WHEN gnn <> rf THEN ndvi END), 6) AS ndvi_there, ROUND(avg(CASE WHEN gnn <> rf THEN slope END), 6) AS slope_there FROM wide JOIN cells USING (node_id) GROUP BY profile")
def _(v):
    return r6(analysis.agreement(_wide(v), "gnn", "rf", ["ndvi", "slope"]))


@query("disagreement_profile", f", {LONG} SELECT profile, feature, ROUND(avg(value), 6) AS mean_all, ROUND(avg(CASE WHEN gnn <> rf THEN value END), 6) AS mean_differ, ROUND(stddev_pop(CASE WHEN gnn <> rf THEN value END), 6) AS std_differ, ROUND((avg(CASE WHEN gnn <> rf THEN value END) - avg(value)) / (stddev_pop(value) + 1e-8), 6) AS z FROM wide JOIN flat USING (node_id) GROUP BY profile, feature")
def _(v):
    return r6(analysis.disagreement_profile(_wide(v), "gnn", "rf", FEATURES))


GRADIENT = "grad AS (SELECT dst AS node_id, avg(abs(a.ndvi - b.ndvi)) AS gradient FROM edges JOIN cells a ON src = a.node_id JOIN cells b ON dst = b.node_id GROUP BY dst)"


@query("neighbour_gradient", f", {GRADIENT} SELECT node_id, ROUND(gradient, 6) AS gradient FROM grad")
def _(v):
    return r6(grid.mean_gradient(v.neighbours(["ndvi"]), "ndvi"))


@query("f1_by_gradient", f", {GRADIENT}, halves AS (SELECT p.*, CASE WHEN ROUND(gradient, 6) > cut THEN 'high' ELSE 'low' END AS half FROM preds p JOIN grad USING (node_id), (SELECT quantile_cont(ROUND(gradient, 6), 0.75) AS cut FROM grad)) {oracle.scores('profile, model, half', 'halves', columns='n, ROUND(macro_f1, 6) AS macro_f1')}")
def _(v):
    keys = ["profile", "model", "half"]
    path = files.work_path(v.spark, "gradients")
    grid.mean_gradient(v.neighbours(["ndvi"]), "ndvi").select("node_id", F.round("gradient", 6).alias("gradient")).write.parquet(path)
    g = v.spark.read.schema("node_id long, gradient double").parquet(path)  # read twice
    high = analysis.above_quantile(g.groupBy("gradient").agg(F.count("*").alias("k")), "gradient", "k", 0.75)
    halves = g.join(high, "gradient").select("node_id", F.when(F.col("above"), "high").otherwise("low").alias("half"))
    return r6(metrics.scores(metrics.cube_of_models(v.wide().join(halves, "node_id"), keys, MODELS), keys).select(*keys, "n", "macro_f1"))


BASINS = "basin AS (SELECT DISTINCT dst AS node_id FROM edges JOIN cells a ON src = a.node_id JOIN cells b ON dst = b.node_id WHERE b.tpi < 0 AND a.tpi > 0)"


@query("micro_basins", f", {BASINS} SELECT count(*) AS cells FROM basin")
def _(v):
    return analysis.basins(v.neighbours(["tpi"])).agg(F.count("*").alias("cells"))


@query("f1_by_basin", f", {BASINS}, placed AS (SELECT p.*, 'basin' AS place FROM preds p JOIN basin USING (node_id) UNION ALL SELECT p.*, 'flat' FROM preds p JOIN cells USING (node_id) WHERE abs(tpi) <= 0.05E0) {oracle.scores('profile, model, place', 'placed', columns='n, ROUND(macro_f1, 6) AS macro_f1')}")
def _(v):
    flat = v.cells().where(F.abs("tpi") <= 0.05).select("node_id", F.lit("flat").alias("place"))
    places = analysis.basins(v.neighbours(["tpi"])).select("node_id", F.lit("basin").alias("place")).union(flat)
    keys = ["profile", "model", "place"]
    return r6(metrics.scores(metrics.cube_of_models(v.wide().join(places, "node_id"), keys, MODELS), keys).select(*keys, "n", "macro_f1"))


@query("isolated_cells", f"SELECT profile, count(*) AS n, count(*) FILTER (2 * other > degree) AS isolated, ROUND(100.0E0 * count(*) FILTER (2 * other > degree) / count(*), 6) AS pct, ROUND(avg(other / degree), 6) AS mean_discordance FROM (SELECT a.profile, dst, count(*) AS degree, count(*) FILTER (a.y <> b.y) AS other {LABEL_EDGES} GROUP BY a.profile, dst) GROUP BY profile")
def _(v):
    return r6(analysis.isolated(_label_neighbours(v), ["profile"]))


@query("lidar_proximity_f1", f", lit AS (SELECT DISTINCT dst AS node_id FROM edges JOIN cells a ON src = a.node_id WHERE a.lidar_available = 1), placed AS (SELECT p.*, l.node_id IS NOT NULL AS lidar FROM preds p LEFT JOIN lit l USING (node_id)) {oracle.scores('profile, model, lidar', 'placed', columns='n, ROUND(macro_f1, 6) AS macro_f1')}")
def _(v):
    _, h, w = v.shape
    cells = v.cells().select("node_id", "p", "slope", "ndvi", "ndwi", "water_mask")
    beside = grid.edges(v.cells().where("lidar_available = 1").select("node_id", "row", "col"), h, w)
    lit = beside.select(F.col("dst").alias("node_id"), F.lit(True).alias("lidar")).distinct()
    keys = ["profile", "model", "lidar"]
    # cells meet the flag before they become a row for each profile
    marked = cells.join(lit.hint("merge"), "node_id", "left").withColumn("lidar", F.coalesce("lidar", F.lit(False)))
    at = v.wide(marked, ["lidar"])
    return r6(metrics.scores(metrics.cube_of_models(at, keys, MODELS), keys).select(*keys, "n", "macro_f1"))


@query("consensus_hard", f", hard AS (SELECT p.*, CASE WHEN w.rf <> w.y AND w.mlp <> w.y THEN 'hard' WHEN w.rf = w.y AND w.mlp = w.y THEN 'easy' ELSE 'mixed' END AS kind FROM preds p JOIN wide w USING (node_id, profile)) {oracle.scores('profile, model, kind', 'hard', columns='n, ROUND(macro_f1, 6) AS macro_f1')}")
def _(v):
    wide = v.wide()
    y = F.col("y")
    kind = F.when((F.col("rf") != y) & (F.col("mlp") != y), "hard").when((F.col("rf") == y) & (F.col("mlp") == y), "easy").otherwise("mixed")
    keys = ["profile", "model", "kind"]
    return r6(metrics.scores(metrics.cube_of_models(wide.withColumn("kind", kind), keys, MODELS), keys).select(*keys, "n", "macro_f1"))


CORR = f", {LONG}, cor AS (SELECT profile, feature, corr(value, CAST(y AS DOUBLE)) AS r FROM labels_cell JOIN flat USING (node_id) GROUP BY profile, feature) "


@query("feature_label_corr", CORR + "SELECT profile, feature, ROUND(r, 6) AS r, ROUND(r * r, 6) AS r2 FROM cor")
def _(v):
    return r6(analysis.correlations(v.labels(), v.cells(), FEATURES))


@query("top3_features", CORR + "SELECT profile, CAST(rank AS INTEGER) AS rank, feature, r FROM (SELECT profile, row_number() OVER (PARTITION BY profile ORDER BY abs(ROUND(r, 6)) DESC, feature) AS rank, feature, ROUND(r, 6) AS r FROM cor) WHERE rank <= 3")
def _(v):
    return analysis.top_features(r6(analysis.correlations(v.labels(), v.cells(), FEATURES)))


@query("imbalance_corr", f", {DIST}, f AS ({oracle.scores('profile, model', 'preds', columns='macro_f1')}) SELECT model, ROUND(corr(pct, macro_f1), 4) AS r FROM f JOIN dist USING (profile) WHERE y = 2 GROUP BY model")
def _(v):
    share = _distribution(v).where("y = 2").select("profile", "pct")
    scored = metrics.scores(_cube(v), KEYS)
    return scored.join(share, "profile").groupBy("model").agg(F.round(F.corr("pct", "macro_f1"), 4).alias("r"))


TZ = "JOIN (SELECT DISTINCT node_id, profile, zone FROM zones) USING (node_id, profile) WHERE zone <> 'far'"


@query("tz_outcome_table", f"SELECT profile, n1, n2, n3, n4, ROUND(100.0E0 * (n1 - n3) / greatest(n1 + n2 + n3 + n4, 1), 6) AS advantage_pct FROM (SELECT profile, count(*) FILTER (gnn = y AND rf <> y) AS n1, count(*) FILTER (gnn = y AND rf = y) AS n2, count(*) FILTER (gnn <> y AND rf = y) AS n3, count(*) FILTER (gnn <> y AND rf <> y) AS n4 FROM wide {TZ} GROUP BY profile)")
def _(v):
    at = _zoned(v).where("zone <> 'far'")
    return r6(analysis.outcome(at, "gnn", "rf"))


@query("divergence_pct", "SELECT profile, ROUND(100.0E0 * avg(CASE WHEN rule <> gnn THEN 1.0E0 ELSE 0.0E0 END), 6) AS rule_pct, ROUND(100.0E0 * avg(CASE WHEN rf <> gnn THEN 1.0E0 ELSE 0.0E0 END), 6) AS rf_pct, ROUND(100.0E0 * avg(CASE WHEN mlp <> gnn THEN 1.0E0 ELSE 0.0E0 END), 6) AS mlp_pct FROM wide GROUP BY profile")
def _(v):
    w = v.wide()
    return r6(w.groupBy("profile").agg(*[(100.0 * F.avg(F.when(F.col(m) != F.col("gnn"), 1.0).otherwise(0.0))).alias(f"{m}_pct") for m in ("rule", "rf", "mlp")]))


@query("disagreement_map", "SELECT \"row\", col, CAST(CASE WHEN gnn = rf THEN 0 WHEN gnn > rf THEN 1 ELSE 2 END AS INTEGER) AS code FROM wide JOIN cells USING (node_id) WHERE profile = 'a_pe'")
def _(v):
    w = v.wide().where("profile = 'a_pe'").join(v.cells().select("node_id", "row", "col"), "node_id")
    return w.select("row", "col", F.when(F.col("gnn") == F.col("rf"), 0).when(F.col("gnn") > F.col("rf"), 1).otherwise(2).alias("code"))


# uncertainty ---------------------------------------------------------------------------------------------


def _entropy_query(kind: str, name: str, expression: str) -> None:
    @query(name, f"SELECT node_id, profile, ROUND({expression}, 6) AS entropy FROM entropies")
    def _(v):
        return r6(uncertainty.with_entropy(v.profile_probs(), kind).select("node_id", "profile", "entropy"))


_entropy_query("raw", "entropy_raw", "raw")
_entropy_query("normalized", "entropy_norm", "raw / ln(3.0E0)")
_entropy_query("log2", "entropy_log2", "(-greatest(p1, 1e-10) * log2(greatest(p1, 1e-10)) - greatest(p2, 1e-10) * log2(greatest(p2, 1e-10)) - greatest(p3, 1e-10) * log2(greatest(p3, 1e-10))) / log2(3.0E0)")


def _entropy(v: Views) -> DataFrame:
    return uncertainty.with_entropy(v.profile_probs()).withColumn("entropy", F.round("entropy", 6))


ENT = "ent AS (SELECT *, ROUND(raw / ln(3.0E0), 6) AS entropy FROM entropies)"


@query("entropy_summary", f", {ENT} SELECT profile, ROUND(avg(entropy), 6) AS mean, ROUND(quantile_cont(entropy, 0.5), 6) AS median, ROUND(quantile_cont(entropy, 0.95), 6) AS p95, max(entropy) AS top, ROUND(avg(CASE WHEN entropy >= 0.8E0 THEN 1.0E0 ELSE 0.0E0 END), 6) AS share FROM ent GROUP BY profile")
def _(v):
    return r6(uncertainty.summary(_entropy(v), 0.8))


@query("entropy_in_out_tz", f", {ENT}, z AS (SELECT e.profile, entropy, abs(ndvi - ndvi_1) <= 0.05E0 AS inside FROM ent e JOIN cells USING (node_id) JOIN limits USING (profile)) SELECT profile, ROUND(avg(entropy), 6) AS mean, ROUND(avg(entropy) FILTER (inside), 6) AS mean_in, ROUND(avg(entropy) FILTER (NOT inside), 6) AS mean_out, ROUND(100.0E0 * count(*) FILTER (inside AND entropy > cut) / count(*) FILTER (inside), 6) AS high_pct FROM z JOIN (SELECT profile, ROUND(quantile_cont(entropy, 0.75), 9) AS cut FROM z GROUP BY profile) USING (profile) GROUP BY profile")
def _(v):
    cells = v.cells().select("node_id", "ndvi")
    e = _entropy(v).join(cells, "node_id").join(F.broadcast(v.limits().select("profile", "ndvi_1")), "profile").withColumn("inside", F.abs(F.col("ndvi") - F.col("ndvi_1")) <= 0.05)
    cut = F.broadcast(e.groupBy("profile").agg(F.round(F.percentile("entropy", 0.75), 9).alias("cut")))
    inside = F.col("inside")
    return r6(e.join(cut, "profile").groupBy("profile").agg(F.avg("entropy").alias("mean"), F.avg(F.when(inside, F.col("entropy"))).alias("mean_in"), F.avg(F.when(~inside, F.col("entropy"))).alias("mean_out"), (100.0 * F.count_if(inside & (F.col("entropy") > F.col("cut"))) / F.count_if(inside)).alias("high_pct")))


@query("tz_p85", f", {ENT} SELECT profile, ROUND(max(cut), 6) AS threshold, count(*) FILTER (entropy >= cut) AS cells, ROUND(100.0E0 * count(*) FILTER (entropy >= cut) / count(*), 6) AS pct FROM ent JOIN (SELECT profile, quantile_cont(entropy, 0.85) AS cut FROM ent GROUP BY profile) USING (profile) GROUP BY profile")
def _(v):
    z = uncertainty.quantile_zone(_entropy(v))
    return r6(z.groupBy("profile").agg(F.max("threshold").alias("threshold"), F.count_if("in_zone").alias("cells"), (100.0 * F.count_if("in_zone") / F.count("*")).alias("pct")))


ZRN = f", {ENT}, zrn AS (SELECT *, CASE WHEN entropy >= 0.8E0 THEN 3 WHEN top = 3 THEN 4 ELSE top END AS pred4 FROM ent) "


@query("zrn_reclass", ZRN + "SELECT node_id, profile, top AS pred3, pred4 FROM zrn")
def _(v):
    return uncertainty.reclassify(_entropy(v), 0.8).select("node_id", "profile", "pred3", "pred4")


@query("zrn_stats", ZRN + "SELECT profile, pred4, count(*) AS n, ROUND(100.0E0 * count(*) / sum(count(*)) OVER (PARTITION BY profile), 6) AS pct FROM zrn GROUP BY profile, pred4")
def _(v):
    n = uncertainty.reclassify(_entropy(v), 0.8).groupBy("profile", "pred4").agg(F.count("*").alias("n"))
    return r6(n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("profile"))))


@query("zrn_transitions", ZRN + "SELECT profile, top AS pred3, pred4, count(*) AS n FROM zrn GROUP BY profile, top, pred4")
def _(v):
    return uncertainty.reclassify(_entropy(v), 0.8).groupBy("profile", "pred3", "pred4").agg(F.count("*").alias("n"))


@query("confidence_correct_wrong", "SELECT profile, count(*) FILTER (top = y) AS \"right\", count(*) FILTER (top <> y) AS wrong, ROUND(avg(CASE WHEN top = y THEN greatest(p1, p2, p3) END), 6) AS confidence_right, ROUND(avg(CASE WHEN top <> y THEN greatest(p1, p2, p3) END), 6) AS confidence_wrong, ROUND(100.0E0 * count(*) FILTER (top <> y AND greatest(p1, p2, p3) > 0.8E0) / NULLIF(count(*) FILTER (top <> y), 0), 6) AS sure_wrong_pct FROM entropies JOIN labels_cell USING (node_id, profile) GROUP BY profile")
def _(v):
    p = v.profile_probs().withColumn("pred3", S.first_argmax([F.col("p1"), F.col("p2"), F.col("p3")]))
    return r6(uncertainty.confidence(p.join(v.labels(), ["node_id", "profile"])))


@query("entropy_histogram", f", {ENT} SELECT profile, CAST(least(FLOOR(entropy / (1.0E0 / 60)), 59) AS INTEGER) AS bin, count(*) AS n FROM ent WHERE entropy BETWEEN 0 AND 1 GROUP BY 1, 2")
def _(v):
    return uncertainty.histogram(_entropy(v), "entropy", 0.0, 1.0, 60)


@query("entropy_ndvi_density", f", {ENT} SELECT CAST(least(FLOOR((ndvi - -1.0E0) / (2.0E0 / 40)), 39) AS INTEGER) AS bx, CAST(least(FLOOR(entropy / (1.0E0 / 40)), 39) AS INTEGER) AS \"by\", count(*) AS n FROM ent JOIN cells USING (node_id) WHERE ndvi BETWEEN -1 AND 1 AND entropy BETWEEN 0 AND 1 GROUP BY 1, 2")
def _(v):
    return uncertainty.density(_entropy(v).join(v.cells().select("node_id", "ndvi"), "node_id"), "ndvi", "entropy", 40, 40, -1.0, 1.0, 0.0, 1.0)


@query("tz_boxplot", f", {ENT}, z AS (SELECT e.profile, least(greatest(slope / ((SELECT quantile_cont(slope, 0.98) FROM cells) + 1e-6), 0.0E0), 1.0E0) AS x, ndvi, entropy >= cut AS in_zone FROM ent e JOIN cells USING (node_id) JOIN (SELECT profile, quantile_cont(entropy, 0.85) AS cut FROM ent GROUP BY profile) USING (profile)) SELECT profile, in_zone, ROUND(quantile_cont(x, 0.25), 6) AS slope_q1, ROUND(quantile_cont(x, 0.5), 6) AS slope_q2, ROUND(quantile_cont(x, 0.75), 6) AS slope_q3, ROUND(quantile_cont(ROUND(ndvi, 6), 0.25), 6) AS ndvi_q1, ROUND(quantile_cont(ROUND(ndvi, 6), 0.5), 6) AS ndvi_q2, ROUND(quantile_cont(ROUND(ndvi, 6), 0.75), 6) AS ndvi_q3 FROM z GROUP BY profile, in_zone")
def _(v):
    cells = v.cells().select("node_id", "slope", F.round("ndvi", 6).alias("ndvi"))  # rounding bounds the distinct values
    top = F.broadcast(cells.agg((F.percentile("slope", 0.98) + 1e-6).alias("top")))  # one row
    z = uncertainty.quantile_zone(_entropy(v)).join(cells.crossJoin(top), "node_id")
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    of = {"slope": S.clip(F.col("slope") / F.col("top"), 0.0, 1.0), "ndvi": F.col("ndvi")}
    q = z.groupBy("profile", "in_zone").agg(*[F.percentile(x, quarters).alias(n) for n, x in of.items()])
    return r6(q.select("profile", "in_zone", *[F.col(n)[i].alias(f"{n}_q{i + 1}") for n in of for i in range(3)]))


# raster --------------------------------------------------------------------------------------------------


@query("scene_search", "SELECT scene_id, cloud, count(*) FILTER (dn > 0) AS valid FROM scenes WHERE cloud <= 6 GROUP BY scene_id, cloud ORDER BY cloud, scene_id LIMIT 4")
def _(v):
    return raster.scene_search(v.scenes(), 6, 4)


@query("scene_mean", "SELECT \"row\", col, ROUND(least(greatest(avg(CASE WHEN dn > 0 THEN dn END) / 10000.0E0, 0.0E0), 1.0E0), 6) AS value, count(*) FILTER (dn > 0) AS scenes FROM scenes GROUP BY \"row\", col HAVING count(*) FILTER (dn > 0) > 0")
def _(v):
    return r6(raster.scene_mean(v.scenes()).where("scenes > 0"))


COVER = ", cover AS (SELECT f.cloud AS cloud, f.scene_id AS scene_id, count(*) AS fresh FROM (SELECT \"row\", col, min({'cloud': cloud, 'scene_id': scene_id}) AS f FROM scenes WHERE dn > 0 GROUP BY \"row\", col) GROUP BY 1, 2), covered AS (SELECT cloud, scene_id, fresh, 100.0E0 * sum(fresh) OVER (ORDER BY cloud, scene_id) / n AS pct FROM cover, n0) "


@query("scene_coverage", COVER + "SELECT cloud, scene_id, fresh, ROUND(pct, 6) AS covered_pct FROM covered")
def _(v):
    return r6(raster.coverage(v.scenes(), v.shape[0]))


@query("scene_early_stop", COVER + "SELECT cloud, scene_id, fresh, ROUND(pct, 6) AS covered_pct FROM (SELECT *, lag(pct, 1, 0.0E0) OVER (ORDER BY cloud, scene_id) AS before FROM covered) WHERE before < 80")
def _(v):
    return r6(raster.needed_scenes(raster.coverage(v.scenes(), v.shape[0]), 80.0).drop("gain"))


@query("quadrant_mosaic", "SELECT \"row\", col, max_by(dn, scene_id) AS dn FROM scenes GROUP BY \"row\", col")
def _(v):
    return raster.mosaic_last(v.scenes(), "scene_id")


@query("tile_merge_first", "SELECT \"row\", col, min_by(dn, scene_id) AS dn FROM scenes WHERE dn > 0 GROUP BY \"row\", col")
def _(v):
    return raster.merge_first(v.scenes(), "scene_id")


@query("nearest_fill", """, given AS (SELECT g.*, "row" AS r, col AS c FROM (SELECT node_id, max_by(elevation, event_id) AS value FROM points GROUP BY node_id) g JOIN cells USING (node_id)),
gaps AS (SELECT node_id, "row", col FROM cells WHERE node_id NOT IN (SELECT node_id FROM given)),
best AS (SELECT gaps.node_id, min({'d2': ("row" - r) * ("row" - r) + (col - c) * (col - c), 'giver': given.node_id, 'value': value}) AS b FROM gaps, given GROUP BY gaps.node_id)
SELECT node_id, value, CAST(0 AS BIGINT) AS d2 FROM given UNION ALL SELECT node_id, b.value, CAST(b.d2 AS BIGINT) FROM best""")
def _(v):
    given = v.points().groupBy("node_id").agg(F.max_by("elevation", "event_id").alias("value"))
    return raster.nearest_fill(v.cells(), given, *v.shape[1:])


@query("percentile_stretch", "SELECT node_id, ROUND(pow(least(greatest((b08 - lo) / (hi - lo), 0.0E0), 1.0E0), 0.95E0), 6) AS stretched FROM cells, (SELECT quantile_cont(b08, 0.02) AS lo, quantile_cont(b08, 0.98) AS hi FROM cells)")
def _(v):
    return r6(raster.stretch(v.cells().select("node_id", "b08"), "b08").select("node_id", "stretched"))


@query("points_bbox_quality", "SELECT event_id, elevation, source FROM points WHERE quality = 1 AND elevation > -100 AND elevation < 10000 AND lat BETWEEN 4.9E0 AND 4.97E0 AND lon BETWEEN -61.61E0 AND -61.0E0")
def _(v):
    p = v.points()
    return p.where((F.col("quality") == 1) & (F.col("elevation") > -100) & (F.col("elevation") < 10000) & F.col("lat").between(4.9, 4.97) & F.col("lon").between(-61.61, -61.0)).select("event_id", "elevation", "source")


@query("points_union", "SELECT source, count(*) AS n, ROUND(avg(elevation), 6) AS mean FROM points GROUP BY source")
def _(v):
    gedi, icesat = v.points().where("source = 'GEDI'"), v.points().where("source = 'ICESat-2'")
    return r6(gedi.unionByName(icesat).groupBy("source").agg(F.count("*").alias("n"), F.avg("elevation").alias("mean")))


@query("multiband_pivot", f"SELECT \"row\", col, {', '.join(f'''max(CASE WHEN profile = '{p}' THEN y END) AS {p}''' for p in PROFILES)} FROM labels_cell JOIN cells USING (node_id) GROUP BY \"row\", col")
def _(v):
    return raster.bands(rules.classify(v.cells(), v.limits()).select("row", "col", "profile", "y"), PROFILES)


@query("incremental_antijoin", "SELECT event_id, elevation FROM points WHERE event_id NOT IN (SELECT event_id FROM points WHERE event_id % 4 = 0)")
def _(v):
    p = v.points()
    return ingest.unprocessed(p, p.where("event_id % 4 = 0"), "event_id").select("event_id", "elevation")


@query("inference_coverage", "SELECT profile, count(p.node_id) AS written, ROUND(100.0E0 * count(p.node_id) / max(n), 6) AS pct, count(p.node_id) >= 0.99E0 * max(n) AS enough FROM profile_probs p, n0 GROUP BY profile")
def _(v):
    n = v.shape[0]
    return r6(v.profile_probs().groupBy("profile").agg(F.count("node_id").alias("written"), (100.0 * F.count("node_id") / F.lit(n)).alias("pct"), (F.count("node_id") >= 0.99 * n).alias("enough")))


# losses, learning, embeddings ----------------------------------------------------------------------------


@query("rule_penalties", "SELECT profile, ROUND(avg(p1 * greatest(slope - 0.35E0, 0.0E0)), 6) AS slope, ROUND(avg(p1 * greatest(ndvi - ndvi_1, 0.0E0)), 6) AS vegetation, ROUND(avg(p1 * CASE WHEN ndwi > 0.3E0 OR water_mask > 0.5E0 THEN 1.0E0 ELSE 0.0E0 END), 6) AS water FROM profile_probs JOIN cells USING (node_id) JOIN limits USING (profile) GROUP BY profile")
def _(v):
    return r6(losses.rule_penalties(v.judged(), v.limits()))


CE = ", ce AS (SELECT profile, -(1 - {s}) * ln(CASE y WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END) - {s} / 3 * (ln(p1) + ln(p2) + ln(p3)) AS ce FROM profile_probs JOIN labels_cell USING (node_id, profile)) "


@query("smoothed_ce", CE.format(s="0.1E0") + "SELECT profile, ROUND(avg(ce), 6) AS loss FROM ce GROUP BY profile")
def _(v):
    return r6(losses.cross_entropy(v.judged()))


@query("focal_loss", CE.format(s="0.05E0") + "SELECT profile, ROUND(avg(pow(1 - exp(-ce), 2.0E0) * ce), 6) AS loss FROM ce GROUP BY profile")
def _(v):
    return r6(losses.focal(v.judged()))


@query("task_weighting", CE.format(s="0.1E0") + "SELECT ROUND(sum(exp(-s) * loss + s), 6) AS total FROM (SELECT profile, avg(ce) AS loss FROM ce GROUP BY profile) JOIN (VALUES ('a_pe', 0.1E0), ('motorizada', 0.2E0), ('mecanizada', -0.1E0), ('blindada', 0.0E0)) AS t(profile, s) USING (profile)")
def _(v):
    s = v.spark.createDataFrame(list(zip(PROFILES, (0.1, 0.2, -0.1, 0.0), strict=True)), "profile string, s double")
    return r6(losses.task_weighting(losses.cross_entropy(v.judged()), s))


@query("toy_attention", ", e AS (SELECT dst, a.ndvi AS x, 0.7E0 * a.ndvi + -0.3E0 * b.ndvi AS z FROM edges JOIN cells a ON src = a.node_id JOIN cells b ON dst = b.node_id), s AS (SELECT dst, x, CASE WHEN z > 0 THEN z ELSE 0.2E0 * z END AS z FROM e), m AS (SELECT dst, max(z) AS top FROM s GROUP BY dst) SELECT dst AS node_id, ROUND(sum(exp(z - top) * x) / sum(exp(z - top)), 6) AS h FROM s JOIN m USING (dst) GROUP BY dst")
def _(v):
    return r6(losses.attention(v.neighbours(["ndvi"]), "ndvi_src", "ndvi_dst", 0.7, -0.3))


@query("embedding_norms", "SELECT label, count(*) AS n, ROUND(avg(norm), 5) AS mean, ROUND(stddev_pop(norm), 5) AS std FROM (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings) GROUP BY label")
def _(v):
    norms = v.table("embeddings").select("label", S.vector_norm(F.col("embedding")).alias("norm"))
    return norms.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("norm"), 5).alias("mean"), F.round(F.stddev_pop("norm"), 5).alias("std"))


@query("embedding_overlap_mean", ", parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT label, CAST(i AS INTEGER) AS i, ROUND(avg(CAST(x AS DOUBLE)), 5) AS mean FROM parts GROUP BY label, i")
def _(v):
    parts = v.table("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return parts.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("feature_append", "SELECT vec_id, CAST(len(embedding) + 2 AS INTEGER) AS width, ROUND(slope, 6) AS slope, ROUND(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings JOIN cells ON vec_id = node_id")
def _(v):
    joined = v.table("embeddings").join(v.cells().select("node_id", "slope", "ndvi"), F.col("vec_id") == F.col("node_id"))
    full = F.concat(F.array("slope", "ndvi"), F.col("embedding").cast("array<double>"))
    return joined.select("vec_id", F.size(full).alias("width"), F.round(full[0], 6).alias("slope"), F.round(full[2], 5).alias("first"))


@query("cumulative_variance", f", {LONG}, var AS (SELECT feature, ROUND(var_pop(value), 6) AS v FROM flat WHERE feature <> 'elevation_m' GROUP BY feature) SELECT feature, ROUND(sum(v) OVER (ORDER BY v DESC, feature) / sum(v) OVER (), 6) AS cumulative FROM var")
def _(v):
    var = quality.unpivot(v.cells(), [c for c in FEATURES if c != "elevation_m"]).groupBy("feature").agg(F.round(F.var_pop("value"), 6).alias("v"))
    w = Window.orderBy(F.desc("v"), "feature").rowsBetween(Window.unboundedPreceding, 0)  # one row per feature
    return r6(var.select("feature", (F.sum("v").over(w) / F.sum("v").over(Window.partitionBy())).alias("cumulative")))


@query("scene_status", "SELECT CASE WHEN dn = 0 THEN 'nodata' WHEN dn < 3000 THEN 'dark' ELSE 'valid' END AS status, count(*) AS n, CAST(sum(dn) AS BIGINT) AS total FROM scenes GROUP BY 1")
def _(v):
    status = F.when(F.col("dn") == 0, "nodata").when(F.col("dn") < 3000, "dark").otherwise("valid")
    return v.scenes().groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("dn").alias("total"))


@query("model_vs_reference_rank", "SELECT profile, model, CAST(row_number() OVER (PARTITION BY profile ORDER BY macro_f1 DESC, model) AS INTEGER) AS place FROM (" + oracle.scores("profile, model", "preds", columns="ROUND(macro_f1, 6) AS macro_f1") + ")")
def _(v):
    scored = r6(metrics.scores(_cube(v), KEYS))
    w = Window.partitionBy("profile").orderBy(F.desc("macro_f1"), "model")
    return scored.select("profile", "model", F.row_number().over(w).alias("place"))


@query("early_stopping_trace", ", hist AS (SELECT CAST(l_linenumber AS INTEGER) AS epoch, ROUND(avg(l_discount), 6) AS loss FROM lineitem GROUP BY 1) SELECT epoch, loss, min(loss) OVER (ORDER BY epoch) AS best, loss <= min(loss) OVER (ORDER BY epoch) AS improved FROM hist")
def _(v):
    hist = v.table("lineitem").groupBy(F.col("l_linenumber").cast("int").alias("epoch")).agg(F.round(F.avg("l_discount"), 6).alias("loss"))
    best = F.min("loss").over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))  # one row per epoch
    return hist.select("epoch", "loss", best.alias("best"), (F.col("loss") <= best).alias("improved"))


@query("neighbour_sample", "SELECT src, dst FROM edges QUALIFY row_number() OVER (PARTITION BY dst ORDER BY (src * 7919 + dst * 104729 + 42) % 10007, src) <= 4")
def _(v):
    """At most four neighbours of a cell, in a pseudo-random order; degrees are at most nine, so the window is small."""
    order = (F.col("src") * 7919 + F.col("dst") * 104729 + 42) % 10007
    return v.edges().select("src", "dst", F.row_number().over(Window.partitionBy("dst").orderBy(order, "src")).alias("rn")).where("rn <= 4").select("src", "dst")


@query("hash_sample", "SELECT node_id, ROUND(ndvi, 6) AS ndvi, slope FROM cells ORDER BY (node_id * 7919 + 42) % 10007, node_id LIMIT 500")
def _(v):
    return r6(v.cells().select("node_id", "ndvi", "slope").orderBy((F.col("node_id") * 7919 + 42) % 10007, "node_id").limit(500))


TRAINED = ["slope", "tpi", "tri", "ndvi", "ndwi", "water_mask"]


def _trained(v: Views, profile: str) -> DataFrame:
    at = rules.classify(v.cells(), v.limits().where(F.col("profile") == profile)).join(v.cell_splits().select("node_id", "split"), "node_id")
    return learn.assemble(at, TRAINED).select("node_id", "profile", "split", "y", "features")


def _forest(v: Views) -> tuple[forest.Forest, DataFrame]:
    """100 trees of depth 20 with balanced weights for each of the four profiles, and the labelled cells."""
    at = rules.class_columns(v.cells(), dimensions.LIMITS).join(v.cell_splits().select("node_id", "split"), "node_id")
    return forest.Forest(at.where("split = 'train'"), "node_id", TRAINED, list(PROFILES)), at


@query("rf_baseline")
def _(v):
    """100 trees of depth 20 with balanced weights, for each of the four profiles."""
    grown, at = _forest(v)
    cube = grown.confusion(at.where("split = 'test'")).select(F.lit("test").alias("split"), F.col("label").alias("profile"), "y", "pred", "n")
    return r6(metrics.scores(cube, ["split", "profile"])).select("split", "n", "accuracy", "macro_f1", "weighted_f1", "profile")


@query("rf_importance")
def _(v):
    found = _forest(v)[0].importances()
    return v.spark.createDataFrame([(c, float(x), p) for p, row in zip(PROFILES, found, strict=True) for c, x in zip(TRAINED, row, strict=True)], "feature string, importance double, profile string")


@query("mlp_baseline")
def _(v):
    """Hidden layers of 64 and 32, batch norm, dropout, Adam, 50 epochs of batches of 4096; all four profiles on the same batches."""
    return structure.perceptron_scores(v, TRAINED)


@query("pca_embeddings")
def _(v):
    return r6(learn.principal_components(v.table("embeddings"), "embedding", 16)[2])


@query("pca_dimensions")
def _(v):
    return learn.dimensions_for(learn.principal_components(v.table("embeddings"), "embedding", 64)[2])


@query("pc_label_corr")
def _(v):
    out, _, _ = learn.principal_components(v.table("embeddings"), "embedding", 4)
    pcs = learn.component_array(out).select(F.col("label").cast("double").alias("label"), *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(4)])
    return r6(pcs.agg(*[F.corr(f"pc{i}", "label").alias(f"pc{i}") for i in range(1, 5)]))


@query("point_formats", "SELECT event_id, event_id AS id2, source AS src FROM points")
def _(v):
    """JSON out and in again."""
    js = v.points().select("event_id", F.to_json(F.struct(F.col("event_id").alias("id2"), F.col("source").alias("src"))).alias("j"))
    return js.select("event_id", F.from_json("j", "id2 long, src string").alias("s")).select("event_id", "s.id2", "s.src")


from cellgrove.plans import structure  # noqa: E402, F401  registers its queries here
