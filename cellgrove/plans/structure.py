"""Queries on structure: what a table must hold, chunks and samples of graphs, windows of a map, value maps, stopping rules."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrove.functions import scalar as S
from cellgrove.operators import analysis, descent, grid, learn, metrics, models, quality, raster, rules, split, training, typed, uncertainty
from cellgrove.plans import oracle
from cellgrove.plans.catalog import ENT, FEATURES, KEYS, LABEL_EDGES, ORACLES, _cube, _entropy, _label_neighbours, long, query, r6
from cellgrove.sources import checkpoints, dimensions, files, rasters
from cellgrove.streaming import ingest, state

# what a table must hold ----------------------------------------------------------------------------------

REQUIRED = {"node_id": "bigint", "lat": "double", "lon": "double", **dict.fromkeys(("slope", "tpi", "tri", "ndvi", "ndwi"), "double"), "water_mask": "int", "thermal": "double"}


@query("schema_check", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}', {str(c != 'thermal').lower()})" for c, t in REQUIRED.items()) + ") AS t(\"column\", type, passed)")
def _(v):
    """The cells have no column of heat, as the check says."""
    return quality.schema_check(v.cells(), REQUIRED)


EXTENT = "ROUND(min(lat), 6) AS south, ROUND(max(lat), 6) AS north, ROUND(min(lon), 6) AS west, ROUND(max(lon), 6) AS east"


@query("dataset_extent", f"SELECT 'cells' AS name, count(*) AS n, CAST({len(FEATURES)} AS INTEGER) AS width, {EXTENT} FROM cells UNION ALL SELECT 'points', count(*), 1, {EXTENT} FROM points")
def _(v):
    parts = [("cells", v.cells(), len(FEATURES)), ("points", v.points(), 1)]
    out = [df.agg(F.count("*").alias("n"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east")).select(F.lit(name).alias("name"), "n", F.lit(width).alias("width"), "south", "north", "west", "east") for name, df, width in parts]
    return r6(out[0].union(out[1]))


@query("label_cardinality", "SELECT profile, count(*) FILTER (node_id % 17 <> 0) AS labelled, count(*) FILTER (node_id % 17 = 0) AS missing, CAST(1 AS BIGINT) AS unknown, count(*) FILTER (node_id % 17 <> 0 AND node_id % 1000 = 1) AS repeated, false AS passed FROM labels_cell GROUP BY profile")
def _(v):
    """Labels with holes, repeats and one unknown cell a profile, against the cells: one label a cell and profile is wanted."""
    labels = v.labels().where("node_id % 17 <> 0").select("node_id", "profile", F.explode(F.when(F.col("node_id") % 1000 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    stray = dimensions.profiles(v.spark).select(F.lit(-1).cast("bigint").alias("node_id"), "profile")
    return quality.label_cardinality(v.cells(), labels.select("node_id", "profile").union(stray), dimensions.profiles(v.spark))


HOLED = "(SELECT p.* FROM preds p JOIN cells USING (node_id) WHERE p.node_id % 13 <> 0 AND p.node_id % 19 <> 0)"


@query("valid_label_scores", oracle.scores("profile, model", HOLED))
def _(v):
    """Cells outside the covered area, and class 0 (no label), take no part."""
    preds = v.preds().withColumns({"y": F.when(F.col("node_id") % 13 == 0, 0).otherwise(F.col("y")), "covered": F.col("node_id") % 19 != 0})
    return r6(metrics.scores(metrics.cube(metrics.valid(preds), KEYS), KEYS))


@query("disagreement_f1", oracle.scores("profile, model", "(SELECT p.* FROM preds p JOIN wide w USING (node_id, profile) WHERE w.gnn <> w.rf AND p.model IN ('gnn', 'rf'))", columns="n, ROUND(macro_f1, 6) AS macro_f1"))
def _(v):
    wide = analysis.wide_models(v.preds().where(F.col("model").isin("gnn", "rf")), ("gnn", "rf")).where("gnn <> rf")
    at = wide.unpivot(["profile", "y"], ["gnn", "rf"], "model", "pred")
    return r6(metrics.scores(metrics.cube(at, KEYS), KEYS).select(*KEYS, "n", "macro_f1"))


# graphs --------------------------------------------------------------------------------------------------

CHUNK = "SELECT node_id, CAST(row_number() OVER (ORDER BY node_id) - 1 AS BIGINT) AS id FROM cells WHERE \"row\" BETWEEN 3 AND 12 AND col BETWEEN 5 AND 20"


@query("chunk_subgraph", f", inside AS ({CHUNK}) SELECT a.id AS src, b.id AS dst, ROUND(dist, 6) AS dist FROM edges JOIN inside a ON src = a.node_id JOIN inside b ON dst = b.node_id")
def _(v):
    inside = v.cells().where("row between 3 and 12 and col between 5 and 20").select("node_id")
    return r6(grid.subgraph(v.edges(), inside))


@query("chunk_points", f", inside AS ({CHUNK}) SELECT id AS cell, event_id FROM points JOIN inside USING (node_id)")
def _(v):
    inside = grid.renumbered(v.cells().where("row between 3 and 12 and col between 5 and 20").select("node_id"))
    return v.points().join(inside, "node_id").select(F.col("id").alias("cell"), "event_id")


CHUNKS = """, axis_r AS (SELECT i AS cr, i * 24 AS r0, least(i * 24 + 32, h) AS r1, i = 0 AS first_r, i = greatest(CAST(ceil((h - 32) / 24) AS INTEGER), 0) AS last_r FROM grid, LATERAL (SELECT CAST(unnest(range(0, greatest(CAST(ceil((h - 32) / 24) AS INTEGER), 0) + 1)) AS INTEGER) AS i)),
axis_c AS (SELECT i AS cc, i * 24 AS c0, least(i * 24 + 32, w) AS c1, i = 0 AS first_c, i = greatest(CAST(ceil((w - 32) / 24) AS INTEGER), 0) AS last_c FROM grid, LATERAL (SELECT CAST(unnest(range(0, greatest(CAST(ceil((w - 32) / 24) AS INTEGER), 0) + 1)) AS INTEGER) AS i)),
chunks AS (SELECT cr, cc, node_id, CAST(row_number() OVER (PARTITION BY cr, cc ORDER BY node_id) - 1 AS BIGINT) AS id, (first_r OR "row" >= r0 + 4) AND (last_r OR "row" < r1 - 4) AND (first_c OR col >= c0 + 4) AND (last_c OR col < c1 - 4) AS kept
 FROM cells JOIN axis_r ON "row" >= r0 AND "row" < r1 JOIN axis_c ON col >= c0 AND col < c1)"""


def _chunks(v) -> DataFrame:
    """Chunks of 32 x 32 cells that overlap by 8; 4 are cropped on the way back."""
    _, h, w = v.shape
    return grid.chunked(v.cells().select("node_id", "row", "col"), h, w, 32, 8, 4)


@query("chunks_of_cells", f"{CHUNKS} SELECT cr, cc, node_id, id, kept FROM chunks")
def _(v):
    return _chunks(v).select("cr", "cc", "node_id", "id", "kept")


@query("chunks_of_edges", f"{CHUNKS} SELECT a.cr, a.cc, a.id AS src, b.id AS dst, ROUND(dist, 6) AS dist FROM edges JOIN chunks a ON src = a.node_id JOIN chunks b ON dst = b.node_id AND a.cr = b.cr AND a.cc = b.cc")
def _(v):
    _, h, w = v.shape
    return r6(grid.chunked_edges(_chunks(v), h, w))


@query("chunks_of_points", f"{CHUNKS} SELECT cr, cc, id AS cell, event_id FROM points JOIN chunks USING (node_id)")
def _(v):
    return grid.chunked_points(_chunks(v), v.points().select("event_id", "node_id")).select("cr", "cc", "cell", "event_id")


@query("chunks_put_together", ", deg AS (SELECT dst AS node_id, count(*) AS degree FROM edges GROUP BY dst) SELECT node_id, degree FROM deg")
def _(v):
    """Degrees counted in every chunk and cropped: at the borders of chunks as in the whole graph."""
    _, h, w = v.shape
    chunks = _chunks(v)
    degrees = grid.chunked_edges(chunks, h, w).groupBy("cr", "cc", F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    return grid.uncropped(chunks, degrees)


@query("edge_union", "SELECT count(*) AS edges, count(DISTINCT src) AS nodes FROM (SELECT src, dst FROM edges WHERE src < dst UNION SELECT src, dst FROM edges WHERE dist < 40)")
def _(v):
    e = v.edges().select("src", "dst", "dist")
    both = grid.merged_edges([e.where("src < dst"), e.where("dist < 40")])
    return both.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("nodes"))


_PAD = "pad AS (SELECT c.node_id, o.dr, o.dc, n.elevation_m AS z FROM cells c, offsets o, grid JOIN cells n ON n.\"row\" = least(greatest(c.\"row\" + o.dr, 0), h - 1) AND n.col = least(greatest(c.col + o.dc, 0), w - 1))"


def _z(dr: int, dc: int) -> str:
    return f"max(z) FILTER (dr = {dr} AND dc = {dc})"


@query("terrain_derivatives", f""", {_PAD}, d AS (SELECT node_id, ({_z(-1, 1)} + 2 * {_z(0, 1)} + {_z(1, 1)} - {_z(-1, -1)} - 2 * {_z(0, -1)} - {_z(1, -1)}) / 240.0E0 AS zx, ({_z(1, -1)} + 2 * {_z(1, 0)} + {_z(1, 1)} - {_z(-1, -1)} - 2 * {_z(-1, 0)} - {_z(-1, 1)}) / 240.0E0 AS zy,
 {_z(0, 0)} AS z, avg(z) FILTER (dr <> 0 OR dc <> 0) AS around, max(z) - min(z) AS roughness, ({_z(0, 1)} + {_z(0, -1)} + {_z(1, 0)} + {_z(-1, 0)} - 4 * {_z(0, 0)}) / 900.0E0 AS curvature, sum(z * z) AS zz, sum(z) AS zs FROM pad GROUP BY node_id)
SELECT node_id, ROUND(degrees(atan(sqrt(zx * zx + zy * zy))), 6) AS slope_deg, ROUND(z - around, 6) AS tpi, ROUND(sqrt(zz - 2 * z * zs + 9 * z * z), 6) AS tri, CAST(roughness AS BIGINT) AS roughness, ROUND(curvature, 6) AS curvature FROM d""")
def _(v):
    """Slope, position, ruggedness, roughness and curvature of 3 x 3 windows; beyond the border the border's cells are repeated."""
    _, h, w = v.shape
    d = grid.derivatives(v.cells().select("node_id", "row", "col", "elevation_m"), "elevation_m", h, w)
    return r6(d.withColumn("roughness", long("roughness")))


# windows of a map, blocks, value maps --------------------------------------------------------------------

_TILE = 20


@query("window_disagreement", f"SELECT profile, CAST(FLOOR(\"row\" / {_TILE}) AS BIGINT) AS window_row, CAST(FLOOR(col / {_TILE}) AS BIGINT) AS window_col, count(*) AS n, ROUND(100.0E0 * count(*) FILTER (gnn = rf) / count(*), 6) AS agree_pct, ROUND(100.0E0 * count(*) FILTER (gnn > rf) / count(*), 6) AS more_pct, ROUND(100.0E0 * count(*) FILTER (gnn < rf) / count(*), 6) AS less_pct FROM wide JOIN cells USING (node_id) GROUP BY ALL")
def _(v):
    wide = v.wide()
    _, _, w = v.shape
    signs = {"agree": F.col("gnn") == F.col("rf"), "more": F.col("gnn") > F.col("rf"), "less": F.col("gnn") < F.col("rf")}
    return r6(analysis.window_shares(wide, w, _TILE, ["profile"], signs))


@query("window_errors", f"SELECT profile, model, CAST(FLOOR(\"row\" / {_TILE}) AS BIGINT) AS window_row, CAST(FLOOR(col / {_TILE}) AS BIGINT) AS window_col, count(*) AS n, ROUND(100.0E0 * count(*) FILTER (pred = y) / count(*), 6) AS correct_pct, ROUND(100.0E0 * count(*) FILTER (pred < y) / count(*), 6) AS dangerous_pct, ROUND(100.0E0 * count(*) FILTER (pred > y) / count(*), 6) AS conservative_pct FROM preds JOIN cells USING (node_id) GROUP BY ALL")
def _(v):
    _, _, w = v.shape
    signs = {"correct": F.col("pred") == F.col("y"), "dangerous": F.col("pred") < F.col("y"), "conservative": F.col("pred") > F.col("y")}
    return r6(analysis.window_shares(v.preds(), w, _TILE, KEYS, signs))


@query("window_isolation", f"SELECT profile, CAST(FLOOR(\"row\" / {_TILE}) AS BIGINT) AS window_row, CAST(FLOOR(col / {_TILE}) AS BIGINT) AS window_col, count(*) AS n, ROUND(100.0E0 * count(*) FILTER (2 * other > degree) / count(*), 6) AS isolated_pct FROM (SELECT a.profile, dst, count(*) AS degree, count(*) FILTER (a.y <> b.y) AS other {LABEL_EDGES} GROUP BY a.profile, dst) JOIN cells ON dst = node_id GROUP BY ALL")
def _(v):
    _, _, w = v.shape
    cell = _label_neighbours(v).groupBy("profile", "dst").agg(F.count("*").alias("degree"), F.count_if(F.col("y_src") != F.col("y_dst")).alias("other"))
    return r6(analysis.window_shares(cell.withColumnRenamed("dst", "node_id"), w, _TILE, ["profile"], {"isolated": 2 * F.col("other") > F.col("degree")}))


SIZES = (0.25, 0.5, 1.0)


def _audit(km: float) -> str:
    block = f"CAST(FLOOR((lat - (SELECT min(lat) FROM cells)) / ({km!r}E0 / 111.0E0)) * 1000 + FLOOR((lon - (SELECT min(lon) FROM cells)) / ({km!r}E0 / 85.0E0)) AS BIGINT)"
    return f"SELECT {km!r}E0 AS km, split, count(*) AS blocks, count(*) FILTER (kinds = 1) AS pure, ROUND(100.0E0 * count(*) FILTER (kinds = 1) / count(*), 6) AS pure_pct FROM (SELECT b, min(split) AS split, count(DISTINCT split) AS kinds FROM (SELECT {block} AS b, split FROM cells JOIN cell_splits USING (node_id)) GROUP BY b) GROUP BY split"


@query("block_audit", " UNION ALL ".join(map(_audit, SIZES)))
def _(v):
    """How pure blocks of several sizes are, given the splits in use."""
    splits, out = v.cell_splits().select("node_id", "split"), None
    for km in SIZES:
        one = split.purity(split.block_ids(v.cells(), km=km).select("node_id", "block_id"), splits)
        one = one.select(F.lit(km).alias("km"), "split", "blocks", long("pure").alias("pure"), (100.0 * F.col("pure") / F.col("blocks")).alias("pure_pct"))
        out = one if out is None else out.union(one)
    return r6(out)


@query("elevation_stats", "SELECT count(z) AS valid, count(*) FILTER (z IS NULL) AS nodata, ROUND(avg(z), 6) AS mean, ROUND(median(z), 6) AS middle FROM (SELECT CASE WHEN raw < -100 THEN NULL ELSE raw END AS z FROM (SELECT CASE WHEN water_mask = 1 THEN -9999 ELSE elevation_m END AS raw FROM cells))")
def _(v):
    raw = v.cells().select(F.when(F.col("water_mask") == 1, -9999).otherwise(F.col("elevation_m")).alias("raw"))
    z = raw.select(F.when(F.col("raw") >= -100, F.col("raw")).alias("z"))
    return r6(z.agg(F.count("z").alias("valid"), F.count_if(F.col("z").isNull()).alias("nodata"), F.avg("z").alias("mean"), F.median("z").alias("middle")))


@query("raster_pixel_stats", "SELECT CAST(k AS INTEGER) AS value, count(y) AS n, ROUND(100.0E0 * count(y) / (SELECT count(*) FROM cells), 6) AS pct FROM range(0, 4) t(k) LEFT JOIN (SELECT CASE WHEN node_id % 13 = 0 THEN 0 ELSE y END AS y FROM labels_cell WHERE profile = 'a_pe') ON y = k GROUP BY k")
def _(v):
    band = v.labels().where("profile = 'a_pe'").select(F.when(F.col("node_id") % 13 == 0, 0).otherwise(F.col("y")).alias("y"))
    return r6(raster.pixel_stats(band, "y", (0, 1, 2, 3)))


@query("target_grid", "SELECT split, CAST(round((max(lon) - min(lon)) / 0.0000898E0) AS BIGINT) AS width, CAST(round((max(lat) - min(lat)) / 0.0000898E0) AS BIGINT) AS height FROM cells JOIN cell_splits USING (node_id) GROUP BY split")
def _(v):
    """The size of a grid of about 10 m that covers the cells of each split."""
    at = v.cells().select("node_id", "lat", "lon").join(v.cell_splits().select("node_id", "split"), "node_id").groupBy("split")
    size = [F.round((F.max(c) - F.min(c)) / 0.0000898).cast("bigint").alias(n) for c, n in (("lon", "width"), ("lat", "height"))]
    return at.agg(*size)


_METRES = "CASE WHEN lo >= 0 AND hi <= 1 THEN z * 600 + 800 WHEN hi < 10 THEN 800 + (z - lo) / greatest(hi - lo, 1e-8) * 600 ELSE z END"
_SCALED = (("unit", "(elevation_m - 800) / 1000000.0E0"), ("scores", "(elevation_m - 900) / 100000.0E0"), ("metres", "CAST(elevation_m AS DOUBLE)"))


@query("elevation_in_metres", " UNION ALL ".join(f"SELECT '{name}' AS form, count(*) AS n, ROUND(min(m), 6) AS low, ROUND(max(m), 6) AS high, ROUND(avg(m), 6) AS mean FROM (SELECT {_METRES} AS m FROM (SELECT {x} AS z, min({x}) OVER () AS lo, max({x}) OVER () AS hi FROM cells))" for name, x in _SCALED))
def _(v):
    out = None
    for name, x in (("unit", (F.col("elevation_m") - 800) / 1000000.0), ("scores", (F.col("elevation_m") - 900) / 100000.0), ("metres", F.col("elevation_m").cast("double"))):
        one = raster.in_metres(v.cells().select(x.alias("z")), "z").agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"), F.avg("z").alias("mean"))
        one = one.select(F.lit(name).alias("form"), "n", "low", "high", "mean")
        out = one if out is None else out.union(one)
    return r6(out)


@query("class_band", f", {ENT} SELECT \"row\", col, CAST(CASE WHEN entropy IS NULL THEN 0 WHEN entropy >= 0.8E0 THEN 3 WHEN top = 3 THEN 4 ELSE top END AS TINYINT) AS band FROM cells c LEFT JOIN (SELECT * FROM ent WHERE profile = 'a_pe' AND node_id % 13 <> 0) e USING (node_id)")
def _(v):
    """Four classes as bytes, 0 where a pixel has no prediction."""
    e = uncertainty.reclassify(_entropy(v).where("profile = 'a_pe' and node_id % 13 <> 0"), 0.8)
    return raster.band(v.cells().select("node_id", "row", "col"), e.select("node_id", F.col("pred4").cast("tinyint").alias("band")), "band", 0)


@query("entropy_band", f", {ENT} SELECT \"row\", col, COALESCE(CAST(entropy AS FLOAT), CAST(-1 AS FLOAT)) AS band FROM cells c LEFT JOIN (SELECT * FROM ent WHERE profile = 'a_pe' AND node_id % 13 <> 0) e USING (node_id)")
def _(v):
    """Entropy as a float band, -1 where a pixel has none."""
    e = _entropy(v).where("profile = 'a_pe' and node_id % 13 <> 0")
    return raster.band(v.cells().select("node_id", "row", "col"), e.select("node_id", F.col("entropy").cast("float").alias("band")), "band", -1.0)


@query("entropy_d", "SELECT node_id, profile, ROUND(-(p1 * ln(p1 + 1e-9) + p2 * ln(p2 + 1e-9) + p3 * ln(p3 + 1e-9)) / ln(3.0E0), 6) AS entropy FROM entropies")
def _(v):
    return r6(uncertainty.with_entropy(v.profile_probs(), "normalized_d").select("node_id", "profile", "entropy"))


@query("first_rows", "SELECT node_id, ROUND(ndvi, 6) AS ndvi FROM cells ORDER BY node_id LIMIT 5000")
def _(v):
    return r6(v.cells().select("node_id", "ndvi").orderBy("node_id").limit(5000))


@query("embedding_dot", "SELECT vec_id, ROUND(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(embedding[1] AS DOUBLE))), 4) AS dot FROM embeddings")
def _(v):
    """Every vector times a constant vector of its own first component."""
    e = v.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", F.round(S.dot(F.col("e"), F.transform("e", lambda _x: F.col("e")[0])), 4).alias("dot"))


# resampling and raster files -----------------------------------------------------------------------------


def _resampled(v, height: int, width: int) -> DataFrame:
    _, h, w = v.shape
    pixels = v.cells().where("water_mask = 0")
    return r6(raster.bilinear(pixels.select("row", "col", "elevation_m"), "elevation_m", (h, w), (height, width)))


@query("bilinear_finer", ", src AS (SELECT \"row\" AS r, col AS c, CAST(elevation_m AS DOUBLE) AS z FROM cells WHERE water_mask = 0), size AS (SELECT h, w, CAST(FLOOR(3 * h / 2) AS BIGINT) AS th, 2 * w + 1 AS tw FROM grid), target AS (SELECT i, j, least(greatest((i + 0.5E0) * h / th - 0.5E0, 0.0E0), h - 1.0E0) AS y, least(greatest((j + 0.5E0) * w / tw - 0.5E0, 0.0E0), w - 1.0E0) AS x, h, w FROM size, LATERAL (SELECT unnest(range(0, th)) AS i), LATERAL (SELECT unnest(range(0, tw)) AS j)), around AS (SELECT i, j, CAST(floor(y) AS BIGINT) + dr AS r, CAST(floor(x) AS BIGINT) + dc AS c, (1 - abs(y - floor(y) - dr)) * (1 - abs(x - floor(x) - dc)) AS wt FROM target, (VALUES (0), (1)) AS a(dr), (VALUES (0), (1)) AS b(dc)) SELECT i AS \"row\", j AS col, ROUND(sum(wt * z) / sum(wt), 6) AS elevation_m FROM around JOIN src USING (r, c) WHERE wt > 0 GROUP BY i, j")
def _(v):
    """Elevations on a finer grid; water counts as missing."""
    return _resampled(v, 3 * v.shape[1] // 2, 2 * v.shape[2] + 1)


@query("bilinear_coarser", ", src AS (SELECT \"row\" AS r, col AS c, CAST(elevation_m AS DOUBLE) AS z FROM cells WHERE water_mask = 0), size AS (SELECT h, w, CAST(FLOOR(h / 2) AS BIGINT) + 1 AS th, CAST(FLOOR(w / 3) AS BIGINT) + 1 AS tw FROM grid), target AS (SELECT i, j, least(greatest((i + 0.5E0) * h / th - 0.5E0, 0.0E0), h - 1.0E0) AS y, least(greatest((j + 0.5E0) * w / tw - 0.5E0, 0.0E0), w - 1.0E0) AS x, h, w FROM size, LATERAL (SELECT unnest(range(0, th)) AS i), LATERAL (SELECT unnest(range(0, tw)) AS j)), around AS (SELECT i, j, CAST(floor(y) AS BIGINT) + dr AS r, CAST(floor(x) AS BIGINT) + dc AS c, (1 - abs(y - floor(y) - dr)) * (1 - abs(x - floor(x) - dc)) AS wt FROM target, (VALUES (0), (1)) AS a(dr), (VALUES (0), (1)) AS b(dc)) SELECT i AS \"row\", j AS col, ROUND(sum(wt * z) / sum(wt), 6) AS elevation_m FROM around JOIN src USING (r, c) WHERE wt > 0 GROUP BY i, j")
def _(v):
    return _resampled(v, v.shape[1] // 2 + 1, v.shape[2] // 3 + 1)


def _georeference() -> dict[str, float]:
    return {"west": -61.6138, "north": 4.9755, "step": 0.000277778}


@query("class_rasters", "SELECT \"row\", col, max(CASE WHEN profile = 'a_pe' THEN y END) AS a_pe, max(CASE WHEN profile = 'motorizada' THEN y END) AS motorizada, max(CASE WHEN profile = 'mecanizada' THEN y END) AS mecanizada, max(CASE WHEN profile = 'blindada' THEN y END) AS blindada FROM labels_all GROUP BY \"row\", col")
def _(v):
    """Classes of all profiles as bands of raster files, written and read again."""
    _, h, w = v.shape
    path = files.work_path(v.spark, "classes")
    classes = rules.class_columns(v.cells(), dimensions.LIMITS).select("row", "col", *dimensions.PROFILES)
    rasters.write_raster(classes, path, h, w, "uint8", 0, block=128, tile=64, tags={"MODEL": "rules", "CLASSES": "1=Go,2=SlowGo,3=NoGo"}, **_georeference())
    return rasters.read_raster(v.spark, path)


@query("entropy_rasters", "SELECT \"row\", col, " + ", ".join(f"max(CASE WHEN profile = '{p}' AND water_mask = 0 THEN ROUND(raw, 6) END) AS {p}" for p in dimensions.PROFILES) + " FROM entropies JOIN cells USING (node_id) GROUP BY \"row\", col")
def _(v):
    """Predictive entropies of all profiles as bands with nodata -9999 over water."""
    _, h, w = v.shape
    path = files.work_path(v.spark, "entropies")
    dry = v.profile_probs().join(v.cells().select("node_id", "row", "col", "water_mask"), "node_id")
    value = F.when(F.col("water_mask") == 0, S.entropy_raw([F.col("p1"), F.col("p2"), F.col("p3")]))
    bands = dry.groupBy("row", "col").pivot("profile", list(dimensions.PROFILES)).agg(F.first(value))
    rasters.write_raster(bands, path, h, w, "float64", -9999.0, block=128, tile=64, **_georeference())
    return r6(rasters.read_raster(v.spark, path))


@query("component_raster")
def _(v):
    """The first component of the cells that have an embedding as a band, -9999 elsewhere."""
    _, h, w = v.shape
    path = files.work_path(v.spark, "component")
    out, _, _ = learn.principal_components(v.table("embeddings"), "embedding", 1)
    first = learn.component_array(out).select(F.col("vec_id").alias("node_id"), F.col("pc")[0].alias("pc1"))
    rasters.write_raster(v.cells().join(first, "node_id").select("row", "col", "pc1"), path, h, w, "float32", -9999.0, block=128, tile=64, **_georeference())
    return rasters.read_raster(v.spark, path).select("row", "col", F.round("pc1", 6).alias("pc1"))


@query("raster_decimated", "SELECT \"row\", col, CAST(elevation_m AS INTEGER) AS elevation_m FROM cells, grid WHERE \"row\" >= 5 AND col < w - 3 AND \"row\" % 4 = 0 AND col % 4 = 0")
def _(v):
    """Every fourth row and column of a window of a raster file."""
    _, h, w = v.shape
    path = files.work_path(v.spark, "elevation")
    rasters.write_raster(v.cells().select("row", "col", "elevation_m"), path, h, w, "int32", -9999, block=64, tile=16, **_georeference())
    return rasters.read_raster(v.spark, path, window=(5, h, 0, w - 3), every=4)


# training ------------------------------------------------------------------------------------------------

_HIST = "hist AS (SELECT CAST(l_orderkey % 60 AS INTEGER) AS epoch, ROUND(1.0E0 / (1 + min(l_orderkey % 60)) + avg(l_discount), 6) AS loss FROM lineitem GROUP BY 1)"


_WALK = """, steps AS (SELECT *, row_number() OVER (ORDER BY epoch) AS i FROM hist),
walk AS (SELECT i, epoch, loss, loss AS best, CAST(0 AS INTEGER) AS counter, false AS stop FROM steps WHERE i = 1 UNION ALL
 SELECT s.i, s.epoch, s.loss, CASE WHEN s.loss > best - 0.01E0 THEN best ELSE s.loss END, CAST(CASE WHEN s.loss > best - 0.01E0 THEN counter + 1 ELSE 0 END AS INTEGER), s.loss > best - 0.01E0 AND counter + 1 >= 5 FROM walk w JOIN steps s ON s.i = w.i + 1 WHERE NOT w.stop)
SELECT epoch, loss, best, counter, stop FROM walk"""


@query("early_stopping", f", {_HIST}{_WALK}")
def _(v):
    """Patience 5 and a least gain of 0.01; epochs after the stop are not run."""
    hist = v.table("lineitem").groupBy((F.col("l_orderkey") % 60).cast("int").alias("epoch")).agg(F.avg("l_discount").alias("d"))
    hist = hist.select("epoch", F.round(1.0 / (1 + F.col("epoch")) + F.col("d"), 6).alias("loss"))
    return training.early_stopping(hist, patience=5, min_delta=0.01)


ORACLES["early_stopping"] = ORACLES["early_stopping"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("models_ranked", f"SELECT model, CAST(rank() OVER (ORDER BY ROUND(avg(macro_f1), 4) DESC) AS INTEGER) AS place FROM ({oracle.scores('profile, model', 'preds', columns='macro_f1')}) GROUP BY model")
def _(v):
    scored = metrics.scores(_cube(v), KEYS).groupBy("model").agg(F.round(F.avg("macro_f1"), 4).alias("f1"))
    return scored.select("model", F.rank().over(Window.orderBy(F.desc("f1"))).alias("place"))  # a row per model


@query("pc_feature_corr")
def _(v):
    """The three features that follow each of the first four components of the embeddings most."""
    e = v.table("embeddings").join(v.cells().select(F.col("node_id").alias("vec_id"), *FEATURES), "vec_id")
    out, _, _ = learn.principal_components(e, "embedding", 4)
    r = learn.component_correlations(out, FEATURES, 4).withColumn("r", F.round(F.abs("r"), 6))  # a component's sign is free
    best = Window.partitionBy("component").orderBy(F.desc_nulls_last("r"), "feature")
    return r.withColumn("place", F.row_number().over(best)).where("place <= 3")


@query("pca_transformed")
def _(v):
    """The first four components of every embedding."""
    out, _, _ = learn.principal_components(v.table("embeddings"), "embedding", 4)
    return r6(learn.component_array(out).select("vec_id", *[F.col("pc")[i].alias(f"pc{i + 1}") for i in range(4)]))


@query("stacked_features", "SELECT node_id, CAST(8 AS INTEGER) AS width, " + ", ".join(f"ROUND(CAST({c} AS DOUBLE), 6) AS f{i}" for i, c in enumerate(FEATURES)) + " FROM cells")
def _(v):
    """Features in their fixed order as one vector a cell."""
    stacked = learn.assemble(v.cells().select("node_id", *FEATURES), FEATURES).select("node_id", vector_to_array("features").alias("f"))
    return stacked.select("node_id", F.size("f").alias("width"), *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(len(FEATURES))])


@query("early_stopping_stream", f", {_HIST}{_WALK}".replace("SELECT epoch, loss, best, counter, stop FROM walk", "SELECT 'all' AS run, epoch, loss, best, counter, stop FROM walk"))
def _(v):
    """The walk of early_stopping from a stream of files, a few epochs in each."""
    hist = v.table("lineitem").groupBy((F.col("l_orderkey") % 60).cast("int").alias("epoch")).agg(F.avg("l_discount").alias("d"))
    hist = hist.select(F.lit("all").alias("run"), "epoch", F.round(1.0 / (1 + F.col("epoch")) + F.col("d"), 6).alias("loss"))
    source, target, marks = (files.work_path(v.spark, f"stopping-{x}") for x in ("in", "out", "marks"))
    hist.repartition(4, "epoch").write.parquet(source)
    stream = v.spark.readStream.schema("run string, epoch int, loss double").option("maxFilesPerTrigger", 1).parquet(source)
    walk = state.early_stopping_stream(stream, 5, 0.01)
    walk.writeStream.format("parquet").outputMode("append").option("checkpointLocation", marks).trigger(availableNow=True).start(target).awaitTermination()
    return v.spark.read.schema(state.WALK).parquet(target)


ORACLES["early_stopping_stream"] = ORACLES["early_stopping_stream"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("means_upserted", "SELECT \"row\", col, ROUND(avg(dn), 6) AS mean, count(*) AS scenes FROM scenes WHERE dn > 0 GROUP BY \"row\", col")
def _(v):
    """Means of all valid pixels from a stream of scenes, upserted batch by batch: three batches, of as many files as there are."""
    source, target, marks = (files.work_path(v.spark, f"means-{x}") for x in ("in", "out", "marks"))
    # dealt by scene and pixel, so no task takes a third of all; rows of a task go to a file for each third of the scenes
    v.scenes().withColumn("third", F.col("scene_id") % 3).write.partitionBy("third").parquet(source)
    stored = v.spark.read.parquet(source)
    table = state.Upserts(v.spark, target, ["row", "col"])
    state.mean_upserts(v.spark, source, table, marks, files_per_batch=max(1, -(-len(stored.inputFiles()) // 3)))
    return r6(table.read(state.MEANS))


# graph networks with given weights -----------------------------------------------------------------------

NETWORK_FEATURES = ["slope", "tri", "ndvi", "ndwi", "tpi"]


def given_weights(width: int = 6, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights of a fixed seed, for passes over networks that are not trained here."""
    rng = np.random.default_rng(seed)
    out = {"encoder": rng.normal(size=(width, len(NETWORK_FEATURES))) / 2, "bias": rng.normal(size=width) / 4}
    for k in range(3):
        out |= {f"left{k}": rng.normal(size=(width, width)) / 3, f"right{k}": rng.normal(size=(width, width)) / 3, f"scorer{k}": rng.normal(size=width)}
    out |= {f"relation{k}": rng.normal(size=(width, width)) / 6 for k in range(4)}
    return out | {p: rng.normal(size=(3, width)) for p in dimensions.PROFILES}


@query("attention_forward")
def _(v):
    """Encoder, three attention layers and a head for each profile, over all cells, tile by tile."""
    _, height, width = v.shape
    net = models.AttentionNet(dimensions.PROFILES, NETWORK_FEATURES)
    return r6(net.infer(given_weights(), v.cells(), net.tiling(height, width)))


def _labelled(v) -> DataFrame:
    """Cells with a class for each profile (y_<profile>) and their split, which meets them by their block."""
    cells = rules.class_columns(split.block_ids(v.cells(), km=0.5), dimensions.LIMITS).withColumnsRenamed({p: f"y_{p}" for p in dimensions.PROFILES})
    return cells.join(v.splits(), "block_id")


def perceptron_scores(v, features: list[str], epochs: int = 50) -> DataFrame:
    net = models.Perceptron(dimensions.PROFILES, features)
    cells = _labelled(v)
    train = cells.where("split = 'train'")
    packs = descent.write_packs(models.perceptron_batches(net, train, train.count(), kind="float"), 1)
    trained = descent.descend(net, descent.State(net.start()), packs, epochs)
    return r6(metrics.scores(net.confusion(trained.weights, cells.where("split = 'test'")), ["profile"])).withColumn("split", F.lit("test"))


@query("attention_trained")
def _(v):
    """Trains the network on the training cells and scores the epoch of the least validation loss on the test cells."""
    _, height, width = v.shape
    net = models.AttentionNet(dimensions.PROFILES, NETWORK_FEATURES, layers=2)
    t = net.tiling(height, width, tile=32)
    cells = _labelled(v)
    counting = {s: cells.withColumn("counted", F.col("split") == s) for s in ("train", "val", "test")}
    packs = {s: descent.write_packs(net.packs(counting[s], t, "float"), 1) for s in ("train", "val")}
    at = checkpoints.Checkpoints(v.spark, files.work_path(v.spark, "attention"))
    descent.descend(net, descent.State(net.start(16)), packs["train"], 8, 2e-2, descent.cosine, clip=1.0, validation=packs["val"], patience=6, checkpoints=at)
    best = descent.load_state(at, "best")
    return r6(metrics.scores(net.confusion(best.weights, counting["test"], net.tiling(height, width)), ["profile"]))


@query("relation_forward")
def _(v):
    """Encoder and one layer over four relations: neighbours along rows, along columns, across, and the cell itself."""
    w, (_, height, width) = given_weights(), v.shape
    out = models.RelationNet(NETWORK_FEATURES).infer(w, v.cells(), height, width)
    return r6(out.select("node_id", *[F.col("h")[i].alias(f"h{i}") for i in range(len(w["bias"]))]))


@query("beam_points", "SELECT event_id % 8 AS beam, count(*) AS n, ROUND(avg(elevation), 6) AS mean FROM points WHERE source = 'ICESat-2' AND lat >= 4.9 GROUP BY 1 UNION ALL SELECT 8 + event_id % 8, count(*), ROUND(avg(elevation), 6) FROM points WHERE source = 'GEDI' AND quality = 1 AND lat >= 4.9 GROUP BY 1")
def _(v):
    """Points stored as beams with arrays, a thousand or so in each, and read as points again."""
    path = files.work_path(v.spark, "beams")
    name = F.concat(F.when(F.col("source") == "GEDI", "BEAM").otherwise("gt"), F.col("event_id") % 8)
    part = F.floor(F.col("event_id") / 8192)  # a granule
    rows = v.points().groupBy("source", name.alias("beam"), part.alias("granule")).agg(F.collect_list(F.struct("lat", "lon", "elevation", "quality")).alias("p"))
    rows.select("source", "beam", *[F.col("p")[c].alias(c) for c in ("lat", "lon", "elevation", "quality")]).write.parquet(path)
    stored = v.spark.read.parquet(path)
    found = [files.points_of_beams(stored.where(F.col("source") == s), s, (-180.0, 4.9, 180.0, 90.0)).select((k + F.regexp_extract("beam", "[0-9]+$", 0).cast("long")).alias("beam"), "elevation") for s, k in (("ICESat-2", 0), ("GEDI", 8))]
    return r6(found[0].unionByName(found[1]).groupBy("beam").agg(F.count("*").alias("n"), F.avg("elevation").alias("mean")))


@query("ingested_twice", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def _(v):
    """Files of events that arrive in two portions, each read once by an incremental stream."""
    source, target, marks = (files.work_path(v.spark, f"events-{x}") for x in ("in", "out", "marks"))
    events = v.table("events").select("event_id", "event_type")
    for late in (False, True):
        events.where((F.col("event_type") == "purchase") == late).write.mode("append").parquet(source)
        ingest.ingest_new(v.spark, source, target, marks)
    return v.spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("model_stored")
def _(v):
    """Forest and components saved, loaded and applied: how many predictions of the loaded forest differ (none)."""
    data = learn.assemble(rules.classify(v.cells(), v.limits().where("profile = 'a_pe'")), FEATURES).select("node_id", "y", "features")
    path, model = files.work_path(v.spark, "forest"), learn.random_forest(data, trees=5, depth=6)
    learn.save_model(model, path, {"profile": "a_pe", "columns": ",".join(FEATURES)})
    again, said = learn.load_model(path)
    both = learn.predict(model, data).select("node_id", F.col("pred").alias("before")).join(learn.predict(again, data).select("node_id", "pred"), "node_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("pred") != F.col("before")).alias("differ")).withColumn("kind", F.lit(said["kind"]))


@query("typed_forward")
def _(v):
    """Cells, pixels of scenes and elevation points through two layers of attention with given weights."""
    _, h, w = v.shape
    net = typed.TypedNet(tuple(NETWORK_FEATURES), {"pixel": ("dn", "cloud"), "point": ("height", "quality")})
    pixels = v.scenes().select((F.col("row") * w + F.col("col")).alias("node_id"), (F.col("dn") / 10000.0).alias("dn"), (F.col("cloud") / 10.0).alias("cloud"))
    points = v.points().select("node_id", ((F.col("elevation") - 800) / 600.0).alias("height"), "quality")
    out = net.embed(net.start(6), v.cells(), {"pixel": pixels, "point": points}, h, w)
    return r6(out.select("node_id", *[F.col("h")[i].alias(f"h{i}") for i in range(6)]))


@query("scene_search_area", """, observed AS (SELECT l_linenumber * 100 + CAST(year(l_shipdate) % 100 AS BIGINT) AS scene_id, l_shipdate AS taken, CAST(l_linenumber * 7 % 10 AS INTEGER) AS cloud, lat, lon FROM lineitem JOIN cells ON l_orderkey = node_id),
catalogue AS (SELECT scene_id, min(taken) AS first, max(taken) AS last, max(cloud) AS cloud, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, count(*) AS pixels FROM observed GROUP BY scene_id)
SELECT scene_id, cloud, strftime(first, '%Y-%m-%d') AS first_day, pixels FROM catalogue WHERE west <= -61.6 AND east >= -61.61 AND south <= 4.975E0 AND north >= 4.97E0 AND first < DATE '1997-07-01' AND last >= DATE '1994-01-01' AND cloud <= 6 ORDER BY cloud, first, scene_id LIMIT 1000""")
def _(v):
    """Scenes of a year each, searched by box, days and cloud cover."""
    lines = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(v.cells().select("node_id", "lat", "lon"), F.col("l_orderkey") == F.col("node_id"))
    observed = lines.select((F.col("l_linenumber") * 100 + F.year("l_shipdate") % 100).cast("bigint").alias("scene_id"), F.col("l_shipdate").alias("taken"), (F.col("l_linenumber") * 7 % 10).cast("int").alias("cloud"), "lat", "lon")
    found = raster.search(raster.scene_catalogue(observed), (-61.61, 4.97, -61.6, 4.975), "1994-01-01", "1997-06-30", 6)
    return found.select("scene_id", "cloud", F.date_format("first", "yyyy-MM-dd").alias("first_day"), "pixels")


@query("classes_reshaped", "SELECT \"row\", col, y AS value FROM labels_all WHERE profile = 'blindada'")
def _(v):
    """Classes by place, from rows that state nothing but the place's number."""
    _, h, w = v.shape
    classes = rules.class_columns(v.cells(), dimensions.LIMITS).select("node_id", F.col("blindada").alias("value"))
    return raster.reshaped(classes, h, w)


# stored tables: out to files and in again ----------------------------------------------------------------


@query("labels_stored", "SELECT node_id, profile, y FROM labels_cell WHERE profile IN ('a_pe', 'blindada')")
def _(v):
    path = files.work_path(v.spark, "labels")
    files.write_labels(v.labels(), path)
    return files.read_labels(v.spark, path, ["a_pe", "blindada"]).select("node_id", "profile", "y")


@query("raster_window_stored", "SELECT \"row\", col, elevation_m FROM cells WHERE \"row\" BETWEEN 3 AND 9 AND col BETWEEN 5 AND 20")
def _(v):
    path = files.work_path(v.spark, "raster")
    files.write_raster(v.cells().select("row", "col", "elevation_m"), path, 8)
    return files.read_window(v.spark, path, 3, 10, 5, 21, 8).select("row", "col", "elevation_m")


@query("points_stored", "SELECT source, count(*) AS n, ROUND(avg(elevation), 6) AS mean FROM points GROUP BY source")
def _(v):
    """Two appends of one file format, read back as one table."""
    path = files.work_path(v.spark, "points")
    points = v.points().select("lat", "lon", F.col("elevation").cast("double").alias("elevation"), "source", F.lit("b").alias("beam"))
    for source in ("GEDI", "ICESat-2"):
        files.append_points_csv(points.where(F.col("source") == source), path)
    return r6(files.read_points_csv(v.spark, path).groupBy("source").agg(F.count("*").alias("n"), F.avg("elevation").alias("mean")))


@query("report_stored", oracle.scores("profile, model", "preds", columns="n, ROUND(macro_f1, 6) AS macro_f1"))
def _(v):
    """A report as JSON lines; of the candidate paths the first that exists is read."""
    path = files.work_path(v.spark, "report")
    files.write_report(r6(metrics.scores(_cube(v), KEYS).select(*KEYS, "n", "macro_f1")), path)
    return files.read_report(v.spark, [path + "-absent", path]).select("profile", "model", "n", "macro_f1")


@query("predictions_stored", "SELECT node_id, profile, pred FROM preds WHERE model = 'gnn'")
def _(v):
    path = files.work_path(v.spark, "predictions")
    wide = v.wide().groupBy("node_id").pivot("profile", list(dimensions.PROFILES)).agg(F.first("gnn"))
    wide.withColumnRenamed("a_pe", "y_a_pe").write.parquet(path)
    return files.read_predictions(v.spark, path, dimensions.PROFILES)


@query("probabilities_stored", "SELECT node_id, profile, ROUND(p1, 6) AS p1, ROUND(p2, 6) AS p2, ROUND(p3, 6) AS p3 FROM profile_probs")
def _(v):
    path = files.work_path(v.spark, "probabilities")
    arrays = v.profile_probs().groupBy("node_id").pivot("profile", list(dimensions.PROFILES)).agg(F.first(F.array("p1", "p2", "p3")))
    arrays.withColumnRenamed("blindada", "probs_blindada").write.parquet(path)
    return r6(files.read_probabilities(v.spark, path, dimensions.PROFILES))


@query("slim_features", "SELECT node_id, ROUND(slope, 6) AS slope, ROUND(ndvi, 6) AS ndvi, CAST(NULL AS DOUBLE) AS tri FROM cells")
def _(v):
    return r6(files.slim(v.cells(), ["slope", "ndvi"], ["slope", "ndvi", "tri"]))


@query("manifest_stored", "SELECT profile, count(*) AS n, true AS named, true AS hashed FROM labels_cell GROUP BY profile")
def _(v):
    """The labels written by profile, and of every folder's files: rows, and whether each has a size and a SHA-256."""
    path = files.work_path(v.spark, "manifest")
    files.write_labels(v.labels(), path)
    m = files.manifest(v.spark, path).where(F.col("file").contains("profile="))
    named = m.select(F.regexp_extract("file", "profile=([^/]*)/", 1).alias("profile"), (F.col("bytes") > 0).alias("named"), (F.length("sha256") == 64).alias("hashed"))
    rows = files.read_labels(v.spark, path).groupBy("profile").agg(F.count("*").alias("n"))
    return named.groupBy("profile").agg(F.bool_and("named").alias("named"), F.bool_and("hashed").alias("hashed")).join(rows, "profile").select("profile", "n", "named", "hashed")


@query("map_window", "SELECT node_id, ROUND(50000 * 10 * 0.0254E0 / (111320.0E0 * cos(radians(lat))) / 2, 6) AS half_lon, ROUND(50000 * 8 * 0.0254E0 / 111320.0E0 / 2, 6) AS half_lat FROM cells")
def _(v):
    """The half extents of a map at 1 : 50,000 of 10 by 8 inches around every cell."""
    lon, lat = S.half_windows(50_000, 10, 8, F.col("lat"))
    return v.cells().select("node_id", F.round(lon, 6).alias("half_lon"), F.round(lat, 6).alias("half_lat"))


@query("softmax_gelu", "SELECT node_id, ROUND(exp(slope - m) / (exp(slope - m) + exp(ndvi - m) + exp(tri - m)), 6) AS s1, ROUND(exp(tri - m) / (exp(slope - m) + exp(ndvi - m) + exp(tri - m)), 6) AS s3, ROUND(0.5E0 * ndvi * (1 + 2 / sqrt(pi()) * list_sum(list_transform(range(0, 30), lambda n: pow(-1, n) * pow(z, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))), 6) AS g FROM (SELECT *, greatest(slope, ndvi, tri) AS m, CAST(ndvi AS DOUBLE) / sqrt(2) AS z FROM cells)")
def _(v):
    s = S.softmax([F.col("slope"), F.col("ndvi"), F.col("tri")])
    return r6(v.cells().select("node_id", s[0].alias("s1"), s[2].alias("s3"), S.gelu(F.col("ndvi")).alias("g")))
