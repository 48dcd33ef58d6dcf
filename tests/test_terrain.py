"""Terrain operators: published golden numbers, properties and edge cases."""

import math
import os

import pytest
from pyspark.sql import functions as F

from cellgrove.functions import scalar as S
from cellgrove.operators import grid, losses, metrics, quality, raster, rules, split
from cellgrove.plans import catalog
from cellgrove.sources import dimensions, files
from cellgrove.sources.views import Views
from cellgrove.streaming import ingest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return Views(spark, SMALL)


def test_flagship_counts(spark):
    rows = catalog.QUERIES["class_distribution"](spark, SMALL).collect()
    assert len(rows) == 12 and sum(r["n"] for r in rows) == 4 * 1500
    assert [r["n"] for r in sorted(rows, key=lambda r: r["y"]) if r["profile"] == "a_pe"] == [618, 412, 470]


def test_edge_counts_of_the_published_grid():
    assert grid.edge_count(3598, 3354, False) == 96_499_828
    assert grid.edge_count(3598, 3354, True) == 108_567_520


def test_edges_are_symmetric_and_counted(views):
    _, h, w = views.shape
    e = views.edges()
    assert e.count() == grid.edge_count(h, w)
    assert e.select("src", "dst").exceptAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).count() == 0


def test_chunks_of_the_published_grid(spark):
    assert grid.chunk_rectangles(spark, 3598, 3354, 250, 50, 25).count() == 306


def test_block_counts_of_the_published_area(spark):
    # 23 x 16 blocks with 85 km a degree of longitude, 23 x 21 with 111
    lat = [4.9755 - i * 0.0025 for i in range(400)]
    lon = [-61.6138 + i * 0.0025 for i in range(373)]
    cells = spark.createDataFrame([(a,) for a in lat], "lat double").crossJoin(spark.createDataFrame([(b,) for b in lon], "lon double"))
    for per_degree, columns in ((85.0, 16), (111.0, 21)):
        ids = split.block_ids(cells, 5.0, 111.0, per_degree).select("block_id").distinct()
        assert ids.select((F.col("block_id") % 1000).alias("c")).distinct().count() == columns


def test_published_confusion_matrix_scores(spark):
    # accuracy and F1 follow from the matrix alone
    m = [[50, 3, 2], [4, 30, 6], [0, 5, 100]]
    cube = spark.createDataFrame([("a", i + 1, j + 1, n) for i, r in enumerate(m) for j, n in enumerate(r)], "k string, y int, pred int, n long")
    s = metrics.scores(cube, ["k"]).first()
    f1 = [2 * m[i][i] / (sum(m[i]) + sum(r[i] for r in m)) for i in range(3)]
    assert s["accuracy"] == pytest.approx(180 / 200) and s["macro_f1"] == pytest.approx(sum(f1) / 3)


def test_macro_f1_leaves_out_absent_classes(spark):
    cube = spark.createDataFrame([("a", 1, 1, 4), ("a", 2, 1, 2)], "k string, y int, pred int, n long")
    s = metrics.scores(cube, ["k"]).first()
    assert s["macro_f1"] == pytest.approx((8 / 10 + 0) / 2)


def test_nan_never_triggers_a_rule(spark):
    nan = float("nan")
    cells = spark.createDataFrame([(1, nan, nan, nan, 0), (2, 0.6, 0.0, 0.0, 0), (3, None, None, None, None), (4, 0.0, 0.9, 0.0, 0)], "node_id long, slope double, ndvi double, ndwi double, water_mask int")
    y = {r["node_id"]: r["y"] for r in rules.classify(cells, dimensions.limits(spark)).where("profile = 'a_pe'").collect()}
    assert y == {1: 1, 2: 3, 3: 1, 4: 3}


def test_classes_grow_with_slope(spark):
    cells = spark.range(0, 90).select(F.col("id").alias("node_id"), (F.col("id") / 90.0).alias("slope"), F.lit(0.0).alias("ndvi"), F.lit(0.0).alias("ndwi"), F.lit(0).alias("water_mask"))
    rows = rules.classify(cells, dimensions.limits(spark)).orderBy("profile", "node_id").collect()
    for p in dimensions.PROFILES:
        ys = [r["y"] for r in rows if r["profile"] == p]
        assert ys == sorted(ys)


def test_incomplete_limits_are_refused(spark):
    with pytest.raises(ValueError):
        dimensions.limits(spark, (("a_pe", 30.0, None, 1.5, 0.7, 0.85, 0.3, 0.1),))


def test_entropy_bounds(spark):
    df = spark.createDataFrame([(1 / 3, 1 / 3, 1 / 3), (1.0, 0.0, 0.0), (0.5, 0.25, 0.25)], "p1 double, p2 double, p3 double")
    p = [F.col("p1"), F.col("p2"), F.col("p3")]
    e = [r[0] for r in df.select(S.entropy_log2(p)).collect()]
    assert e[0] == pytest.approx(1.0) and e[1] == pytest.approx(0.0, abs=1e-6) and 0 < e[2] < 1


def test_argmax_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.4, 0.4)], "a double, b double, c double")
    assert [r[0] for r in df.select(S.first_argmax([F.col("a"), F.col("b"), F.col("c")])).collect()] == [1, 2]


def test_softmax_and_gelu(spark):
    r = spark.createDataFrame([(1.0, 2.0, 700.0)], "a double, b double, c double").select(*[x.alias(f"s{i}") for i, x in enumerate(S.softmax([F.col("a"), F.col("b"), F.col("c")]))], S.gelu(F.col("a")).alias("g")).first()
    assert r["s0"] + r["s1"] + r["s2"] == pytest.approx(1.0) and r["g"] == pytest.approx(0.8412, abs=1e-3)


def test_splits_cover_and_are_disjoint(views):
    cs = views.cell_splits()
    assert cs.count() == views.shape[0] == cs.select("node_id").distinct().count()
    assert {r["split"] for r in cs.select("split").distinct().collect()} == {"train", "test"}  # six blocks leave none for val


def test_reconnaissance_share_falls_with_the_threshold(views):
    from cellgrove.operators import uncertainty

    e = uncertainty.with_entropy(views.profile_probs())
    shares = [uncertainty.reclassify(e, t).where("pred4 = 3").count() for t in (0.2, 0.6, 0.9, 1.1)]
    assert shares == sorted(shares, reverse=True) and shares[-1] == 0


def test_attention_of_equal_values_is_the_value(spark):
    near = spark.createDataFrame([(1, 2, 0.5, 0.1), (3, 2, 0.5, 0.1)], "src long, dst long, x_src double, x_dst double")
    assert losses.attention(near, "x_src", "x_dst", 1.0, 1.0).first()["h"] == pytest.approx(0.5)


def test_one_row_grid(spark):
    cells = spark.createDataFrame([(i, 0, i) for i in range(5)], "node_id long, row long, col long")
    assert grid.edges(cells, 1, 5, False).count() == grid.edge_count(1, 5, False) == 8


def test_roll_up_without_checks(spark):
    assert quality.roll_up([spark.createDataFrame([], "passed boolean")]).first()["success_rate"] == 0.0


def test_stretch_of_a_constant_is_null(spark):
    assert raster.stretch(spark.createDataFrame([(1, 5.0), (2, 5.0)], "node_id long, v double"), "v").first()["stretched"] is None


def test_map_window():
    lon, lat = S.half_window(50_000, 10, 8, 4.4)
    assert lat == round(50_000 * 8 * 0.0254 / 111_320 / 2, 6) and lon > 0 and math.isfinite(lon)


def test_files_round_trip(spark, views, tmp_path):
    files.write_labels(views.labels(), str(tmp_path / "labels"))
    one = files.read_labels(spark, str(tmp_path / "labels"), ["a_pe"])
    assert one.count() == 1500
    pixels = views.cells().select("row", "col", "elevation_m")
    files.write_raster(pixels, str(tmp_path / "raster"), 8)
    assert files.read_window(spark, str(tmp_path / "raster"), 3, 10, 5, 9, 8).count() == 28
    points = views.points().select("lat", "lon", F.col("elevation").cast("double"), "source", F.lit("b1").alias("beam"))
    files.append_points_csv(points, str(tmp_path / "points"))
    files.append_points_csv(points.limit(3), str(tmp_path / "points"))
    assert files.read_points_csv(spark, str(tmp_path / "points")).count() == points.count() + 3
    assert files.manifest(spark, str(tmp_path / "points")).count() > 0


def test_stream_takes_each_file_once(spark, tmp_path):
    source, target, marks = (str(tmp_path / d) for d in ("in", "out", "marks"))
    spark.range(10).write.parquet(source)
    ingest.ingest_new(spark, source, target, marks)
    spark.range(10, 15).write.mode("append").parquet(source)
    ingest.ingest_new(spark, source, target, marks)
    assert sorted(r[0] for r in spark.read.parquet(target).collect()) == list(range(15))


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 12
    assert set(e.oracle_sql()) <= set(e.queries())
