"""Raster files: round trips of all pixels, windows, decimation, aborted jobs; resampling, chunks and nearest cells."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import raster
from cellgrove.sources import files, rasters, tiff


def test_tiff_round_trip():
    rng = np.random.default_rng(1)
    for dtype, nodata in (("uint8", 0), ("int16", -9999), ("float32", -9999.0), ("float64", float("nan"))):
        bands = (rng.random((3, 37, 21)) * 200).astype(dtype)
        data = tiff.encode(bands, ["a", "b", "ç"], 16, nodata, {"MODEL": "x<&>", "CLASSES": "1=Go"}, -61.5, 4.5, 0.25)
        import io

        head = tiff.Header(io.BytesIO(data))
        assert (head.width, head.height, head.names, head.tags) == (21, 37, ["a", "b", "ç"], {"MODEL": "x<&>", "CLASSES": "1=Go"})
        assert (head.west, head.north, head.step) == (-61.5, 4.5, 0.25) and (head.nodata == nodata or np.isnan(nodata))
        for k in range(3):
            got, read = head.window(k, 0, 37, 0, 21)
            assert (got == bands[k]).all() and read == 6
            got, read = head.window(k, 17, 20, 3, 9)
            assert (got == bands[k, 17:20, 3:9]).all() and read == 1


def _pixels(spark, height, width):
    ids = spark.range(height * width)
    at = ids.select(F.floor(F.col("id") / width).alias("row"), (F.col("id") % width).alias("col"))
    return at.where((F.col("row") * 7 + F.col("col")) % 11 != 0).select("row", "col", (1 + (F.col("row") + F.col("col")) % 3).cast("int").alias("a"), F.when(F.col("col") % 5 > 0, F.col("row") % 200).cast("int").alias("b"))


def test_every_pixel_comes_back(spark, tmp_path):
    px, path = _pixels(spark, 50, 70), "file://" + str(tmp_path / "r")
    rasters.write_raster(px.repartition(7), path, 50, 70, "uint8", 255, block=32, tile=16, tags={"MODEL": "gnn"})
    assert sorted(os.listdir(tmp_path / "r")) == ["0-0.tif", "0-1.tif", "0-2.tif", "1-0.tif", "1-1.tif", "1-2.tif", "_index.json"]
    assert rasters.read_index(path)["tags"] == {"MODEL": "gnn"}
    got = rasters.read_raster(spark, path)
    assert got.dtypes == [("row", "bigint"), ("col", "bigint"), ("a", "int"), ("b", "int")] and got.count() == 3500
    assert got.where("a is not null").exceptAll(px).count() == 0 and px.exceptAll(got).count() == 0
    with pytest.raises(FileExistsError):
        rasters.write_raster(px, path, 50, 70, "uint8", 255)
    assert rasters.read_raster(spark, path, ["b"], (5, 40, 33, 60), every=3).exceptAll(px.select("row", "col", "b").where("row between 5 and 39 and col between 33 and 59 and row % 3 = 0 and col % 3 = 0")).where("b is not null").count() == 0
    few = rasters.read_raster(spark, path, None, (5, 40, 33, 60), every=3)
    assert few.count() == 12 * 9 and few.rdd.getNumPartitions() == 2
    assert rasters.read_raster(spark, path, None, (90, 95, 0, 5)).count() == 0


def test_conditions_narrow_what_is_read(spark, tmp_path):
    px, path = _pixels(spark, 64, 64), str(tmp_path / "r")
    rasters.write_raster(px, path, 64, 64, "int16", -9999, block=16, tile=8)
    df = rasters.read_raster(spark, path).where("row >= 20 and row < 30 and col = 40 and a > 1")
    assert df.rdd.getNumPartitions() == 1
    assert sorted(df.collect()) == sorted(px.where("row >= 20 and row < 30 and col = 40 and a > 1").collect())


def test_an_aborted_job_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "r")
    bad = _pixels(spark, 40, 40).repartition(4).withColumn("a", F.when((F.col("row") == 39) & (F.col("col") == 38), F.raise_error(F.lit("no"))).otherwise(F.col("a")))
    with pytest.raises(Exception, match="no"):
        rasters.write_raster(bad, path, 40, 40, "uint8", 0, block=8, tile=8)
    assert [f for _, _, files in os.walk(path) for f in files] == []
    rasters.write_raster(_pixels(spark, 40, 40), path, 40, 40, "uint8", 0, block=8, tile=8)
    assert rasters.read_raster(spark, path).where("a is not null").count() == _pixels(spark, 40, 40).count()
    rasters.write_raster(_pixels(spark, 4, 4).limit(0), path + "0", 4, 4, "uint8", 0)
    assert rasters.read_raster(spark, path + "0").count() == 0


def test_scenes_by_box_and_days(spark):
    rows = [(1, "1994-05-01", 3, 0.0, 0.0), (1, "1994-05-02", 3, 2.0, 2.0), (2, "1994-06-01", 1, 2.0, 3.0), (3, "1995-01-01", 0, 1.0, 1.0), (4, "1994-05-05", 9, 1.0, 1.0), (5, "1994-05-05", 1, 9.0, 9.0), (6, "1994-05-31 23:59:00", 1, 1.5, 1.5)]
    seen = spark.createDataFrame(rows, "scene_id long, t string, cloud int, lat double, lon double").withColumn("taken", F.to_timestamp("t"))
    found = raster.search(raster.scene_catalogue(seen), (1.0, 1.0, 3.0, 2.0), "1994-05-02", "1994-06-01", 5)
    assert [r["scene_id"] for r in found.collect()] == [6, 2, 1]
    assert [r["scene_id"] for r in raster.search(raster.scene_catalogue(seen), (1.0, 1.0, 3.0, 2.0), "1994-05-02", "1994-05-31", 5, limit=1).collect()] == [6]


def test_reshaping_needs_one_value_a_place(spark):
    full = spark.createDataFrame([(i, i * 2) for i in range(12)], "node_id long, value long")
    got = sorted(map(tuple, raster.reshaped(full, 3, 4).collect()))
    assert got == [(i // 4, i % 4, 2 * i) for i in range(12)]
    for bad in (full.limit(11), full.union(full.limit(1)), full.where("node_id < 11").union(full.limit(1)), full.withColumn("node_id", F.col("node_id") + 1)):
        with pytest.raises(ValueError, match="3 x 4"):
            raster.reshaped(bad, 3, 4)


def test_beams_become_points(spark):
    nan = float("nan")
    rows = [("gt1l", [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [5.0, nan, -100.0], [1, 1, 1]), ("gt2r", [1.0, 9.0, 2.0], [1.0, 1.0, 2.0], [10000.0, 5.0, 9999.0], [0, 0, 0]), ("BEAM01", [1.0, 2.0], [1.0, 2.0], [7.0, 8.0], [0, 1])]
    rows += [("orbit_info", [1.0], [1.0], [5.0], [1]), ("gt3l", None, [1.0], [5.0], None), ("gt3r", [], [], [], []), ("gt1r", [2.0, 2.0], [2.0], [6.0, 7.0], [1])]
    df = spark.createDataFrame(rows, "beam string, lat array<double>, lon array<double>, elevation array<double>, quality array<int>")
    got = sorted(tuple(r) for r in files.points_of_beams(df, "ICESat-2", (0.0, 0.0, 5.0, 5.0)).collect())
    assert got == [(1.0, 1.0, 5.0, "ICESat-2", "gt1l"), (2.0, 2.0, 6.0, "ICESat-2", "gt1r"), (2.0, 2.0, 9999.0, "ICESat-2", "gt2r")]
    assert [tuple(r) for r in files.points_of_beams(df, "GEDI").collect()] == [(2.0, 2.0, 8.0, "GEDI", "BEAM01")]
