"""File sources and sinks of the terrain tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "lat double, lon double, elevation double, source string, beam string"


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share; in local mode a temporary one will do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cellgrove-files-")
    return f"{root.rstrip('/')}/cellgrove-files/{label}-{uuid.uuid4().hex}"


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POINTS).option("header", True).csv(path)


def append_points_csv(points: DataFrame, path: str) -> None:
    """Every file carries its header, so appending never writes one twice into a file."""
    points.select("lat", "lon", "elevation", "source", "beam").write.mode("append").option("header", True).csv(path)


#: how the two instruments name their beams, and the elevations that either may have
BEAMS, ELEVATIONS = {"ICESat-2": "gt", "GEDI": "BEAM"}, (-100.0, 10000.0)


def points_of_beams(granules: DataFrame, source: str, box: tuple[float, float, float, float] | None = None, elevations: tuple[float, float] = ELEVATIONS) -> DataFrame:
    """lat, lon, elevation, source and beam of every point of an instrument's granules.

    granules: one row a beam, with its name and arrays lat, lon and elevation, and quality for GEDI, whose points count where it is 1. Other
    groups of a granule are passed over. Arrays are flattened in step as far as the shortest; NaN, null and elevations not inside the
    bounds go, and so do points outside the box (west, south, east, north).
    """
    arrays = ["lat", "lon", "elevation"] + (["quality"] if source == "GEDI" else [])
    beams = granules.where(F.startswith("beam", F.lit(BEAMS[source])))
    length = F.least(*[F.size(c) for c in arrays])
    flat = beams.select("beam", F.inline(F.slice(F.arrays_zip(*arrays), 1, F.greatest(length, F.lit(0)))))
    low, high = elevations
    good = ~F.isnan("elevation") & (F.col("elevation") > low) & (F.col("elevation") < high)
    if source == "GEDI":
        good &= F.col("quality") == 1
    if box:
        west, south, east, north = box
        good &= F.col("lon").between(west, east) & F.col("lat").between(south, north)
    return flat.where(good).select("lat", "lon", F.col("elevation").cast("double").alias("elevation"), F.lit(source).alias("source"), "beam")


def write_labels(labels: DataFrame, path: str) -> None:
    """Partitioned by profile: readers of one profile prune the others."""
    labels.write.mode("overwrite").partitionBy("profile").option("compression", "zstd").parquet(path)


def read_labels(spark: SparkSession, path: str, profiles: list[str] | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out.where(F.col("profile").isin(profiles)) if profiles else out


def write_raster(values: DataFrame, path: str, tile: int = 256) -> None:
    """(row, col, bands) partitioned by tile rows, so a map window reads few files."""
    values.withColumn("tile_row", F.floor(F.col("row") / tile).cast("int")).write.mode("overwrite").partitionBy("tile_row").parquet(path)


def read_window(spark: SparkSession, path: str, row0: int, row1: int, col0: int, col1: int, tile: int = 256) -> DataFrame:
    """Pixels of a window [row0, row1) x [col0, col1); tile rows outside are pruned."""
    df = spark.read.parquet(path)
    return df.where(F.col("tile_row").between(row0 // tile, (row1 - 1) // tile) & (F.col("row") >= row0) & (F.col("row") < row1) & (F.col("col") >= col0) & (F.col("col") < col1))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def _first_that_exists(spark: SparkSession, paths: list[str]) -> str:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            return path
    raise FileNotFoundError(f"none of {paths}")


def read_metrics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of the candidate JSON files (each one document) that exists."""
    return spark.read.option("multiLine", True).json(_first_that_exists(spark, paths))


def read_report(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of the candidate reports (JSON lines, as write_report leaves them) that exists."""
    return spark.read.json(_first_that_exists(spark, paths))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """File name, size and SHA-256 of every file of a folder, a file per row."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _columns_of(df: DataFrame, profiles: tuple[str, ...], prefix: str) -> dict[str, str]:
    """The column of each profile: its name, or the prefix and its name; profiles without either are left out."""
    return {p: c for p in profiles for c in (p, prefix + p) if c in df.columns}


def read_predictions(spark: SparkSession, path: str, profiles: tuple[str, ...]) -> DataFrame:
    """Stored classes, a column a profile (named P or y_P) and node_id, as rows (node_id, profile, pred)."""
    df = spark.read.parquet(path)
    found = _columns_of(df, profiles, "y_")
    return df.select("node_id", *[F.col(c).cast("int").alias(p) for p, c in found.items()]).unpivot(["node_id"], list(found), "profile", "pred")


def read_probabilities(spark: SparkSession, path: str, profiles: tuple[str, ...]) -> DataFrame:
    """Stored probabilities, an array of three a profile (named P or probs_P) and node_id, as rows (node_id, profile, p1, p2, p3)."""
    df = spark.read.parquet(path)
    rows = F.array(*[F.struct(F.lit(p).alias("profile"), *[F.col(c)[i].cast("double").alias(f"p{i + 1}") for i in range(3)]) for p, c in _columns_of(df, profiles, "probs_").items()])
    return df.select("node_id", F.inline(rows))


def slim(cells: DataFrame, keep: list[str], every: list[str]) -> DataFrame:
    """node_id and every feature, those not kept as null: readers find the same columns whatever was kept."""
    return cells.select("node_id", *[F.col(c).cast("double").alias(c) if c in keep else F.lit(None).cast("double").alias(c) for c in every])
