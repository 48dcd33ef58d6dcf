"""Rasters as folders of GeoTIFF blocks: a Spark data source that writes and reads them.

A block is a square of pixels in one file, with a band for each column. Tasks write whole blocks under temporary names;
the job's commit gives them their names and writes the index last, in one rename, so readers see all blocks of a job or none, and
an aborted job leaves no file. The index states the raster's shape and its blocks; readers plan a task for each block that the
wanted window touches, and a task reads only the tiles it needs of the bands it needs. Conditions on row and col that Spark pushes down
narrow the window. Folders may be in any file system that pyarrow opens by its address.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from cellgrove.sources import tiff
from cellgrove.sources.shipping import ship

NAME, INDEX = "cellgrove_raster", "_index.json"
#: column types of samples
_SAMPLES = {"uint8": "int", "int16": "int", "int32": "int", "float32": "double", "float64": "double"}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def read_index(path: str) -> dict:
    system, at = _open(path)
    with system.open_input_stream(f"{at}/{INDEX}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    blocks: list[tuple[int, int, str]]


@dataclass
class Block(InputPartition):
    br: int
    bc: int
    name: str


class _Writer(DataSourceArrowWriter):
    """Rows come sorted by block (write_raster sees to it): a task holds one block at a time."""

    def __init__(self, options: dict, bands: list[str]):
        self.path, self.bands = options["path"], bands
        self.height, self.width, self.block, self.tile = (int(options[k]) for k in ("height", "width", "block", "tile"))
        self.dtype, self.nodata = np.dtype(options["dtype"]), float(options["nodata"])
        self.west, self.north, self.step = (float(options[k]) for k in ("west", "north", "step"))
        self.tags, self.job = json.loads(options["tags"]), uuid.uuid4().hex

    def _temporary(self) -> str:
        return f"_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = _open(self.path)
        done: list[tuple[int, int, str]] = []
        held, place = None, None

        def flush() -> None:
            name = f"{self._temporary()}/{uuid.uuid4().hex}.tif"
            data = tiff.encode(held, self.bands, self.tile, self.nodata, self.tags, self.west + place[1] * self.block * self.step, self.north - place[0] * self.block * self.step, self.step)
            system.create_dir(f"{at}/{self._temporary()}", recursive=True)
            with system.open_output_stream(f"{at}/{name}") as f:
                f.write(data)
            done.append((*place, name))

        for b in iterator:
            if not b.num_rows:
                continue
            row, col = b.column("row").to_numpy(), b.column("col").to_numpy()
            br, bc = row // self.block, col // self.block
            cuts = [0, *(np.flatnonzero((np.diff(br) != 0) | (np.diff(bc) != 0)) + 1).tolist(), b.num_rows]
            values = [b.column(x).cast(pa.float64()).fill_null(self.nodata).to_numpy(zero_copy_only=False) for x in self.bands]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                here = (int(br[lo]), int(bc[lo]))
                if here != place:
                    if place is not None:
                        flush()
                    place = here
                    h, w = min(self.block, self.height - here[0] * self.block), min(self.block, self.width - here[1] * self.block)
                    held = np.full((len(self.bands), h, w), self.nodata, self.dtype)
                for k, v in enumerate(values):
                    held[k, row[lo:hi] - here[0] * self.block, col[lo:hi] - here[1] * self.block] = v[lo:hi]
        if place is not None:
            flush()
        return Written(done)

    def commit(self, messages: list) -> None:
        system, at = _open(self.path)
        system.create_dir(at, recursive=True)
        blocks = []
        for br, bc, name in (x for m in messages if m is not None for x in m.blocks):
            final = f"{br}-{bc}.tif"
            system.move(f"{at}/{name}", f"{at}/{final}")
            blocks.append((br, bc, final))
        index = {"height": self.height, "width": self.width, "block": self.block, "tile": self.tile, "dtype": str(self.dtype), "nodata": self.nodata, "bands": self.bands, "west": self.west, "north": self.north, "step": self.step, "tags": self.tags, "blocks": sorted(blocks)}
        system.create_dir(f"{at}/{self._temporary()}", recursive=True)
        with system.open_output_stream(f"{at}/{self._temporary()}/{INDEX}") as f:
            f.write(json.dumps(index).encode())
        system.move(f"{at}/{self._temporary()}/{INDEX}", f"{at}/{INDEX}")
        system.delete_dir(f"{at}/_temporary")

    def abort(self, messages: list) -> None:
        system, at = _open(self.path)
        if system.get_file_info(f"{at}/{self._temporary()}").type != fs.FileType.NotFound:
            system.delete_dir(f"{at}/{self._temporary()}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict, bands: list[str]):
        self.path, self.bands = options["path"], bands
        self.index = read_index(self.path)
        self.every = int(options.get("every", "1"))
        bounds = {"row0": 0, "row1": self.index["height"], "col0": 0, "col1": self.index["width"]}
        self.window = {k: min(max(int(options.get(k, v)), 0), bounds[k[:3] + "1"]) for k, v in bounds.items()}

    def pushFilters(self, filters: list):
        """Bounds on row and col narrow the window; what else there is goes back to Spark."""
        w = self.window
        for f in filters:
            name = getattr(f, "attribute", ("",))[-1]
            if name not in ("row", "col") or not isinstance(getattr(f, "value", None), int | float):
                yield f
            elif isinstance(f, GreaterThanOrEqual | GreaterThan):
                w[f"{name}0"] = max(w[f"{name}0"], math.floor(f.value) + 1 if isinstance(f, GreaterThan) else math.ceil(f.value))
            elif isinstance(f, LessThanOrEqual | LessThan):
                w[f"{name}1"] = min(w[f"{name}1"], math.ceil(f.value) if isinstance(f, LessThan) else math.floor(f.value) + 1)
            elif isinstance(f, EqualTo):
                w[f"{name}0"], w[f"{name}1"] = max(w[f"{name}0"], math.ceil(f.value)), min(w[f"{name}1"], math.floor(f.value) + 1)
            else:
                yield f

    def partitions(self) -> list[Block]:
        w, b = self.window, self.index["block"]
        if w["row0"] >= w["row1"] or w["col0"] >= w["col1"]:
            return []
        return [Block(r, c, name) for r, c, name in self.index["blocks"] if r * b < w["row1"] and (r + 1) * b > w["row0"] and c * b < w["col1"] and (c + 1) * b > w["col0"]]

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so where there are no partitions
            return
        system, at = _open(self.path)
        with system.open_input_file(f"{at}/{partition.name}") as file:
            head, b, w = tiff.Header(file), self.index["block"], self.window
            # pixels of every n-th row and column of the whole raster: the first of this block's rows, a strip of tiles at a time
            r0, c0 = max(w["row0"] - partition.br * b, 0), max(w["col0"] - partition.bc * b, 0)
            r1, c1 = min(w["row1"] - partition.br * b, head.height), min(w["col1"] - partition.bc * b, head.width)
            types = {n: pa.int32() if _SAMPLES[self.index["dtype"]] == "int" else pa.float64() for n in self.bands}
            for lo in range(r0 // head.tile * head.tile, r1, head.tile):
                a, z = max(lo, r0), min(lo + head.tile, r1)
                rows, cols = np.arange(a, z) + partition.br * b, np.arange(c0, c1) + partition.bc * b
                i, j = np.flatnonzero(rows % self.every == 0), np.flatnonzero(cols % self.every == 0)
                if not (len(i) and len(j)):
                    continue
                out = {"row": np.repeat(rows[i], len(j)), "col": np.tile(cols[j], len(i))}
                for name in self.bands:
                    out[name] = head.window(head.names.index(name), a, z, c0, c1)[0][np.ix_(i, j)].reshape(-1)
                columns = [pa.array(out["row"], pa.int64()), pa.array(out["col"], pa.int64())]
                for name in self.bands:
                    v = out[name].astype(float)
                    empty = np.isnan(v) if math.isnan(self.index["nodata"]) else v == self.index["nodata"]
                    columns.append(pa.array(out[name], mask=empty).cast(types[name]))
                yield pa.RecordBatch.from_arrays(columns, names=["row", "col", *self.bands])


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _bands(self) -> list[str]:
        index = read_index(self.options["path"])
        asked = self.options.get("bands")
        return [b for b in index["bands"] if asked is None or b in json.loads(asked)]

    def schema(self) -> str:
        kind = _SAMPLES[read_index(self.options["path"])["dtype"]]
        return ", ".join(["row long", "col long", *[f"`{b}` {kind}" for b in self._bands()]])

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, self._bands())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, [f.name for f in schema.fields if f.name not in ("row", "col")])


def _register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses readers that take conditions otherwise
    spark.dataSource.register(RasterSource)


def write_raster(pixels: DataFrame, path: str, height: int, width: int, dtype: str, nodata: float, block: int = 1024, tile: int = 256, tags: dict[str, str] | None = None, west: float = 0.0, north: float = 0.0, step: float = 1.0) -> None:
    """row, col and a column for each band to a new folder; pixels that are null or missing get nodata.

    One shuffle by block; a task holds one block of all bands. A folder that holds a raster already is refused.
    """
    if dtype not in _SAMPLES:
        raise ValueError(f"samples of {dtype} are not supported: {', '.join(_SAMPLES)}")
    system, at = _open(path)
    if system.get_file_info(f"{at}/{INDEX}").type != fs.FileType.NotFound:
        raise FileExistsError(path)
    _register(pixels.sparkSession)
    bands = [c for c in pixels.columns if c not in ("row", "col")]
    placed = pixels.select(F.col("row").cast("long"), F.col("col").cast("long"), *bands).where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    br, bc = F.floor(F.col("row") / block), F.floor(F.col("col") / block)
    options = {"height": height, "width": width, "block": block, "tile": tile, "dtype": dtype, "nodata": nodata, "west": west, "north": north, "step": step, "tags": json.dumps(tags or {})}
    placed.repartition(br, bc).sortWithinPartitions(br, bc).write.format(NAME).options(**options).mode("append").save(path)


def read_raster(spark: SparkSession, path: str, bands: list[str] | None = None, window: tuple[int, int, int, int] | None = None, every: int = 1) -> DataFrame:
    """row, col and bands (nodata as null) of a window (row0, row1, col0, col1: ends excluded), of every n-th row and column."""
    _register(spark)
    options = {"every": every} | ({"bands": json.dumps(bands)} if bands else {})
    if window:
        options |= dict(zip(("row0", "row1", "col0", "col1"), window, strict=True))
    return spark.read.format(NAME).options(**options).load(path)
