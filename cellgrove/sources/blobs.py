"""Byte strings of rows in a few files of a shared folder, with an index of where each lies.

Every task appends its rows' bytes to a file of its own, whose name no other attempt has; what an attempt that fails leaves behind is in
no index. Readers fetch single rows in the order they like and hold one at a time. Folders may be in any file system that pyarrow opens by its address.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.sources.shipping import ship

PLACE = "file string, start long, length long"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """Local addresses may hold spaces and the like, as they may for Spark."""
    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", path)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)


def store(rows: DataFrame, path: str, data: str = "data") -> DataFrame:
    """rows with, instead of their bytes, the file, start and length; the index is one file, a short row for each."""
    ship(rows.sparkSession)
    others = [c for c in rows.columns if c != data]

    def run(batches):
        out, name, at = None, None, 0
        try:
            for b in batches:
                starts, lengths, column = [], [], b.column(data)
                for x in column:
                    if out is None:
                        system, folder = _opened(path)
                        system.create_dir(f"{folder}/data", recursive=True)
                        name = f"data/{uuid.uuid4().hex}"
                        out = system.open_output_stream(f"{folder}/{name}")
                    view = x.as_buffer()
                    out.write(view)
                    starts.append(at)
                    lengths.append(view.size)
                    at += view.size
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], pa.array([name] * len(column), pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], names=[*others, "file", "start", "length"])
        finally:
            if out is not None:
                out.close()

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != data)
    rows.mapInArrow(run, f"{kept}, {PLACE}").write.parquet(f"{path}/parts")
    spark = rows.sparkSession
    spark.read.parquet(f"{path}/parts").coalesce(1).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def reader(path: str) -> Callable[[str, int, int], bytes]:
    """For a task: the bytes at a place of the index; files stay open as long as it lives."""
    system, folder = _opened(path)
    files = {}

    def read(file: str, start: int, length: int) -> bytes:
        if file not in files:
            files[file] = system.open_input_file(f"{folder}/{file}")
        return files[file].read_at(length, start)

    return read


def fetched(index: DataFrame, path: str, tasks: int, data: str = "data") -> DataFrame:
    """The rows of an index with their bytes, dealt to so many tasks."""
    others = [f for f in index.schema.fields if f.name not in ("file", "start", "length")]

    def run(batches):
        read = reader(path)
        for b in batches:
            for i, place in enumerate(zip(*(b.column(c).to_pylist() for c in ("file", "start", "length")), strict=True)):
                yield pa.RecordBatch.from_arrays([*[b.column(f.name).slice(i, 1) for f in others], pa.array([read(*place)], pa.binary())], names=[*[f.name for f in others], data])

    return index.repartition(tasks, F.hash("file", "start")).mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others) + f", {data} binary")
