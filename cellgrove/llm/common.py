"""What the operators share: scratch tables in the shared folder, shipping of the package, Arrow helpers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SHIPPED: set[str] = set()
#: bytes of an Arrow batch on its way to Python, unless the session has another setting than Spark's own
BATCH_BYTES = 4 << 20
_BYTES_SETTING, _BYTES_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def col(name: str) -> Column:
    """A top-level column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ship(spark: SparkSession) -> None:
    """Let the executors' Python import this package, wherever the driver found it (once per application).

    Also bounds the bytes of the batches that reach Python, so a task holds few of its rows, however long they are.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BYTES_SETTING, None) in (str(_BYTES_DEFAULT), f"{_BYTES_DEFAULT}b"):
        spark.conf.set(_BYTES_SETTING, str(BATCH_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="cellgrove-")), "cellgrove_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a folder of this machine serves, but only if all tasks run on it (local mode);
    on a cluster that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = sc._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cellgrove-checkpoints-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/cellgrove/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of the shared folder, once no result that was read from them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark, "any")).getParent()
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with underscores behind those that are columns of df already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here and lost executors cost nothing.

    Partitions are written by four tasks a core at most (or an eighth of the shuffle partitions, where those are more), which
    take several in turn: many small files cost more than they give. Where executors come and go (dynamic allocation) the cores are not known before, and every partition has its task.
    """
    path, sc = scratch(df.sparkSession, label), df.sparkSession.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false") != "true":
        df = df.coalesce(max(4 * sc.defaultParallelism, -(-partitions(df) // 8)))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(classes: DataFrame, first: str, label: str) -> tuple[DataFrame, bool]:
    """Classes with rep, a number of their own, and whether it is another than first, the smallest id of their rows.

    It is another one only where an id stands for rows of several classes.
    """
    repeated = not classes.groupBy(first).agg(F.count("*").alias("k")).where("k > 1").isEmpty()
    if not repeated:
        return classes.withColumn("rep", F.col(first)), False
    return stage(classes.withColumn("rep", F.monotonically_increasing_id()), label), True  # written once: the numbers stay


def smallest_ids(comp: DataFrame, classes: DataFrame, first: str, repeated: bool) -> DataFrame:
    """(node, component) with the smallest id of a component's classes for the smallest of their numbers."""
    if not repeated:
        return comp
    at = comp.join(classes.select(F.col("rep").alias("node"), first), "node")
    least = at.groupBy("component").agg(F.min(first).alias("least"))
    return at.select("node", "component").join(least, "component").select("node", F.col("least").alias("component"))


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def give_back() -> None:
    """Return this process's free memory to the system: Spark keeps Python workers over stages, side by side."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


#: what modules keep over the batches of a task, by name; Spark keeps Python workers for other stages, so it goes when a task ends
TASK_CACHES: list[dict] = []


def end_task() -> None:
    """Empty the caches of a task that ends, and return their memory."""
    for cache in TASK_CACHES:
        cache.clear()
    give_back()


def arrow_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str | StructType, rows: int = 1000) -> DataFrame:
    """mapInArrow with a function of at most so many rows, which bounds what a task holds as Python objects."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                b = whole.slice(lo, rows)
                out = fn(b)
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                elif out is not None:
                    yield out
                del b, out
            del whole
            give_back()
        end_task()

    return df.mapInArrow(run, schema)


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """fn of whole groups, many at a time: a table sorted by the integer keys, and where each group starts and ends.

    For groups of a bounded size: those that a batch cuts wait for the next one.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            k = np.stack([t.column(c).to_numpy() for c in keys])
            change = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            held = t
            if len(change):
                held = t.slice(change[-1])
                yield from fn(t.slice(0, change[-1]), np.concatenate([[0], change[:-1]]), change).to_batches()
        if held is not None and held.num_rows:
            yield from fn(held, np.array([0]), np.array([held.num_rows])).to_batches()
        del held
        end_task()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as Python strings, null as the empty text."""
    return [t if t is not None else "" for t in batch.column(name).to_pylist()]


def list_lengths(a: pa.Array) -> np.ndarray:
    return np.asarray(a.value_lengths().fill_null(0))


def crc_mod(id_column: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n: the folds of the contracts."""
    return F.pmod(F.crc32(col(id_column).cast("string").cast("binary")), F.lit(n))
