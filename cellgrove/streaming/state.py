"""Streams that keep state: early stopping of training runs, and running means of pixels as keyed upserts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cellgrove.sources.shipping import ship

WALK = "run string, epoch int, loss double, best double, counter int, stop boolean"
_STATE = "epoch int, best double, counter int, stopped boolean, waiting string"


def early_stopping_stream(history: DataFrame, patience: int, min_delta: float = 0.0) -> DataFrame:
    """The walk of ``training.early_stopping`` for every run of a stream of (run, epoch, loss), epochs numbered from 0.

    State holds a run's best loss, counter and whether it has stopped; epochs that arrive before an earlier one wait for it,
    so the walk is the same however epochs are dealt out to batches. Epochs after the stop, and repeated ones, give no row.
    """
    ship(history.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, best, counter, stopped, kept = state.get if state.exists else (0, None, 0, False, "{}")
        waiting = {int(k): v for k, v in json.loads(kept).items()}
        for f in frames:
            for e, loss in zip(f["epoch"], f["loss"], strict=True):
                if not stopped and e >= epoch:
                    waiting.setdefault(int(e), None if loss is None else float(loss))
        rows = []
        while not stopped and epoch in waiting:
            loss = waiting.pop(epoch)
            worse = best is not None and loss > best - min_delta
            counter = counter + 1 if worse else 0
            best = best if worse else loss
            stopped = worse and counter >= patience
            rows.append((key[0], epoch, loss, best, counter, stopped))
            epoch += 1
        state.update((epoch, best, counter, stopped, "{}" if stopped else json.dumps(waiting)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in WALK.split(", ")])

    picked = history.where("run is not null and epoch is not null and loss is not null").select("run", F.col("epoch").cast("int").alias("epoch"), F.col("loss").cast("double").alias("loss"))
    return picked.groupBy("run").applyInPandasWithState(step, WALK, _STATE, "append", GroupStateTimeout.NoTimeout)


class Upserts:
    """A keyed table in buckets of files, replaced bucket by bucket under a pointer that is committed last.

    Every commit writes new files for the buckets that change and then, in one rename, a pointer that names the files of
    all buckets and the batch. Readers follow the newest pointer: they see whole batches only, and files of buckets that did not
    change stay as they are. A batch whose number is not above the pointer's was committed before and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def pointer(self) -> tuple[int, dict[int, str]]:
        """The last batch committed (-1: none) and the folder of each bucket."""
        at, fs = self._fs(f"{self.path}/_pointers")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        done = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))
        if not done:
            return -1, {}
        rows = self.spark.read.schema("bucket int, folder string").parquet(f"{self.path}/_pointers/batch={done[-1]}").collect()  # a row for each bucket
        return done[-1], {r["bucket"]: r["folder"] for r in rows}

    def read(self, schema: str) -> DataFrame:
        _, folders = self.pointer()
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*sorted(folders.values()))

    def put(self, changed: DataFrame, batch: int) -> None:
        """changed: rows by key that replace those of the same key or are new; keys are not repeated."""
        last, folders = self.pointer()
        if batch <= last:
            return
        schema = changed.schema.simpleString()[7:-1].replace(":", " ")
        placed = changed.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).persist()
        try:
            touched = [r["bucket"] for r in placed.select("bucket").distinct().collect()]  # as many as there are buckets
            old = [folders[b] for b in touched if b in folders]
            rows = placed
            if old:
                before = self.spark.read.schema(schema).parquet(*old).join(placed.select(self.keys), self.keys, "left_anti")
                rows = placed.unionByName(before.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")))
            folder = f"{self.path}/batch={batch}-{uuid.uuid4().hex}"
            if touched:
                rows.repartition("bucket").write.partitionBy("bucket").parquet(folder)
            now = folders | {b: f"{folder}/bucket={b}" for b in touched}
            temporary = f"{self.path}/_pointers/_{uuid.uuid4().hex}"
            self.spark.createDataFrame(sorted(now.items()), "bucket int, folder string").coalesce(1).write.parquet(temporary)
            source, fs = self._fs(temporary)
            target, _ = self._fs(f"{self.path}/_pointers/batch={batch}")
            if not fs.rename(source, target):
                raise OSError(f"could not commit {target}")
            for f in set(folders.values()) - set(now.values()):  # files that no newer pointer names
                at, fs = self._fs(f)
                fs.delete(at, True)
        finally:
            placed.unpersist()


MEANS = "row bigint, col bigint, mean double, scenes bigint"


def mean_upserts(spark: SparkSession, source: str, table: Upserts, checkpoint: str, files_per_batch: int = 1000) -> None:
    """row, col, mean and scenes of all valid values (dn > 0) seen so far: each batch writes the pixels that it changes, and no others.

    Sums and counts by pixel are the stream's state. A further call goes on from the checkpoint; a batch that runs again after
    a failure changes nothing.
    """
    schema = spark.read.parquet(source).schema
    seen = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).where("dn > 0")
    means = seen.groupBy("row", "col").agg(F.avg("dn").alias("mean"), F.count("*").alias("scenes"))
    put = means.select(F.col("row").cast("long"), F.col("col").cast("long"), "mean", "scenes").writeStream.outputMode("update").foreachBatch(table.put)
    put.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def quadrant_progress(means: DataFrame, height: int, width: int) -> DataFrame:
    """quadrant (1 to 4, row by row), pixels covered, their share and the fewest and most scenes of one."""
    half_h, half_w = -(-height // 2), -(-width // 2)
    quadrant = 1 + F.when(F.col("row") >= half_h, 2).otherwise(0) + F.when(F.col("col") >= half_w, 1).otherwise(0)
    whole = F.when(F.col("quadrant") <= 2, half_h).otherwise(height - half_h) * F.when(F.col("quadrant") % 2 == 1, half_w).otherwise(width - half_w)
    done = means.groupBy(quadrant.cast("int").alias("quadrant")).agg(F.count("*").alias("covered"), F.min("scenes").alias("fewest"), F.max("scenes").alias("most"))
    return done.select("quadrant", "covered", (100.0 * F.col("covered") / whole).alias("covered_pct"), "fewest", "most")
