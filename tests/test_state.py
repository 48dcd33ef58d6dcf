"""Stateful streams: any split into batches, restarts, repeated batches, untouched buckets."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cellgrove.operators import training
from cellgrove.streaming import state


def _walks(spark, runs, patience, delta):
    out = {}
    for name, losses in runs.items():
        hist = spark.createDataFrame(list(enumerate(losses)), "epoch int, loss double")
        out[name] = [tuple(r) for r in training.early_stopping(hist, patience, delta).orderBy("epoch").collect()]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stopping_does_not_depend_on_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    runs = {f"r{k}": [1 / (1 + e) + rng.random() / 4 for e in range(25)] for k in range(4)}
    rows = [(k, e, x) for k, losses in runs.items() for e, x in enumerate(losses)]
    rng.shuffle(rows)
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):  # every piece is a restart
        part = [*rows[lo:hi], *rows[:2]]  # some epochs come again
        spark.createDataFrame(part, "run string, epoch int, loss double").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("run string, epoch int, loss double").option("maxFilesPerTrigger", 1).parquet(source)
        walk = state.early_stopping_stream(stream, 4, 0.01)
        walk.writeStream.format("parquet").outputMode("append").option("checkpointLocation", marks).trigger(availableNow=True).start(target).awaitTermination()
    got = {}
    for r in spark.read.parquet(target).orderBy("run", "epoch").collect():
        got.setdefault(r["run"], []).append(tuple(r)[1:])
    assert got == _walks(spark, runs, 4, 0.01)


def _means(spark, table):
    return {(r["row"], r["col"]): (r["mean"], r["scenes"]) for r in table.read(state.MEANS).collect()}


def test_means_are_upserted(spark, tmp_path):
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    table = state.Upserts(spark, target, ["row", "col"], buckets=16)
    assert _means(spark, table) == {} and table.pointer() == (-1, {})
    rng, seen = random.Random(3), {}
    folders = []
    for turn in range(3):
        rows = [(rng.randrange(20), rng.randrange(20), rng.randrange(0, 50)) for _ in range(150 if turn < 2 else 1)]
        if turn == 2:
            rows = [(3, 4, 7)]
        for r, c, dn in rows:
            if dn > 0:
                seen.setdefault((r, c), []).append(dn)
        spark.createDataFrame(rows, "row int, col int, dn int").coalesce(1).write.mode("append").parquet(source)
        state.mean_upserts(spark, source, table, marks)
        got = _means(spark, table)
        assert got.keys() == seen.keys() and all(got[k] == (pytest.approx(sum(v) / len(v)), len(v)) for k, v in seen.items())
        folders.append(table.pointer()[1])
    changed = [b for b in folders[2] if folders[2][b] != folders[1][b]]
    assert len(changed) == 1  # one pixel changed: its bucket alone was written again
    last = table.pointer()[0]
    table.put(spark.createDataFrame([(3, 4, -1.0, 9)], state.MEANS), last)  # the same batch again
    assert _means(spark, table)[3, 4] == (pytest.approx(sum(seen[3, 4]) / len(seen[3, 4])), len(seen[3, 4])) and table.pointer()[1] == folders[2]
    os.makedirs(f"{target}/_pointers/_half")  # a writer that died before its commit
    os.makedirs(f"{target}/batch=99-dead/bucket=0")
    assert _means(spark, table).keys() == seen.keys()
    table.put(spark.createDataFrame([], state.MEANS), last + 1)
    assert table.pointer() == (last + 1, folders[2])
    done = {r["quadrant"]: r for r in state.quadrant_progress(table.read(state.MEANS), 20, 20).collect()}
    assert sum(r["covered"] for r in done.values()) == len(seen) and done[1]["covered_pct"] == 100.0 * done[1]["covered"] / 100
    assert done[1]["most"] == max(len(v) for (r, c), v in seen.items() if r < 10 and c < 10)


def test_progress_of_uneven_quadrants(spark):
    full = spark.range(15).select(F.floor(F.col("id") / 5).alias("row"), (F.col("id") % 5).alias("col"), F.lit(1.0).alias("mean"), F.lit(2).cast("long").alias("scenes"))
    got = {r["quadrant"]: (r["covered"], r["covered_pct"], r["fewest"]) for r in state.quadrant_progress(full, 3, 5).collect()}
    assert got == {1: (6, 100.0, 2), 2: (4, 100.0, 2), 3: (3, 100.0, 2), 4: (2, 100.0, 2)}
