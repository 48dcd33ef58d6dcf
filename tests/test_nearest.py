"""Nearest givers and cells against brute force, without a bound on the distance."""

import random

from pyspark.sql import functions as F

from cellgrove.operators import grid, nearest, raster


def _fill(cells, givers):
    out = {}
    for i, (r, c) in cells.items():
        near = [((r - cells[g][0]) ** 2 + (c - cells[g][1]) ** 2, g) for g in givers]
        out[i] = (givers[min(near)[1]], min(near)[0]) if near else (None, None)
    return out


def _frames(spark, cells, givers):
    at = spark.createDataFrame([(i, r, c) for i, (r, c) in cells.items()], "node_id long, row long, col long")
    return at, spark.createDataFrame(list(givers.items()), "node_id long, value long")


def test_fill_reaches_every_cell(spark):
    rng = random.Random(1)
    full = {r * 17 + c: (r, c) for r in range(13) for c in range(17)}
    holes = {i: x for i, x in full.items() if i % 5}
    for cells, givers in (
        (full, {0: 5}),
        (full, {0: 1, 3 * 17 + 7: 2, 7 * 17 + 4: 3}),  # (7, 4) has d2 = 16 from (3, 4), nearer than a corner of the square
        (full, {i: i * 10 for i in rng.sample(sorted(full), 9)}),
        (holes, {i: i * 10 for i in rng.sample(sorted(holes), 6)}),
        (full, {}),
    ):
        got = raster.nearest_fill(*_frames(spark, cells, givers)).collect()
        assert len(got) == len(cells)
        assert {r["node_id"]: (r["value"], r["d2"]) for r in got} == _fill(cells, givers)


def test_k_nearest_look_beyond_missing_cells(spark):
    rng = random.Random(2)
    kept = sorted(rng.sample(range(12 * 15), 20))
    cells = spark.createDataFrame([(i,) for i in kept], "node_id long")
    points = spark.createDataFrame([(e, e * 7 % 180) for e in range(30)], "event_id long, node_id long")
    for k in (3, 8, 25):
        got = {}
        for r in grid.nearest_points(points, cells, 15, 12, k=k).collect():
            got.setdefault(r["event_id"], set()).add((r["d2"], r["cell_id"]))
        for e in range(30):
            r, c = divmod(e * 7 % 180, 15)
            assert got[e] == set(sorted(((r - i // 15) ** 2 + (c - i % 15) ** 2, i) for i in kept)[:k])


def test_a_place_is_looked_up_once_for_all_its_points(spark):
    cells = spark.range(40 * 40).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / 40).alias("row"), (F.col("id") % 40).alias("col"))
    points = spark.range(500).select("id", F.lit(0).cast("long").alias("row"), (F.col("id") % 2 * 39).alias("col"))
    df = nearest._square(points, cells, 3, 2)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(-2" not in text and "[-2,-1,0,1,2]" not in text  # no point is multiplied by the places around it
    got = {(r["row"], r["col"]): [(b["d2"], b["cell_id"]) for b in r["best"]] for r in df.collect()}
    assert got == {(0, 0): [(0, 0), (1, 1), (1, 40)], (0, 39): [(0, 39), (1, 38), (1, 79)]} and df.count() == 500


def test_nearest_one_at_any_distance_with_ties(spark, monkeypatch):
    monkeypatch.setattr(nearest, "COLUMN_PLACES", 60)  # several blocks of columns
    rng = random.Random(3)
    for giver_count in (1, 4, 40):
        places = [(r, c) for r in range(20) for c in range(23)]
        rng.shuffle(places)
        ids = rng.sample(range(10_000), len(places))
        givers, gaps = list(zip(ids, places, strict=True))[:giver_count], list(zip(ids, places, strict=True))[giver_count + 30 :]
        frames = [spark.createDataFrame([(i, r, c) for i, (r, c) in part], f"{name} long, row long, col long") for name, part in (("id", gaps), ("cell_id", givers))]
        got = {x["id"]: (x["d2"], x["cell_id"]) for x in nearest.nearest_one(*frames, 20, 23).collect()}
        assert got == {i: min(((r - a) ** 2 + (c - b) ** 2, g) for g, (a, b) in givers) for i, (r, c) in gaps}
