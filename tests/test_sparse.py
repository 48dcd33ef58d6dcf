"""Sparse rasters, resampling and chunks against brute force."""

import random
import time

import numpy as np
import pytest

from cellgrove.operators import grid, nearest, raster


def test_few_cells_far_away_are_found_fast(spark):
    cells = spark.createDataFrame([(0,), (399,), (399 * 400 + 200,)], "node_id long")
    points = spark.createDataFrame([(1, 200 * 400 + 190), (2, 0)], "event_id long, node_id long")
    grid.nearest_points(points, cells, 400, 400, k=2).collect()
    started = time.time()
    got = sorted(map(tuple, grid.nearest_points(points, cells, 400, 400, k=2).select("event_id", "d2", "cell_id").collect()))
    assert got == [(1, 199**2 + 10**2, 399 * 400 + 200), (1, 200**2 + 190**2, 0), (2, 0, 0), (2, 399**2, 399)]
    assert time.time() - started < 60  # seconds of planning; the square search took longer than a minute on nothing but candidates


def test_the_pyramid_lists_few_blocks(spark):
    """A dense corner and a lone point: what is kept on the way down stays small."""
    rng = random.Random(5)
    cells = {r * 256 + c: (r, c) for r in range(64) for c in range(64)} | {i: (i // 256, i % 256) for i in rng.sample(range(256 * 256), 20)}
    at = spark.createDataFrame([(i, r, c) for i, (r, c) in cells.items()], "cell_id long, row long, col long")
    points = [(e, rng.randrange(256), rng.randrange(256)) for e in range(25)] + [(100, 255, 255), (101, 0, 0)]
    frame = spark.createDataFrame(points, "id long, row long, col long")
    got = {}
    for r in nearest._descend(frame, at, 4, 8).collect():
        got.setdefault(r["id"], set()).add((r["d2"], r["cell_id"]))
    for e, r, c in points:
        assert got[e] == set(sorted(((r - a) ** 2 + (c - b) ** 2, i) for i, (a, b) in cells.items())[:4])


@pytest.mark.parametrize("target", [(5, 7), (9, 11), (13, 30), (1, 1), (4, 3)])
def test_bilinear_equals_inverse_mapping(spark, target):
    h, w = 9, 11
    rng = random.Random(7)
    z = {(r, c): rng.random() for r in range(h) for c in range(w) if rng.random() > 0.2}
    rows = [(r, c, v) for (r, c), v in z.items()] + [(0, 0, None)] * ((0, 0) not in z) + [(8, 10, float("nan"))] * ((8, 10) not in z)
    got = {(x["row"], x["col"]): x["v"] for x in raster.bilinear(spark.createDataFrame(rows, "row long, col long, v double"), "v", (h, w), target).collect()}
    want = {}
    for i in range(target[0]):
        for j in range(target[1]):
            y, x = min(max((i + 0.5) * h / target[0] - 0.5, 0), h - 1), min(max((j + 0.5) * w / target[1] - 0.5, 0), w - 1)
            parts = [((1 - abs(y - r)) * (1 - abs(x - c)), z[r, c]) for r in range(h) for c in range(w) if abs(y - r) < 1 and abs(x - c) < 1 and (r, c) in z]
            if sum(p for p, _ in parts) > 0:
                want[i, j] = sum(p * v for p, v in parts) / sum(p for p, _ in parts)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


@pytest.mark.parametrize("height,width", [(5, 6), (20, 33), (8, 8), (1, 19)])
def test_chunks_cover_every_cell_once(spark, height, width):
    cells = [(r * width + c, r, c) for r in range(height) for c in range(width) if (r * 5 + c) % 7]
    frame = spark.createDataFrame(cells, "node_id long, row long, col long")
    chunks = grid.chunked(frame, height, width, 8, 4, 2).toPandas()
    assert sorted(chunks[chunks.kept].node_id) == [i for i, _, _ in cells]
    for (cr, cc), part in chunks.groupby(["cr", "cc"]):
        assert len(part) <= 64 and sorted(part.id) == list(range(len(part))) and (part.sort_values("node_id").id.diff().dropna() == 1).all()
        assert set(part.node_id) == {i for i, r, c in cells if cr * 4 <= r < cr * 4 + 8 and cc * 4 <= c < cc * 4 + 8}
    assert np.array_equal(sorted(set(chunks.node_id)), [i for i, _, _ in cells])
