"""What keeps training over many packs in time: cheap steps, long chains, packs fetched one by one, scores counted in tasks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import dense, descent, models, planes
from cellgrove.sources import blobs

FEATURES = ["f0", "f1", "f2"]


def _tile(seed=1, height=9, width=7):
    rng = np.random.default_rng(seed)
    there = rng.random((height, width)) > 0.2
    y = {f"y_{p}": (rng.integers(1, 4, there.shape) * there).astype(np.int8) for p in "ab"}
    return {"x": rng.normal(size=(height, width, 3)) * there[..., None], "there": there, "counted": there & (rng.random(there.shape) > 0.4)} | y


def test_a_layer_in_planes_equals_a_plain_loop():
    tile, rng = _tile(), np.random.default_rng(3)
    at, there = planes.planes(tile["there"]), tile["there"]
    left, right, scorer = rng.normal(size=(4, 4)), rng.normal(size=(4, 4)), rng.normal(size=4)
    h = rng.normal(size=(*there.shape, 4)) * there[..., None]
    got = at.back(planes.attention(at.of(h), at, left, right, scorer)[0])
    message = dense.neighbour_message(h, there, left, right, scorer)[0]
    want = dense.gelu(dense.layer_norm(h + message)[0])[0] * there[..., None]
    assert np.allclose(got, want, atol=1e-12)


def _precisions_agree(net, w, arrays):
    double, single = net.gradients(w, arrays, [1, 2]), net.gradients(w, arrays | {"x": arrays["x"].astype(np.float32)}, [1, 2])
    assert single[0] == pytest.approx(double[0], rel=1e-5) and single[1] == double[1]
    for k, g in double[2].items():
        assert g.dtype == np.float64 and single[2][k].dtype == np.float32, k
        assert np.allclose(g, single[2][k], atol=1e-4 * max(1, np.abs(g).max())), k


def test_gradients_have_the_precision_of_the_pack():
    net = models.AttentionNet(("a", "b"), FEATURES)
    _precisions_agree(net, net.start(8), _tile())


def test_gelu_in_single_precision():
    x = np.linspace(-9, 9, 4001).astype(np.float32)
    for got, want in zip(dense.gelu(x), dense.gelu(x.astype(np.float64)), strict=True):
        assert got.dtype == np.float32 and np.abs(got - want).max() < 5e-7


def test_the_loss_alone_is_that_of_the_gradients():
    net, tile = models.AttentionNet(("a", "b"), FEATURES), _tile()
    w = net.start(4)
    assert net.loss(w, tile) == pytest.approx(net.gradients(w, tile, None)[:2])
    assert net.loss(w, tile | {"counted": tile["counted"] & False}) == (0.0, 0)


def test_packs_keep_arrays_and_types():
    arrays = {"x": np.arange(7, dtype=np.float32), "there": np.eye(3, dtype=bool), "none": np.zeros((0, 2)), "one": np.array(2.5), "y": np.arange(6, dtype=np.int8).reshape(2, 3).T}
    got = descent.unpacked(descent.packed(arrays))
    assert got.keys() == arrays.keys() and all(got[k].dtype == x.dtype and got[k].shape == x.shape and (got[k] == x).all() for k, x in arrays.items())


def test_blobs_are_fetched_from_the_index(spark, tmp_path):
    rows = spark.range(40).select("id", F.when(F.col("id") == 7, F.encode(F.lit(""), "utf-8")).otherwise(F.encode(F.repeat(F.lit("ab"), F.col("id").cast("int") * 100), "utf-8")).alias("data")).repartition(6)
    path = f"file://{tmp_path}/blobs of rows"
    index = blobs.store(rows, path)
    assert index.columns == ["id", "file", "start", "length"] and index.count() == 40
    got = {r["id"]: bytes(r["data"]) for r in blobs.fetched(index.where("id % 2 = 1"), path, 3).collect()}
    assert got == {i: b"" if i == 7 else b"ab" * (100 * i) for i in range(1, 40, 2)}


def test_counts_of_tiles_equal_those_of_joined_probabilities(spark):
    tile = _tile(height=19, width=13)
    there = tile["there"]
    rows = [(r * 13 + c, r, c, *map(float, tile["x"][r, c]), int(tile["y_a"][r, c]), int(tile["y_b"][r, c]), bool(tile["counted"][r, c])) for r, c in np.argwhere(there).tolist()]
    cells = spark.createDataFrame(rows, "node_id long, row long, col long, f0 double, f1 double, f2 double, y_a int, y_b int, counted boolean")
    net = models.AttentionNet(("a", "b"), FEATURES, layers=2)
    w, t = net.start(4), net.tiling(19, 13, 5)
    best = {(r["node_id"], r["profile"]): 1 + int(np.argmax([r["p1"], r["p2"], r["p3"]])) for r in net.infer(w, cells, t).collect()}
    want = {}
    for node, r, c, *_ in rows:
        for p in "ab":
            if tile["counted"][r, c]:
                key = (p, int(tile[f"y_{p}"][r, c]), best[node, p])
                want[key] = want.get(key, 0) + 1
    assert {(r["profile"], r["y"], r["pred"]): r["n"] for r in net.confusion(w, cells, t).collect()} == want
    assert math.isclose(sum(want.values()), 2 * tile["counted"].sum())
