"""The perceptrons' training over many packs: few passes in a step, long chains, scores counted in tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import descent, models

FEATURES = ["f0", "f1", "f2"]


def _precisions_agree(net, w, arrays):
    double, single = net.gradients(w, arrays, [1, 2]), net.gradients(w, arrays | {"x": arrays["x"].astype(np.float32)}, [1, 2])
    assert single[0] == pytest.approx(double[0], rel=1e-5) and single[1] == double[1]
    for k, g in double[2].items():
        assert g.dtype == np.float64 and single[2][k].dtype == np.float32, k
        assert np.allclose(g, single[2][k], atol=1e-4 * max(1, np.abs(g).max())), k


def test_gradients_have_the_precision_of_the_pack():
    rng, net = np.random.default_rng(4), models.Perceptron(("a", "b"), FEATURES, hidden=8)
    y = {f"y_{p}": rng.integers(1, 4, 300).astype(np.int8) for p in "ab"}
    _precisions_agree(net, net.start(), {"x": rng.normal(size=(300, 3)) + [0, 50, -3]} | y)


def test_dropout_keeps_its_share():
    kept = models.Perceptron(("a",), FEATURES, hidden=64, dropout=0.2)._kept([1, 2], 20000)
    assert kept.shape == (96, 20000) and kept.mean() == pytest.approx(0.8, abs=0.001)
    assert models.Perceptron(("a",), FEATURES, hidden=4, dropout=0.0)._kept([1], 5).all()


def _rows(spark, n):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 3))
    return spark.createDataFrame([(i, *map(float, x[i]), 1 + int(x[i, 0] > 0) + int(x[i, 1] > 0.5), 1 + int(x[i, 2] > 0)) for i in range(n)], "node_id long, f0 double, f1 double, f2 double, y_a int, y_b int")


def test_an_epoch_of_some_hundred_steps_is_one_chain(spark, monkeypatch):
    net = models.Perceptron(("a", "b"), FEATURES, hidden=4)
    packs = descent.write_packs(models.perceptron_batches(net, _rows(spark, 1500), 1500, 10, kind="float"), 1)
    chains, made, fetched = [], descent._chain, []
    monkeypatch.setattr(descent, "_chain", lambda *a: chains.append(len(a[1])) or made(*a))
    state = descent.descend(net, descent.State(net.start()), packs, 1)
    assert packs.steps > 120 and chains == [packs.steps]
    assert all(x.dtype == np.float64 for x in state.weights.values()) and state.steps == packs.of(None).count()
    for r in packs.of(3).collect() + packs.of(None).limit(3).collect():
        fetched.append(descent.unpacked(r["data"]))
    assert fetched and all(a["x"].dtype == np.float32 and a["y_a"].dtype == np.int8 and not a["x"].flags.owndata for a in fetched)


def test_counts_of_tasks_equal_those_of_joined_predictions(spark):
    rows, net = _rows(spark, 400).repartition(3), models.Perceptron(("a", "b"), FEATURES, hidden=8)
    w = net.start()
    joined = net.predict(w, rows).join(rows.select("node_id", F.inline(F.array(*[F.struct(F.lit(p).alias("profile"), F.col(f"y_{p}").alias("y")) for p in "ab"]))), ["node_id", "profile"])
    want = {(r["profile"], r["y"], r["pred"]): r["count"] for r in joined.groupBy("profile", "y", "pred").count().collect()}
    assert {(r["profile"], r["y"], r["pred"]): r["n"] for r in net.confusion(w, rows).collect()} == want
