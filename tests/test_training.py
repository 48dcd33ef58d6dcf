"""Tiles, layers with gradients, training and checkpoints against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.functions import scalar as S
from cellgrove.operators import dense, descent, models, tiles, typed
from cellgrove.plans import structure
from cellgrove.sources import files
from cellgrove.sources.checkpoints import Checkpoints
from cellgrove.sources.views import Views

SMALL = "/root/testdata/sf0.001"
PROFILES = ("a", "b")


def test_erf_in_both_forms(spark):
    x = np.concatenate([np.linspace(-8, 8, 801), [1e-12, 40.0, -300.0]])
    want = np.array([math.erf(v) for v in x])
    assert np.abs(dense.erf(x) - want).max() < 1e-14
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = np.array([r[0] for r in df.select(S.erf(F.col("x"))).collect()])
    assert np.abs(got - want).max() < 1e-14


def _raster(height, width, seed=1, holes=True):
    rng = np.random.default_rng(seed)
    there = rng.random((height, width)) > (0.15 if holes else -1)
    return rng.normal(size=(height, width, 3)), there, rng.integers(1, 4, (2, height, width))


def _cells(spark, x, there, y):
    rows = [(r * x.shape[1] + c, r, c, *map(float, x[r, c]), int(y[0, r, c]), int(y[1, r, c])) for r, c in np.argwhere(there).tolist()]
    return spark.createDataFrame(rows, "node_id long, row long, col long, f0 double, f1 double, f2 double, y_a int, y_b int")


FEATURES = ["f0", "f1", "f2"]


@pytest.mark.parametrize("height,width,tile", [(19, 23, 5), (19, 23, 64), (1, 7, 3), (8, 8, 4)])
def test_tiles_equal_the_whole_raster(spark, height, width, tile):
    x, there, y = _raster(height, width)
    net = models.AttentionNet(PROFILES, FEATURES)
    w = net.start(5)
    want = net.probabilities(w, x * there[..., None], there)
    t = net.tiling(height, width, tile)
    got = net.infer(w, _cells(spark, x, there, y).repartition(3), t).toPandas()
    assert len(got) == 2 * there.sum()
    for p, rows in got.groupby("profile"):
        rows = rows.sort_values("node_id")
        assert np.allclose(rows[["p1", "p2", "p3"]].to_numpy(), want[p][there], atol=1e-12)
    most = tiles.spread(_cells(spark, x, there, y), t).groupBy("tr", "tc").count().agg(F.max("count")).first()[0]
    assert most <= (tile + 2 * t.halo) ** 2


@pytest.mark.parametrize("tile", [4, 64])
def test_typed_nodes_equal_the_whole_graph(spark, tile):
    """Cells, two further types with copies and empty cells: a plain loop over every cell's sources."""
    height, width = 11, 9
    x, there, _ = _raster(height, width, seed=4)
    rng = np.random.default_rng(5)
    net = typed.TypedNet(("f0", "f1", "f2"), {"pixel": ("dn",), "point": ("z", "q")})
    w = net.start(4)
    ids = np.flatnonzero(there.ravel())
    pixels = [(int(i), float(rng.normal())) for i in rng.choice(ids, 150)] + [(int(ids[0]), 0.5)] * 30
    points = [(int(i), float(rng.normal()), float(rng.normal())) for i in rng.choice(ids, 20)]
    cells = _cells(spark, x, there, np.ones((2, height, width), int))
    got = {r["node_id"]: r["h"] for r in net.embed(w, cells, {"pixel": spark.createDataFrame(pixels, "node_id long, dn double"), "point": spark.createDataFrame(points, "node_id long, z double, q double")}, height, width, tile).collect()}

    def norm(v):
        return (v - v.mean()) / math.sqrt(v.var() + 1e-5)

    def act(v):
        return np.array([0.5 * t * (1 + math.erf(t / math.sqrt(2))) for t in norm(v)])

    def sent(kind, k, h, sources):
        s = [w[f"{kind}/left{k}"] @ v for v in sources]
        pre = [a + w[f"{kind}/right{k}"] @ h for a in s]
        e = np.array([w[f"{kind}/scorer{k}"] @ np.where(p > 0, p, 0.2 * p) for p in pre])
        a = np.exp(e - e.max())
        return sum(u * v for u, v in zip(a / a.sum(), s, strict=True))

    state = {int(i): act(w["cell/encoder"] @ x.reshape(-1, 3)[i] + w["cell/bias"]) for i in ids}
    others = {}
    for kind, rows in (("pixel", pixels), ("point", points)):
        for i, *v in rows:
            others.setdefault((kind, i), []).append(act(w[f"{kind}/encoder"] @ np.array(v) + w[f"{kind}/bias"]))
    for k in range(net.layers):
        new = {}
        for i, h in state.items():
            r, c = divmod(i, width)
            around = [state[a * width + b] for a in range(r - 1, r + 2) for b in range(c - 1, c + 2) if 0 <= a < height and 0 <= b < width and a * width + b in state]
            m = sent("cell", k, h, around)
            for kind in ("pixel", "point"):
                if (kind, i) in others:
                    m = m + sent(kind, k, h, others[kind, i])
            new[i] = act(h + m)
        state = new
    assert got.keys() == state.keys() and all(np.allclose(got[i], state[i], atol=1e-10) for i in state)


def test_the_plan_does_not_grow_with_the_layers(spark):
    x, there, y = _raster(6, 6)
    cells = _cells(spark, x, there, y)
    sizes = []
    for layers in (1, 3, 6):
        net = models.AttentionNet(PROFILES, FEATURES, layers)
        plan = net.infer(net.start(4), cells, net.tiling(6, 6))._jdf.queryExecution().executedPlan().toString()
        sizes.append((plan.count("Exchange"), plan.count("Join")))
    assert sizes == [(1, 0)] * 3


def _numeric(model, w, arrays, seed, name, at, eps=1e-6):
    out = []
    for d in (eps, -eps):
        moved = {k: v.copy() for k, v in w.items()}
        moved[name][at] += d
        out.append(model.gradients(moved, arrays, seed)[0])
    return (out[0] - out[1]) / (2 * eps)


def _check_gradients(model, w, arrays, seed):
    rng = np.random.default_rng(0)
    _, _, grad, _ = model.gradients(w, arrays, seed)
    for name, g in grad.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, n)) for n in g.shape)
            assert g[at] == pytest.approx(_numeric(model, w, arrays, seed, name, at), rel=2e-4, abs=1e-6), (name, at)


def test_gradients_of_the_attention_network():
    x, there, y = _raster(7, 6)
    net = models.AttentionNet(PROFILES, FEATURES)
    counted = there & (np.random.default_rng(3).random(there.shape) > 0.4)
    _check_gradients(net, net.start(4), {"x": x * there[..., None], "there": there, "counted": counted, "y_a": y[0] * there, "y_b": y[1] * there}, None)


def test_gradients_of_the_perceptron():
    rng = np.random.default_rng(2)
    net = models.Perceptron(PROFILES, FEATURES, hidden=8)
    arrays = {"x": rng.normal(size=(40, 3)), "y_a": rng.integers(1, 4, 40), "y_b": rng.integers(1, 4, 40)}
    _check_gradients(net, net.start(), arrays, [1, 2, 3])
    loss, n, grad, tend = net.gradients(net.start(), arrays, None)
    assert n == 40 and not grad and not tend and loss > 0


def _rows(spark, n=600):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 3))
    return spark.createDataFrame([(i, *map(float, x[i]), 1 + int(x[i, 0] > 0) + int(x[i, 1] > 0.5), 1 + int(x[i, 2] > 0)) for i in range(n)], "node_id long, f0 double, f1 double, f2 double, y_a int, y_b int")


def test_weights_do_not_depend_on_partitions(spark):
    rows, net, runs = _rows(spark), models.Perceptron(PROFILES, FEATURES, hidden=16), []
    for parts in (1, 5):
        packs = descent.write_packs(models.perceptron_batches(net, rows.repartition(parts), 600, 100), 2)
        assert packs.steps == 3
        runs.append(descent.descend(net, descent.State(net.start()), packs, 15, 1e-2))
    for k, v in runs[0].weights.items():
        assert np.allclose(v, runs[1].weights[k], atol=1e-9), k
    losses = [h["train"] for h in runs[0].history]
    assert losses[-1] < 0.6 * losses[0]
    got = net.predict(runs[0].weights, rows).join(rows.select("node_id", F.col("y_a").alias("y")), "node_id").where("profile = 'a'")
    assert got.count() == 600 and got.where("y = pred").count() > 500


def test_a_resumed_run_equals_an_unbroken_one(spark, tmp_path):
    rows, net = _rows(spark, 200), models.Perceptron(PROFILES, FEATURES, hidden=8)
    packs = descent.write_packs(models.perceptron_batches(net, rows, 200, 100), 1)
    whole = descent.descend(net, descent.State(net.start()), packs, 5, 1e-2, descent.cosine)
    at = Checkpoints(spark, str(tmp_path / "run"), every=2)

    def killed(rate, epoch, epochs):
        if epoch == 3:
            raise KeyboardInterrupt
        return descent.cosine(rate, epoch, epochs)

    with pytest.raises(KeyboardInterrupt):
        descent.descend(net, descent.State(net.start()), packs, 5, 1e-2, killed, checkpoints=at)
    assert at.versions()[-1] == 3
    again = descent.descend(net, descent.State({}), packs, 5, 1e-2, descent.cosine, checkpoints=at)
    assert all(np.allclose(v, again.weights[k], atol=1e-12) for k, v in whole.weights.items())
    assert [h["train"] for h in whole.history] == pytest.approx([h["train"] for h in again.history])
    kept = at.versions()
    assert kept[-1] == 5 and {2, 4} <= set(kept) and at.best() in kept
    assert descent.load_state(at, "best").epoch == at.best()
    assert Checkpoints(spark, str(tmp_path / "none")).load() is None


def test_checkpoints_show_whole_versions_only(spark, tmp_path):
    at = Checkpoints(spark, str(tmp_path / "c"))
    at.save(1, {"w": np.arange(6.0).reshape(2, 3)}, {"loss": 2.0})
    spark.range(3).write.parquet(str(tmp_path / "c" / "_half"))  # a run that died while it wrote
    at.save(2, {"w": np.zeros(1)}, {"loss": 3.0})
    at.save(3, {"w": np.ones(1)}, {"loss": 2.5})
    assert at.versions() == [1, 3] and at.best() == 1
    at.save(3, {"w": np.zeros(1)}, {"loss": 0.0})  # the same epoch again changes nothing
    epoch, arrays, about = at.load()
    assert (epoch, arrays["w"].tolist(), about["loss"]) == (3, [1.0], 2.5)
    assert at.load("best")[1]["w"].shape == (2, 3)


def test_packs_that_are_not_finite_are_skipped(spark):
    net = models.Perceptron(("a",), FEATURES, hidden=4)
    good = {"x": np.random.default_rng(1).normal(size=(20, 3)), "y_a": np.random.default_rng(2).integers(1, 4, 20)}
    bad = good | {"x": good["x"] * np.nan}
    frame = spark.createDataFrame([(0, descent.packed(good)), (1, descent.packed(bad))], "pack long, data binary")
    both = descent.descend(net, descent.State(net.start()), descent.write_packs(frame, 2), 3)
    alone = descent.descend(net, descent.State(net.start()), descent.write_packs(frame.where("pack = 0"), 1), 3)
    assert [h["skipped"] for h in both.history] == [1, 1, 1] and [h["skipped"] for h in alone.history] == [0, 0, 0]
    assert all(np.allclose(v, alone.weights[k]) for k, v in both.weights.items())


def test_clipping_and_adam():
    s = descent.State({"w": np.zeros(2)})
    descent.adam(s, {"w": np.array([3.0, 4.0])}, 0.1, clip=1.0)
    assert np.allclose(s.first["w"], 0.1 * np.array([0.6, 0.8]), atol=1e-6) and np.allclose(s.weights["w"], [-0.1, -0.1], atol=1e-4)
    assert descent.cosine(1.0, 0, 10) == 1.0 and descent.cosine(1.0, 5, 10) == pytest.approx(0.5)


def test_the_network_learns_and_stops(spark):
    v = Views(spark, SMALL)
    _, height, width = v.shape
    net = models.AttentionNet(structure.dimensions.PROFILES, structure.NETWORK_FEATURES, layers=1)
    cells = structure._labelled(v)
    t = net.tiling(height, width, 16)
    held = F.col("node_id") % 5 == 0
    packs = [descent.write_packs(net.packs(cells.withColumn("counted", c), t), 1) for c in (~held, held)]
    counted = [sum(int(descent.unpacked(r["data"])["counted"].sum()) for r in p.of(None).collect()) for p in packs]
    assert counted == [1200, 300]
    state = descent.descend(net, descent.State(net.start(6)), packs[0], 10, 2e-2, clip=1.0, validation=packs[1])
    assert state.history[-1]["train"] < 0.9 * state.history[0]["train"] and state.history[-1]["validation"] < state.history[0]["validation"]
    worse = descent.descend(net, descent.State(state.weights), packs[0], 50, 0.0, validation=packs[1], patience=2)
    assert worse.epoch == 3  # nothing changes at a rate of 0: two epochs without a gain
    assert files.work_path(spark, "x").startswith("file:")


def test_erf_is_exact_to_the_last_digits():
    x = np.concatenate([np.linspace(-7, 7, 20001), [0.46875, -0.46875, 4.0, -4.0, 1e-300]])
    assert np.abs(dense.erf(x) - np.vectorize(math.erf)(x)).max() < 4e-16
    assert np.isnan(dense.erf(np.array([np.nan]))).all()


def test_a_chain_of_steps_equals_steps_of_a_job_each(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, *map(float, rng.normal(size=2)), *map(int, rng.integers(1, 4, 2))) for i in range(300)], "node_id long, a double, b double, y_p int, y_q int")
    net = models.Perceptron(("p", "q"), ["a", "b"], hidden=8)
    packs = descent.write_packs(models.perceptron_batches(net, rows, 300, 40), 1)
    monkeypatch.setattr(descent, "CHAIN", 3)  # several chains an epoch
    jobs, made = [], descent._chain
    monkeypatch.setattr(descent, "_chain", lambda *a: jobs.append(len(a[1])) or made(*a))
    chained = descent.descend(net, descent.State(net.start()), packs, 2)
    assert packs.steps > 3 and len(jobs) == 2 * -(-packs.steps // 3)
    packs.per_step = 0  # the way of steps of several packs
    stepwise = descent.descend(net, descent.State(net.start()), packs, 2)
    assert chained.steps == stepwise.steps and [h["train"] for h in chained.history] == pytest.approx([h["train"] for h in stepwise.history], rel=1e-12)
    for k, x in stepwise.weights.items():
        assert np.allclose(chained.weights[k], x, rtol=1e-12, atol=1e-14)
    assert chained.first.keys() == stepwise.first.keys()
