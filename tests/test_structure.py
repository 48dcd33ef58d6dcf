"""Networks, components, models and streams against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import grid, learn, models, network, quality, training
from cellgrove.plans import catalog, structure
from cellgrove.sources import dimensions, files
from cellgrove.sources.views import Views
from cellgrove.streaming import ingest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cells(spark):
    v = Views(spark, SMALL)
    df = v.cells().select("node_id", "row", "col", *structure.NETWORK_FEATURES).orderBy("node_id").toPandas()
    edges = v.edges().select("src", "dst").toPandas()
    return df, edges.src.to_numpy(), edges.dst.to_numpy(), v.shape[2]


def _gelu(x):
    return 0.5 * x * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


def _norm(x):
    return (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + 1e-5)


def _encoded(df, w):
    return _gelu(df[structure.NETWORK_FEATURES].to_numpy(float) @ w["encoder"].T + w["bias"])


def test_attention_forward_equals_numpy(spark, cells):
    df, src, dst, _ = cells
    w = structure.given_weights()
    h = _encoded(df, w)
    for k in range(3):
        sent = h @ w[f"left{k}"].T
        mixed = sent[src] + (h @ w[f"right{k}"].T)[dst]
        e = np.where(mixed > 0, mixed, 0.2 * mixed) @ w[f"scorer{k}"]
        top = np.full(len(h), -np.inf)
        np.maximum.at(top, dst, e)
        x = np.exp(e - top[dst])
        total, m = np.zeros(len(h)), np.zeros_like(h)
        np.add.at(total, dst, x)
        np.add.at(m, dst, sent[src] * x[:, None])
        h = _gelu(_norm(h + m / total[:, None]))
    got = catalog.QUERIES["attention_forward"](spark, SMALL).toPandas().sort_values(["profile", "node_id"])
    assert len(got) == 4 * len(df)
    for profile, rows in got.groupby("profile"):
        z = h @ w[profile].T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        assert np.allclose(rows[["p1", "p2", "p3"]].to_numpy(), p, atol=1e-5)


def test_relation_forward_equals_numpy(spark, cells):
    df, src, dst, width = cells
    w = structure.given_weights()
    h, step = _encoded(df, w), np.abs(src - dst)
    m = np.zeros_like(h)
    for k, at in enumerate((step == 1, step == width, (step != 1) & (step != width) & (step != 0), step == 0)):
        np.add.at(m, dst[at], (h @ w[f"relation{k}"].T)[src[at]])
    got = catalog.QUERIES["relation_forward"](spark, SMALL).toPandas().sort_values("node_id")
    assert np.allclose(got.drop(columns="node_id").to_numpy(), _gelu(_norm(h + m)), atol=1e-5)


def _components(spark, k):
    e = pd.read_parquet(f"{SMALL}/embeddings.parquet").sort_values("vec_id")
    return e


def test_components_equal_numpy(spark):
    e = _components(spark, 16)
    x = np.stack(e.embedding.to_numpy()).astype(float)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    shares = values / values.sum()
    got = catalog.QUERIES["pca_embeddings"](spark, SMALL).orderBy("component").toPandas()
    assert np.allclose(got.share, shares[:16], atol=1e-5) and np.allclose(got.cumulative, np.cumsum(shares)[:16], atol=1e-5)
    dims = catalog.QUERIES["pca_dimensions"](spark, SMALL).first()
    assert [dims[f"d{t}"] for t in (90, 95, 99)] == [int(np.argmax(np.cumsum(shares) >= t / 100 - 1e-12)) + 1 for t in (90, 95, 99)]
    pcs = z @ vectors[:, :4]
    got = catalog.QUERIES["pc_label_corr"](spark, SMALL).first()
    for i in range(4):
        assert abs(got[f"pc{i + 1}"]) == pytest.approx(abs(np.corrcoef(pcs[:, i], e.label.to_numpy(float))[0, 1]), abs=1e-4)


def test_component_feature_correlations_equal_numpy(spark):
    cells = Views(spark, SMALL).cells().select("node_id", *catalog.FEATURES).toPandas()
    e = _components(spark, 4).merge(cells, left_on="vec_id", right_on="node_id")
    x = np.stack(e.embedding.to_numpy()).astype(float)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    pcs = z @ np.linalg.eigh(np.cov(z.T))[1][:, ::-1][:, :4]
    got = catalog.QUERIES["pc_feature_corr"](spark, SMALL).collect()
    assert len(got) == 12
    for r in got:
        assert r["r"] == pytest.approx(abs(np.corrcoef(pcs[:, r["component"] - 1], e[r["feature"]].to_numpy(float))[0, 1]), abs=1e-4)


def test_models_are_saved_with_a_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(float(i % 7), float(i % 3), 1 + i % 3) for i in range(60)], "a double, b double, y int")
    data = learn.assemble(rows, ["a", "b"])
    model = learn.random_forest(data, trees=3, depth=4)
    learn.save_model(model, str(tmp_path / "a_pe"), {"profile": "a_pe", "columns": "a,b"})
    again, said = learn.load_model(str(tmp_path / "a_pe"))
    assert said["profile"] == "a_pe" and said["kind"] == "RandomForestClassificationModel"
    assert learn.predict(again, data).exceptAll(learn.predict(model, data)).count() == 0


def test_a_batch_that_runs_again_leaves_its_rows_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).coalesce(1).write.parquet(source)
    ingest.ingest_by_batch(spark, source, target, str(tmp_path / "marks"))
    ingest.ingest_by_batch(spark, source, target, str(tmp_path / "new-marks"))  # the checkpoint was lost: batch 0 again
    assert sorted(r[0] for r in spark.read.parquet(target).select("id").collect()) == list(range(10))


def test_running_means_go_on(spark, tmp_path):
    source, target, marks = (str(tmp_path / d) for d in ("in", "out", "marks"))
    rows = [(0, 0, 10), (0, 0, 0), (0, 1, 4)]
    spark.createDataFrame(rows, "row long, col long, dn long").write.parquet(source)
    ingest.running_means(spark, source, target, marks)
    spark.createDataFrame([(0, 0, 20), (1, 1, 7)], "row long, col long, dn long").write.mode("append").parquet(source)
    ingest.running_means(spark, source, target, marks)
    got = {(r["row"], r["col"]): (r["mean"], r["scenes"]) for r in spark.read.parquet(target).collect()}
    assert got == {(0, 0): (15.0, 2), (0, 1): (4.0, 1), (1, 1): (7.0, 1)}


def test_derivatives_of_a_plane_and_of_one_cell(spark):
    plane = spark.createDataFrame([(r * 5 + c, r, c, 30.0 * c) for r in range(4) for c in range(5)], "node_id long, row long, col long, z double")
    got = {r["node_id"]: r for r in grid.derivatives(plane, "z", 4, 5).collect()}
    assert len(got) == 20 and got[7]["slope_deg"] == pytest.approx(45.0) and got[7]["curvature"] == pytest.approx(0.0)
    one = grid.derivatives(spark.createDataFrame([(0, 0, 0, 5.0)], "node_id long, row long, col long, z double"), "z", 1, 1).first()
    assert (one["slope_deg"], one["tri"], one["roughness"]) == (0.0, 0.0, 0.0)


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1, 2.0)], "node_id long, slope double")
    assert quality.require_schema(df, {"slope": "double"}) is df
    with pytest.raises(ValueError, match="ndvi"):
        quality.require_schema(df, {"slope": "double", "ndvi": "double"})


def test_early_stopping_without_gain_and_without_rows(spark):
    hist = spark.createDataFrame([(i, 1.0) for i in range(9)], "epoch int, loss double")
    got = training.early_stopping(hist, patience=3).orderBy("epoch").collect()
    assert [(r["counter"], r["stop"]) for r in got] == [(0, False), (0, False)] + [(0, False)] * 7  # equal losses count as a gain of 0
    got = training.early_stopping(hist, patience=3, min_delta=0.1).orderBy("epoch").collect()
    assert [r["counter"] for r in got] == [0, 1, 2, 3] and got[-1]["stop"]
    assert training.early_stopping(hist.limit(0), patience=3).count() == 0


def test_stored_predictions_come_back_as_rows(spark, tmp_path):
    v = Views(spark, SMALL)
    wide = v.wide().groupBy("node_id").pivot("profile", list(dimensions.PROFILES)).agg(F.first("gnn"))
    wide.withColumnRenamed("a_pe", "y_a_pe").write.parquet(str(tmp_path / "p"))
    got = files.read_predictions(spark, str(tmp_path / "p"), dimensions.PROFILES)
    assert got.exceptAll(v.wide().select("node_id", "profile", F.col("gnn").alias("pred"))).count() == 0 and got.count() == 6000
    probs = v.profile_probs()
    arrays = probs.groupBy("node_id").pivot("profile", list(dimensions.PROFILES)).agg(F.first(F.array("p1", "p2", "p3")))
    arrays.withColumnRenamed("blindada", "probs_blindada").write.parquet(str(tmp_path / "q"))
    back = files.read_probabilities(spark, str(tmp_path / "q"), dimensions.PROFILES)
    assert back.exceptAll(probs).count() == 0 and back.count() == probs.count()


def test_slim_tables_keep_their_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "node_id long, slope double, ndvi double")
    assert files.slim(df, ["slope"], ["slope", "ndvi", "tri"]).first() == (1, 2.0, None, None)


def test_baselines_learn_the_rules(spark):
    """At full size, held out: far above the commonest class; steep slopes and vegetation matter most."""
    data = catalog._trained(Views(spark, SMALL), "a_pe")
    train, test = data.where("split = 'train'").cache(), data.where("split = 'test'").cache()
    common = test.groupBy("y").count().agg(F.max("count")).first()[0] / test.count()
    forest = learn.random_forest(train)
    assert learn.predict(forest, test).where("pred = y").count() / test.count() >= max(0.9, common)
    ranked = [r["feature"] for r in learn.importance(forest, catalog.TRAINED).orderBy(F.desc("importance")).collect()]
    assert set(ranked[:2]) <= {"slope", "ndvi", "ndwi"}
    net = learn.perceptron(train, len(catalog.TRAINED))
    assert learn.predict(net, test).where("pred = y").count() / test.count() >= common + 0.1
    train.unpersist(), test.unpersist()


def test_relation_layer_over_edges_equals_tiles(spark):
    v, w = Views(spark, SMALL), structure.given_weights()
    width = v.shape[2]
    step, e = F.abs(F.col("src") - F.col("dst")), v.edges().select("src", "dst")
    kinds = (step == 1, step == width, (step != 1) & (step != width) & (step != 0), step == 0)
    nodes = network.encode(v.cells(), structure.NETWORK_FEATURES, w["encoder"], w["bias"])
    want = {r["node_id"]: r["h"] for r in network.relation_layer(nodes, {f"relation{k}": e.where(c) for k, c in enumerate(kinds)}, w).collect()}
    got = {r["node_id"]: r["h"] for r in models.RelationNet(structure.NETWORK_FEATURES).infer(w, v.cells(), *v.shape[1:], tile=7).collect()}
    assert got.keys() == want.keys()
    assert max(abs(a - b) for i, h in got.items() for a, b in zip(h, want[i], strict=True)) < 1e-9


def test_relation_forward_sends_no_edges(spark):
    plan = catalog.QUERIES["relation_forward"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan


def test_scenes_are_stored_by_as_many_tasks_as_there_are(spark, monkeypatch):
    paths, made = [], structure.files.work_path
    monkeypatch.setattr(structure.files, "work_path", lambda s, label: paths.append(made(s, label)) or paths[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["row"], r["col"]): (r["mean"], r["scenes"]) for r in catalog.QUERIES["means_upserted"](spark, SMALL).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.parquet(paths[0]).inputFiles()) > 3
    want = Views(spark, SMALL).scenes().where("dn > 0").groupBy("row", "col").agg(F.round(F.avg("dn"), 6).alias("mean"), F.count("*").alias("scenes")).collect()
    assert got == {(r["row"], r["col"]): (r["mean"], r["scenes"]) for r in want}
