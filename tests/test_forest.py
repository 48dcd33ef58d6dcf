"""The forest of packs against trees that plain loops grow from the same bags."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.operators import forest
from cellgrove.plans import catalog
from cellgrove.sources.views import Views

NAMES = ["a", "b", "c"]


def _rows(n=700):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.integers(0, 2, n).astype(float)
    y = np.where(a + 0.3 * b > 1, 3, np.where(rng.random(n) < 0.2, 2, 1))
    z = np.where(c > 0, 1, np.where(a > 0.5, 2, 1))  # class 3 is missing
    return [(int(i), float(a[i]), float(b[i]), float(c[i]), int(y[i]), int(z[i]), int(y[i])) for i in range(n)]


def _plain(plan, label, tree, x, y, w, asked):
    """The falls of one tree by feature, and the probabilities of asked rows."""
    weight, falls, probs = plan.weights[label], np.zeros(plan.features), np.zeros((len(asked), 3))

    def gini(counts):
        t = counts * weight
        return t.sum() - (t * t).sum() / t.sum() if t.sum() else 0.0

    def counted(rows):
        return np.bincount(y[rows], w[rows], 3)

    def grow(path, rows, wanted):
        here, best = counted(rows), None
        if (here > 0).sum() > 1 and path < 1 << plan.depth:
            for f in plan.drawn(tree, np.array([path]))[0]:
                for cut in range(forest.BINS - 1):
                    left = x[rows, f] <= cut
                    if w[rows][left].any() and w[rows][~left].any():
                        fall = gini(here) - gini(counted(rows[left])) - gini(counted(rows[~left]))
                        if fall > 1e-9 and (best is None or fall > best[0] + 1e-9):
                            best = fall, f, cut
        if best is None:
            probs[wanted] = here * weight / (here * weight).sum()
            return
        fall, f, cut = best
        falls[f] += fall
        for side in (0, 1):
            grow(2 * path + side, rows[(x[rows, f] > cut) == side], wanted[(asked[wanted, f] > cut) == side])

    grow(1, np.flatnonzero(w), np.arange(len(asked)))
    return falls, probs


@pytest.mark.parametrize("small", [1, 60, 10_000])
def test_forest_equals_plain_loops_wherever_its_upper_part_ends(spark, monkeypatch, small):
    monkeypatch.setattr(forest, "SMALL", small)
    monkeypatch.setattr(forest, "PACK", 100)
    monkeypatch.setattr(forest, "SLOT", 90)
    known, odd = _rows(), [(9001, None, 1.0, 0.0, 1, 1, 1), (9002, float("nan"), 1.0, 0.0, 2, 1, 2)]
    schema = "id long, a double, b double, c double, y int, z int, again int"
    df = spark.createDataFrame(known[:500] + odd, schema).repartition(3)
    grown = forest.Forest(df, "id", NAMES, ["y", "z", "again"], trees=4, depth=7)
    assert grown.n == 500 and [len(c) for c in grown.cuts] == [31, 4, 1]
    data = np.array(known)
    bins = np.stack([np.searchsorted(c, data[:, i + 1]) for i, c in enumerate(grown.cuts)], axis=1)
    ids, plan = data[:500, 0].astype(np.int64), grown.plan
    cube, found = {}, []
    for k, name in enumerate(("y", "z")):
        y, sums, each = data[:, 4 + k].astype(int) - 1, 0, 0
        for tree in range(4):
            falls, p = _plain(plan, k, tree, bins[:500], y[:500], plan.bag(ids, tree).astype(float), bins[500:])
            sums, each = sums + p.astype(np.float32), each + falls / falls.sum()
        found.append(each / each.sum())
        for a, b in zip(y[500:], sums.argmax(axis=1), strict=True):
            for label in (name, "again") if name == "y" else (name,):
                cube[label, a + 1, b + 1] = cube.get((label, a + 1, b + 1), 0) + 1
    assert np.allclose(grown.importances(), [found[0], found[1], found[0]], atol=1e-9)
    got = {(r["label"], r["y"], r["pred"]): r["n"] for r in grown.confusion(spark.createDataFrame(known[500:] + odd, schema)).collect()}
    assert got == cube


def test_queries_take_few_jobs(spark):
    """All profiles and trees share a job a level; MLlib's forests took several a level and profile."""
    small = "/root/testdata/sf0.001"
    sc = spark.sparkContext
    sc.setJobGroup("forest", "jobs of a forest")
    try:
        found = catalog.QUERIES["rf_importance"](spark, small)
        jobs = len(sc.statusTracker().getJobIdsForGroup("forest"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60
    totals = found.groupBy("profile").agg(F.sum("importance").alias("s"), F.count("*").alias("n")).collect()
    assert len(totals) == 4 and all(r["n"] == len(catalog.TRAINED) and abs(r["s"] - 1) < 1e-9 for r in totals)
    at = Views(spark, small).cell_splits().where("split = 'test'").count()
    assert [r["n"] for r in catalog.QUERIES["rf_baseline"](spark, small).collect()] == [at] * 4


def test_no_rows_give_the_first_class(spark):
    schema = "id long, a double, y int"
    grown = forest.Forest(spark.createDataFrame([], schema), "id", ["a"], ["y"], trees=2, depth=3)
    assert (grown.importances() == 0).all()
    assert [tuple(r) for r in grown.confusion(spark.createDataFrame([(1, 2.0, 2)], schema)).collect()] == [("y", 2, 1, 1)]
