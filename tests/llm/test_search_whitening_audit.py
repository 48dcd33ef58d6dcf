"""Nearest neighbours, whitening and the filter audit against plain versions, and on rows of every kind."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.llm import interplay, nearest, whitening

VECTORS = "vec_id long, embedding array<double>"


def _neighbours(rows, k, every=2):
    """By brute force over rows (id, vector): query -> [(-score, id)], for ids that every divides; an id once."""
    good = [(i, v) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            best = {}
            for i, b in good:
                if i != q and len(a) == len(b):
                    score = 0.0
                    for x, y in zip(a, b, strict=True):
                        score += x * y
                    best[i] = max(best.get(i, -math.inf), score)
            out[q] = sorted((-s, i) for i, s in best.items())[:k]
    return out


def _found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    for rows in out.values():
        assert [x[0] for x in sorted(rows)] == list(range(1, len(rows) + 1))
    return {q: [x[1:] for x in sorted(rows)] for q, rows in out.items()}


def test_all_probes_give_the_brute_force_neighbours(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * s for _ in range(6)]) for i, s in zip(range(120), itertools.cycle((1.0, 1.1, 30.0, 1e-3)))]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300 + i, rows[4][1]) for i in range(3)]  # more equal vectors than k
    rows += [(400, [1.0, 2.0]), (402, [2.0, 1.0]), (404, [-1.0, 0.5])]  # another length, fewer than k
    rows += [(500, None), (501, []), (502, [0.0] * 6), (504, [None] + [1.0] * 5), (506, [math.nan] * 6), (508, [math.inf] * 6), (None, [1.0] * 6)]
    rows += [rows[8], rows[9]]  # repeated rows
    df = spark.createDataFrame(rows, VECTORS).select("*", F.lit(1).alias("band"), F.lit("x").alias("query"), F.lit(2).alias("best"))
    want = _neighbours(rows, 5)
    for block in (2048, 7):
        got = _found(nearest.search(df.repartition(3), F.col("vec_id") % 2 == 0, k=5, recall=1.0, sample=1000, block=block))
        assert {q: x for q, x in want.items() if x} == got
    assert nearest.search(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0
    with pytest.raises(TypeError):
        nearest.search(df.withColumn("vec_id", F.col("vec_id").cast("string")), F.lit(True))


def test_an_id_of_several_vectors_is_found_once_at_its_best(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [2.0, 0.0]), (3, [0.5, 0.5]), (0, [0.0, 1.0])]
    got = nearest.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0, k=5, recall=1.0).collect()
    assert sorted((r["vec_id"], r["score"]) for r in got) == [(1, 0.1), (1, 2.0), (3, 0.5), (3, 0.5)]  # each vector of 0 asks for itself


@pytest.mark.parametrize("bucket", [512, 2])
def test_recall_on_clusters(spark, bucket):
    """With buckets of 2 rows, two rotations are combined."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    m = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = _found(nearest.search(df, F.col("vec_id") % 20 == 0, bucket=bucket))
    full = m.astype(float)
    hits = 0
    for q in range(0, 3000, 20):
        s = full @ full[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {i for _, i in got[q]})
        assert len(got[q]) == 20 and all(abs(-x - s[i]) < 1e-9 for x, i in got[q])
    assert len(got) == 150 and hits / 3000 >= 0.9
    if bucket == 2:
        assert len(nearest.axes_for(24, 2, 3000, bucket)) == 2


def test_probes_come_in_the_order_of_their_estimates():
    v = np.random.default_rng(1).normal(size=(5, 8))
    axes, bands = [8, 4], np.array([-1, 0, 3])
    b, k = nearest.probes_of(v, 1, axes, bands, 50)
    for row in range(5):
        one, two = nearest.rotated(v, 1, 0)[row], nearest.rotated(v, 1, 1)[row, :4]
        first, second = np.stack([one, -one], 1).ravel(), np.stack([two, -two], 1).ravel()
        every = sorted(((-(2 ** ((x - 3) / 2)) * (first[i] + second[j]), x, i * 8 + j) for x in bands for i in range(16) for j in range(8)))
        assert np.allclose([e[0] for e in every[:50]], [-(2 ** ((x - 3) / 2)) * (first[y // 8] + second[y % 8]) for x, y in zip(b[row], k[row])])
        assert len({(x, y) for x, y in zip(b[row].tolist(), k[row].tolist())}) == 50
    own = nearest.buckets_of(v, 1, axes)
    assert (own == nearest.probes_of(v, 1, axes, np.array([0]), 1)[1][:, 0]).all()


def _whitened(rows, components=4):
    dim = max((len(v) for _, v in rows), key=lambda d: (sum(len(v) == d for _, v in rows), d))
    ids, x = [i for i, v in rows if len(v) == dim], np.array([[math.floor(256 * c) for c in v] for _, v in rows if len(v) == dim])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    v = (fit - total / n).T @ (fit - total / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return ids, x, n, total, e, u, np.trace(v)


@pytest.mark.parametrize("dim,tile", [(5, 8), (7, 3), (2, 8), (19, 8)])
def test_whitening_equals_numpy(spark, monkeypatch, dim, tile):
    monkeypatch.setattr(whitening, "TILE", tile)
    rng = np.random.default_rng(dim)
    rows = [(i, (rng.normal(size=dim) * np.arange(1, dim + 1)).tolist()) for i in range(60)]
    rows += [(100 + i, rows[1][1]) for i in range(30)] + [(7, rows[2][1]), (None, rows[5][1]), (200, [0.5])]
    bad = [(300, None), (301, [None] * dim), (302, [math.nan] * dim), (303, [-math.inf] * dim), (304, [])]
    df = spark.createDataFrame(rows + bad, VECTORS).select("*", F.lit(1).alias("x"), F.lit(1).alias("component"), F.lit(1).alias("n"))
    got = whitening.whiten(df.repartition(4)).collect()
    ids, x, n, total, e, u, trace = _whitened(rows)
    k = min(4, dim)
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {n}
    deviation = ((n * x - total) ** 2).sum(axis=1).tolist()
    assert sorted(((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1), key=repr) == sorted(zip(ids, deviation, strict=True), key=repr)
    want = (x - total / n) @ u / np.sqrt(e)
    for c in range(k):
        mine = sorted((r["deviation"], r["whitened"]) for r in got if r["component"] == c + 1)
        plain = sorted(zip(deviation, want[:, c].tolist(), strict=True))
        sign = np.sign(sum(a[1] * b[1] for a, b in zip(mine, plain, strict=True)))
        assert np.allclose([a[1] * sign for a in mine], [b[1] for b in plain], atol=1e-8)
        assert np.allclose({r["explained"] for r in got if r["component"] == c + 1}.pop(), e[c] / trace)
    assert {r["identity_error"] < 1e-9 for r in got} == {True}


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], VECTORS)
    got = whitening.whiten(same).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, None, None, None)] * 4
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], VECTORS)
    got = whitening.whiten(line).collect()
    assert {r["component"]: r["whitened"] is None for r in got} == {1: False, 2: True, 3: True}
    assert {r["identity_error"] < 1e-9 for r in got} == {True}
    assert whitening.whiten(line.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(line.limit(0)).count() == 0
    far = spark.createDataFrame([(1, [1e12]), (2, [-1e12])], VECTORS)
    assert [r["deviation"] for r in whitening.whiten(far).collect()] == [None, None]


def _audited(docs, labels):
    """Every document through every order, one by one."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    out = {}
    for i, text, part in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and least[text] < i,
        }
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = out.setdefault((part or "", "".join(order), step), dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), 0))
                now = fails[f] and not gone
                row["removed"] += now
                row["redundant"] += fails[f] and gone
                row["unique_fails"] += fails[f] and sum(fails.values()) == 1
                row["good_lost"] += now and i in good
                row["toxic_lost"] += now and i in toxic
                gone |= fails[f]
                row["kept"] += not gone
    shapley = {}
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + row["removed"]
    return {(part, order, step, *row.values(), shapley[part, order[step - 1]]) for (part, order, step), row in out.items()}


def test_audit_equals_one_by_one(spark):
    rng = random.Random(9)
    vocabulary = ["word", "Word", "état", "a$b", "x", "　", "y" * 50, "z\x0b", "MORE"] + [f"w{i}" for i in range(300)]
    docs = []
    for i in range(150):
        some = vocabulary if i % 3 else vocabulary[9:]
        docs.append((i, " \t".join(rng.choice(some[: rng.choice((12, 400))]) for _ in range(rng.choice((0, 3, 199, 200, 260)))), rng.choice(("a", "b", None, ""))))
    docs += [(200 + i, docs[7][1], "a") for i in range(40)] + [(3, docs[7][1], "b"), (3, docs[7][1], "b"), (5, "other text", "a"), (5, docs[7][1], "c")]
    docs += [(None, docs[7][1], "a"), (None, docs[7][1], "a"), (None, None, None), (300, None, "a"), (301, "", "a"), (302, " \n ", "a"), (303, "long " * 200_000, "a")]
    labels = [(i, int(i % 3 > 0), int(i % 11 == 0)) for i in range(0, 260, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (9, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").select("*", F.lit(1).alias("id"), F.lit(2).alias("mask"), F.lit(2).alias("n"), F.lit("w").alias("word"))
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    columns = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    got = interplay.audit(df.repartition(5), said)
    assert got.columns == columns
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 600 * 4 and set(rows) == _audited(docs, labels)
    assert interplay.audit(df.limit(0), said).count() == 0
    assert {r["good_lost"] for r in interplay.audit(df, said.limit(0)).collect()} == {0}
    with pytest.raises(TypeError):
        interplay.audit(df.withColumn("doc_id", F.col("doc_id").cast("string")), said)


def test_audit_shuffles_texts_once(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    counts = interplay.word_counts(interplay._documents(df, "doc_id", "text", "source"))
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
