"""Models and packing against plain versions: dense normal equations, pooled positions one by one, an exhaustive optimum;
and the same edge cases for every operator."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrove.llm import hosts, langid, media, packing, paragraphs, pieces, quality, shingles, vectors, warc
from cellgrove.llm.common import crc_mod

P = pytest.importorskip("public_tokenizers")


def _corpus():
    rng = random.Random(5)
    words = ["the", "house", "and", "river", "under", "stone"]
    docs, labels = [], []
    for i in range(240):
        good = i % 3 > 0
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60)))
        docs.append((i, text + "." if good else (text.upper() + "!!! $$$ " * 4)))
        labels.append((i, int(good)))
    return docs, labels


def test_fit_equals_a_dense_solve(spark):
    docs, labels = _corpus()
    stats = quality.document_statistics(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    model = quality.fit(stats, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True), components=32)
    fold = {r["doc_id"]: r["c"] for r in stats.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).alias("c")).collect()}
    x = np.array([quality.statistics(t) for _, t in docs])
    y = np.array([v for _, v in labels], float)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-4), rtol=1e-3, atol=1e-4)
    train = np.array([not fold[i] for i, _ in docs])
    z = model.features(x[train])
    d = z.shape[1]
    penalty = 1e-3 * train.sum() / d * np.eye(d)
    penalty[-1, -1] = 1e-9
    want = np.linalg.solve(z.T @ z + penalty, z.T @ y[train])
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)
    held = ~train
    scores = model.raw(x[held])
    order = np.argsort(scores)
    assert (np.diff(model.score(x[held])[order]) >= -1e-9).all()


def test_pooled_probabilities_equal_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    h, classes = 6, ("aa", "bb", "cc")
    m = langid.BiGRU(classes, rng.normal(size=(2, 256, 3 * h)).astype(np.float32), (rng.normal(size=(2, 3 * h, h)) / 3).astype(np.float32), rng.normal(size=(3, 2 * h)).astype(np.float32), rng.normal(size=(3, 1)).astype(np.float32))

    def run(seq, d):
        state, out = np.zeros(h), []
        for b in seq:
            xt, a = m.wx[d, b], m.u[d] @ state
            z, r = (np.clip((xt[k * h : (k + 1) * h] + a[k * h : (k + 1) * h]) * 0.25 + 0.5, 0, 1) for k in (0, 1))
            n = np.tanh(xt[2 * h :] + r * a[2 * h :])
            state = z * state + (1 - z) * n
            out.append(state)
        return out

    texts = ["short", "x" * 64, "a longer text that runs over some segments " * 5, "é"]
    for text in texts:
        data = text.encode()
        total = np.zeros(3)
        for lo in range(0, len(data), langid.SEGMENT):
            seg = data[lo : lo + langid.SEGMENT]
            forward, backward = run(seg, 0), run(seg[::-1], 1)[::-1]
            for a, b in zip(forward, backward, strict=True):
                logits = m.v @ np.concatenate([a, b]) + m.c[:, 0]
                e = np.exp(logits - logits.max())
                total += e / e.sum()
        (got,) = langid.predict_bytes(m, [data])
        assert np.allclose(got, total / len(data), atol=2e-4)


def _optimum(lengths, capacity):
    """The least number of bins, by trying all assignments."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best and i < len(lengths):
            return
        if i == len(lengths):
            best = min(best, len(rooms))
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, [r - lengths[i] if j == k else r for j, r in enumerate(rooms)])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_small_packings_are_near_the_optimum():
    rng, over = random.Random(3), 0
    for _ in range(150):
        lengths = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))), reverse=True)
        bins, offsets, rooms = packing.best_two_fit(np.array(lengths), 20)
        used = np.bincount(bins, lengths, minlength=len(rooms))
        assert (used + rooms == 20).all() and (rooms >= 0).all()
        for b in range(len(rooms)):
            at = sorted((int(offsets[i]), lengths[i]) for i in np.flatnonzero(bins == b))
            assert [o for o, _ in at] == list(itertools.accumulate([n for _, n in at], initial=0))[:-1]
        over += len(rooms) - _optimum(lengths, 20)
    assert over <= 3


ROWS = [(None, "a text without an id"), (3, None), (3, "another text"), (3, "another text"), (4, ""), (5, "x" * 200_000), (1 << 40, "one two three four five six seven"), (-7, "one two three four five six seven")]
EXTRA = "token int, rep string, score double, n int, key string, text_digest long"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, i, f"r{i}", 0.5, i, f"k{i}", i) for i, r in enumerate(rows)], f"doc_id long, text string, {EXTRA}")


@pytest.mark.parametrize("rows", [ROWS, []], ids=["edge", "empty"])
def test_text_operators_take_any_rows(spark, rows):
    docs = _frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") > 3, "en"))
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None), (None, 1)], "doc_id long, quality int")
    stats = quality.document_statistics(docs)
    model = quality.fit(stats, labels, F.lit(True))
    scored = quality.score(stats, model).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] == 3}) <= 2  # null, and the text that two rows repeat
    net = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    found = langid.detect(docs, net).collect()
    assert len(found) == len(rows) and sum(r["lang_pred"] == "und" for r in found) >= sum(not t for _, t in rows)
    assert quality.keep_good(docs, model).columns == docs.columns == langid.keep_identified(docs, net).columns
    stored = media.digests(media.sniff(media.store_texts(docs), "media", "declared")).collect()
    assert len(stored) == len(rows) and all(r["payload_bytes"] % 192 == 0 and r["payload_bytes"] > 0 for r in stored)
    encoded = pieces.encode_checked(docs, P.path("piece_bpe_32k.model")).collect()
    assert len(encoded) == len(rows)
    packed = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(rows)
    near = shingles.near_duplicates(docs).collect()
    assert len(near) == len(rows)
    assert {r["component_id"] for r in near if r["doc_id"] in (-7, 1 << 40)} <= {-7}
    assert all(r["kept"] for r in near if r["doc_id"] is None)
    cut = paragraphs.remove_repeated(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_records_that_repeat_an_id_stay_apart(spark):
    a, b = "a" * 1500, "b" * 1500
    rows = [(5, "http://x.org/1", a), (5, "http://x.org/2", b), (9, "http://x.org/3", a), (6, "http://x.org/4", b), (5, None, "small"), (None, "http://y.org/", a), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(spark, warc.archive(pages)).collect())
    want = sorted([(5, 1500, "revisit", 9), (5, 1500, "revisit", 6), (9, 1500, "response", None), (6, 1500, "response", None), (5, 5, "response", None), (-1, 1500, "response", None), (-1, 0, "response", None)], key=repr)
    assert sorted(got, key=repr) == want


def test_a_payload_full_of_false_headers(spark):
    false = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\n"
    rows = [(i, f"http://x.org/{i}", (false * 400 if i == 3 else "") + "z" * i) for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["payload_bytes"] for r in warc.read(spark, warc.archive(pages)).collect()}
    assert got == {i: len(h) for i, _, h in rows}


def test_vectors_with_ties_repeats_and_clashing_names(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.9, (1 - 0.81) ** 0.5]), (3, [0.0, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rep int, key int")
    got = vectors.near_duplicates(df, bucket=2, block=4).collect()
    assert len(got) == 5
    assert {r["component_id"] for r in got if r["vec_id"] in (1, 2)} == {1}
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_posteriors_by_hand(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.a.org/{i}") for i in range(8)] + [(8, "http://new.b.org/"), (9, None), (10, "no scheme")], "page_id long, url string")
    outcomes = spark.createDataFrame([(f"http://h{i % 2}.a.org/{i}", int(i % 2 == 0)) for i in range(8)], "url string, bad int")
    got = {r["page_id"]: r for r in hosts.judge(pages, outcomes).collect()}
    assert got[9]["host"] == got[10]["host"] == "" and len(got) == 11
    # h0: 4 of 4 bad, h1: 0 of 4; half of all are bad, so h0 is blocked and h1 is not
    assert got[0]["verdict"] == "block" and got[1]["verdict"] == "allow"
