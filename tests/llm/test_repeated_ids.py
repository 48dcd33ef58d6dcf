"""Rows that share an id but not their content, in the operators on pairs and in the pipeline; very many languages."""

import random

import pytest

from cellgrove.llm import langid, shingles, vectors

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _text(rng, n=200):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def _near(words):
    return " ".join(words[:-3] + ["other", "words", "here"])


def test_near_copies_of_texts_that_share_an_id(spark):
    rng = random.Random(1)
    a, b, c = _text(rng), _text(rng), _text(rng)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, _near(a)), (9, _near(b)), (7, " ".join(c)), (5, " ".join(a)), (None, " ".join(a)), (11, None), (11, " ".join(c).upper())]
    got = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hashed="h").collect()
    assert len(got) == len(rows) and len({r["h"] for r in got}) == 7
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=repr)
    want = [(5, 196, 5, True)] * 3 + [(7, 196, 5, False), (9, 196, 5, False), (7, 196, 7, True), (None, 196, None, True), (11, 0, 11, True), (11, 196, 7, False)]
    assert found == sorted(want, key=repr)


def test_links_of_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0]), (1, [-1.0, -0.01])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 1, False)]
    with pytest.raises(TypeError):
        vectors.near_duplicates(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))


def test_the_pipeline_keeps_texts_that_resemble_nothing(spark):
    import corpus_pipeline

    rng = random.Random(2)
    a, c = _text(rng), _text(rng)
    rows = [(5, " ".join(a), "en", "s", 1), (7, _near(a), "en", "s", 1), (7, " ".join(c), "en", "s", 1), (None, None, None, None, None), (8, None, None, None, None), (9, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], *rows[2:]], key=repr)
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.repeated_passage_stage(spark, docs, "").count() == len(rows)
    assert corpus_pipeline.repeated_passage_stage(spark, docs.limit(0), "").count() == 0
    packed = corpus_pipeline.packing_stage(spark, docs, "").collect()
    assert sum(r["doc_id"] == 7 for r in packed) == 2 and len(packed) == len(rows)


def test_very_many_languages(spark):
    rng = random.Random(3)
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * rng.randrange(3, 8), f"l{i:04d}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    model = langid.fit(docs, F.lit(True), epochs=1)
    assert len(model.classes) == 600
    found = langid.detect(docs, model).collect()
    assert len(found) == 600 and {r["lang_pred"] for r in found} <= set(model.classes)
    few = langid.fit(docs, F.lit(True), most_docs=1, epochs=1)
    assert len(few.classes) == 600
