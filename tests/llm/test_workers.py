"""How many Python workers a task keeps: those of a stage run side by side, and Spark keeps them for later stages."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellgrove.llm import langid, packing, paragraphs, shingles


def _most_in_a_stage(node):
    """(Python operators between node and the exchanges below it, the most in any stage)."""
    below = [_most_in_a_stage(node.children().apply(i)) for i in range(node.children().size())]
    name = node.nodeName()
    here = sum(n for n, _ in below) + any(x in name for x in ("Python", "InArrow", "InPandas"))
    if name == "Union":
        here = max(n for n, _ in below)  # each partition is of one side
    most = max([here, *(m for _, m in below)])
    return (0, most) if "Exchange" in name and "Broadcast" not in name else (here, most)


def test_removal_runs_one_python_worker_a_task(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = words(80)
    rows = [(i, " ".join([words(60), passage, words(60)]) if i % 4 == 0 else words(150)) for i in range(40)] + [(None, passage), (0, words(90))]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    out = paragraphs.remove_repeated(df)
    plan = out._jdf.queryExecution().executedPlan()
    assert _most_in_a_stage(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)[1] == 1
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(left) == len(rows) and sum(len(t) for _, t in left) < sum(len(t) for _, t in rows)
    kept = {t for _, t in left}
    assert all(t in kept for i, t in rows if i is None or i % 4 or passage not in t)


def test_fitting_languages_needs_no_rows_from_python(spark, monkeypatch):
    made, before = [], SparkSession.createDataFrame

    def create(self, *args, **kwargs):
        made.append(before(self, *args, **kwargs))
        return made[-1]

    docs = spark.createDataFrame([(i, ("der die das " if i % 2 else "the and of ") * 9, "de" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string")
    monkeypatch.setattr(SparkSession, "createDataFrame", create)
    model = langid.fit(docs, F.lit(True))
    assert model.classes == ("de", "en") and made
    assert not any("PythonRDD" in df._jdf.queryExecution().toRdd().toDebugString() for df in made)


def test_workers_keep_no_caches_after_a_task(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(i, f"some words of text number {i} and more") for i in range(80)], "doc_id long, text string").repartition(8)
    packing.pieces(docs, tokenizers.path("word_bpe_49k.json")).collect()
    shingles.signatures(docs).collect()

    def kept(batches):
        from cellgrove.llm import packing, words

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(packing._MODELS) + len(words._POWERS)]})

    assert {r["n"] for r in docs.mapInArrow(kept, "n long").collect()} == {0}
