"""Passages that repeat, wherever lines break and wherever they stand in a text."""

import random

import pytest

from cellgrove.llm import paragraphs

RNG = random.Random(11)
VOCABULARY = [f"q{i}" for i in range(6000)]


def _words(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def _hold(words, passage):
    """Positions of a passage's words in a text that are still there, in order."""
    text, at, kept = " ".join(words), 0, 0
    grams = [" ".join(passage[i : i + 6]) for i in range(len(passage) - 5)]
    for g in grams:
        kept += g in text[at:]
    return kept


@pytest.fixture(scope="module")
def planted():
    passages = [_words(RNG.randrange(55, 90)) for _ in range(40)]
    docs = {}
    for i in range(400):
        words = _words(RNG.randrange(30, 160))
        if i % 2:
            p = list(passages[i % 40])
            if i % 4 == 1:
                p[RNG.randrange(len(p))] = "changed"  # one word differs in half of the copies
            at = RNG.randrange(len(words))
            words[at:at] = p
        breaks = RNG.sample(range(len(words)), 5)  # lines break anywhere, in the passage too
        docs[i] = "".join(w + ("\n" if k in breaks else " ") for k, w in enumerate(words))
    return passages, docs


def test_passages_in_the_middle_of_lines_are_found(spark, planted):
    passages, docs = planted
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r["doc_id"] for r in paragraphs.repeated(df).collect()}
    held = [i for i in docs if i % 2]
    assert sum(i in found for i in held) >= 0.95 * len(held)
    assert not [i for i in found if i % 2 == 0]


def test_most_words_of_later_copies_go_and_all_others_stay(spark, planted):
    passages, docs = planted
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in paragraphs.remove_repeated(df).collect()}
    gone = whole = 0
    for i, text in docs.items():
        before, after = text.split(), out[i].split()
        if i % 2 == 0:
            assert out[i] == text
        elif i >= 40:
            whole += len(passages[i % 40])
            gone += len(before) - len(after)
            own = [w for w in before if w not in passages[i % 40] and w != "changed"]
            assert len([w for w in own if w not in after]) <= 12  # at most the rest of a paragraph that straddles the passage's end
    assert gone >= 0.55 * whole


def test_short_notices_stay(spark):
    notice = " ".join(_words(13))
    docs = [(i, " ".join(_words(60)) + "\n" + notice) for i in range(50)]
    assert paragraphs.repeated(spark.createDataFrame(docs, "doc_id long, text string")).count() == 0


def test_passages_of_short_lines_are_found(spark):
    verse = [" ".join(_words(10)) for _ in range(6)]
    docs = [(i, "\n".join([" ".join(_words(RNG.choice([3, 7, 12, 30]))) for _ in range(3)] + (verse if i % 2 else [x for v in verse for x in (v, "")]))) for i in range(12)]
    found = {r["doc_id"] for r in paragraphs.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == set(range(12))


def test_rows_that_share_an_id_lose_only_what_repeats(spark):
    p, u, v = (" ".join(_words(80)) for _ in range(3))
    rows = [(1, p), (5, p + "\n" + u), (5, v + "\n" + " ".join(_words(50))), (1 << 40, v), (-(1 << 62), u), (7, None), (None, p), (None, u), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, len((r["text"] or "").split())) for r in paragraphs.remove_repeated(df).collect())
    assert len(out) == len(rows)
    texts = " ".join(r["text"] or "" for r in paragraphs.remove_repeated(df).where("doc_id is not null").collect())
    for x in (p, u, v):  # every passage is still there once
        w = x.split()
        assert " ".join(w[8:72]) in " ".join(texts.split()) and texts.split().count(w[40]) >= 1
    assert {r["text"] for r in paragraphs.remove_repeated(df).where("doc_id is null").collect()} == {p, u}
    assert paragraphs.remove_repeated(df).where("doc_id = 5").agg({"*": "count"}).first()[0] == 2


def test_other_ids_are_refused(spark):
    with pytest.raises(TypeError):
        paragraphs.repeated(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert paragraphs.repeated(empty).count() == 0 and paragraphs.remove_repeated(empty).count() == 0
    p = " ".join(_words(90))
    names = "doc_id long, text string, key int, cuts string, digest long, td long, start int, n int"
    rows = [(i, p, i, f"c{i}", i, i, i, i) for i in range(3)]
    df = spark.createDataFrame(rows, names)
    out = paragraphs.remove_repeated(df)
    assert out.columns == df.columns
    got = sorted(out.collect())
    assert [tuple(r)[2:] for r in got] == [r[2:] for r in rows] and [bool(r["text"]) for r in got] == [True, False, False]
