"""The pipeline on a small fixture: every stage against brute force or what was planted."""

import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from cellgrove.llm import packing, paragraphs  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents():
    rng = random.Random(12)
    parts = {"en": ["the", "and", "ing", "ou", "st"], "de": ["ung", "sch", "ein", "ver", "ü"]}

    def words(lang, n):
        return ["".join(rng.choice(parts[lang]) for _ in range(rng.randrange(2, 5))) for _ in range(n)]

    passage = " ".join(words("en", 60))
    rows, labels = [], []
    for i in range(300):
        lang = "en" if i % 3 else "de"
        lines = [" ".join(words(lang, rng.randrange(25, 60))) for _ in range(3)]
        if i % 10 == 0:
            lines.insert(1, passage)
        good = i % 7 != 3
        if not good:
            lines = [" ".join(w.upper() + "!!" for w in words(lang, 90))]
        rows.append([i, "\n".join(lines), lang])
        if i % 2:
            labels.append((i, int(good)))
    good = [r for r in rows if r[0] % 7 != 3]
    for k in range(20):  # near copies of good documents
        source = good[10 * k]
        w = source[1].split(" ")
        w[k % len(w)] = "changed"
        rows.append([300 + k, " ".join(w), source[2]])
    rows += [[400, None, None], [401, "", "en"], [402, "12 34 ..", None]]
    return [(i, t, lang, f"s{i % 3}", None if t is None else len(t)) for i, t, lang in rows], labels


def _near(a, b):
    def shingle(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    x, y = shingle(a), shingle(b)
    return 100 * len(x & y) >= 75 * len(x | y)


def test_stages(spark, tmp_path):
    rows, labels = _documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, work) in enumerate(corpus_pipeline.STAGES):
        docs = work(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert docs.columns == COLUMNS
        kept.append(docs.collect())
    language, quality, near, passages, packed = ({r["doc_id"]: r for r in x} for x in kept)
    original = {r[0]: r for r in rows}
    assert set(language) == set(original) - {400, 401, 402}
    bad = {i for i in range(300) if i % 7 == 3}
    assert len(bad & set(quality)) <= 2 and len(set(language) - bad - set(quality)) <= 2
    ids = sorted(quality)
    root = {i: i for i in ids}
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if _near(quality[a]["text"], quality[b]["text"]):
                root = {k: root[a] if v == root[b] else v for k, v in root.items()}
    assert set(near) == {min(k for k, v in root.items() if v == r) for r in set(root.values())}
    assert set(passages) == set(near)
    gone: dict[int, set[int]] = {}
    for r in paragraphs.repeated(spark.createDataFrame(list(near.values()))).where("removed").collect():
        gone.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["length"]))
    holders = [i for i in sorted(near) if i < 300 and i % 10 == 0]
    assert len(set(holders[1:]) & set(gone)) >= 0.9 * len(holders[1:]) and holders[0] not in gone
    for i in near:
        assert passages[i]["text"].split() == [w for k, w in enumerate(near[i]["text"].split()) if k not in gone.get(i, ())]
        assert passages[i]["n_chars"] == len(passages[i]["text"]) and (i in gone or passages[i]["text"] == near[i]["text"])
    encoded = dict(zip(sorted(passages), packing.encode([passages[i]["text"] for i in sorted(passages)], P.path("word_bpe_49k.json")), strict=True))
    total = {}
    for r in kept[4]:
        ids_ = np.frombuffer(encoded[r["doc_id"]] + b"\0\0\0\0", "<u4")[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(ids_.tobytes())
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: len(b) // 4 + 1 for i, b in encoded.items()} and set(packed) == set(passages)
