"""Near-duplicate operators against brute force: documents, vectors, paragraphs, components."""

import random

import numpy as np
from pyspark.sql import functions as F

from cellgrove.llm import neighbours, paragraphs, shingles, vectors
from cellgrove.llm.components import components
from cellgrove.llm.words import mix, word_hashes


def _roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def _near(docs):
    sets = {i: _set(t) for i, t in docs}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                links.append((a, b))
    return sets, _roots(ids, links)


def _edited(rng, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return " ".join(out)


def test_spread_group_of_near_copies(spark):
    """Copies whose similarity to each other lies on both sides of the threshold, a passage that many share, exact copies."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(140)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    docs = [(i, _edited(rng, base, rng.choice([0, 1, 2, 3, 4, 6, 8, 10]), vocabulary)) for i in range(160)]
    docs += [(i, " ".join(rng.choice(vocabulary) for _ in range(80)) + " " + shared) for i in range(160, 240)]
    docs += [(i, docs[i % 7][1].upper()) for i in range(240, 260)]
    docs += [(300, None), (301, ""), (302, " \n "), (303, "One two"), (304, "one  TWO"), (305, "x" * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("token", F.lit(1)).withColumn("rep", F.lit(2))
    got = {r["doc_id"]: r for r in shingles.near_duplicates(df).collect()}
    sets, roots = _near(docs)
    assert {i: r["component_id"] for i, r in got.items()} == roots
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (roots[i] == i) for i in got)


def test_small_blocks_give_the_same_components(spark):
    """Long lists dealt out as pairs of tiny blocks."""
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    docs = [(i, _edited(rng, base, rng.choice([3, 5, 7, 9]), vocabulary)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sig = shingles.signatures(df).cache()
    items = sig.select(F.col("doc_id").alias("rep"), "n", *[f"s{i}" for i in range(5)])
    posted = shingles.lists(sig.withColumnRenamed("doc_id", "rep"))
    comp = neighbours.connect(posted, items, shingles.sets_of(df, sig.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("first"), "d1", "d2"), "doc_id", "text"), shingles.LEAST, block=8)
    _, roots = _near(docs)
    found = {i: i for i in roots} | {r["node"]: r["component"] for r in comp.collect()}
    assert found == roots


def test_empty_documents_table(spark):
    assert shingles.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_intersections_are_exact():
    rng = np.random.default_rng(1)
    left = [np.unique(rng.integers(0, 300, rng.integers(1, 90))) for _ in range(7)]
    right = [np.unique(rng.integers(0, 300, rng.integers(1, 90))) for _ in range(5)]
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert (neighbours._intersections(left, right, width=16) == np.array(want)).all()


def test_sketch_matches_equal_plain_counts(spark):
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 3, (50, 35)).astype(np.uint32) for _ in range(2))
    sa, sb = neighbours.sketch(a), neighbours.sketch(b)
    df = spark.createDataFrame([(*map(int, x), *map(int, y)) for x, y in zip(sa, sb, strict=True)], [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(5)])
    got = [r[0] for r in df.select(neighbours.matches([F.col(f"a{i}") for i in range(5)], [F.col(f"b{i}") for i in range(5)])).collect()]
    assert got == (a == b).sum(axis=1).tolist() == np.diag(neighbours._np_matches(sa, sb)).tolist()


def test_components_of_paths_stars_and_nulls(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    want = _roots({x for p in links for x in p if x is not None}, [p for p in links if None not in p])
    for parts in (1, 3, 9):
        got = components(spark.createDataFrame(links, "a long, b long").repartition(parts)).collect()
        assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forests_may_be_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr("cellgrove.llm.components._HELD", 5)
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == _roots({x for p in links for x in p if p[0] != p[1]}, links)


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(240):
        v = base[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3, 0.5])
        rows.append((i, [float(x) for x in v]))
    rows += [(240 + i, rows[i][1]) for i in range(20)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] + [1.0] * 15), (303, [None] + [1.0] * 15), (304, []), (305, [1.0, 0.0]), (306, [2.0, 0.0]), (307, [1e300] * 16), (308, [1e-300] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df, recall=0.99999, bucket=40, block=64).collect()}
    ok = {i: np.array(v) / np.abs(v).max() for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.9]
    roots = _roots([i for i, _ in rows], links)
    degree = {i: sum(i in p for p in links) for i, _ in rows}
    right = sum(got[i]["n_links"] == degree[i] for i in degree)
    assert all(got[i]["n_links"] <= degree[i] for i in degree) and right >= 0.98 * len(degree)
    assert {i: r["component_id"] for i, r in got.items()} == roots


def test_bands_reach_the_recall():
    bands, rows = paragraphs.tune_bands()
    assert 1 - (1 - 0.75**rows) ** bands >= 0.98 and bands * rows <= 12


def _passages():
    rng = random.Random(6)
    vocabulary = [f"p{i}" for i in range(5000)]

    def line(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    common, other = line(60), line(55)
    docs = []
    for i in range(40):
        lines = [line(rng.randrange(22, 60)) for _ in range(4)]
        if i % 4 == 0:
            lines.insert(2, common)
        if i % 5 == 0:
            lines.insert(1, _edited(rng, other.split(), 1, vocabulary))
        if i % 3 == 0:
            lines.append("short line that repeats")
        docs.append((i, "\n".join(lines)))
    docs += [(40, None), (41, ""), (42, common + "\n" + common), (43, line(30000))]
    return docs


def _cut(words, radius=paragraphs.RADIUS):
    """The paragraphs of a text by the definition: start, words."""
    w = words_of(words)
    f = [int(mix(np.array([sum(int(a) * int(b) for a, b in zip(paragraphs._THREE, [*w[i : i + 3], 0, 0][:3], strict=True)) % (1 << 64)], np.uint64))[0]) for i in range(len(w))]
    cuts = [0]
    for i in range(radius + 1, len(w) - radius - 2):
        if all(f[i] < f[i - k] for k in range(1, radius + 1)) and all(f[i] <= f[i + k] for k in range(1, radius + 1)):
            cuts.append(i)
    return [(a, words[a:b]) for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True) if b - a >= radius + 1]


def words_of(words):
    return word_hashes(" ".join(words).encode())


def _in_runs(keys, units):
    """The keys (document, start) that lie in runs of neighbours of LEAST_RUN words or more."""
    out, run = set(), []
    for k in [*sorted(keys), None]:
        if run and (k is None or k[0] != run[-1][0] or k[1] != run[-1][1] + len(units[run[-1]])):
            if sum(len(units[x]) for x in run) >= paragraphs.LEAST_RUN:
                out |= set(run)
            run = []
        run.append(k)
    return out


def test_repeated_paragraphs_against_all_pairs(spark):
    docs = _passages()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    units = {(i, start): tuple(w) for i, t in docs for start, w in _cut((t or "").split())}
    rows = paragraphs.paragraphs(df).collect()
    assert {(r["doc_id"], r["start"], r["n"]) for r in rows} == {(*k, len(w)) for k, w in units.items()}
    posted = {}
    for r in rows:
        for k in range(0, len(r["tokens"]), 8):
            posted.setdefault(r["tokens"][k : k + 8], []).append((r["doc_id"], r["start"]))
    touched = _in_runs({x for ks in posted.values() if len(ks) > 1 for x in ks}, units)
    sets = {k: _set(" ".join(units[k])) for k in touched}
    index = {}
    for k, x in sets.items():
        for g in x:
            index.setdefault(g, []).append(k)
    pairs = {(min(a, b), max(a, b)) for ks in index.values() for a in ks for b in ks if a != b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    roots = _roots(touched, links)
    members = {}
    for k, r in roots.items():
        members.setdefault(r, []).append(k)
    out = _in_runs({k for k, r in roots.items() if len(members[r]) > 1}, units)
    want = {(*k, len(units[k]), roots[k][0], k != roots[k]) for k in out}
    got = {(r["doc_id"], r["start"], r["length"], r["kept_in"], r["removed"]) for r in paragraphs.repeated(df).collect()}
    assert got == want and len(want) > 40


def test_removal_cuts_only_the_repeats(spark):
    docs = _passages()
    df = spark.createDataFrame([(i, t, i * 2) for i, t in docs], "doc_id long, text string, line int")
    gone = {}
    for r in paragraphs.repeated(df).where("removed").collect():
        gone.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["length"]))
    out = {r["doc_id"]: r["text"] for r in paragraphs.remove_repeated(df).collect()}
    for i, t in docs:
        if i not in gone:
            assert out[i] == t
        else:
            assert out[i].split() == [w for k, w in enumerate(t.split()) if k not in gone[i]]
    assert paragraphs.remove_repeated(df).columns == df.columns


def test_filter_passes_its_ids_and_few_others(spark):
    rng = np.random.default_rng(8)
    ids = rng.integers(-(1 << 62), 1 << 62, 5000)
    df = spark.createDataFrame([(int(i),) for i in ids] + [(None,)], "x long").repartition(3)
    test = neighbours.bloom(df, "x")
    assert test(ids).all() and test(rng.integers(-(1 << 62), 1 << 62, 5000)).sum() <= 5
    assert not neighbours.bloom(df.limit(0), "x")(ids).any() and len(test(ids[:0])) == 0
