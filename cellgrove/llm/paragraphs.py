"""Substring deduplication by paragraph: MinHash banding, exact Jaccard, components, removal.

Paragraphs are cut by content, over the words of the whole text; line breaks are blanks. A new paragraph
starts where the hash of a three-word window is the least within ``RADIUS`` words to either side, so cuts
recur wherever a passage does, whatever stands around it: a passage of over 50 words holds at least one
whole paragraph (about 13 words, 7 at least). Every word belongs to one paragraph.

A paragraph is posted under the bands of its minhash values; ``tune_bands`` picks them for the wanted recall
at the threshold. Colliding paragraphs are equal (then only counted) or are compared on their full sets of
five-word shingles (Jaccard of 0.75 or more, see ``neighbours``); components of similar paragraphs follow.
The first paragraph of a component, by document and position, stays; the others go. Paragraphs count only
in runs of neighbours of ``least_run`` words or more that occur again, so notices of a line stay alone; those
whose neighbours collide with nothing are left out before any are compared.

Null, empty and wordless texts and those below 7 words have no paragraphs. Very long texts are cut whole. Repeats within
one document count like repeats between documents. Rows are told apart by id and text: rows that repeat an
id with another text are documents of their own, rows that repeat both are one document. Rows without id are
passed over (they keep their text). Ids are whole numbers of any size up to 64 bits; others are refused. In
the candidate search paragraphs go by a digest of 64 bits, equal ones by 128. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StructType

from cellgrove.llm.common import arrow_rows, col, ship, stage, unused
from cellgrove.llm.neighbours import FIVE, LONGS, SKETCH, as_column, bloom, connect, minima, sketch
from cellgrove.llm.words import chunks, hash_words, mix, places

RADIUS, LEAST_RUN = 6, 20
LEAST_WORDS = RADIUS + 1
_BAND_BITS = np.uint64(15)  # the last bits of a token are the band's number
_THREE = np.random.default_rng(31).integers(1, 1 << 63, 3, dtype=np.uint64) | np.uint64(1)
_SEEN = 1 << 16


def tune_bands(threshold: float = 0.75, recall: float = 0.98, hashes: int = 12, longest: int = 2) -> tuple[int, int]:
    """(bands, rows): the longest bands, of at most longest rows, that still reach the recall at the threshold with so many hashes."""
    for rows in range(min(longest, hashes), 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            while bands > 1 and 1 - (1 - threshold**rows) ** (bands - 1) >= recall:
                bands -= 1
            return bands, rows
    return hashes, 1


def cut(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first word of every paragraph; text k has the words at[k] to at[k + 1]."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    ahead = np.concatenate([words, np.zeros(2, np.uint64)])
    f = mix(words * _THREE[0] + ahead[1 : n + 1] * _THREE[1] + ahead[2:] * _THREE[2])
    least = np.ones(n, bool)
    for k in range(1, RADIUS + 1):
        least[k:] &= f[k:] < f[:-k]
        least[:-k] &= f[:-k] <= f[k:]
    found = np.flatnonzero(least)
    text = np.searchsorted(at, found, "right") - 1
    # no cut whose window would reach beyond the text
    found = found[(found - at[text] > RADIUS) & (at[text + 1] - found > RADIUS + 2)]
    return np.union1d(at[:-1][np.diff(at) > 0], found)


class Paragraphs:
    """Those of some texts: text, start and n (in words), two digests each, and a digest of each text's words."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        first = cut(words, at)
        self.words, self.first = words, first
        self.n = np.diff(first, append=len(words))
        self.text = np.searchsorted(at, first, "right") - 1
        self.start = first - at[self.text]
        place = places(self.n).astype(np.uint64)
        total = [np.add.reduceat(mix(words + mix(place + np.uint64(1))), first), np.add.reduceat(mix(words ^ mix(place + np.uint64(1 << 40))), first)] if len(first) else [words, words]
        self.d1, self.d2 = (mix(x + self.n.astype(np.uint64)) for x in total)
        self.whole = np.zeros(len(at) - 1, np.uint64)
        np.add.at(self.whole, self.text, mix(self.d1 ^ mix(self.start.astype(np.uint64))))

    def shingles(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the five-word shingles of some paragraphs of at least 5 words, and where each one's begin."""
        counts = self.n[some] - 4
        i = np.repeat(self.first[some], counts) + places(counts)
        total = self.words[i] * FIVE[0]
        for j in range(1, 5):
            total += self.words[i + j] * FIVE[j]
        return mix(total), np.cumsum(counts) - counts


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    if not isinstance(docs.schema[id_col].dataType, ByteType | ShortType | IntegerType | LongType):
        raise TypeError(f"{id_col} must be a whole number, not {docs.schema[id_col].dataType.simpleString()}")
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = 5, rows: int = 2) -> DataFrame:
    """doc_id, td (digest of the text's words), start, n, d1, d2 and tokens (one per band) of every paragraph that is compared."""

    def run(b: pa.RecordBatch) -> pa.Table:
        out, names = [], ["doc_id", "td", "start", "n", "d1", "d2", "tokens"]
        ids = b.column("doc_id")
        for lo, hi, data, offsets in chunks(b.column("text")):
            words, _, _, at = hash_words(data, offsets)
            p = Paragraphs(words, at)
            some = np.flatnonzero(p.n >= LEAST_WORDS)
            values, begin = p.shingles(some)
            m = minima(values, begin, bands * rows).astype(np.uint64).reshape(len(some), bands, rows)
            token = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40), (len(some), bands))
            for j in range(rows):
                token = mix(token + m[:, :, j])
            token = (token & ~_BAND_BITS) | np.arange(bands, dtype=np.uint64)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * bands), len(some), [None, pa.py_buffer(np.ascontiguousarray(token))]).cast(pa.binary())
            text = p.text[some]
            out.append(pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(text)), _long(p.whole[text]), pa.array(p.start[some].astype(np.int32)), pa.array(p.n[some].astype(np.int32)), _long(p.d1[some]), _long(p.d2[some]), raw], names=names))
        return pa.Table.from_batches(out) if out else None

    return arrow_rows(_ids(docs, id_col, text_col).where("doc_id is not null"), run, "doc_id long, td long, start int, n int, d1 long, d2 long, tokens binary")


def _postings(found: DataFrame, bands: int) -> DataFrame:
    """(token, rep): every paragraph under its bands, rep its digest.

    A task posts a paragraph that it meets again only once more, in the first band, as a sign that it repeats; it
    remembers the last ``_SEEN`` paragraphs or so, which is what takes very common ones out of the shuffle.
    """
    ship(found.sparkSession)

    def run(batches):
        key, state = np.zeros(_SEEN, np.int64), np.zeros(_SEEN, np.int8)
        for b in batches:
            if not b.num_rows:
                continue
            rep, at, count = np.unique(b.column("d1").to_numpy(), return_index=True, return_counts=True)
            token = np.frombuffer(b"".join(b.column("tokens").take(pa.array(at)).to_pylist()), np.int64).reshape(len(rep), bands)
            slot = (rep & (_SEEN - 1)).astype(np.int64)
            known = np.where(key[slot] == rep, state[slot], 0)
            new, again = known == 0, (known < 2) & (known + count > 1)
            key[slot], state[slot] = rep, np.minimum(2, known + count)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([token[new].reshape(-1), token[again, 0]])), pa.array(np.concatenate([np.repeat(rep[new], bands), rep[again]]))], names=["token", "rep"])

    return found.select("d1", "tokens").mapInArrow(run, "token long, rep long")


def _lists(posted: DataFrame) -> DataFrame:
    """(token, rep, pivot): pivot is the least of a token's paragraphs; rep is another one under it, or, in the
    first band, the paragraph that occurs again itself is both. Lists are read as a sorted stream, never held."""
    ship(posted.sparkSession)

    def run(batches):
        last, pivot = None, np.zeros(1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            token, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            if last is None:
                same = np.concatenate([[False], token[1:] == token[:-1]])
                equal = same & np.concatenate([[False], rep[1:] == rep[:-1]])
            else:
                before = np.concatenate([[last[0]], token[:-1]]), np.concatenate([[last[1]], rep[:-1]])
                same = token == before[0]
                equal = same & (rep == before[1])
            starts = np.flatnonzero(~same)
            own = np.concatenate([pivot, rep[starts]])[np.cumsum(~same)]
            take = (same & ~equal & (rep != own)) | (equal & (token & int(_BAND_BITS) == 0))
            own_out = np.where(equal, rep, own)
            last, pivot = (token[-1], rep[-1]), own[-1:].copy()
            yield pa.RecordBatch.from_arrays([pa.array(token[take]), pa.array(rep[take]), pa.array(own_out[take])], names=["token", "rep", "pivot"])

    return posted.repartition("token").sortWithinPartitions("token", "rep").mapInArrow(run, "token long, rep long, pivot long")


def _full(docs: DataFrame, found: DataFrame, ends: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rep, n, sketch and set x of the paragraphs in ends. Only documents that hold one for the first time are cut again."""
    wanted = bloom(ends, "rep")

    def held(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(wanted(b.column("rep").to_numpy())))

    holders = arrow_rows(found.select(F.col("d1").alias("rep"), "doc_id"), held, "rep long, doc_id long").groupBy("rep").agg(F.min("doc_id").alias("doc_id"))
    holders = stage(holders.select("doc_id").distinct(), "paragraphs-holders")
    reading = bloom(holders, "doc_id")

    def run(b: pa.RecordBatch) -> pa.Table | None:
        b = b.filter(pa.array(reading(b.column("doc_id").to_numpy())))
        out = []
        for _, _, data, offsets in chunks(b.column("text")):
            words, _, _, at = hash_words(data, offsets)
            p = Paragraphs(words, at)
            some = np.flatnonzero((p.n >= LEAST_WORDS) & wanted(p.d1.view(np.int64)))
            values, begin = p.shingles(some)
            sets = [np.unique(x) for x in np.split(values, begin[1:])] if len(some) else []
            longs = sketch(minima(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])]), SKETCH)) if sets else np.zeros((0, len(LONGS)), np.int64)
            out.append(pa.RecordBatch.from_arrays([_long(p.d1[some]), pa.array([len(x) for x in sets], pa.int32()), *(pa.array(longs[:, j]) for j in range(len(LONGS))), as_column(sets)], names=["rep", "n", *LONGS, "x"]))
        return pa.Table.from_batches(out) if out else None

    rows = _ids(docs, id_col, text_col).where("doc_id is not null")
    schema = f"rep long, n int, {', '.join(f'{c} long' for c in LONGS)}, x array<long>"
    return arrow_rows(rows, run, schema).join(ends, "rep", "left_semi").dropDuplicates(["rep"])


def _in_runs(rows: DataFrame, least_run: int) -> DataFrame:
    """The rows (doc_id, td, start, n, ..) that lie in runs of neighbours of least_run words or more. A window holds one document's rows."""
    own = Window.partitionBy("doc_id", "td").orderBy("start")
    run = F.sum(F.when(F.lag(F.col("start") + F.col("n")).over(own) == F.col("start"), 0).otherwise(1)).over(own)
    words = F.sum("n").over(Window.partitionBy("doc_id", "td", "run"))
    return rows.withColumn("run", run).withColumn("run_words", words).where(F.col("run_words") >= least_run).drop("run", "run_words")


def _held(found: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """The paragraphs whose digest is among the names, once for each place; a filter thins them out before the shuffle."""
    some = bloom(names, name)

    def held(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(some(b.column("d1").to_numpy())))

    kept = ["doc_id", "td", "start", "n", "d1", "d2"]
    rows = arrow_rows(found.select(kept), held, "doc_id long, td long, start int, n int, d1 long, d2 long")
    return rows.join(names.select(F.col(name).alias("d1")), "d1", "left_semi")


def _members(lists: DataFrame) -> DataFrame:
    """(token, rep) of the lists with several paragraphs, pivots among them."""
    near = lists.where("rep <> pivot")
    return near.select("token", "rep").union(near.select("token", "pivot")).distinct()


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, recall: float = 0.98, least_run: int = LEAST_RUN) -> DataFrame:
    """Every paragraph that occurs again, alike or nearly: id, text_digest, start and length (in words), component_id, kept_in, removed.

    component_id names the component (a paragraph's digest), kept_in is the document of its first paragraph;
    text_digest tells rows of one id apart.
    """
    bands, rows = tune_bands(percent / 100, recall)
    found = stage(paragraphs(docs, id_col, text_col, bands, rows), "paragraphs")
    lists = stage(_lists(_postings(found, bands)), "paragraphs-lists")
    colliding = stage(lists.select("rep").union(_members(lists).select("rep")).distinct(), "paragraphs-colliding")
    # what stands alone, or beside paragraphs that collide with none, can never lie in a run that counts
    once = _held(found, colliding, "rep").repartition("doc_id", "td").groupBy("doc_id", "td", "start").agg(*[F.first(c).alias(c) for c in ("n", "d1", "d2")])
    touched = stage(_in_runs(once, least_run), "paragraphs-touched")
    able = stage(touched.select(F.col("d1").alias("rep")).distinct(), "paragraphs-able")
    members = stage(_members(lists).join(able, "rep", "left_semi"), "paragraphs-members")
    pivots = members.groupBy("token").agg(F.min("rep").alias("pivot"), F.count("*").alias("g")).where("g > 1").select("token", "pivot")
    shared = stage(members.join(pivots, "token").where("rep <> pivot").select("token", "rep", "pivot"), "paragraphs-shared")
    ends = stage(shared.select("rep").union(shared.select("pivot")).distinct(), "paragraphs-ends")
    full = stage(_full(docs, touched, ends, id_col, text_col), "paragraphs-sets")
    # the sketch only filters: 10 of 35 equal coordinates is over six deviations below 0.75
    comp = connect(shared, full.drop("x"), lambda reps: full.select("rep", "x").join(reps, "rep"), least=10, percent=percent, label="paragraphs")
    equal = lists.where("rep = pivot").select(F.col("rep").alias("node")).distinct()
    named = stage(equal.join(comp, "node", "full").select(F.col("node").alias("d1"), "component"), "paragraphs-named")
    again = touched.join(named, "d1").withColumn("other", F.when(F.col("component").isNull(), F.col("d2")).otherwise(F.lit(0)))
    again = stage(again.withColumn("component", F.coalesce("component", "d1")), "paragraphs-again")
    here = F.struct("doc_id", "td", "start")
    first = again.groupBy("component", "other").agg(F.count("*").alias("k"), F.min(here).alias("first")).where("k > 1").drop("k")
    out = _in_runs(again.join(stage(first, "paragraphs-first"), ["component", "other"]), least_run)
    return out.select(F.col("doc_id").alias(id_col), F.col("td").alias("text_digest"), "start", F.col("n").alias("length"), F.col("component").alias("component_id"), F.col("first.doc_id").alias("kept_in"), (here != F.col("first")).alias("removed"))


def _without(data: np.ndarray, begin: np.ndarray, end: np.ndarray, gone: list[tuple[int, int]]) -> str:
    """A text without some runs of words, each with the blanks behind it; at the text's end with those before it."""
    out, here = [], 0
    for start, n in sorted(gone):
        last = start + n >= len(begin)
        upto = (int(end[start - 1]) if start else 0) if last else int(begin[start])
        out.append(data[here : max(here, upto)].tobytes())
        here = len(data) if last else int(begin[start + n])
    return b"".join([*out, data[here:].tobytes()]).decode()


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents with every removed paragraph cut out of the text; all columns and rows stay.

    Only documents that may lose a paragraph, by a filter of their ids, are shuffled; the others pass through.
    """
    gone = repeated(docs, id_col, text_col, **params).where("removed")
    spans = F.collect_list(F.struct("start", "length"))  # a document's own paragraphs
    digest, key, cuts = unused(docs, "digest", "key", "cuts")
    gone = stage(gone.groupBy(col(id_col).cast("long").alias(key), F.col("text_digest").alias(digest)).agg(spans.alias(cuts)), "paragraphs-gone")
    touched = bloom(gone, key)

    def may_lose(ids: pa.Array) -> pa.Array:
        return pa.array(touched(ids.cast(pa.int64()).fill_null(-1).to_numpy()))

    place, at, width, names = docs.columns.index(id_col), docs.columns.index(text_col), len(docs.columns), list(docs.columns)

    def digested(b: pa.RecordBatch) -> pa.RecordBatch:
        b, whole = b.filter(may_lose(b.column(place))), [np.zeros(0, np.uint64)]
        for _, _, data, offsets in chunks(b.column(at)):
            words, _, _, first = hash_words(data, offsets)
            whole.append(Paragraphs(words, first).whole)
        return pa.RecordBatch.from_arrays([*b.columns, _long(np.concatenate(whole))], names=[*b.schema.names, digest])

    def shortened(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, lists = b.column(at).to_pylist(), b.column(width).to_pylist()
        for i, spans in enumerate(lists):
            if spans:
                raw = np.frombuffer(texts[i].encode(), np.uint8)
                _, begin, end, _ = hash_words(raw, np.array([0, len(raw)]))
                texts[i] = _without(raw, begin, end, [(s["start"], s["length"]) for s in spans])
        columns = list(b.columns[:width])
        columns[at] = pa.array(texts, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    # one Python worker a task: the filter runs within each branch's own function, and a sort-merge join parts the two of the second branch
    others = docs.where(~F.arrow_udf(may_lose, "boolean")(col(id_col)))
    marked = arrow_rows(docs, digested, StructType([*docs.schema.fields]).add(digest, "long"))
    joined = marked.join(gone.hint("merge"), (marked[digest] == gone[digest]) & (col(id_col).cast("long") == gone[key]), "left").select(*[marked[f"`{c}`"] for c in docs.columns], gone[cuts])
    return others.union(arrow_rows(joined, shortened, docs.schema))
