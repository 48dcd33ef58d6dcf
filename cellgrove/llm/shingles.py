"""MinHash near-duplicates by an inverted join of signature coordinates.

A document's set is its distinct five-word shingles, hashed to 64 bits; documents with equal sets are one
class. A class is posted under (coordinate, value) pairs of its minhash signature. By the pigeonhole
principle two signatures with at least ``least`` equal coordinates of ``SKETCH`` meet in the first
``SKETCH - least + 1`` postings of both under any common order, so only this prefix is posted; the order is
rarest first, by hashed counts of a fixed size, which keeps very common passages out of the prefixes.
Collisions give candidates (see ``neighbours``), links are confirmed on the full sets.

A pair at the similarity 0.75 is missed if fewer than ``least`` = 15 of 35 coordinates agree: about 3 in
100,000, fewer above. Null, empty and wordless texts have an empty set and link with nothing. Long texts are
hashed whole. Repeated rows are equal documents. Null ids stay alone. Ids are whole numbers; others are
refused. Rows that repeat an id with different texts are documents of their own: each has the smallest id that its
own text reaches. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from cellgrove.llm.common import arrow_rows, col, named, ship, smallest_ids, stage
from cellgrove.llm.neighbours import LONGS, SKETCH, as_column, bloom, connect, minima, shingles, sketch
from cellgrove.llm.words import chunks, hash_words, mix, word_hashes

LEAST, BUCKETS = 15, 1 << 20


def shingle_set(text: str) -> np.ndarray:
    return shingles(word_hashes(text.encode("utf-8", "replace")))


def _sets(column: pa.Array):
    """The shingle sets of some texts at a time: first row, sets."""
    for lo, _, data, offsets in chunks(column):
        words, _, _, at = hash_words(data, offsets)
        yield lo, [shingles(words[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    if not isinstance(docs.schema[id_col].dataType, ByteType | ShortType | IntegerType | LongType):
        raise TypeError(f"{id_col} must be a whole number, not {docs.schema[id_col].dataType.simpleString()}")
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"), F.xxhash64(col(text_col)).alias("h"))


def _digests(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Two longs for each of some sets of hashes, (2, sets); begin has no empty ones."""
    if not len(begin):
        return np.zeros((2, 0), np.int64)
    return np.stack([np.add.reduceat(mix(x), begin).view(np.int64) for x in (flat ^ np.uint64(1), flat + np.uint64(7))])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), n (set size), d1 and d2 (digest of the set), m (minima as bytes) and the sketch s0.."""

    def run(b: pa.RecordBatch) -> pa.Table | None:
        out = []
        for lo, sets in _sets(b.column("text")):
            n = np.array([len(x) for x in sets], np.int64)
            some = np.flatnonzero(n)
            flat = np.concatenate([sets[i] for i in some]) if len(some) else np.zeros(0, np.uint64)
            begin = np.cumsum(n[some]) - n[some]
            rows, digests = np.full((len(n), SKETCH), np.iinfo(np.uint32).max, np.uint32), np.zeros((2, len(n)), np.int64)
            rows[some] = minima(flat, begin)
            digests[:, some] = _digests(flat, begin)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * SKETCH), len(n), [None, pa.py_buffer(rows.astype("<u4"))]).cast(pa.binary())
            longs = sketch(rows)
            columns = [b.column("doc_id").slice(lo, len(n)), b.column("h").slice(lo, len(n)), pa.array(n.astype(np.int32)), *map(pa.array, digests), raw, *(pa.array(longs[:, j]) for j in range(len(LONGS)))]
            out.append(pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n", "d1", "d2", "m", *LONGS]))
        return pa.Table.from_batches(out) if out else None

    return arrow_rows(_ids(docs, id_col, text_col), run, f"doc_id long, h long, n int, d1 long, d2 long, m binary, {', '.join(f'{c} long' for c in LONGS)}")


def sets_of(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str):
    """A function that adds x, the full shingle set of rep, to a table; classes: (rep, first, d1, d2) tells which document has them."""

    def sets(reps: DataFrame) -> DataFrame:
        asked = stage(classes.select("rep", "first", "d1", "d2").join(reps, "rep"), "shingles-asked")
        wanted, digests = bloom(asked, "first"), bloom(asked, "d1")

        def run(b: pa.RecordBatch) -> pa.Table | None:
            b = b.filter(pa.array(wanted(b.column("first").to_numpy())))
            out = []
            for lo, x in _sets(b.column("text")):
                n = np.array([len(y) for y in x], np.int64)
                some = np.flatnonzero(n)
                d = _digests(np.concatenate([x[i] for i in some]) if len(some) else np.zeros(0, np.uint64), np.cumsum(n[some]) - n[some])
                take = digests(d[0])
                some, d = some[take], d[:, take]
                out.append(pa.RecordBatch.from_arrays([b.column("first").take(pa.array(lo + some)), *map(pa.array, d), as_column([x[i] for i in some])], names=["first", "d1", "d2", "x"]))
            return pa.Table.from_batches(out) if out else None

        rows = _ids(docs, id_col, text_col).select(F.col("doc_id").alias("first"), "text").where("first is not null")
        found = arrow_rows(rows, run, "first long, d1 long, d2 long, x array<long>")
        # one shuffle of the sets: the join finds them by the keys that they were made distinct by
        return found.dropDuplicates(["first", "d1", "d2"]).join(asked, ["first", "d1", "d2"]).drop("first", "d1", "d2")

    return sets


def _tokens(b: pa.RecordBatch) -> np.ndarray:
    """64-bit tokens (rows, SKETCH) of (coordinate, value)."""
    m = np.frombuffer(b"".join(b.column("m").to_pylist()), "<u4").reshape(b.num_rows, SKETCH).astype(np.uint64)
    return mix(m + (np.arange(1, SKETCH + 1, dtype=np.uint64) << np.uint64(40)))


def rarity(reps: DataFrame) -> np.ndarray:
    """How often tokens occur, by hash: BUCKETS counts."""
    ship(reps.sparkSession)

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount((_tokens(b) % np.uint64(BUCKETS)).astype(np.int64).reshape(-1), minlength=BUCKETS)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + 65536]), pa.array(total[at[lo : lo + 65536]])], names=["bucket", "c"])

    # buckets that hold a common pair: at most BUCKETS rows of two numbers, whatever the table's size
    table = reps.select("m").mapInArrow(count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).where("c > 3").toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[table.column("bucket").to_numpy()] = table.column("c").to_numpy()
    return counts


def postings(reps: DataFrame, counts: np.ndarray, least: int = LEAST, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(token, rep): the SKETCH - least + 1 rarest coordinate-value pairs of every class, or those of them that are wanted."""
    shared = reps.sparkSession.sparkContext.broadcast(counts)  # BUCKETS longs

    def prefix(b: pa.RecordBatch) -> pa.RecordBatch:
        t = _tokens(b)
        c = shared.value[(t % np.uint64(BUCKETS)).astype(np.int64)]
        order = np.lexsort((t, c), axis=1)[:, : SKETCH - least + 1]
        first = np.take_along_axis(t, order, axis=1).astype(np.int64)
        token, rep = first.reshape(-1), np.repeat(b.column("rep").to_numpy(), first.shape[1])
        if wanted is not None:
            some = wanted(token)
            token, rep = token[some], rep[some]
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(rep)], names=["token", "rep"])

    return arrow_rows(reps.select("rep", "m"), prefix, "token long, rep long")


def lists(reps: DataFrame, least: int = LEAST) -> DataFrame:
    """(token, rep, pivot): the classes under every token that several share; the least, the pivot, apart.

    Counts per token come first, from partial counts; only postings whose token may be shared are then shuffled.
    """
    counts = rarity(reps)
    firsts = postings(reps, counts, least).groupBy("token").agg(F.min("rep").alias("pivot"), F.count("*").alias("g"))
    firsts = stage(firsts.where("g > 1").select("token", "pivot"), "shingles-firsts")
    some = postings(reps, counts, least, bloom(firsts, "token"))
    return stage(some.join(firsts, "token").where("rep <> pivot").select("token", "rep", "pivot"), "shingles-lists")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, least: int = LEAST, hashed: str | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), kept.

    hashed: name of a further column with xxhash64 of the text, which tells rows of one id apart.
    """
    docs_sig = stage(signatures(docs, id_col, text_col), "shingles-signatures")
    some = docs_sig.where("n > 0 and doc_id is not null")
    classes = some.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("first"), F.min("m").alias("m"), *[F.min(c).alias(c) for c in LONGS])
    reps, repeated = named(stage(classes, "shingles-classes"), "first", "shingles-named")
    items = reps.select("rep", "n", *LONGS)
    comp = connect(lists(reps, least), items, sets_of(docs, reps, id_col, text_col), least, percent, label="shingles")
    comp = smallest_ids(comp, reps, "first", repeated)
    classes = reps.join(comp, reps["rep"] == comp["node"], "left").select("d1", "d2", "n", F.coalesce("component", "first").alias("component"))
    classes = stage(classes, "shingles-result")
    out = docs_sig.join(classes, ["d1", "d2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    extra = [F.col("h").alias(hashed)] if hashed else []
    return out.select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *extra)
