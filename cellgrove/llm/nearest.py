"""Approximate nearest neighbours by largest inner product: cross-polytope hashing, multiprobe tables, exact scores.

A vector's direction is turned by fast pseudo-rotations (three rounds of random signs and a Hadamard transform) and
falls to the nearest signed axis; a bucket is the axes of one or more rotations, and the vector's band of norms (a
factor of 1.41 wide), as long vectors win inner products. Every vector is in one bucket of each of ``tables`` tables. A query visits
in each table the ``probes`` buckets of the largest estimates: the band's norm times the sum of its coordinates on the
axes. Candidates found there are scored exactly, a bucket at a time; large buckets are dealt out as pairs of
blocks, and no pairs leave a task but the best ones of each query.

``probes`` is fitted: for at most ``sample`` query vectors (those with the smallest digests) the true neighbours are found among all
rows, and the least number of probes is taken with which ``recall`` of them share a visited bucket. If even ``MOST``
probes do not reach it, buckets are made coarser, down to one rotation, where the probes may be all buckets. Queries that
find fewer than k neighbours, where more exist, are compared with all rows in blocks.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows whose id is null;
vectors are compared with those of their own length. Equal vectors are one query, and of equal candidates the k + 1
smallest ids are kept, as no query can need more. Ties go to the smaller id. A row that repeats another one wholly counts once; an id
that stands for several vectors is found once, at its best score, and never by a query of the same id; as a query it asks with each vector. Ids are
whole numbers; others are refused. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, FloatType, IntegerType, LongType, ShortType

from cellgrove.llm.common import arrow_rows, by_group, col, give_back, partitions, ship, stage

#: the most probes a table, where a bucket is the axes of several rotations
MOST = 4096
_AT = ["tbl", "dim", "band", "bucket"]


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a list column by length: row numbers and a matrix; rows with null, non-finite or no components left out."""
    x = column.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    lengths, begin = np.asarray(column.value_lengths().fill_null(0)), column.offsets.to_numpy()[:-1]
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        m = x[begin[rows][:, None] + np.arange(dim)]
        whole = np.isfinite(m).all(axis=1)
        yield rows[whole], m[whole]


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and base-2 logarithms of norms of rows that are not zero."""
    top = np.abs(m).max(axis=1, keepdims=True)
    v = m / top
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / norm, (np.log2(top) + np.log2(norm))[:, 0]


def _hadamard(y: np.ndarray) -> np.ndarray:
    n, size, step = len(y), y.shape[1], 1
    while step < size:
        y = y.reshape(n, size // (2 * step), 2, step)
        y = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2)
        step *= 2
    return y.reshape(n, size) / math.sqrt(size)


def rotated(v: np.ndarray, table: int, turn: int) -> np.ndarray:
    """Rows v, padded with zeros to a power of two, under one pseudo-rotation."""
    n, dim = v.shape
    size = 1 << max(0, (dim - 1).bit_length())
    y = np.zeros((n, size))
    y[:, :dim] = v
    for signs in np.random.default_rng([11, dim, table, turn]).choice([-1.0, 1.0], (3, size)):
        y = _hadamard(y * signs)
    return y


def axes_for(dim: int, rotations: int, rows: int, bucket: int) -> list[int]:
    """How many axes each rotation tells apart: all, but the last of several only what rows need."""
    size = 1 << max(0, (dim - 1).bit_length())
    if rotations == 1:
        return [size]
    rest = rows / bucket / (2 * size) ** (rotations - 1)
    return [size] * (rotations - 1) + [min(size, 1 << max(0, math.ceil(math.log2(max(1.0, rest / 2)))))]


def buckets_of(v: np.ndarray, table: int, axes: list[int]) -> np.ndarray:
    out = np.zeros(len(v), np.int64)
    for turn, width in enumerate(axes):
        y = rotated(v, table, turn)[:, :width]
        k = np.abs(y).argmax(axis=1)
        out = out * (2 * width) + 2 * k + (y[np.arange(len(y)), k] < 0)
    return out


def probes_of(v: np.ndarray, table: int, axes: list[int], bands: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(bands, buckets), best first, that each query visits in a table: two arrays (queries, at most probes)."""
    score, bucket = np.zeros((len(v), 1)), np.zeros((len(v), 1), np.int64)
    for turn, width in enumerate(axes):
        y = rotated(v, table, turn)[:, :width]
        s = np.stack([y, -y], axis=2).reshape(len(v), -1)
        near = np.argsort(-s, axis=1, kind="stable")[:, :probes]
        s = np.take_along_axis(s, near, axis=1)
        # the best sums of two falling rows stand where the product of their places is small
        i, j = np.nonzero(np.outer(np.arange(1, score.shape[1] + 1), np.arange(1, s.shape[1] + 1)) <= probes)
        score, bucket = score[:, i] + s[:, j], bucket[:, i] * (2 * width) + near[:, j]
        best = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        score, bucket = np.take_along_axis(score, best, axis=1), np.take_along_axis(bucket, best, axis=1)
    ratio = np.exp2((bands - bands.max()) / 2.0)
    every = (ratio[None, :, None] * score[:, None, :]).reshape(len(v), -1)
    best = np.argsort(-every, axis=1, kind="stable")[:, :probes]
    return bands[best // score.shape[1]], np.take_along_axis(bucket, best % score.shape[1], axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, one by one: summed in the order of the components, so equal rows have equal products."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def best_of(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k rows of the largest inner product, ties to smaller ids: (query, row, score), sorted."""
    near = queries @ rows.T
    at_least = np.full((len(queries), 1), -np.inf)
    if near.shape[1] > k:
        # the matrix product may differ in its last bits: rows that close to the k-th are kept for the exact scores
        slack = 1e-12 * np.abs(queries).sum(axis=1, keepdims=True) * np.abs(rows).max()
        at_least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k][:, None] - slack
    q, r = np.nonzero(near >= at_least)
    score = exact(queries[q], rows[r])
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    some = place < k
    return q[some], r[some], score[some]


def _rows(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """vec_id, query, h1, h2 (digest), dim, band, v (packed components) of the rows that take part, and how v is packed."""
    if not isinstance(vectors.schema[id_col].dataType, ByteType | ShortType | IntegerType | LongType):
        raise TypeError(f"{id_col} must be a whole number, not {vectors.schema[id_col].dataType.simpleString()}")
    kind = vectors.schema[vector_col].dataType
    pack, cast = ("<f4", "array<float>") if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else ("<f8", "array<double>")

    def run(b: pa.RecordBatch) -> pa.Table | None:
        out = []
        for rows, m in matrices(b.column("v")):
            some = m.any(axis=1)
            rows, m = rows[some], m[some]
            if not len(rows):
                continue
            raw = [r.tobytes() for r in m.astype(pack)]
            digest = np.frombuffer(b"".join(hashlib.blake2b(r, digest_size=16).digest() for r in raw), "<i8").reshape(-1, 2)
            band = np.floor(2 * _unit(m.astype(np.float64))[1] + 0.5).astype(np.int32)
            at = pa.array(rows)
            columns = [b.column("vec_id").take(at), b.column("query").take(at), *(pa.array(np.ascontiguousarray(digest[:, i])) for i in (0, 1)), pa.array(np.full(len(rows), m.shape[1], np.int32)), pa.array(band), pa.array(raw, pa.binary())]
            out.append(pa.RecordBatch.from_arrays(columns, names=["vec_id", "query", "h1", "h2", "dim", "band", "v"]))
        return pa.Table.from_batches(out) if out else None

    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"), col(vector_col).cast(cast).alias("v")).where("vec_id is not null")
    return stage(arrow_rows(rows, run, "vec_id long, query boolean, h1 long, h2 long, dim int, band int, v binary").dropDuplicates(["vec_id", "h1", "h2"]), "nearest-rows"), pack


def _by_dim(t: pa.Table | pa.RecordBatch, pack: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of one length at a time: the length, row numbers and a matrix of doubles."""
    dims, raw = t.column("dim").to_numpy(), t.column("v").to_pylist()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, np.frombuffer(b"".join(raw[i] for i in at), pack).reshape(len(at), dim).astype(np.float64)


def _true_neighbours(sampled: pa.Table, cands: DataFrame, pack: str, k: int) -> pa.Table:
    """(s, dim, band, v) of the k true neighbours of each sampled query s, from all candidates."""
    spark = cands.sparkSession
    ship(spark)
    queries = {dim: (at, m) for dim, at, m in _by_dim(sampled, pack)}
    shared = spark.sparkContext.broadcast(queries)  # at most the sample

    def run(batches):
        best = {}
        for b in batches:
            for dim, at, m in _by_dim(b, pack):
                if dim in shared.value:
                    ids = b.column("vec_id").to_numpy()[at]
                    q, r, score = best_of(shared.value[dim][1], m, ids, k)
                    new = pa.table({"s": shared.value[dim][0][q], "score": score, "vec_id": ids[r], "dim": np.full(len(q), dim, np.int32), "band": b.column("band").to_numpy()[at][r], "v": b.column("v").take(pa.array(at[r]))})
                    t = pa.concat_tables([best[dim], new]).combine_chunks() if dim in best else new
                    s, order = t.column("s").to_numpy(), np.lexsort((t.column("vec_id").to_numpy(), -t.column("score").to_numpy(), t.column("s").to_numpy()))
                    best[dim] = t.take(pa.array(order[np.arange(len(s)) - np.searchsorted(s[order], s[order]) < k]))
        for t in best.values():
            yield from t.to_batches()
        give_back()

    found = cands.select("vec_id", "dim", "band", "v").mapInArrow(run, "s long, score double, vec_id long, dim int, band int, v binary")
    place = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("s", "dim", "band", "v").toArrow()  # k rows for each of the sample


def _fit(sampled: pa.Table, truth: pa.Table, pack: str, bands: dict[int, np.ndarray], counts: dict[int, int], tables: int, bucket: int, recall: float) -> tuple[dict[int, list[int]], int]:
    """Axes of each length's rotations and the number of probes that reach the recall on the sample."""
    queries, near = {d: (at, m) for d, at, m in _by_dim(sampled, pack)}, list(_by_dim(truth, pack))

    def rotations(dim: int, most: int) -> int:
        size = 2 << max(0, (dim - 1).bit_length())
        return min(most, max(1, math.ceil(math.log(max(1.0, counts[dim] / bucket)) / math.log(size))))

    most = max((rotations(d, 64) for d in counts), default=1)
    while True:
        axes = {d: axes_for(d, rotations(d, most), n, bucket) for d, n in counts.items()}
        # of one rotation all buckets may be visited
        limit = MOST if most > 1 else max([2 * len(bands[d]) * sum(a) for d, a in axes.items()], default=1)
        ranks = [np.zeros(0)]
        for dim, at, m in near:
            asked, q = queries[dim]
            ask = np.searchsorted(asked, truth.column("s").to_numpy()[at])
            band = truth.column("band").to_numpy()[at]
            rank = np.full(len(at), np.inf)
            unit, turned = _unit(m)[0], _unit(q)[0]
            for t in range(tables):
                b, k = probes_of(turned, t, axes[dim], bands[dim], limit)
                own = buckets_of(unit, t, axes[dim])
                for lo in range(0, len(at), 256):
                    some = slice(lo, lo + 256)
                    hit = (k[ask[some]] == own[some, None]) & (b[ask[some]] == band[some, None])
                    rank[some] = np.minimum(rank[some], np.where(hit.any(axis=1), hit.argmax(axis=1), np.inf))
            ranks.append(rank)
        rank = np.sort(np.concatenate(ranks))
        need = math.ceil(recall * len(rank))
        if not len(rank):
            return axes, 1
        if most == 1 or np.isfinite(rank[need - 1]):
            return axes, int(rank[need - 1]) + 1
        most -= 1


def _meet(cands: DataFrame, queries: DataFrame, pack: str, k: int, block: int) -> DataFrame:
    """h1, h2, vec_id, score: the k best candidates of each query in each bucket that both are in (or each pair of its blocks)."""
    c = cands.select(*_AT, F.lit(0).alias("side"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "vec_id", "v")
    q = queries.select(*_AT, F.lit(1).alias("side"), "h1", "h2", F.lit(0).cast("long").alias("vec_id"), "v")
    sizes = c.select(*_AT, "side").union(q.select(*_AT, "side")).groupBy(*_AT).agg(F.count_if(F.col("side") == 0).alias("nc"), F.count_if(F.col("side") == 1).alias("nq"))
    # only buckets that hold both; large ones in blocks of either side
    cut = stage(sizes.where("nc > 0 and nq > 0").select(*_AT, F.ceil(F.col("nc") / block).cast("int").alias("nc"), F.ceil(F.col("nq") / block).cast("int").alias("nq")), "nearest-buckets")
    c, q = c.join(cut, _AT), q.join(cut, _AT)
    own_c, own_q = F.pmod(F.xxhash64("vec_id"), F.col("nc")).cast("int"), F.pmod(F.col("h1"), F.col("nq")).cast("int")
    c = c.select(*_AT, own_c.alias("i"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("j"), "side", "h1", "h2", "vec_id", "v")
    q = q.select(*_AT, F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("i"), own_q.alias("j"), "side", "h1", "h2", "vec_id", "v")

    def run(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
        side, ids, h1, h2, dims = (t.column(x).to_numpy() for x in ("side", "vec_id", "h1", "h2", "dim"))
        raw, out = t.column("v").to_pylist(), [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            m = np.frombuffer(b"".join(raw[a:b]), pack).reshape(b - a, dims[a]).astype(np.float64)
            left, right = np.flatnonzero(side[a:b] == 1), np.flatnonzero(side[a:b] == 0)
            if len(left) and len(right):
                x, y, score = best_of(m[left], m[right], ids[a:b][right], k)
                out.append((h1[a:b][left][x], h2[a:b][left][x], ids[a:b][right][y], score))
        whole = [np.concatenate(x) for x in zip(*out, strict=True)]
        # a query may meet several buckets here: of all it found, the best go on
        order = np.lexsort((whole[2], -whole[3], whole[1], whole[0]))
        whole = [x[order] for x in whole]
        if len(order):
            new = np.flatnonzero(np.concatenate([[True], (whole[0][1:] != whole[0][:-1]) | (whole[1][1:] != whole[1][:-1])]))
            place = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
            # the same candidate comes once from each table at most: k of each are enough
            whole = [x[place < k * (int(t.column("tbl").to_numpy().max()) + 1)] for x in whole]
        return pa.table(dict(zip(("h1", "h2", "vec_id", "score"), whole, strict=True)))

    return by_group(c.union(q), [*_AT, "i", "j"], run, "h1 long, h2 long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """h1, h2, best: the k best of each query as an array, an id once."""
    once = found.groupBy("h1", "h2", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))
    top = once.withColumn("place", place).where(F.col("place") <= k)
    return top.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))  # k at most


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 3, recall: float = 0.96, sample: int = 256, bucket: int = 512, block: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row that is a query, among all other rows.

    recall: wanted share of the sample's true neighbours; bucket: candidates a bucket should hold on average, where one rotation
    has too few axes for that; block: rows of either side that meet in one step.
    """
    rows, pack = _rows(vectors, is_query, id_col, vector_col)
    keep = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    cands = stage(rows.select("vec_id", "h1", "h2", "dim", "band", "v").withColumn("place", keep).where(F.col("place") <= k + 1).drop("place", "h1", "h2"), "nearest-candidates")
    asked = rows.where("query")
    queries = stage(asked.groupBy("h1", "h2").agg(F.min("dim").alias("dim"), F.min("v").alias("v")), "nearest-queries")
    # a row for each length and band of norms, a few in practice
    groups = cands.groupBy("dim", "band").agg(F.count("*").alias("n")).toArrow()
    dims, found_bands, numbers = (groups.column(c).to_numpy() for c in ("dim", "band", "n"))
    bands = {d: np.sort(found_bands[dims == d]) for d in np.unique(dims).tolist()}
    counts = {d: int(numbers[dims == d].sum()) for d in bands}
    sampled = queries.orderBy("h1", "h2").limit(sample).select("dim", "v").toArrow()
    axes, probes = _fit(sampled, _true_neighbours(sampled, cands, pack, k + 1), pack, bands, counts, tables, bucket, recall)

    def deal(b: pa.RecordBatch) -> pa.Table:
        parts = []
        for dim, at, m in _by_dim(b, pack):
            unit, rows = _unit(m)[0], b.take(pa.array(at))
            parts += [pa.table({"tbl": np.full(len(at), t, np.int32), "dim": rows.column("dim"), "band": rows.column("band"), "bucket": buckets_of(unit, t, axes[dim]), "vec_id": rows.column("vec_id"), "v": rows.column("v")}) for t in range(tables)]
        return pa.concat_tables(parts).combine_chunks()

    def visit(b: pa.RecordBatch) -> pa.Table:
        parts = []
        for dim, at, m in _by_dim(b, pack):
            unit = _unit(m)[0]
            for t in range(tables):
                band, bucket = probes_of(unit, t, axes[dim], bands[dim], probes)
                rows = b.take(pa.array(np.repeat(at, band.shape[1])))
                parts.append(pa.table({"tbl": np.full(rows.num_rows, t, np.int32), "dim": rows.column("dim"), "band": band.reshape(-1).astype(np.int32), "bucket": bucket.reshape(-1), "h1": rows.column("h1"), "h2": rows.column("h2"), "v": rows.column("v")}))
        return pa.concat_tables(parts).combine_chunks()

    dealt = arrow_rows(cands, deal, "tbl int, dim int, band int, bucket long, vec_id long, v binary")
    visits = arrow_rows(queries.select("dim", "h1", "h2", "v"), visit, "tbl int, dim int, band int, bucket long, h1 long, h2 long, v binary", rows=256)
    best = stage(_best(_meet(dealt, visits, pack, k + 1, block), k + 1), "nearest-best")
    # who found too few, where there are more, meets all rows of its length
    enough = F.lit(0)
    for d, n in counts.items():
        enough = F.when(F.col("dim") == d, min(k + 1, n)).otherwise(enough)
    short = queries.join(best, ["h1", "h2"], "left").where(F.coalesce(F.size("best"), F.lit(0)) < enough).select(queries.columns)
    short = stage(short, "nearest-short")
    if not short.isEmpty():
        everywhere = [F.lit(0).alias("tbl"), F.col("dim"), F.lit(0).alias("band"), F.lit(0).cast("long").alias("bucket")]
        again = _meet(cands.select(*everywhere, "vec_id", "v"), short.select(*everywhere, "h1", "h2", "v"), pack, k + 1, block)
        best = best.join(short, ["h1", "h2"], "left_anti").unionByName(stage(_best(again, k + 1), "nearest-best"))
    own = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(best, ["h1", "h2"])
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    placed = own.select("query_id", F.posexplode(others).alias("place", "found"))
    return placed.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("found.vec_id").alias("vec_id"), F.col("found.score").alias("score"))
