"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors are one class with a multiplicity. A class is hashed by the signs of ``bits`` random
projections in each of ``tables`` tables; ``bits`` follows the number of classes, so buckets stay small, and
``tables`` follows from the wanted recall at the threshold. Cosines are computed in double precision inside
a bucket; a pair counts in the first table where it meets, so nothing is counted twice and no pairs leave a
task: a bucket gives each vector its number of links and its local component. Buckets of more than ``block``
vectors are dealt out as pairs of blocks. Vectors travel once a table (14 tables at 6 bits, 282 at 24, the most):
beyond 2^24 times ``bucket`` classes buckets grow, and with them the cosines, but no link is lost.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of
different lengths. Rows that repeat an id are rows of their own, each with its own links and the smallest id that its own
vector reaches. Ids are whole numbers; others are refused. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from cellgrove.llm.common import arrow_rows, col, named, smallest_ids, stage
from cellgrove.llm.components import components


def _planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([3, dim, tables, bits]).normal(size=(dim, tables * bits))


def _keys(v: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Bucket numbers (n, tables) of unit vectors v (n, dim)."""
    signs = (v @ _planes(v.shape[1], tables, bits) > 0).reshape(len(v), tables, bits)
    return (signs << np.arange(bits, dtype=np.int64)).sum(axis=2)


def _unit(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, h1 and h2 (digest; null if the vector links with nothing) and v (the components as doubles)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        h1, h2, out = [], [], []
        for x in b.column("v").to_pylist():
            raw = None
            if x and None not in x:
                a = np.asarray(x, np.float64)
                if np.isfinite(a).all() and a.any():
                    raw = a / 2.0 ** np.floor(np.log2(np.abs(a).max()))  # a power of two: exact, and squares stay finite
                    raw = raw.tobytes()
            d = hashlib.sha256(raw).digest() if raw else None
            h1.append(int.from_bytes(d[:8], "little", signed=True) if d else None)
            h2.append(int.from_bytes(d[8:16], "little", signed=True) if d else None)
            out.append(raw)
        return pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "h1", "h2", "v"])

    if not isinstance(vectors.schema[id_col].dataType, ByteType | ShortType | IntegerType | LongType):
        raise TypeError(f"{id_col} must be a whole number, not {vectors.schema[id_col].dataType.simpleString()}")
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("v"))
    return stage(arrow_rows(rows, run, "vec_id long, h1 long, h2 long, v binary"), "vectors-rows")


def _join_block(tables: int, bits: int, threshold: float):
    def run(t: pa.Table) -> pa.Table:
        rep, mult, side = (t.column(c).to_numpy() for c in ("rep", "mult", "side"))
        v, first = _unit(t.column("v").to_pylist()), int(t.column("tbl")[0].as_py())
        keys = _keys(v, tables, bits)[:, :first]
        two = side.any()
        left = np.flatnonzero(side == 0) if two else np.arange(len(rep))
        right = np.flatnonzero(side == 1) if two else left
        near = v[left] @ v[right].T >= threshold
        for k in range(first):  # counted in an earlier table
            near &= keys[left, k][:, None] != keys[right, k][None, :]
        if not two:
            np.fill_diagonal(near, False)
        links = np.zeros(len(rep), np.int64)
        links[left] += near @ mult[right]
        if two:
            links[right] += near.T @ mult[left]
        root, big = rep.copy(), np.iinfo(np.int64).max
        while True:
            before = root.copy()
            root[left] = np.minimum(root[left], np.where(near, root[right][None, :], big).min(axis=1, initial=big))
            root[right] = np.minimum(root[right], np.where(near, root[left][:, None], big).min(axis=0, initial=big))
            if (root == before).all():
                break
        some = links > 0
        return pa.table({"rep": rep[some], "links": links[some], "root": root[some]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.999, bucket: int = 256, block: int = 2048) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable), kept.

    recall: wanted chance that a pair exactly at the threshold meets in some table; bucket: vectors that a
    bucket should hold on average.
    """
    rows = _classes(vectors, id_col, vector_col)
    classes = rows.where("v is not null and vec_id is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("mult"), F.min("v").alias("v"))
    classes, repeated = named(stage(classes, "vectors-classes"), "first", "vectors-named")
    bits = min(24, max(6, math.ceil(math.log2(max(1, classes.count()) / bucket))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))

    def deal(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = b.column("v").to_pylist()
        sizes = np.array([len(x) // 8 for x in raw])
        keys = np.zeros((len(raw), tables), np.int64)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            keys[at] = _keys(_unit([raw[i] for i in at]), tables, bits)
        again = np.repeat(np.arange(len(raw)), tables)
        taken = b.take(pa.array(again))
        return pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(raw))), pa.array(keys.reshape(-1)), pa.array(sizes[again].astype(np.int32)), *(taken.column(c) for c in ("rep", "mult", "v"))], names=["tbl", "key", "dim", "rep", "mult", "v"])

    dealt = arrow_rows(classes.select("rep", "mult", "v"), deal, "tbl int, key long, dim int, rep long, mult long, v binary")
    at = ["tbl", "key", "dim"]
    heavy = stage(dealt.groupBy(*at).agg(F.count("*").alias("g")).where(F.col("g") > block), "vectors-heavy")
    if heavy.limit(1).count():
        both = dealt.join(heavy, at, "left").withColumn("nb", F.coalesce(F.ceil(F.col("g") / block), F.lit(1)).cast("int"))
        both = both.withColumn("x", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        both = both.select(*at, "rep", "mult", "v", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).cast("int").alias("side"))
    else:
        both = dealt.select(*at, "rep", "mult", "v", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    found = both.groupBy(*at, "i", "j").applyInArrow(_join_block(tables, bits, threshold), "rep long, links long, root long")
    found = stage(found, "vectors-links")
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = smallest_ids(components(found, "rep", "root"), classes, "first", repeated)
    done = classes.select("h1", "h2", "rep", "first", "mult").join(degree, "rep", "left").join(comp, classes["rep"] == comp["node"], "left")
    done = stage(done.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "first").alias("component")), "vectors-result")
    out = rows.select("vec_id", "h1", "h2").join(done, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
