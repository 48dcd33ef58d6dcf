"""From posting lists to components of similar items, without listing the pairs of a long list.

Items (representatives of equal texts) are posted under tokens. Whoever shares a token may be similar;
similarity is the exact Jaccard coefficient of the items' shingle sets. What is asked for is the components
that the similar pairs form, so pairs inside a component already found need no check:

1. every member of a list is paired with the list's first item; sketches filter the pairs;
2. each item's best such pair is verified on full sets, then the others that still join two components;
3. lists that still hold several components are compared across components, in pairs of blocks of bounded
   size: by sketch first, then those with a possible partner on full sets. Only links leave a task.

After step 3 every pair that shares a token and passes the sketch filter is verified or inside a component.

A sketch is ``SKETCH`` coordinates of 7 bits, seven to a long, so the number of equal coordinates of two
sketches is a few integer operations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import arrow_rows, by_group, ship, stage
from cellgrove.llm.components import components
from cellgrove.llm.words import mix

SKETCH = 35
LONGS = [f"s{i}" for i in range(SKETCH // 7)]
#: of a Bloom filter: bits per id, and its largest size in 64-bit words (32 MB)
FILTER_BITS, FILTER_WORDS = 32, 1 << 22
_ALL, _TOP = 0x007F7F7F7F7F7F7F, 0x0080808080808080
_MULT = np.random.default_rng(2024).integers(1, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(2025).integers(1, 1 << 63, SKETCH, dtype=np.uint64)
_SH = np.uint64(32)


FIVE = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the size-word shingles; of the whole sequence if there are fewer words."""
    n = len(words)
    if not n:
        return words
    if n < size:
        return mix(np.array([(words * FIVE[32 : 32 + n]).sum() + np.uint64(n)], np.uint64))
    total = words[: n - size + 1] * FIVE[0]
    for j in range(1, size):
        total = total + words[j : n - size + 1 + j] * FIVE[j]
    return np.unique(mix(total))


def _bits(ids: np.ndarray, words: int) -> np.ndarray:
    """The three bits of 64 * words that stand for each id, (3, n)."""
    return np.stack([mix(ids.astype(np.uint64) + np.uint64(k << 56)) % np.uint64(64 * words) for k in (1, 2, 3)])


def bloom(ids: DataFrame, name: str) -> Callable[[np.ndarray], np.ndarray]:
    """A test of arrays of longs: true for every id in a column, and for few that are not there.

    The Bloom filter has 32 bits an id and passes 1 in 1,000 strangers, up to 32 MB (8 million ids), the bound of
    what is broadcast; beyond, it passes more. It only thins out what is shuffled, so an exact join must
    follow. Null ids are not in it; of an empty column nothing passes.
    """
    ship(ids.sparkSession)
    n = ids.count()
    words = min(FILTER_WORDS, 1 << max(6, (FILTER_BITS * n // 64).bit_length()))

    def collect(batches):
        bits = np.zeros(words, np.uint64)
        for b in batches:
            at = _bits(b.column(0).drop_null().to_numpy(), words).reshape(-1)
            np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(bits)
        for lo in range(0, len(used), 65536):
            some = used[lo : lo + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(bits[some].view(np.int64))], names=["word", "bits"])

    # at most FILTER_WORDS rows of two numbers
    table = ids.select(F.col(name).cast("long")).mapInArrow(collect, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    def test(x: np.ndarray) -> np.ndarray:
        at = _bits(x, words)
        return ((shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=0)

    return test


def minima(values: np.ndarray, begin: np.ndarray, hashes: int = SKETCH) -> np.ndarray:
    """The minhash coordinates (32 bits each) of sets of hashes that begin at begin and are not empty, (n, hashes)."""
    out = np.empty((len(begin), hashes), np.uint32)
    if len(begin):
        for j in range(hashes):
            out[:, j] = np.minimum.reduceat((values * _MULT[j] + _ADD[j]) >> _SH, begin)
    return out


def sketch(m: np.ndarray) -> np.ndarray:
    """Rows of minima (n, SKETCH) as longs (n, SKETCH / 7)."""
    seven = (m & np.uint32(0x7F)).astype(np.int64).reshape(len(m), -1, 7)
    return (seven << (8 * np.arange(7, dtype=np.int64))).sum(axis=2)


def matches(left: list[Column], right: list[Column]) -> Column:
    """How many coordinates of two sketches are equal."""
    out = F.lit(SKETCH)
    for x, y in zip(left, right, strict=True):
        out = out - F.bit_count((x.bitwiseXOR(y) + F.lit(_ALL)).bitwiseAND(F.lit(_TOP)))
    return out


def _np_matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal coordinates of each row of a with each row of b."""
    out = np.full((len(a), len(b)), SKETCH, np.int16)
    for j in range(a.shape[1]):
        out -= np.bitwise_count(((a[:, j][:, None] ^ b[:, j][None, :]) + _ALL) & _TOP).astype(np.int16)
    return out


def as_column(sets: list[np.ndarray]) -> pa.Array:
    """Sets of hashes as sorted lists of longs."""
    return pa.array([np.sort(x.astype(np.int64)) for x in sets], pa.list_(pa.int64()))


def _lists(column) -> list[np.ndarray]:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends, flat = x.offsets.to_numpy(), x.values.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _verify(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, block: int = 512) -> DataFrame:
    """Those pairs (a, b) whose full sets have 100 * |intersection| >= percent * |union|.

    The set of b travels to a, in blocks of about so many pairs of one a; the set of a goes to each of its blocks and comes
    first there, so a task holds one set beside the batch that it reads.
    """
    ship(pairs.sparkSession)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    firsts = sizes.select(F.col("a").alias("rep"), "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("slot"), F.lit(0).alias("side"))
    others = pairs.join(sizes, "a").select(F.col("b").alias("rep"), "a", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("slot"), F.lit(1).alias("side"))

    def run(batches):
        at, held = None, None
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            for i, (*here, side, x) in enumerate(zip(*(t.column(c).to_pylist() for c in ("a", "slot", "side")), _lists(t.column("x")), strict=True)):
                if not side:
                    at, held = here, x.copy()
                elif at == here:
                    k = _common(x, held)
                    keep[i] = 100 * k >= percent * (len(x) + len(held) - k)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("rep")], names=["a", "b"]).filter(pa.array(keep))

    keyed = sets(firsts.union(others)).select("a", "slot", "side", "rep", "x")
    return keyed.repartition("a", "slot").sortWithinPartitions("a", "slot", "side").mapInArrow(run, "a long, b long")


def _meeting(least: int, percent: int):
    """The items of two blocks of one list that have a partner in the other by component, size and sketch.

    d1 and d2 are a digest of all such items of the two blocks, with their sides.
    """

    def run(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
        rep, comp, n, side = (t.column(c).to_numpy() for c in ("rep", "comp", "n", "side"))
        own = mix(rep.astype(np.uint64) + side.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        digests = np.zeros((2, len(n)), np.uint64)
        s = np.stack([t.column(c).to_numpy() for c in LONGS], axis=1)
        keep = np.zeros(len(n), bool)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            zero = side[a:b] == 0
            left, right = np.flatnonzero(zero) + a, np.flatnonzero(~zero) + a
            for lo in range(0, len(left), 256):
                k = left[lo : lo + 256]
                nk = n[k][:, None]
                ok = (comp[k][:, None] != comp[right]) & (100 * np.minimum(nk, n[right]) >= percent * np.maximum(nk, n[right]))
                if ok.any():
                    ok &= _np_matches(s[k], s[right]) >= least
                    keep[k[ok.any(axis=1)]] = True
                    keep[right[ok.any(axis=0)]] = True
            met = own[a:b][keep[a:b]]
            digests[0, a:b], digests[1, a:b] = mix(met ^ np.uint64(1)).sum(), mix(met + np.uint64(7)).sum()
        out = t.select(["token", "i", "j", "side", "rep", "comp"])
        return out.append_column("d1", pa.array(digests[0].view(np.int64))).append_column("d2", pa.array(digests[1].view(np.int64))).filter(pa.array(keep))

    return run


def _intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each left with each right set: products of 0/1 matrices, some elements at a time."""
    sizes = [len(x) for x in left + right]
    value, index, count = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sizes)), sizes), count[index] > 1
    place = (np.cumsum(count > 1) - 1)[index[shared]]
    row = row[shared]
    order = np.argsort(place)
    place, row = place[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int((count > 1).sum()), width):
        a, b = np.searchsorted(place, [lo, lo + width])
        some, at = np.unique(row[a:b], return_inverse=True)
        m = np.zeros((len(some), width), np.float32)
        m[at, place[a:b] - lo] = 1.0
        cut = np.searchsorted(some, len(left))
        if 0 < cut < len(some):
            out[np.ix_(some[:cut], some[cut:] - len(left))] += m[:cut] @ m[cut:].T
    return out


def _linked(percent: int):
    """Exact links between two blocks of one list, as (item, smallest item of its local component)."""

    def run(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
        reps, comps, sides = (t.column(c).to_numpy() for c in ("rep", "comp", "side"))
        every, out, big = _lists(t.column("x")), [np.zeros((0, 2), np.int64)], np.iinfo(np.int64).max
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            rep, comp, sets = reps[a:b], comps[a:b], every[a:b]
            left, right = np.flatnonzero(sides[a:b] == 0), np.flatnonzero(sides[a:b] == 1)
            if not (len(left) and len(right)):
                continue
            root, n = rep.copy(), np.array([len(y) for y in sets])
            if len(left) * len(right) <= 16:
                inter = np.array([[_common(sets[i], sets[j]) for j in right] for i in left])
            else:
                inter = _intersections([sets[i] for i in left], [sets[i] for i in right])
            near = (100 * inter >= percent * (n[left][:, None] + n[right] - inter)) & (comp[left][:, None] != comp[right])
            while True:
                before = root.copy()
                root[left] = np.minimum(root[left], np.where(near, root[right], big).min(axis=1))
                root[right] = np.minimum(root[right], np.where(near, root[left][:, None], big).min(axis=0))
                if (root == before).all():
                    break
            some = root != rep
            out.append(np.stack([root[some], rep[some]], axis=1))
        links = np.concatenate(out)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return run


def connect(shared: DataFrame, items: DataFrame, sets: Callable[[DataFrame], DataFrame], least: int, percent: int = 75, block: int = 512, label: str = "near") -> DataFrame:
    """(node, component) of the items that have a similar item.

    shared: (token, rep, pivot), the lists of items with a common token, the least one apart, which is the pivot;
    items: (rep, n, s0..) with n the set's size and the sketch; sets: adds x, the shingle set of rep, to a table
    with any rows for a rep; least: equal sketch coordinates that a pair must have.
    """
    ship(items.sparkSession)
    pairs = shared.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    la = items.select(F.col("rep").alias("a"), F.col("n").alias("na"), *[F.col(c).alias(f"{c}a") for c in LONGS])
    lb = items.select(F.col("rep").alias("b"), F.col("n").alias("nb"), *[F.col(c).alias(f"{c}b") for c in LONGS])
    equal = matches([F.col(f"{c}a") for c in LONGS], [F.col(f"{c}b") for c in LONGS])
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    found = pairs.join(la, "a").join(lb, "b").where(sized).select("a", "b", equal.alias("equal")).where(F.col("equal") >= least)
    found = stage(found, f"{label}-candidates")
    best = found.groupBy("b").agg(F.max(F.struct("equal", (-F.col("a")).alias("a"))).alias("t")).select((-F.col("t.a")).alias("a"), "b")
    best = stage(best, f"{label}-best")
    links = stage(_verify(best, sets, percent), f"{label}-links")
    comp = components(links)
    # the other candidates that would still join two components
    ca, cb = comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), comp.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    split = found.join(best, ["a", "b"], "left_anti").join(ca, "a", "left").join(cb, "b", "left")
    rest = stage(split.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), f"{label}-rest")
    if rest.limit(1).count():
        links = links.union(stage(_verify(rest, sets, percent), f"{label}-links"))
        comp = components(links)

    # lists whose members (the pivot apart: its pairs are done) are in several components
    named = shared.join(comp, shared["rep"] == comp["node"], "left").select("token", "rep", F.coalesce("component", "rep").alias("comp"))
    named = stage(named, f"{label}-named")
    sizes = named.groupBy("token", "comp").agg(F.count("*").alias("k"))
    mixed = stage(sizes.groupBy("token").agg(F.count("*").alias("comps"), F.sum("k").alias("g"), F.max(F.struct("k", "comp")).alias("top")).where("comps > 1").select("token", "g", F.col("top.comp").alias("main"), (F.col("g") - F.col("top.k")).alias("odd")), f"{label}-mixed")
    if mixed.limit(1).count():
        rows = stage(named.join(mixed, "token").join(items, "rep"), f"{label}-members")
        n_all, n_odd = F.ceil(F.col("g") / block).cast("int"), F.ceil(F.col("odd") / block).cast("int")
        cut = F.xxhash64("rep")
        # the odd ones of a list, in blocks, meet all blocks of the list
        odd = rows.where("comp <> main").select("*", F.pmod(cut, n_odd).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), n_all - 1)).alias("j"), F.lit(0).alias("side"))
        every = rows.select("*", F.explode(F.sequence(F.lit(0), n_odd - 1)).alias("i"), F.pmod(cut, n_all).cast("int").alias("j"), F.lit(1).alias("side"))
        columns = ["token", "i", "j", "side", "rep", "comp", "n", *LONGS]
        met = by_group(odd.select(columns).union(every.select(columns)), ["token", "i", "j"], _meeting(least, percent), "token long, i int, j int, side int, rep long, comp long, d1 long, d2 long")
        met = stage(met, f"{label}-meeting")
        # copies share many tokens: blocks that hold the same items are compared once
        once = met.groupBy("d1", "d2").agg(F.min(F.struct("token", "i", "j")).alias("g")).select("g.*")
        met = met.join(once, ["token", "i", "j"], "left_semi").drop("d1", "d2")
        if met.limit(1).count():
            last = by_group(sets(met).select("token", "i", "j", "side", "rep", "comp", "x"), ["token", "i", "j"], _linked(percent), "a long, b long")
            last = stage(last.distinct(), f"{label}-links")
            if last.limit(1).count():
                comp = components(links.union(last))
    return comp
