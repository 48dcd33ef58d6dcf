"""Models trained by ``descent``: the perceptron baseline and the attention network over tiles, each for several profiles at once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.operators import dense, descent, planes, tiles
from cellgrove.operators.descent import Weights
from cellgrove.sources.shipping import ship

CLASSES = 3


class Perceptron:
    """Linear, batch norm, ReLU, dropout, linear of half the width, ReLU, dropout, linear: one net for each profile, on the same batches.

    In training the batch's own mean and variance normalise, and the followed ones tend to them; afterwards the followed ones do.
    """

    def __init__(self, profiles: tuple[str, ...], features: list[str], hidden: int = 64, dropout: float = 0.2):
        self.profiles, self.features, self.hidden, self.dropout = profiles, features, hidden, dropout
        self.followed = tuple(f"{p}/{x}" for p in profiles for x in ("mean", "var"))
        self.numbered = tuple(enumerate(profiles))

    def split(self) -> list[Perceptron]:
        """The nets of the profiles, each with its profile's number: they share batches, and nothing else."""
        out = [Perceptron((p,), self.features, self.hidden, self.dropout) for p in self.profiles]
        for one, number in zip(out, self.numbered, strict=True):
            one.numbered = (number,)
        return out

    def start(self, seed: int = 42) -> Weights:
        """Uniform within 1 / sqrt(inputs)."""
        rng, out = np.random.default_rng(seed), {}
        sizes = {"1": (len(self.features), self.hidden), "2": (self.hidden, self.hidden // 2), "3": (self.hidden // 2, CLASSES)}
        for p in self.profiles:
            for k, (i, o) in sizes.items():
                bound = 1 / math.sqrt(i)
                out |= {f"{p}/w{k}": rng.uniform(-bound, bound, (o, i)), f"{p}/b{k}": rng.uniform(-bound, bound, o)}
            out |= {f"{p}/scale": np.ones(self.hidden), f"{p}/shift": np.zeros(self.hidden), f"{p}/mean": np.zeros(self.hidden), f"{p}/var": np.ones(self.hidden)}
        return out

    def logits(self, w: Weights, p: str, x: np.ndarray) -> np.ndarray:
        a = x @ w[f"{p}/w1"].T + w[f"{p}/b1"]
        a = (a - w[f"{p}/mean"]) / np.sqrt(w[f"{p}/var"] + 1e-5) * w[f"{p}/scale"] + w[f"{p}/shift"]
        b = np.maximum(a, 0) @ w[f"{p}/w2"].T + w[f"{p}/b2"]
        return np.maximum(b, 0) @ w[f"{p}/w3"].T + w[f"{p}/b3"]

    def loss(self, w: Weights, arrays: dict[str, np.ndarray]) -> tuple[float, int]:
        """As the nets are used: nothing random, followed mean and variance."""
        n = len(arrays["x"])
        return sum(dense.cross_entropy(self.logits(w, p, arrays["x"]), arrays[f"y_{p}"].astype(np.int64) - 1, np.ones(n, bool))[0] for p in self.profiles), n

    def gradients(self, w: Weights, arrays: dict[str, np.ndarray], seed: list[int] | None) -> tuple[float, int, Weights, Weights]:
        if seed is None:
            return *self.loss(w, arrays), {}, {}
        w, n, (x, centre, spread), total, grad, tend = _as(arrays["x"].dtype, w), len(arrays["x"]), _centred(arrays["x"]), 0.0, {}, {}
        more = 1 / (1 - self.dropout)  # dropout's factor goes with the weights
        for number, p in self.numbered:
            kept = self._kept([*seed, number], n)
            # batch norm of a linear map follows from the inputs' mean and covariance, so that it takes no pass of its own over the hidden units
            w1, scale = w[f"{p}/w1"], w[f"{p}/scale"]
            var = np.einsum("oi,ij,oj->o", w1, spread, w1)
            rise = 1 / np.sqrt(var + 1e-5)
            normal = w1 * rise[:, None]
            a1 = np.concatenate([normal * scale[:, None], w[f"{p}/shift"][:, None]], axis=1)
            a2, a3 = (np.concatenate([w[f"{p}/w{k}"] * more, w[f"{p}/b{k}"][:, None]], axis=1) for k in (2, 3))
            h1, on1 = _rectified(a1 @ x, kept[: self.hidden])
            h2, on2 = _rectified(a2 @ h1, kept[self.hidden :])
            loss, g = dense.cross_entropy_by_class(np.stack([row @ h2 for row in a3]), arrays[f"y_{p}"])  # row by row, which is faster for three
            total += loss
            g3 = np.stack([h2 @ row for row in g])
            g = a3[:, :-1].T @ g
            g *= on2
            g2 = g @ h1.T
            g = a2[:, :-1].T @ g
            g *= on1
            g1 = g @ x.T
            g_scale = (g1[:, :-1] * normal).sum(axis=1)
            grad |= {f"{p}/w3": g3[:, :-1] * more, f"{p}/b3": g3[:, -1], f"{p}/w2": g2[:, :-1] * more, f"{p}/b2": g2[:, -1], f"{p}/scale": g_scale, f"{p}/shift": g1[:, -1]}
            # what batch norm takes off, the mean and the part along normal; a constant before it, such as b1, is taken off whole
            grad |= {f"{p}/w1": (rise * scale)[:, None] * (g1[:, :-1] - g_scale[:, None] * (normal @ spread)), f"{p}/b1": np.zeros_like(rise)}
            tend |= {f"{p}/mean": w1 @ centre + w[f"{p}/b1"], f"{p}/var": var * n / max(1, n - 1)}
        return total, n, grad, tend

    def _kept(self, seed: list[int], n: int) -> np.ndarray:
        """Which units dropout keeps, (units of both hidden layers, rows)."""
        units, of, bits = self.hidden + self.hidden // 2, 2**16, np.random.SFC64(seed)
        drawn = bits.random_raw(-(-units * n // 4)).view(np.uint16)[: units * n]
        whole, part = divmod(self.dropout * of, 1)
        kept = drawn > int(whole)
        edge = np.flatnonzero(drawn == int(whole))  # of these a part, so that the share is exact
        kept[edge] = np.random.Generator(bits).random(len(edge)) >= part
        return kept.reshape(units, n)

    def predict(self, w: Weights, rows: DataFrame, id_col: str = "node_id") -> DataFrame:
        """id, profile, pred (from 1) for every row."""
        ship(rows.sparkSession)
        features, profiles, logits = self.features, self.profiles, self.logits
        shared = rows.sparkSession.sparkContext.broadcast(w)

        def run(batches):
            for b in batches:
                x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], axis=1)
                for p in profiles:
                    yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([p] * len(x)), pa.array((logits(shared.value, p, x).argmax(axis=1) + 1).astype(np.int32))], names=[id_col, "profile", "pred"])

        return rows.select(F.col(id_col).cast("long").alias(id_col), *features).mapInArrow(run, f"{id_col} long, profile string, pred int")

    def confusion(self, w: Weights, rows: DataFrame) -> DataFrame:
        """profile, y, pred and n over rows that have the features and y_<profile>: a task counts its own."""
        ship(rows.sparkSession)
        features, profiles, logits = self.features, self.profiles, self.logits
        shared = rows.sparkSession.sparkContext.broadcast(w)

        def run(batches):
            found = {p: np.zeros((CLASSES, CLASSES), np.int64) for p in profiles}
            for b in batches:
                x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in features], axis=1)
                for p in profiles:
                    found[p] += _counts(b.column(f"y_{p}").to_numpy(zero_copy_only=False), logits(shared.value, p, x).argmax(axis=1))
            yield from _counted(found).to_batches()

        return _summed(_doubles(rows, features).select(*_compact(features, profiles, "double")).mapInArrow(run, COUNTED))


class AttentionNet:
    """A linear encoder and GELU, layers of attention over neighbours, a head of logits for each profile."""

    followed: tuple[str, ...] = ()

    def __init__(self, profiles: tuple[str, ...], features: list[str], layers: int = 3):
        self.profiles, self.features, self.layers = profiles, features, layers

    def start(self, width: int, seed: int = 42) -> Weights:
        rng = np.random.default_rng(seed)

        def part(*shape: int) -> np.ndarray:
            bound = math.sqrt(6 / sum(shape)) if len(shape) > 1 else math.sqrt(3 / shape[0])
            return rng.uniform(-bound, bound, shape)

        out = {"encoder": part(width, len(self.features)), "bias": np.zeros(width)}
        for k in range(self.layers):
            out |= {f"left{k}": part(width, width), f"right{k}": part(width, width), f"scorer{k}": part(width)}
        return out | {p: part(CLASSES, width) for p in self.profiles}

    def _forward(self, w: Weights, x: np.ndarray, at: planes.Planes):
        """States (width, places) of a tile's places from features (features, places), and what backward needs."""
        a, rise = dense.gelu(w["encoder"] @ x + w["bias"][:, None])
        h, kept = a * at.there, []
        for k in range(self.layers):
            h, one = planes.attention(h, at, w[f"left{k}"], w[f"right{k}"], w[f"scorer{k}"])
            kept.append(one)
        return h, rise, kept

    def probabilities(self, w: Weights, x: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
        at = planes.planes(there)
        h, _, _ = self._forward(w, at.of(x), at)
        return {p: dense.softmax(at.back(w[p] @ h)) for p in self.profiles}

    def _heads(self, w: Weights, h: np.ndarray, arrays: dict[str, np.ndarray], at: planes.Planes) -> tuple[np.ndarray, float, np.ndarray]:
        """All profiles' heads as one matrix, by class, then profile; loss, and the gradient by the logits."""
        heads = np.concatenate([w[p][k : k + 1] for k in range(CLASSES) for p in self.profiles])
        y = at.of(np.stack([arrays["counted"], *[arrays[f"y_{p}"] for p in self.profiles]], axis=-1))
        loss, g = dense.cross_entropy_by_class((heads @ h).reshape(CLASSES, len(self.profiles), -1), y[1:], y[0] > 0)
        return heads, loss, g.reshape(len(heads), -1)

    def loss(self, w: Weights, arrays: dict[str, np.ndarray]) -> tuple[float, int]:
        n = int(arrays["counted"].sum())
        if not n:
            return 0.0, 0
        w, at = _as(arrays["x"].dtype, w), planes.planes(arrays["there"])
        return self._heads(w, self._forward(w, at.of(arrays["x"]), at)[0], arrays, at)[1], n

    def gradients(self, w: Weights, arrays: dict[str, np.ndarray], seed: list[int] | None) -> tuple[float, int, Weights, Weights]:
        """arrays: x and there of a tile with its halo, counted (cells whose loss counts) and y_<profile>; computed in the precision of x."""
        w, at = _as(arrays["x"].dtype, w), planes.planes(arrays["there"])
        x = at.of(arrays["x"])
        h, rise, kept = self._forward(w, x, at)
        heads, total, g = self._heads(w, h, arrays, at)
        by_head = (g @ h.T).reshape(CLASSES, len(self.profiles), -1)
        grad, gh = {p: by_head[:, i] for i, p in enumerate(self.profiles)}, heads.T @ g
        for k in reversed(range(self.layers)):
            gh, grad[f"left{k}"], grad[f"right{k}"], grad[f"scorer{k}"] = planes.attention_back(gh, kept[k], at, w[f"left{k}"], w[f"right{k}"], w[f"scorer{k}"])
        g = gh * at.there * rise
        grad |= {"encoder": g @ x.T, "bias": g.sum(axis=1)}
        return total, int(arrays["counted"].sum()), grad, {}

    def tiling(self, height: int, width: int, tile: int = 128) -> tiles.Tiling:
        return tiles.Tiling(height, width, tile, self.layers)

    def infer(self, w: Weights, cells: DataFrame, t: tiles.Tiling) -> DataFrame:
        """node_id, profile, p1, p2, p3 of every cell: whole tiles at a time, each through all layers."""
        shared = cells.sparkSession.sparkContext.broadcast(w)
        features, profiles, probabilities = self.features, self.profiles, self.probabilities

        def run(tile: tiles.Tile) -> dict[str, np.ndarray]:
            return probabilities(shared.value, tile.stack(features), tile.there)

        wide = tiles.per_tile(_doubles(cells, features), features, t, run, ", ".join(f"{p} array<double>" for p in profiles))
        rows = F.array(*[F.struct(F.lit(p).alias("profile"), *[F.col(p)[i].alias(f"p{i + 1}") for i in range(CLASSES)]) for p in profiles])
        return wide.select("node_id", F.inline(rows))

    def confusion(self, w: Weights, cells: DataFrame, t: tiles.Tiling) -> DataFrame:
        """profile, y, pred and n over counted cells: as packs, but whole tiles go through all layers at once and only their counts leave them."""
        shared = cells.sparkSession.sparkContext.broadcast(w)
        features, profiles, probabilities = self.features, self.profiles, self.probabilities

        def run(table: pa.Table) -> pa.Table:
            tile = tiles.dense(table, t)
            counted = tile.values["counted"] & tile.inner
            if not counted.any():
                return _counted({})
            found = probabilities(shared.value, tile.stack(features), tile.there)
            return _counted({p: _counts(tile.values[f"y_{p}"][counted], found[p][counted].argmax(axis=1)) for p in profiles})

        picked = tiles.spread(_doubles(cells, features).select("node_id", "row", "col", *_compact(features, profiles, "double"), "counted"), t)
        return _summed(picked.groupBy("tr", "tc").applyInArrow(run, COUNTED))

    def packs(self, cells: DataFrame, t: tiles.Tiling, kind: str = "double") -> DataFrame:
        """(pack, data) of every tile: cells have the features, y_<profile> and counted (boolean: a cell to learn from). kind: double or float."""
        features, profiles, across = self.features, self.profiles, t.columns()

        def run(table: pa.Table) -> pa.Table:
            tile = tiles.dense(table, t)
            arrays = {"x": tile.stack(features), "there": tile.there, "counted": tile.values["counted"] & tile.inner} | {f"y_{p}": tile.values[f"y_{p}"] for p in profiles}
            return pa.table({"pack": [tile.tr * across + tile.tc], "data": [descent.packed(arrays)]})

        picked = tiles.spread(_doubles(cells, features).select("node_id", "row", "col", *_compact(features, profiles, kind), "counted"), t)
        return picked.groupBy("tr", "tc").applyInArrow(run, "pack long, data binary")


class RelationNet:
    """A linear encoder and GELU, and one layer over four relations of a raster: neighbours along rows, along columns, across, and the cell itself.

    ``network.relation_layer`` on a raster's edges, tile by tile: a cell travels once, with a halo of one, where edges would carry every state nine times.
    """

    def __init__(self, features: list[str]):
        self.features = features

    def states(self, w: Weights, x: np.ndarray, there: np.ndarray) -> np.ndarray:
        h = dense.gelu(x @ w["encoder"].T + w["bias"])[0] * there[..., None]
        sent, message = [h @ w[f"relation{k}"].T for k in range(4)], np.zeros_like(h)
        for dr, dc in dense.NEIGHBOURS:
            message += dense.shifted(sent[2 if dr and dc else 0 if dc else 1 if dr else 3], dr, dc)
        return dense.gelu(dense.layer_norm(h + message)[0])[0]

    def infer(self, w: Weights, cells: DataFrame, height: int, width: int, tile: int = 128) -> DataFrame:
        """node_id and h (an array) of every cell."""
        shared = cells.sparkSession.sparkContext.broadcast(w)
        features, states = self.features, self.states

        def run(tile: tiles.Tile) -> dict[str, np.ndarray]:
            return {"h": states(shared.value, tile.stack(features), tile.there)}

        return tiles.per_tile(_doubles(cells, features), features, tiles.Tiling(height, width, tile, 1), run, "h array<double>")


COUNTED = "profile string, y int, pred int, n long"


def _counts(y: np.ndarray, best: np.ndarray) -> np.ndarray:
    """How often each class (from 1) was given each best class (from 0)."""
    return np.bincount((y.astype(np.int64) - 1) * CLASSES + best, minlength=CLASSES * CLASSES).reshape(CLASSES, CLASSES)


def _counted(found: dict[str, np.ndarray]) -> pa.Table:
    rows = [(p, i + 1, j + 1, int(n)) for p, of in found.items() for (i, j), n in np.ndenumerate(of) if n]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["profile", "y", "pred", "n"])


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("profile", "y", "pred").agg(F.sum("n").alias("n"))


def _as(kind: np.dtype, w: Weights) -> Weights:
    return {k: x.astype(kind, copy=False) for k, x in w.items()}


def _rectified(z: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """z where it is above 0 and kept, with a last row of ones for biases, and where that is. What is not a number stays so."""
    on = z > 0
    on &= kept
    out = np.empty((len(z) + 1, z.shape[1]), z.dtype)
    np.multiply(z, on, out=out[:-1])
    out[-1] = 1
    return out, on


def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (n, features) as columns around their mean, with a last row of ones; the mean; the covariance."""
    centre = x.mean(axis=0, dtype=np.float64).astype(x.dtype)
    out = np.ones((x.shape[1] + 1, len(x)), x.dtype)
    np.subtract(x.T, centre[:, None], out=out[:-1])
    return out, centre, out[:-1] @ out[:-1].T / len(x)


def _doubles(cells: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles; null ones count as 0."""
    return cells.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


def _compact(features: list[str], profiles: tuple[str, ...], kind: str) -> list[Column]:
    return [*[F.col(c).cast(kind).alias(c) for c in features], *[F.col(f"y_{p}").cast("tinyint").alias(f"y_{p}") for p in profiles]]


def perceptron_batches(model: Perceptron, rows: DataFrame, total: int, size: int = 4096, id_col: str = "node_id", kind: str = "double") -> DataFrame:
    """(pack, data) of rows that have an id, the features and y_<profile>. kind: double or float, the precision of gradients."""

    def arrays(t: pa.Table) -> dict[str, np.ndarray]:
        x = np.stack([t.column(c).to_numpy() for c in model.features], axis=1)
        return {"x": x} | {f"y_{p}": t.column(f"y_{p}").to_numpy() for p in model.profiles}

    picked = _doubles(rows, model.features).select(id_col, *_compact(model.features, model.profiles, kind))
    return descent.batches(picked, id_col, size, arrays, total)
