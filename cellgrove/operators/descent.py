"""Synchronous data-parallel training: bounded packs of rows, gradients summed in tasks, one update a step on the driver.

A pack is one batch's arrays, at most so many rows, made once and written to the shared folder (``blobs``), with an index that has its step;
which rows share a pack follows from their ids, not from partitions. A step reads its packs only, every task sums the
gradients of its packs in the packs' order, and the driver adds at most one row a task, of the size of the model. So the weights
do not depend on how rows are partitioned but for the last bits of sums. A pack whose loss is not finite is
skipped and counted. Random masks are seeded by epoch and pack.

A step of one pack has nothing to share out, so such steps go in chains: one task takes up to ``CHAIN`` steps one after the other, fetches each one's
pack when it comes to it and returns the state. That is the same arithmetic with a Spark job for a chain instead of one for a step. Gradients have the
precision of the packs' arrays, weights and moments are doubles. A model whose parts do not touch each other (``split``) has a chain for each part at a time, unless gradients are shortened together.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, partial
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.sources import blobs, files
from cellgrove.sources.checkpoints import Checkpoints
from cellgrove.sources.shipping import ship

Weights = dict[str, np.ndarray]
#: steps that a task takes before the state comes back; it holds one pack at a time
CHAIN = 1000


class Model(Protocol):
    #: weights that are not trained by gradients but follow the statistics of the packs
    followed: tuple[str, ...]

    def loss(self, w: Weights, arrays: dict[str, np.ndarray]) -> tuple[float, int]:
        """Sum of losses and rows, with nothing random."""

    def gradients(self, w: Weights, arrays: dict[str, np.ndarray], seed: list[int] | None) -> tuple[float, int, Weights, Weights]:
        """Sum of losses, rows, sums of gradients and the values that followed weights tend to; without a seed nothing is random and nothing is followed."""


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Names, types and shapes, then the arrays one after the other, each from a multiple of 8 bytes on."""
    head = json.dumps([(k, x.dtype.str, x.shape) for k, x in arrays.items()]).encode()
    parts = [len(head).to_bytes(8, "little"), head, *[x.tobytes() for x in arrays.values()]]
    return b"".join(p + bytes(-len(p) % 8) for p in parts)


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    """Read-only views of the data."""
    at = 8 + int.from_bytes(data[:8], "little")
    out = {}
    for k, kind, shape in json.loads(data[8:at]):
        at += -at % 8
        out[k] = np.frombuffer(data, kind, math.prod(shape), at).reshape(shape)
        at += out[k].nbytes
    return out


@dataclass
class Packs:
    """Packs in a folder, with an index (pack, step, and the place) of them; steps of the same number of packs but for the last."""

    spark: SparkSession
    path: str
    steps: int
    per_step: int = 1

    @cached_property
    def index(self) -> DataFrame:
        return self.spark.read.schema(f"pack long, step int, {blobs.PLACE}").parquet(f"{self.path}/index")

    def of(self, step: int | None) -> DataFrame:
        """(pack, step, data) of a step, or of all."""
        some = self.index if step is None else self.index.where(F.col("step") == step)
        return blobs.fetched(some, self.path, 2 * self.spark.sparkContext.defaultParallelism if step is None else max(1, min(self.per_step, self.spark.sparkContext.defaultParallelism)))


def write_packs(packs: DataFrame, per_step: int, label: str = "packs") -> Packs:
    """packs: (pack long from 0, data binary)."""
    spark, path = packs.sparkSession, files.work_path(packs.sparkSession, label)
    index = blobs.store(packs.select("pack", F.floor(F.col("pack") / per_step).cast("int").alias("step"), "data"), path)
    last = index.agg(F.max("step").alias("m")).first()["m"]
    return Packs(spark, path, 0 if last is None else last + 1, per_step)


def batches(rows: DataFrame, id_col: str, size: int, fn: Callable[[pa.Table], dict[str, np.ndarray]], total: int, seed: int = 42) -> DataFrame:
    """(pack, data): rows dealt by a hash of their id into packs of about size rows (of total), each sorted by id."""
    ship(rows.sparkSession)
    parts = max(1, math.ceil(total / size))
    dealt = rows.withColumn("pack", F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(parts)).cast("long"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"pack": [key[0].as_py()], "data": [packed(fn(t.sort_by(id_col)))]})

    return dealt.groupBy("pack").applyInArrow(run, "pack long, data binary")


def _sums(packs: DataFrame, model: Model, w: Weights, seed: list[int] | None) -> tuple[float, int, int, int, Weights, Weights]:
    """Loss, rows, packs, packs skipped, gradients and tendencies (both sums over packs) of some packs."""
    shared = packs.sparkSession.sparkContext.broadcast(w)  # the model

    def run(parts):
        loss = rows = done = skipped = 0
        grad, tend = {}, {}
        for b in parts:
            order = np.argsort(b.column("pack").to_numpy())
            for i in order.tolist():
                number, arrays = b.column("pack")[i].as_py(), unpacked(b.column("data")[i].as_py())
                one, n, g, t = model.gradients(shared.value, arrays, None if seed is None else [*seed, number])
                if not (math.isfinite(one) and all(np.isfinite(x).all() for x in g.values())):
                    skipped += 1
                    continue
                loss, rows, done = loss + one, rows + n, done + 1
                for into, new in ((grad, g), (tend, t)):
                    for k, x in new.items():
                        into[k] = into[k] + x if k in into else x
        yield pa.RecordBatch.from_pydict({"loss": [float(loss)], "rows": [rows], "done": [done], "skipped": [skipped], "grad": [packed(grad)], "tend": [packed(tend)]})

    found = packs.mapInArrow(run, "loss double, rows long, done long, skipped long, grad binary, tend binary").collect()  # a row of the model's size from each task
    shared.unpersist()
    grad, tend = {}, {}
    for r in found:
        for into, new in ((grad, unpacked(r["grad"])), (tend, unpacked(r["tend"]))):
            for k, x in new.items():
                into[k] = into[k] + x if k in into else x
    return sum(r["loss"] for r in found), sum(r["rows"] for r in found), sum(r["done"] for r in found), sum(r["skipped"] for r in found), grad, tend


@dataclass
class State:
    """All that a run needs to go on: weights, Adam's moments and counters, the history of epochs."""

    weights: Weights
    first: Weights = field(default_factory=dict)
    second: Weights = field(default_factory=dict)
    steps: int = 0
    epoch: int = 0
    history: list[dict] = field(default_factory=list)


def adam(s: State, grad: Weights, rate: float, clip: float | None = None, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> None:
    """One update; gradients longer than clip (over all weights together) are shortened to it."""
    g = np.concatenate([np.ravel(x) for x in grad.values()], dtype=np.float64)
    if clip:
        norm = math.sqrt(float(g @ g))
        if norm > clip:
            g *= clip / (norm + 1e-6)
    s.steps += 1
    was = [np.concatenate([np.ravel(of[k]) if k in of else np.zeros(x.size) for k, x in grad.items()]) for of in (s.first, s.second, s.weights)]
    m, v = b1 * was[0] + (1 - b1) * g, b2 * was[1] + (1 - b2) * g * g
    now = was[2] - rate * (m / (1 - b1**s.steps)) / (np.sqrt(v / (1 - b2**s.steps)) + eps)
    at = 0
    for k, x in grad.items():
        for of, flat in ((s.first, m), (s.second, v), (s.weights, now)):
            of[k] = flat[at : at + x.size].reshape(x.shape)
        at += x.size


def cosine(rate: float, epoch: int, epochs: int, least: float = 0.0) -> float:
    """The rate of an epoch (from 0), falling from rate to least as half a cosine."""
    return least + (rate - least) * (1 + math.cos(math.pi * epoch / epochs)) / 2


def _roomy() -> None:
    """Freeing one large block keeps glibc from handing a step's arrays back to the system and fetching them anew in the next one."""
    np.empty(31 << 20, np.uint8)


def _losses(packs: DataFrame, model: Model, w: Weights) -> tuple[float, int]:
    """Loss and rows of all packs whose loss is finite."""
    shared = packs.sparkSession.sparkContext.broadcast(w)  # the model

    def run(parts):
        _roomy()
        found = [model.loss(shared.value, unpacked(data.as_py())) for b in parts for data in b.column("data")]
        found = [(x, n) for x, n in found if math.isfinite(x)]
        yield pa.RecordBatch.from_pydict({"loss": [float(sum(x for x, _ in found))], "rows": [sum(n for _, n in found)]})

    found = packs.mapInArrow(run, "loss double, rows long").collect()  # a row from each task
    shared.unpersist()
    return sum(r["loss"] for r in found), sum(r["rows"] for r in found)


def _chain(train: Packs, steps: list[int], model: Model, state: State, seed: list[int], rate: float, clip: float | None, momentum: float) -> tuple[float, int, int]:
    """Takes steps of one pack each in their order, in one task for each part of the model; loss, rows and packs skipped."""
    parts = model.split() if hasattr(model, "split") and not clip else [model]
    shared = train.spark.sparkContext.broadcast((parts, state.weights, state.first, state.second, state.steps))  # of the model's size
    place, path = {s: i for i, s in enumerate(steps)}, train.path

    def run(number, batches):
        packs = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("step", "pack", "file", "start", "length")), strict=True)]
        own, weights, first, second, done = shared.value[0][number], *shared.value[1:]
        s = State(dict(weights), dict(first), dict(second), done)
        loss, rows, skipped, moved, read = 0, 0, [], set(), blobs.reader(path)
        _roomy()
        for _, pack, *at in sorted(packs, key=lambda x: place[x[0]]):
            one, n, g, t = own.gradients(s.weights, unpacked(read(*at)), [*seed, pack])
            if not (math.isfinite(one) and all(np.isfinite(x).all() for x in g.values())):
                skipped.append(pack)
                continue
            loss, rows = loss + one, rows + n
            if n:
                _step(s, g, t, n, 1, rate, clip, momentum)
                moved |= g.keys() | t.keys()
        out = {"weights": s.weights, "first": s.first, "second": s.second}
        yield pa.RecordBatch.from_pydict({"loss": [float(loss)], "rows": [rows], "skipped": pa.array([skipped], pa.list_(pa.int64())), "steps": [s.steps], **{k: [packed({x: y for x, y in v.items() if x in moved})] for k, v in out.items()}})

    some = train.index.where(F.col("step").isin(steps)).coalesce(1)

    def job(number: int):
        # the state of a part, one row; a worker that is read to its end is there for the next chain, after first() it would not be
        return some.mapInArrow(partial(run, number), "loss double, rows long, skipped array<long>, steps long, weights binary, first binary, second binary").collect()

    with ThreadPoolExecutor(len(parts)) as pool:  # the parts' jobs side by side
        found = [r for rows in pool.map(job, range(len(parts))) for r in rows]
    shared.unpersist()
    for r in found:
        state.weights |= unpacked(r["weights"])
        state.first |= unpacked(r["first"])
        state.second |= unpacked(r["second"])
    state.steps = max([state.steps, *(r["steps"] for r in found)])
    return sum(r["loss"] for r in found), max((r["rows"] for r in found), default=0), len({p for r in found for p in r["skipped"]})


def _step(s: State, grad: Weights, tend: Weights, rows: int, packs: int, rate: float, clip: float | None, momentum: float) -> None:
    """One update from sums over rows and packs."""
    adam(s, {k: g / rows for k, g in grad.items()}, rate, clip)
    for k, x in tend.items():
        s.weights[k] = (1 - momentum) * s.weights[k] + momentum * x / packs


def descend(
    model: Model,
    state: State,
    train: Packs,
    epochs: int,
    rate: float = 1e-3,
    schedule: Callable[[float, int, int], float] | None = None,
    clip: float | None = None,
    momentum: float = 0.1,
    validation: Packs | None = None,
    patience: int = 0,
    checkpoints: Checkpoints | None = None,
    seed: int = 42,
) -> State:
    """Train up to epochs; from the latest checkpoint on, where there is one.

    history has for every epoch its losses (means over rows), rate and skipped packs. patience: epochs without a better
    validation loss until the run stops (0: none).
    """
    if checkpoints is not None:
        state = load_state(checkpoints) or state
    while state.epoch < epochs:
        losses = [h["validation"] for h in state.history]
        if patience and losses and len(losses) - 1 - losses.index(min(losses)) >= patience:
            break
        now = schedule(rate, state.epoch, epochs) if schedule else rate
        loss = rows = skipped = 0
        order = np.random.default_rng([seed, state.epoch]).permutation(train.steps).tolist()
        if train.per_step == 1:
            for i in range(0, len(order), CHAIN):
                part, n, bad = _chain(train, order[i : i + CHAIN], model, state, [seed, state.epoch], now, clip, momentum)
                loss, rows, skipped = loss + part, rows + n, skipped + bad
            order = []
        for step in order:
            part, n, done, bad, grad, tend = _sums(train.of(step), model, state.weights, [seed, state.epoch])
            loss, rows, skipped = loss + part, rows + n, skipped + bad
            if n:
                _step(state, grad, tend, n, done, now, clip, momentum)
        mean = loss / rows if rows else math.nan
        held = mean
        if validation is not None:
            part, n = _losses(validation.of(None), model, state.weights)
            held = part / n if n else math.nan
        state.epoch += 1
        state.history.append({"epoch": state.epoch, "train": mean, "validation": held, "rate": now, "skipped": skipped})
        if checkpoints is not None:
            save_state(checkpoints, state)
    return state


def save_state(at: Checkpoints, s: State) -> None:
    arrays = {f"weights/{k}": v for k, v in s.weights.items()} | {f"first/{k}": v for k, v in s.first.items()} | {f"second/{k}": v for k, v in s.second.items()}
    at.save(s.epoch, arrays, {"steps": s.steps, "history": s.history, "loss": s.history[-1]["validation"]})


def load_state(at: Checkpoints, which: str = "latest") -> State | None:
    found = at.load(which)
    if found is None:
        return None
    epoch, arrays, about = found
    parts = {kind: {k.split("/", 1)[1]: v for k, v in arrays.items() if k.startswith(kind + "/")} for kind in ("weights", "first", "second")}
    return State(parts["weights"], parts["first"], parts["second"], about["steps"], epoch, about["history"])
