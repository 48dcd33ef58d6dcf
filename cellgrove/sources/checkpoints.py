"""Checkpoints of a training run: one folder a version, committed by a rename, old ones pruned.

A version is written beside the others under a temporary name and then renamed, so readers see whole versions
only, and a run that dies while it writes leaves the version before. Which one is the best follows from the losses
stored with them; there is no pointer that could disagree.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, shape array<int>, data binary, about string"


class Checkpoints:
    def __init__(self, spark: SparkSession, path: str, every: int = 0):
        """every: keep each such epoch besides the latest and the best (0: only those two)."""
        self.spark, self.path, self.every = spark, path.rstrip("/"), every

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self._fs(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("epoch="))

    def _read(self, epoch: int) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/epoch={epoch}")

    def about(self, epoch: int) -> dict:
        return json.loads(self._read(epoch).where("name is null").first()["about"])

    def best(self) -> int | None:
        losses = {e: self.about(e)["loss"] for e in self.versions()}
        return min((e for e in losses if not math.isnan(losses[e])), key=lambda e: (losses[e], e), default=max(losses, default=None))

    def save(self, epoch: int, arrays: dict[str, np.ndarray], about: dict) -> None:
        """A version with arrays by name; about must hold its loss. A version that is there already stays."""
        if epoch in self.versions():
            return
        rows = [(k, list(np.shape(v)), np.ascontiguousarray(v, "<f8").tobytes(), None) for k, v in sorted(arrays.items())]
        temporary = f"{self.path}/_{uuid.uuid4().hex}"
        self.spark.createDataFrame([*rows, (None, None, None, json.dumps(about))], SCHEMA).coalesce(1).write.parquet(temporary)  # the size of the model
        source, fs = self._fs(temporary)
        target, _ = self._fs(f"{self.path}/epoch={epoch}")
        if not fs.rename(source, target):
            fs.delete(source, True)
            raise OSError(f"could not commit {target}")
        self.prune()

    def prune(self) -> None:
        every, best = self.versions(), self.best()
        for e in every[:-1]:
            if e != best and not (self.every and e % self.every == 0):
                at, fs = self._fs(f"{self.path}/epoch={e}")
                fs.delete(at, True)

    def load(self, which: str | int = "latest") -> tuple[int, dict[str, np.ndarray], dict] | None:
        """(epoch, arrays, about) of the latest or best version or a given epoch; None if there is none."""
        every = self.versions()
        if not every:
            return None
        epoch = every[-1] if which == "latest" else self.best() if which == "best" else which
        rows = self._read(epoch).collect()  # the size of the model
        arrays = {r["name"]: np.frombuffer(r["data"], "<f8").reshape(r["shape"]).copy() for r in rows if r["name"] is not None}
        return epoch, arrays, json.loads(next(r["about"] for r in rows if r["name"] is None))
