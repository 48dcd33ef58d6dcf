"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Every whole text gives ``FEATURES`` statistics (lengths, character classes, word and line repetition, byte
entropy). They are standardised with the labelled rows' mean and deviation and mapped to ``components``
random Fourier features, which approximate a Gaussian kernel. Each partition sums its share of the normal
equations; the sums are added up in two steps and the ridge system of a fixed size is solved on the driver.
Scores of a calibration fold (a fifth of the labelled rows, which the ridge fit does not see) are summed
on a grid and made monotone by pooling adjacent violators; scores in between are interpolated.

All labelled rows take part. Null and empty texts have all-zero statistics and get a score like any other.
Labels other than 0 and 1, or null, are ignored; a document with several label rows counts with each.
Without usable labels every score is 0.5. Repeated rows score alike. A null id never finds a label.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import arrow_rows, col, partitions, ship, stage, texts_of

FEATURES = (
    "log_bytes", "log_words", "log_lines", "letters", "uppercase", "digits", "marks", "spaces", "high_bytes", "entropy",
    "word_length", "long_words", "distinct_words", "repeated_next", "top_word", "log_run", "capital_words", "marked_words",
    "line_words", "distinct_lines", "longest_line", "bars", "exclamations", "periods", "commas", "symbols",
)
_LETTER, _UPPER, _DIGIT, _MARK, _SPACE, _HIGH, _SYMBOL = np.zeros((7, 256))
for _b in range(256):
    _c = chr(_b)
    _LETTER[_b], _UPPER[_b], _DIGIT[_b] = _b >= 128 or _c.isalpha(), _b < 128 and _c.isupper(), _b < 128 and _c.isdigit()
    _SPACE[_b], _HIGH[_b] = _c in " \t\n\r\v\f", _b >= 128
    _MARK[_b] = _b < 128 and not (_c.isalnum() or _c in " \t\n\r\v\f")
    _SYMBOL[_b] = _c in "*#%&$@^~<>=+_\\{}[]"
_CLASSES = np.stack([_LETTER, _UPPER, _DIGIT, _MARK, _SPACE, _HIGH, _SYMBOL], axis=1)


def statistics(text: str) -> list[float]:
    """The FEATURES of one whole text."""
    data = text.encode("utf-8", "replace")
    if not data:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    letters, upper, digits, marks, spaces, high, symbols = counts @ _CLASSES / n
    share = counts[counts > 0] / n
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    kinds: dict[str, int] = {}
    run = longest = 0
    again = sum(map(operator.eq, words, words[1:]))
    if again:
        last = None
        for x in words:
            run = run + 1 if x == last else 1
            longest = max(longest, run)
            last = x
    for x in words:
        kinds[x] = kinds.get(x, 0) + 1
    marked = sum(c for x, c in kinds.items() if not x[-1].isalnum())
    capital = sum(c for x, c in kinds.items() if x.isupper())
    long_words = sum(c for x, c in kinds.items() if len(x) > 12)
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), letters, upper, digits, marks, spaces, high, float(-(share * np.log2(share)).sum()),
        (n - counts[32] - counts[10]) / w, long_words / w, len(kinds) / w, again / w, max(kinds.values(), default=0) / w, np.log1p(longest), capital / w, marked / w,
        np.log1p(len(words) / len(lines)), len(set(lines)) / len(lines), max(map(len, lines)) / max(1, len(text)), counts[ord("|")] / w, counts[ord("!")] / w, counts[ord(".")] / w, counts[ord(",")] / w, symbols,
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray  # (F, D)
    phases: np.ndarray  # (D,)
    weights: np.ndarray  # (D + 1,)
    knots: np.ndarray  # ridge scores
    levels: np.ndarray  # calibrated probabilities at the knots

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6.0, 6.0)
        out = np.cos(z @ self.directions + self.phases) * np.sqrt(2.0 / len(self.phases))
        return np.concatenate([out, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels) if len(self.knots) else np.full(len(x), 0.5)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array of FEATURES, written to the shared folder: both fit and scoring read it."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in texts_of(b)], np.float64)
        lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), lists], names=["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return stage(arrow_rows(rows, run, f"doc_id {kind}, x array<double>"), "quality-statistics")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))


def _sums(df: DataFrame, size: int, add) -> np.ndarray:
    """Sum over all rows of the vectors that add(batch, total) builds up in each partition.

    The partitions' vectors are added in as many tasks as the root of the shuffle partitions, then their sums in one.
    """
    tasks = max(1, round(partitions(df) ** 0.5))

    def summed(batches):
        total = np.zeros(size)
        for b in batches:
            for v in b.column("v"):
                total += np.frombuffer(v.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([0], pa.int32())], names=["v", "part"])

    def run(batches):
        total, part = np.zeros(size), TaskContext.get().partitionId() % tasks
        for b in batches:
            if b.num_rows:
                add(b, total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([part], pa.int32())], names=["v", "part"])

    parts = df.mapInArrow(run, "v binary, part int").repartition(tasks, "part").mapInArrow(summed, "v binary, part int")
    return np.frombuffer(parts.repartition(1).mapInArrow(summed, "v binary, part int").first()["v"])


def pool_adjacent_violators(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence closest to value in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([float(v), float(w), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id", components: int = 256, ridge: float = 1e-3, width: float = 4.0, grid: int = 200, seed: int = 11) -> Model:
    """stats: document_statistics; labels: id and 0/1; usable: which labelled ids may be learnt from.

    components: random Fourier features; width: of the Gaussian kernel, in standard deviations; grid: score
    steps per unit at which calibration counts are gathered (at most 3 * grid of them reach the driver).
    """
    ship(stats.sparkSession)
    y = labels.where(col(label_col).isin(0, 1)).select(col(id_col).alias("doc_id"), col(label_col).cast("double").alias("y"))
    fold = (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).alias("calibrate")
    rows = stage(stats.join(y, "doc_id").where(usable).select("doc_id", "x", "y", fold), "quality-training")
    n_f, rng = len(FEATURES), np.random.default_rng(seed)

    def moments(b, total):
        x = _matrix(b)
        total += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    m = _sums(rows, 1 + 2 * n_f, moments)
    blank = Model(np.zeros(n_f), np.ones(n_f), rng.normal(size=(n_f, components)) / width, rng.uniform(0, 2 * np.pi, components), np.zeros(components + 1), np.zeros(0), np.zeros(0))
    if not m[0]:
        return blank
    mean = m[1 : 1 + n_f] / m[0]
    scale = np.sqrt(np.maximum(m[1 + n_f :] / m[0] - mean * mean, 1e-8))
    model, d = Model(mean, scale, blank.directions, blank.phases, blank.weights, blank.knots, blank.levels), components + 1

    def normal(b, total):
        z = model.features(_matrix(b))
        total[: d * d] += (z.T @ z).reshape(-1)
        total[d * d :] += z.T @ b.column("y").to_numpy()

    s = _sums(rows.where(~F.col("calibrate")), d * d + d, normal)
    a = s[: d * d].reshape(d, d)
    penalty = ridge * max(1.0, a[-1, -1]) / d * np.eye(d)
    penalty[-1, -1] = 1e-9
    model = Model(mean, scale, blank.directions, blank.phases, np.linalg.solve(a + penalty, s[d * d :]), blank.knots, blank.levels)

    def judged(b: pa.RecordBatch) -> pa.RecordBatch:
        at = np.round(np.clip(model.raw(_matrix(b)), -1.0, 2.0) * grid).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at), b.column("y")], names=["at", "y"])

    seen = arrow_rows(rows.where("calibrate"), judged, "at long, y double").groupBy("at").agg(F.sum("y").alias("s"), F.count("*").alias("n")).orderBy("at").collect()
    if not seen:
        return Model(mean, scale, model.directions, model.phases, model.weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    knots = np.array([r["at"] for r in seen]) / grid
    weight = np.array([r["n"] for r in seen], np.float64)
    levels = pool_adjacent_violators(np.array([r["s"] for r in seen]) / weight, weight)
    # scores outside the calibrated range move on towards 0 and 1; within pooled blocks they keep their order
    knots = np.concatenate([[knots[0] - 1.0], knots, [knots[-1] + 1.0]])
    levels = np.concatenate([[0.0], np.clip(levels, 1e-3, 1 - 1e-3), [1.0]])
    levels = 0.98 * levels + 0.02 * np.clip((knots + 1.0) / 3.0, 0.0, 1.0)
    return Model(mean, scale, model.directions, model.phases, model.weights, knots, levels)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of document_statistics."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.clip(model.score(_matrix(b)), 0.0, 1.0))], names=["doc_id", "score"])

    return arrow_rows(stats, run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, unchanged, whose text scores at least least."""
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t if t is not None else "") for t in b.column(at).to_pylist()], np.float64)
        return b.filter(pa.array(model.score(x) >= least))

    return arrow_rows(docs, run, docs.schema)
