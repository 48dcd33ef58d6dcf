"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in segments of ``SEGMENT`` bytes, forwards and backwards at once, labels
every byte position with a distribution over the languages, and a document's probabilities are the mean
over all positions of its whole text. It is trained in numpy by backpropagation through time on a bounded
sample of labelled documents (``sample_docs`` documents per language, ``segments_per_doc`` segments each);
prediction is one pass over the texts in Arrow batches, with no shuffle.

Gates use the piecewise linear sigmoid clip(x/4 + 1/2, 0, 1), the candidate state tanh.

Null text, empty text and text without any letter give language ``und`` with score 0. Very long texts are
just more segments. A null id is kept. Repeated rows are predicted alike. Without any labelled row every
prediction is ``und``. Ties between languages go to the first in alphabetical order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import arrow_rows, col, ship, texts_of

SEGMENT = 64
CHUNK = 2048
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class BiGRU:
    """wx: input rows by direction and byte; u: recurrent weights by direction; v, c: the output layer."""

    classes: tuple[str, ...]
    wx: np.ndarray  # (2, 256, 3H), gates z, r, candidate
    u: np.ndarray  # (2, 3H, H)
    v: np.ndarray  # (C, 2H)
    c: np.ndarray  # (C, 1)


def _forward(m: BiGRU, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (L, 2H, B) of byte segments x (L, B); mask (L, B) is 0 behind a segment's end."""
    length, b = x.shape
    h_dim = m.u.shape[2]
    full = mask.all(axis=1)
    h = np.zeros((2, h_dim, b), np.float32)
    out = np.empty((length, 2 * h_dim, b), np.float32)
    rows = np.empty((2, b, 3 * h_dim), np.float32)
    for t in range(length):
        back = length - 1 - t
        np.take(m.wx[0], x[t], axis=0, out=rows[0], mode="clip")
        np.take(m.wx[1], x[back], axis=0, out=rows[1], mode="clip")
        xt = np.ascontiguousarray(rows.transpose(0, 2, 1))
        a = np.matmul(m.u, h)
        zr = xt[:, : 2 * h_dim] + a[:, : 2 * h_dim]
        zr *= 0.25
        zr += 0.5
        np.clip(zr, 0.0, 1.0, out=zr)
        n = a[:, 2 * h_dim :] * zr[:, h_dim:]
        n += xt[:, 2 * h_dim :]
        np.tanh(n, out=n)
        before = h
        h = before - n
        h *= zr[:, :h_dim]
        h += n
        if not full[t]:
            h[0] *= mask[t]
        if not full[back]:
            h[1] *= mask[back]
        if keep is not None:
            keep.append((before, zr, n, a[:, 2 * h_dim :]))
        out[t, :h_dim] = h[0]
        out[back, h_dim:] = h[1]
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradients(m: BiGRU, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy of all positions, by backpropagation through time; x and mask (L, B)."""
    length, n = x.shape
    h_dim, kept = m.u.shape[2], []
    states = _forward(m, x, mask, kept)
    p = _softmax(np.matmul(m.v, states) + m.c)
    p[:, labels, np.arange(n)] -= 1.0
    p *= (mask / max(1.0, mask.sum()))[:, None, :]
    g = {"v": np.einsum("lcb,lhb->ch", p, states, optimize=True), "c": p.sum(axis=(0, 2))[:, None], "u": np.zeros_like(m.u)}
    into = np.matmul(m.v.T, p)  # (L, 2H, B)
    d_rows = np.empty((2, length, n, 3 * h_dim), np.float32)
    dh = np.zeros((2, h_dim, n), np.float32)
    for t in range(length - 1, -1, -1):
        back = length - 1 - t
        before, zr, cand, an = kept[t]
        z, r = zr[:, :h_dim], zr[:, h_dim:]
        dh[0] += into[t, :h_dim]
        dh[1] += into[back, h_dim:]
        dh[0] *= mask[t]
        dh[1] *= mask[back]
        d_pre = dh * (1.0 - z) * (1.0 - cand * cand)
        d_z = dh * (before - cand) * 0.25 * ((z > 0) & (z < 1))
        d_r = d_pre * an * 0.25 * ((r > 0) & (r < 1))
        d_a = np.concatenate([d_z, d_r, d_pre * r], axis=1)
        g["u"] += np.matmul(d_a, before.transpose(0, 2, 1))
        d_x = np.concatenate([d_z, d_r, d_pre], axis=1).transpose(0, 2, 1)
        d_rows[0, t], d_rows[1, back] = d_x[0], d_x[1]
        dh = dh * z + np.matmul(m.u.transpose(0, 2, 1), d_a)
    flat = x.reshape(-1)
    hot = np.zeros((flat.size, 256), np.float32)
    hot[np.arange(flat.size), flat] = 1.0
    g["wx"] = np.stack([hot.T @ d_rows[d].reshape(-1, 3 * h_dim) for d in (0, 1)])
    return g


def train(x: np.ndarray, lengths: np.ndarray, labels: np.ndarray, classes: tuple[str, ...], hidden: int = 8, epochs: int = 6, batch: int = 256, rate: float = 0.02, seed: int = 7) -> BiGRU:
    """Adam on the mean cross entropy of all positions; x (N, L) bytes, lengths (N), labels (N) class numbers."""
    rng = np.random.default_rng(seed)
    h_dim, c_dim = hidden, len(classes)
    w = {
        "wx": rng.normal(0, 0.3, (2, 256, 3 * h_dim)),
        "u": rng.normal(0, 0.4 / np.sqrt(h_dim), (2, 3 * h_dim, h_dim)),
        "v": rng.normal(0, 0.3, (c_dim, 2 * h_dim)),
        "c": np.zeros((c_dim, 1)),
    }
    w = {k: a.astype(np.float32) for k, a in w.items()}
    first, second, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    n_rows, length = x.shape
    for epoch in range(epochs):
        lr = rate * (1.0 - epoch / epochs)
        order = rng.permutation(n_rows)
        for lo in range(0, n_rows, batch):
            pick = order[lo : lo + batch]
            xb = np.ascontiguousarray(x[pick].T).astype(np.intp)
            mask = (np.arange(length)[:, None] < lengths[pick][None, :]).astype(np.float32)
            g = gradients(BiGRU(classes, **w), xb, mask, labels[pick])
            step += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            scale = min(1.0, 1.0 / max(norm, 1e-9))
            for k, a in g.items():
                a = a * scale
                first[k] += 0.1 * (a - first[k])
                second[k] += 0.01 * (a * a - second[k])
                w[k] = (w[k] - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return BiGRU(classes, **w)


def predict_bytes(m: BiGRU, texts: list[bytes]) -> np.ndarray:
    """Mean class probabilities over all byte positions of each non-empty text, (n, C); zeros for empty ones."""
    sizes = np.array([len(t) for t in texts], np.int64)
    segments = -(-sizes // SEGMENT)
    total = int(segments.sum())
    sums = np.zeros((len(texts), len(m.classes)))
    if not total:
        return sums
    owner = np.repeat(np.arange(len(texts)), segments)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(segments, out=starts[1:])
    flat = np.zeros(total * SEGMENT, np.uint8)
    for i, t in enumerate(texts):
        flat[starts[i] * SEGMENT : starts[i] * SEGMENT + len(t)] = np.frombuffer(t, np.uint8)
    left = np.full(total, SEGMENT, np.int64)
    ends = starts[1:][segments > 0] - 1
    left[ends] = sizes[segments > 0] - (segments[segments > 0] - 1) * SEGMENT
    flat = flat.reshape(total, SEGMENT)
    per_segment = np.empty((total, len(m.classes)))
    for lo in range(0, total, CHUNK):
        hi = min(total, lo + CHUNK)
        mask = (np.arange(SEGMENT)[:, None] < left[lo:hi][None, :]).astype(np.float32)
        states = _forward(m, np.ascontiguousarray(flat[lo:hi].T).astype(np.intp), mask)
        p = _softmax(np.matmul(m.v, states) + m.c)
        p *= mask[:, None, :]
        per_segment[lo:hi] = p.sum(axis=0).T
    np.add.at(sums, owner, per_segment)
    return sums / np.maximum(sizes, 1)[:, None]


def _cut(batch: pa.RecordBatch, segments_per_doc: int) -> pa.RecordBatch:
    """Training segments of sampled documents: evenly spread over the whole text, every fourth one shortened."""
    out_lang, out_bytes = [], []
    for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
        data = text.encode("utf-8", "replace")
        n = max(1, -(-len(data) // SEGMENT))
        for j in range(min(n, segments_per_doc)):
            k = j * n // min(n, segments_per_doc)
            piece = data[k * SEGMENT : (k + 1) * SEGMENT]
            if j % 4 == 3:
                piece = piece[: 8 + (len(data) + 13 * j) % 40]
            if piece:
                out_lang.append(lang)
                out_bytes.append(piece)
    return pa.RecordBatch.from_pydict({"lang": pa.array(out_lang, pa.string()), "bytes": pa.array(out_bytes, pa.binary())})


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 400, segments_per_doc: int = 8, most_docs: int = 200_000, **params) -> BiGRU:
    """Train on at most about sample_docs documents of each language among the usable rows, and most_docs in all.

    The sample is drawn by a hash of the id at a rate of that number over the language's count, so what
    reaches the driver is bounded by the parameters and the number of languages, which the model has weights for, not by the
    table. All languages are classes, but one of which no document is drawn is never predicted.
    """
    ship(docs.sparkSession)
    rows = docs.where(usable & col(lang_col).isNotNull() & col(text_col).isNotNull() & (F.length(col(text_col)) > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy(col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row for each class of the model
    classes = tuple(sorted(counts))
    if not classes:
        return BiGRU((), *(np.zeros((0, 0), np.float32) for _ in range(4)))
    each = min(sample_docs, max(1, most_docs // len(classes)))
    # from Arrow: a list of rows would go through the executors' Python, in a daemon of its own that stays
    rates = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(list(counts), pa.string()), "rate": pa.array([min(1.0, each / n) for n in counts.values()])}))
    drawn = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_003)) < F.col("rate") * F.lit(1_000_003)
    named = rows.select(col(id_col).alias("id"), col(lang_col).alias("lang"), col(text_col).alias("text"))
    picked = named.join(F.broadcast(rates), "lang").where(drawn).select("lang", "text")  # a row for each class of the model
    cut = arrow_rows(picked, lambda b: _cut(b, segments_per_doc), "lang string, bytes binary").toArrow()
    pieces, langs = cut.column("bytes").to_pylist(), cut.column("lang").to_pylist()
    if not pieces:
        return BiGRU((), *(np.zeros((0, 0), np.float32) for _ in range(4)))
    order = sorted(range(len(pieces)), key=lambda i: (langs[i], pieces[i]))  # the same model however rows arrive
    x = np.zeros((len(order), SEGMENT), np.uint8)
    for row, i in enumerate(order):
        x[row, : len(pieces[i])] = np.frombuffer(pieces[i], np.uint8)
    lengths = np.array([len(pieces[i]) for i in order])
    number = {lang: k for k, lang in enumerate(classes)}
    labels = np.array([number[langs[i]] for i in order])
    # every language weighs the same: the rarer ones are repeated up to the commonest
    most = np.bincount(labels).max()
    again = np.concatenate([np.resize(np.flatnonzero(labels == k), most) for k in range(len(classes)) if (labels == k).any()])
    return train(x[again], lengths[again], labels[again], classes, **params)


def _labels(texts: list[str], model: BiGRU) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    has = np.array([bool(model.classes) and _LETTER.search(t) is not None for t in texts], bool)
    lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    keep = np.flatnonzero(has)
    if keep.size:
        p = predict_bytes(model, [texts[i].encode("utf-8", "replace") for i in keep])
        best = p.argmax(axis=1)
        lang[keep] = np.array(model.classes, object)[best]
        score[keep] = np.clip(p[np.arange(len(keep)), best], 0.0, 1.0)
    return lang, score


def detect(docs: DataFrame, model: BiGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (the mean probability of lang_pred)."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = _labels(texts_of(batch), model)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    out = arrow_rows(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), run, schema)
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: BiGRU, text_col: str = "text", least: float = 0.35, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows, unchanged, whose language is one of languages (any learnt one) with a score of at least least."""
    wanted, at = np.array(languages or model.classes, object), docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = _labels([t if t is not None else "" for t in batch.column(at).to_pylist()], model)
        return batch.filter(pa.array(np.isin(lang.astype(str), wanted.astype(str)) & (score >= least)))

    return arrow_rows(docs, run, docs.schema)
