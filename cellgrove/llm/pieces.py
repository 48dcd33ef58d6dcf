"""SentencePiece encoding and decoding (BPE models with byte fallback) by suffix-array matching.

A batch's texts become words (a run of ``▁`` and what follows it), since no piece has a ``▁`` behind another
character. The distinct words, concatenated, are indexed by a suffix array; every piece of the vocabulary is
found by binary search as a range of suffixes, all pieces at once; the ranges' positions are edges of the
words, sorted by end position, and relaxed from left to right. A BPE model does not ask for the path of
best total score but for the one its merges lead to: a prefix's encoding ends in the one edge whose piece is
compatible with the last piece of the encoding before it, that is, the two are still two after merging. So
relaxing keeps an edge only if it is compatible; the result is the library's encoding, exactly.

Characters without a piece fall back to their UTF-8 bytes. Null and empty texts give no ids. Very long texts
are encoded whole. Models whose pieces span words, or that are not BPE with byte fallback and identity
normalisation, are refused. Repeated rows encode alike.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellgrove.llm.common import col, ship, texts_of

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_MODELS: dict[str, Vocabulary] = {}


class Vocabulary:
    """Pieces, ids and merge ranks of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.vocab_size()
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        self.bytes = np.array([p.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        plain = [i for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain) or any(p.is_unknown(int(i)) for i in self.bytes):
            raise ValueError("a BPE model with byte fallback, whose pieces stay within words, is needed")
        self.rank = {self.pieces[i]: -p.get_score(i) for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        order = sorted(plain, key=lambda i: self.pieces[i])
        self.sorted_ids = np.array(order, np.int64)
        self.longest = max(len(self.pieces[i]) for i in plain)
        self.sizes = np.array([len(self.pieces[i]) for i in order], np.int64)
        self.chars = np.zeros((len(order), self.longest), np.int32)
        for row, i in enumerate(order):
            self.chars[row, : self.sizes[row]] = [ord(c) for c in self.pieces[i]]
        self.by_id = {i: self.pieces[i] for i in plain}
        # by id: the character or piece; None for bytes above ASCII and for what has no text
        self.shown = [self.pieces[i] if i in self.by_id else None for i in range(n)]
        for b in range(128):
            self.shown[int(self.bytes[b])] = chr(b)
        self.byte_of = {int(i): b for b, i in enumerate(self.bytes)}
        self.words: dict[str, bytes] = {}
        self.pair_keys, self.pair_values = np.zeros(0, np.int64), np.zeros(0, bool)

    def merged(self, text: str) -> list[str]:
        """Plain merging of one short string: of the adjacent pairs that form a piece the best-ranked, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(np.inf, 0))
            if best[0] == np.inf:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of ids stays two pieces when merged; answers are kept in a sorted table of a bounded size."""
        key = left * len(self.pieces) + right
        at = np.searchsorted(self.pair_keys, key)
        known = self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] == key if len(self.pair_keys) else np.zeros(len(key), bool)
        if not known.all():
            new = np.unique(key[~known])
            value = np.array([self._two(int(k)) for k in new], bool)
            if len(self.pair_keys) > 3_000_000:
                self.pair_keys, self.pair_values = self.pair_keys[:0], self.pair_values[:0]
            order = np.argsort(keys := np.concatenate([self.pair_keys, new]), kind="stable")
            self.pair_keys, self.pair_values = keys[order], np.concatenate([self.pair_values, value])[order]
            return self.compatible(left, right)
        return self.pair_values[at]

    def _two(self, key: int) -> bool:
        a, b = self.by_id[key // len(self.pieces)], self.by_id[key % len(self.pieces)]
        return self.merged(a + b) == [a, b]


def vocabulary(path: str) -> Vocabulary:
    if path not in _MODELS:
        _MODELS[path] = Vocabulary(path)
    return _MODELS[path]


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of the integers x in the order of their first depth items: packed first items, then prefix doubling."""
    n = len(x)
    kinds, rank = np.unique(x, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    width = int(len(kinds) + 1).bit_length()
    k = max(1, 62 // width)
    key, shifted = np.zeros(n, np.int64), np.concatenate([rank, np.zeros(k, np.int64)])
    for j in range(k):
        key = (key << width) | shifted[j : j + n]
    order = np.argsort(key)
    while k < depth:
        steps = np.empty(n, bool)
        steps[0], steps[1:] = True, np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(steps)
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = rank[k:]
        key = rank * (n + 2) + second
        order = np.argsort(key)
        k *= 2
    return order


def occurrences(x: np.ndarray, order: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi): each sorted piece's range of suffixes in order, narrowed character by character."""
    n, m = len(x), len(v.sizes)
    padded = np.concatenate([x, np.zeros(v.longest, x.dtype)])
    lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
    for d in range(v.longest):
        live = np.flatnonzero((v.sizes > d) & (lo < hi))
        if not len(live):
            break
        want = v.chars[live, d]
        for right in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                c = padded[order[np.minimum(mid, n - 1)] + d]
                up = open_ & ((c <= want) if right else (c < want))
                a = np.where(up, mid + 1, a)
                b = np.where(open_ & ~up, mid, b)
            if right:
                hi[live] = a
            else:
                new_lo = a
        lo[live] = new_lo
    return lo, hi


def _encode_words(words: list[str], v: Vocabulary) -> list[bytes]:
    """Ids of the distinct words, as little-endian unsigned 32-bit integers."""
    text = "\0".join(words) + "\0"
    x = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int32)
    order = suffix_array(x, v.longest)
    lo, hi = occurrences(x, order, v)
    count = np.maximum(hi - lo, 0)
    piece = np.repeat(np.arange(len(count)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = order[lo[piece] + place]
    end = start + v.sizes[piece]
    by_end = np.argsort(end * (v.longest + 1) - v.sizes[piece])
    start, end, ids = start[by_end], end[by_end], v.sorted_ids[piece[by_end]]
    first = np.searchsorted(end, np.arange(len(x) + 2))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.cumsum(sizes + 1) - sizes - 1
    # last piece and its start for the encoding of each prefix, by end position; -2: a character in bytes
    last, back = np.full(len(x) + 1, -1, np.int64), np.arange(-1, len(x), dtype=np.int64)
    by_size = np.argsort(-sizes)
    for e in range(1, int(sizes.max()) + 1):
        live = by_size[: np.searchsorted(-sizes[by_size], -e, side="right")]
        here = at[live] + e
        n_edges = first[here + 1] - first[here]
        owner = np.repeat(here, n_edges)
        edge = np.arange(int(n_edges.sum())) - np.repeat(np.cumsum(n_edges) - n_edges, n_edges) + np.repeat(first[here], n_edges)
        before = last[start[edge]]
        ok = before == -2
        ok |= start[edge] == np.repeat(at[live], n_edges)
        ask = np.flatnonzero(~ok & (before >= 0))
        ok[ask] = v.compatible(before[ask], ids[edge[ask]])
        edge, owner = edge[ok], owner[ok]
        last[here] = -2
        last[owner[::-1]], back[owner[::-1]] = ids[edge[::-1]], start[edge[::-1]]
    out = []
    lasts, backs = last.tolist(), back.tolist()
    for w, lo_, size in zip(words, at.tolist(), sizes.tolist(), strict=True):
        found: list[int] = []
        e = lo_ + size
        while e > lo_:
            if lasts[e] >= 0:
                found.append(lasts[e])
            else:
                found.extend(v.bytes[list(w[e - lo_ - 1].encode("utf-8", "replace"))][::-1].tolist())
            e = backs[e]
        out.append(struct.pack(f"<{len(found)}I", *found[::-1]))
    return out


def encode(texts: list[str], path: str, block: int = 400_000, keep: int = 800_000) -> list[bytes]:
    """The ids of each text (4 bytes each).

    block: characters of distinct words that are indexed together; keep: words whose ids are kept over batches.
    """
    v = vocabulary(path)
    if len(v.words) > keep:
        v.words.clear()
    known = v.words
    split = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    new, size = [], 0
    for w in sorted(set().union(*split).difference(known)):
        new.append(w)
        size += len(w) + 1
        if size > block:
            known.update(zip(new, _encode_words(new, v), strict=True))
            new, size = [], 0
    if new:
        known.update(zip(new, _encode_words(new, v), strict=True))
    return [b"".join(map(known.__getitem__, ws)) for ws in split]


def decode(ids: bytes, path: str) -> str:
    """The text of ids: pieces and byte runs joined, ``▁`` as blank, the first blank dropped."""
    v = vocabulary(path)
    numbers = np.frombuffer(ids, "<u4").tolist()
    try:
        text = "".join(map(v.shown.__getitem__, numbers))
    except TypeError:  # bytes of characters without a piece
        out = bytearray()
        for i in numbers:
            if v.shown[i] is not None:
                out += v.shown[i].encode()
            elif i in v.byte_of:
                out.append(v.byte_of[i])
        text = out.decode("utf-8", "replace")
    text = text.replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def encode_column(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 2000) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    return _run(docs, model_path, id_col, text_col, rows, False)


def encode_checked(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 2000) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and whether decoding gives the text back (U+2581 itself reads as a blank)."""
    return _run(docs, model_path, id_col, text_col, rows, True)


def _run(docs: DataFrame, model_path: str, id_col: str, text_col: str, rows: int, checked: bool) -> DataFrame:
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                b = whole.slice(lo, rows)
                texts = texts_of(b)
                ids = encode(texts, model_path)
                if checked:
                    same = [decode(i, model_path) == t.replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "decoded"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    schema = f"doc_id {kind}, " + ("n_tokens long, ids_crc32 long, decoded boolean" if checked else "ids array<int>")
    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, schema)


def decode_column(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of arrays of ids; null ids give null."""
    ship(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if i is None else decode(np.array(i, "<u4").tobytes(), model_path) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select(col(id_col).alias("doc_id"), col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
