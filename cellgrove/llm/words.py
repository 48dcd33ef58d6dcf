"""Words of whole texts as arrays: hashed straight from Arrow buffers, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cellgrove.llm.common import TASK_CACHES

_BYTES = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z like a-z
_SOLID = np.ones(256, bool)
_SOLID[[32, *range(9, 14)]] = False
_BYTES[~_SOLID] = 0
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
TASK_CACHES.append(_POWERS)
#: bytes of texts that are taken at once, which bounds the arrays made from them
AT_ONCE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, at least n of each."""
    if len(_POWERS.get(_ODD, ())) < n:
        for odd in (_ODD, _INVERSE):
            base = np.full(n + n // 4, np.uint64(odd))
            base[:1] = 1
            _POWERS[odd] = np.multiply.accumulate(base)
    return _POWERS[_ODD], _POWERS[_INVERSE]


def places(n_each: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of consecutive runs of so many elements."""
    return np.arange(n_each.sum()) - np.repeat(np.cumsum(n_each) - n_each, n_each)


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words [^\\x20\\x09-\\x0D]+ of texts that lie between offsets of data: 64-bit hashes (A-Z lower-cased),
    where each begins and ends, and the first word of each text (with the number of words at the end)."""
    solid = (data != 32) & (data - np.uint8(9) > 4)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.zeros(len(begin), np.uint64)
    lo = 0
    while lo < len(begin):  # some bytes at a time, however long a text is
        hi = max(lo + 1, int(np.searchsorted(end, begin[lo] + AT_ONCE, "right")))
        a, b = begin[lo:hi] - begin[lo], end[lo:hi] - begin[lo]
        power, inverse = _powers(int(b[-1]))
        sums = np.empty(b[-1] + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[data[begin[lo] : end[hi - 1]]] * power[: b[-1]], out=sums[1:])
        out[lo:hi] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        lo = hi
    return out, begin, end, np.searchsorted(begin, offsets)


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of one text in UTF-8, in order."""
    return hash_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]


def chunks(column: pa.Array, at_once: int = AT_ONCE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string column, some texts at a time; a null is an empty text."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if whole.null_count:
        whole = whole.fill_null("")
    if not len(whole):
        return
    wide = pa.types.is_large_string(whole.type) or pa.types.is_large_binary(whole.type)
    _, ends, values = whole.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(whole):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + at_once, "right")) - 1)
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi
