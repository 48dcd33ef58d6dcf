"""A tile as planes: arrays (features, places) in which a neighbour is the same array some places further on.

A row of a tile is followed by one empty place, which lies between its last cell and the next row's first, so no neighbour wraps around. What cells send
lies in a longer array with an empty row before and after, and each of the nine neighbours' values is a slice of it, not a copy.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from cellgrove.operators import dense


class Planes:
    """Where the places of a tile lie, and which of their neighbours exist."""

    def __init__(self, there: np.ndarray):
        self.height, self.width = there.shape
        self.stride = self.width + 1
        self.places = self.height * self.stride
        self.first = self.stride + 1  # of a tile's places in the longer array
        self.length = self.places + 2 * self.first
        self.slices = [slice(at, at + self.places) for at in (self.first + dr * self.stride + dc for dr, dc in dense.NEIGHBOURS)]
        self.own = slice(self.first, self.first + self.places)
        self.there = self.of(there[..., None])[0]
        known = np.zeros(self.length, bool)
        known[self.own] = self.there
        self.valid = np.stack([known[s] & self.there for s in self.slices])

    def of(self, x: np.ndarray) -> np.ndarray:
        """(height, width, features) as planes; places without a cell are 0."""
        out = np.zeros((x.shape[-1], self.height, self.stride), x.dtype)
        out[:, :, : self.width] = np.moveaxis(x, -1, 0)
        return out.reshape(len(out), -1)

    def back(self, x: np.ndarray) -> np.ndarray:
        return np.moveaxis(x.reshape(len(x), self.height, self.stride)[:, :, : self.width], 0, -1)


@lru_cache(maxsize=32)
def _planes(shape: tuple[int, int], there: bytes) -> Planes:
    return Planes(np.frombuffer(there, bool).reshape(shape))


def planes(there: np.ndarray) -> Planes:
    """The planes of a tile; most tiles of a raster share theirs."""
    return _planes(there.shape, np.ascontiguousarray(there, bool).tobytes())


def attention(h: np.ndarray, at: Planes, left: np.ndarray, right: np.ndarray, scorer: np.ndarray, slope: float = 0.2):
    """A layer: ``dense.neighbour_message``, residual, LayerNorm and GELU over states (width, places), and what backward needs.

    leaky(x) is x (1 + slope) / 2 + |x| (1 - slope) / 2. Of the first part of a score only what the source adds counts, as what the target adds
    is the same for all its neighbours and softmax takes it off.
    """
    sent = np.zeros((len(left), at.length), h.dtype)
    np.matmul(left, h, out=sent[:, at.own])
    own, alone, bent = right @ h, scorer @ sent * ((1 + slope) / 2), scorer * ((1 - slope) / 2)
    pre = np.empty((len(at.slices), *own.shape), h.dtype)
    size, e = np.empty_like(pre), np.empty((len(pre), at.places), h.dtype)
    for k, s in enumerate(at.slices):
        np.add(sent[:, s], own, out=pre[k])
        np.abs(pre[k], out=size[k])
        np.add(bent @ size[k], alone[s], out=e[k])
    e = np.where(at.valid, e, -np.inf)
    e -= np.where(at.there, e.max(axis=0), 0)
    share = np.exp(e, out=e)
    share /= np.where(at.there, share.sum(axis=0), 1)
    t, one = h.copy(), np.empty_like(own)
    for a, s in zip(share, at.slices, strict=True):
        t += np.multiply(a, sent[:, s], out=one)
    n, scale = dense.layer_norm(t, axis=0)
    out, rise = dense.gelu(n)
    out *= at.there
    return out, (h, share, sent, pre, size, n, scale, rise)


def attention_back(g: np.ndarray, kept, at: Planes, left: np.ndarray, right: np.ndarray, scorer: np.ndarray, slope: float = 0.2):
    """Gradients of h and of the three weights.

    Those of a target's scores add up to 0, so of leaky's first part nothing comes back to the target, and to a source as much as it scored alone.
    """
    h, share, sent, pre, size, n, scale, rise = kept
    gt = dense.layer_norm_back(g * at.there * rise, n, scale, axis=0)
    ge = np.stack([np.einsum("dn,dn->n", gt, sent[:, s]) for s in at.slices])
    ge -= (share * ge).sum(axis=0)
    ge *= share
    linear, bent = (1 + slope) / 2, scorer * ((1 - slope) / 2)
    alone, g_sent, g_size = np.zeros(at.length, h.dtype), np.zeros_like(sent), np.zeros_like(scorer)
    g_own, one, two = np.zeros_like(pre[0]), np.empty_like(pre[0]), np.empty_like(pre[0])
    least = np.finfo(h.dtype).tiny
    for a, e, p, q, s in zip(share, ge, pre, size, at.slices, strict=True):
        alone[s] += e
        g_size += q @ e
        np.divide(p, np.maximum(q, least, out=one), out=one)  # the sign
        one *= e
        one *= bent[:, None]
        g_own += one
        one += np.multiply(a, gt, out=two)
        g_sent[:, s] += one
    g_sent += (linear * scorer)[:, None] * alone
    back = g_sent[:, at.own]
    return gt + left.T @ back + right.T @ g_own, back @ h.T, g_own @ h.T, linear * (sent @ alone) + (1 - slope) / 2 * g_size
