"""Layers on numpy arrays with their gradients: what a task computes on one tile or one batch.

Every layer is a pair: forward gives its output and what backward needs; backward turns the output's gradient into those
of the inputs and weights. Weights are (outputs, inputs).
"""

from __future__ import annotations

import math

import numpy as np

#: W. J. Cody's rational approximations of erf (up to 0.46875) and erfc (up to 4, and beyond), numerators and denominators
SMALL = (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
MIDDLE = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3), (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
LARGE = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
SINGLE = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)
#: beyond it erf is 1 in double precision
ERF_END = 6.0
NEIGHBOURS = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]


def erf(x: np.ndarray) -> np.ndarray:
    """The error function to double precision: one quotient of polynomials on each of three ranges."""
    z = np.clip(x, -ERF_END, ERF_END)
    y, t = np.abs(z), z * z
    c = _quotient(MIDDLE, np.minimum(y, 4.0))
    far = y > 4
    if far.any():
        f, r = y[far], 1 / t[far]
        c[far] = (1 / math.sqrt(math.pi) - r * _quotient(LARGE, r)) / f
    return np.where(y > 0.46875, np.copysign(1 - np.exp(-t) * c, z), z * _quotient(SMALL, np.minimum(t, 0.25)))


def _quotient(of: tuple[tuple[float, ...], tuple[float, ...]], x: np.ndarray) -> np.ndarray:
    top, bottom = (np.full_like(x, part[0]) for part in of)
    for a, b in zip(of[0][1:], of[1][1:], strict=True):
        top *= x
        top += a
        bottom *= x
        bottom += b
    return top / bottom


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x times the normal distribution function, and its derivative."""
    if x.dtype == np.float32:
        return _single_gelu(x)
    phi = 0.5 * (1 + erf(x / math.sqrt(2)))
    return x * phi, phi + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _single_gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same in single precision: Abramowitz and Stegun 7.1.26, whose error (7.5e-8 of the distribution function) is that of its digits.

    tail is the distribution function at -|x|; one exponential serves it and the density.
    """
    size = np.abs(x)
    t = 1 / (1 + np.float32(0.3275911 / math.sqrt(2)) * size)
    tail = np.full_like(t, SINGLE[0])
    for a in SINGLE[1:]:
        tail *= t
        tail += np.float32(a)
    tail *= t
    bell = np.exp(x * x * np.float32(-0.5))
    tail *= bell
    tail *= np.float32(0.5)
    up = (x > 0).astype(np.float32)
    rise = tail - up * (2 * tail - 1)
    bell *= x
    bell *= np.float32(1 / math.sqrt(2 * math.pi))
    rise += bell
    size *= tail
    return np.maximum(x, 0) - size, rise


def layer_norm(x: np.ndarray, eps: float = 1e-5, axis: int = -1) -> tuple[np.ndarray, np.ndarray]:
    d = x - x.mean(axis=axis, keepdims=True)
    scale = 1 / np.sqrt((d * d).mean(axis=axis, keepdims=True) + eps)
    return d * scale, scale


def layer_norm_back(g: np.ndarray, out: np.ndarray, scale: np.ndarray, axis: int = -1) -> np.ndarray:
    return scale * (g - g.mean(axis=axis, keepdims=True) - out * (g * out).mean(axis=axis, keepdims=True))


def shifted(x: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """x of the cell dr rows up and dc columns to the left of each cell; zeros beyond the border."""
    out = np.zeros_like(x)
    h, w = x.shape[:2]
    out[max(dr, 0) : h + min(dr, 0), max(dc, 0) : w + min(dc, 0)] = x[max(-dr, 0) : h + min(-dr, 0), max(-dc, 0) : w + min(-dc, 0)]
    return out


def neighbour_message(h: np.ndarray, there: np.ndarray, left: np.ndarray, right: np.ndarray, scorer: np.ndarray, slope: float = 0.2):
    """What one head of dynamic attention sends to each cell from its 8 neighbours and itself, and what backward needs.

    A score is scorer . leaky(left h_src + right h_dst), softmax by target, message the weighted sum of left h_src.
    """
    sent, own = h @ left.T, h @ right.T
    srcs, mixed, scores = [], [], []
    for dr, dc in NEIGHBOURS:
        s = shifted(sent, dr, dc)
        pre = s + own
        act = np.where(pre > 0, pre, slope * pre)
        srcs.append(s)
        mixed.append((act, np.where(pre > 0, 1.0, slope)))
        scores.append(np.where(shifted(there, dr, dc) & there, act @ scorer, -np.inf))
    e = np.stack(scores)
    top = np.where(there, e.max(axis=0), 0.0)
    x = np.exp(e - top)
    share = x / np.where(there, x.sum(axis=0), 1.0)
    return sum(a[..., None] * s for a, s in zip(share, srcs, strict=True)), (share, srcs, mixed)


def source_message(h: np.ndarray, sources: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, scorer: np.ndarray, slope: float = 0.2) -> np.ndarray:
    """The same from other nodes (n, width), each to the row of h (cells, width) that at names; cells without sources get zeros."""
    out = np.zeros((len(h), len(left)))
    if len(at):
        order = np.argsort(at, kind="stable")
        at, sent = at[order], sources[order] @ left.T
        pre = sent + (h @ right.T)[at]
        e = np.where(pre > 0, pre, slope * pre) @ scorer
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        x = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), np.diff(np.append(begin, len(at)))))
        out[at[begin]] = np.add.reduceat(x[:, None] * sent, begin) / np.add.reduceat(x, begin)[:, None]
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def cross_entropy(z: np.ndarray, y: np.ndarray, counted: np.ndarray) -> tuple[float, np.ndarray]:
    """The sum over counted rows of -log p of class y (from 0), and its gradient by z."""
    p = softmax(z)
    at = np.take_along_axis(p, y[..., None], axis=-1)[..., 0]
    g = p.copy()
    np.put_along_axis(g, y[..., None], (at - 1)[..., None], axis=-1)
    return float(-np.log(np.maximum(at, 1e-300))[counted].sum()), g * counted[..., None]


def cross_entropy_by_class(z: np.ndarray, y: np.ndarray, counted: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """The same for logits (classes, ..) and y (..) from 1: a few classes, each taken as a whole array. Without counted all count."""
    p = z - z.max(axis=0)
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    own = np.zeros_like(p[0])
    for k, row in enumerate(p, 1):
        hit = y == k
        own += row * hit
        row -= hit
    if counted is not None:
        own = own[..., counted]
    loss = -np.log(np.maximum(own, max(1e-300, np.finfo(p.dtype).tiny))).sum(dtype=np.float64)
    return float(loss), p if counted is None else p * counted
