"""Metrics as matrices of squared distances, and the least squared distance of two boxes.

Each kernel does the operations of the metric's SQL text in their order, so that ties fall alike.
A box bounds points in the space of its metric (``space``); gaps are a hair's breadth less than
the bound, as boxes and kernels round differently.
"""

from __future__ import annotations

import numpy as np

#: Of a gap, for rounding; cosine distances near 0 are off by ROUND times the number of features.
HAIR, ROUND = 1 - 1e-12, 1e-15


def _differences(a: np.ndarray, b: np.ndarray):
    return (a[:, f, None] - b[None, :, f] for f in range(a.shape[1]))


def _guarded(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """num / den, 0 where den is 0."""
    return np.divide(num, den, out=np.zeros(np.broadcast(num, den).shape), where=den != 0)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed feature by feature, left to right, so that ties fall as in the SQL strategy."""
    out = np.zeros((len(a), len(b)))
    for diff in _differences(a, b):
        out += diff * diff
    return out


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for diff in _differences(a, b):
        out += np.abs(diff)
    return out


def _chebyshev(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for diff in _differences(a, b):
        np.maximum(out, np.abs(diff), out=out)
    return out


def _canberra(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for f, diff in enumerate(_differences(a, b)):
        out += _guarded(np.abs(diff), np.abs(a[:, f, None]) + np.abs(b[None, :, f]))
    return out


def _braycurtis(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    den = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        den += np.abs(a[:, f, None] + b[None, :, f])
    return _guarded(_manhattan(a, b), den)


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        out += a[:, f, None] != b[None, :, f]
    return out / a.shape[1]


def _norms(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for f in range(x.shape[1]):
        out += x[:, f] * x[:, f]
    return np.sqrt(out)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dot = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        dot += a[:, f, None] * b[None, :, f]
    return 1.0 - _guarded(dot, _norms(a)[:, None] * _norms(b)[None, :])


PLAIN = {
    "manhattan": _manhattan, "cityblock": _manhattan, "l1": _manhattan, "chebyshev": _chebyshev, "canberra": _canberra,
    "braycurtis": _braycurtis, "hamming": _hamming, "cosine": _cosine,
}


def squared(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b; KeyError for an unknown metric."""
    if metric == "euclidean":
        return squared_distances(a, b)
    d = PLAIN[metric](a, b)
    return d * d


def space(metric: str, x: np.ndarray) -> np.ndarray:
    """The points as boxes bound them: directions for cosine (0 stays 0), else the points."""
    return _guarded(x, _norms(x)[:, None]) if metric == "cosine" else x


def gap(metric: str, lo: np.ndarray, hi: np.ndarray, olo: np.ndarray, ohi: np.ndarray) -> np.ndarray:
    """A lower bound of the squared distance of two boxes, features last; a point is a box of its own."""
    left, right = lo - ohi, olo - hi
    apart = np.maximum(np.maximum(left, right), 0.0)
    if metric == "euclidean":
        bound = (apart * apart).sum(axis=-1)
    elif metric == "chebyshev":
        bound = apart.max(axis=-1) ** 2
    elif metric == "hamming":
        bound = (apart > 0).mean(axis=-1) ** 2
    elif metric == "canberra":  # least where both are at the ends that face each other
        ends = np.where(right > 0, np.abs(hi) + np.abs(olo), np.abs(lo) + np.abs(ohi))
        bound = _guarded(apart, np.where(apart > 0, ends, 1.0)).sum(axis=-1) ** 2
    elif metric == "braycurtis":
        low, high = lo + olo, hi + ohi
        den = np.maximum(np.abs(low), np.abs(high)).sum(axis=-1)
        none = ((low <= 0) & (high >= 0)).all(axis=-1)  # the sums may all be 0, which is a distance of 0
        bound = _guarded(apart.sum(axis=-1), np.where(none, 0.0, den)) ** 2
    elif metric == "cosine":
        bound = np.maximum((apart * apart).sum(axis=-1) / 2 - ROUND * (8 + lo.shape[-1]), 0.0) ** 2
    else:
        bound = apart.sum(axis=-1) ** 2
    return bound * HAIR
