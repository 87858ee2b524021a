"""Windows of a fixed length, grouped by the least k-gram in them.

Every window of `length` bytes has a least k-gram hash (its key), so equal
windows have equal keys. Successive windows of a document with one key form a
run; a run's bytes are all that its windows cover. So two places of one window
meet under its key, and only runs of a key that differ need a closer look.
"""

from __future__ import annotations

import numpy as np

from . import _kernel as K


def run_keys(buf: np.ndarray, off: np.ndarray, length: int, k: int, p: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start within the chunk, number of starts, key) of each
    run of windows, and whether its least k-gram stands in it more than once,
    without which no window of the run equals another of it. Elements are bytes,
    or whatever p is the prefix hash of (buf then gives their number only)."""
    size = np.diff(off)
    docs = np.flatnonzero(size >= length)
    none = np.zeros(0, np.int64)
    if not len(docs):
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    p = K.prefix_hash(buf) if p is None else p
    n = len(buf) - k + 1
    inverse = K.powers(len(p))[1]
    g = K.mix((p[k:] - p[:n]) * inverse[:n])
    w = length - k + 1
    low = sliding_min(g, w)  # of window starts 0 .. len(buf) - length
    starts = np.repeat(off[docs], size[docs] - length + 1)
    count = size[docs] - length + 1
    at = starts + np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
    doc = np.repeat(docs, count)
    key = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n_starts = np.diff(np.append(first, len(at)))
    # a run of more than w windows (periodic text) is cut, so that contexts stay short
    if (n_starts > w).any():
        parts = -(-n_starts // w)
        base = np.repeat(first, parts)
        step = np.arange(len(base)) - np.repeat(np.cumsum(parts) - parts, parts)
        left = np.repeat(n_starts, parts) - step * w
        first, n_starts = base + step * w, np.minimum(left, w)
    doc, at, key = doc[first], at[first], key[first]
    return doc, at, n_starts, key, _several(g, key, at, at + n_starts + w - 1)


def _several(g: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether key occurs more than once in g[start:end], for each."""
    names = np.unique(key)
    q = np.flatnonzero(g <= names[-1])  # keys are minima, so this leaves few
    of = np.searchsorted(names, g[q])
    q, of = q[names[of] == g[q]], of[names[of] == g[q]]
    scale = len(g) + 1
    places = np.sort(of * scale + q)
    own = np.searchsorted(names, key) * scale
    return np.searchsorted(places, own + end) - np.searchsorted(places, own + start) > 1


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w successive elements."""
    n = len(x)
    if w == 1:
        return x
    m = -(-n // w) * w
    padded = np.full(m, K.NO_KEY)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])
