"""Code-point views of text chunks: letters, folding, words."""

from __future__ import annotations

from functools import cache

import numpy as np

N_POINTS = 0x110000


@cache
def is_letter() -> np.ndarray:
    t = np.fromiter((chr(i).isalpha() for i in range(0x20000)), bool, 0x20000)
    return np.concatenate([t, np.zeros(N_POINTS - 0x20000, bool) | _upper_planes()])


@cache
def is_word() -> np.ndarray:
    """Letters and decimal digits."""
    t = is_letter().copy()
    t[:0x20000] |= np.fromiter((chr(i).isdecimal() for i in range(0x20000)), bool, 0x20000)
    return t


def _upper_planes() -> np.ndarray:
    t = np.zeros(N_POINTS - 0x20000, bool)
    t[: 0x14000] = np.fromiter((chr(i).isalpha() for i in range(0x20000, 0x34000)), bool, 0x14000)
    return t


@cache
def folded() -> np.ndarray:
    """Lower case of each code point where that is one code point too."""
    out = np.arange(N_POINTS, dtype=np.uint32)
    for i in range(0x1F000):
        if not 0xD800 <= i < 0xE000 and len(low := chr(i).lower()) == 1:
            out[i] = ord(low)
    return out


def points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets of n + 1) of a chunk of UTF-8 texts."""
    cp = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=starts[1:])
    return cp, starts[off]


def word_runs(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first run of each document and the total) of runs of letters and digits."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = is_word()[cp]
    begin, end = np.empty(n, bool), np.empty(n, bool)
    begin[0], end[-1] = w[0], w[-1]
    np.greater(w[1:], w[:-1], out=begin[1:])
    np.greater(w[:-1], w[1:], out=end[:-1])
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begin[cut] = w[cut]
    end[cut - 1] = w[cut - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)
