"""Vectorised text kernels over Arrow string buffers.

Everything here works on UTF-8 bytes in numpy, on chunks of about a quarter of a
megabyte, so a worker's memory doesn't grow with a batch. One document is
never divided: a very long one makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
#: Low bits of a sketch key that hold a position; the rest holds the hash.
POS_BITS = np.uint64(26)
POS_MASK = np.uint64((1 << 26) - 1)
NO_KEY = np.uint64(0xFFFFFFFFFFFFFFFF)

_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)
_G = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser (a published constant mixer)."""
    x = x ^ (x >> np.uint64(30))
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that depend on nothing but seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _G + np.uint64(seed)) | np.uint64(1)


_BYTE = constants(256, 11)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n and their inverses modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base & _M64))
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix_hash(buf: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """P with P[j] - P[i] = sum of table[buf[t]] * base**t over i <= t < j."""
    p = np.empty(len(buf) + 1, np.uint64)
    p[0] = 0
    np.cumsum(table[buf] * powers(len(buf))[0][: len(buf)], out=p[1:])
    return p


def prefix_of(values: np.ndarray) -> np.ndarray:
    """As prefix_hash, of 64-bit values."""
    p = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span that depends on its bytes alone."""
    return mix((p[end] - p[start]) * powers(len(p))[1][start] + (end - start).astype(np.uint64) * _G)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # pyarrow splits above 2 GB
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks])
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(buf: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of successive chunks."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_table(extra: bytes = b"_") -> np.ndarray:
    """True for bytes of words: ASCII letters, digits, `extra`, and all above 7F."""
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    t[list(extra)] = True
    return t


def spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first span of each document and the total) of runs of table's bytes within documents."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = table[buf]
    begin, end = np.empty(n, bool), np.empty(n, bool)
    begin[0], end[-1] = w[0], w[-1]
    np.greater(w[1:], w[:-1], out=begin[1:])
    np.greater(w[:-1], w[1:], out=end[:-1])
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    if len(cut):
        begin[cut] = w[cut]
        end[cut - 1] = w[cut - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each span."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


class Grams:
    """Occurrence-numbered word k-grams of a chunk's documents, in text order.

    hash: of each k-gram with its occurrence number, equal for equal words
    (ASCII case aside). first: the first k-gram of each document and the total.
    A document of 1 to k - 1 words has one gram of all its words; one without
    words has none.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, k: int, table: np.ndarray):
        low = _LOWER[buf]
        s, e, first = spans(low, off, table)
        n_words = np.diff(first)
        self.n_words, self.word_first = n_words, first
        self.words = words = span_hash(prefix_hash(low), s, e) if len(s) else np.zeros(0, np.uint64)
        n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
        self.first = np.concatenate([[0], np.cumsum(n)])
        total = int(self.first[-1])
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(total) - self.first[doc] + first[doc]
        c = constants(k, 77)
        g = np.zeros(total, np.uint64)
        padded = np.concatenate([words, np.zeros(k, np.uint64)])
        short = (n_words < k)[doc] if total else np.zeros(0, bool)
        for j in range(k):
            x = padded[at + j] * c[j]
            if short.any():
                x[short & (j >= n_words[doc])] = 0
            g += x
        g = mix(g)
        self.hash = numbered(g, doc)


def numbered(g: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """g with the occurrence number within its document mixed in, from the second occurrence on."""
    if len(g) < 2:
        return g
    own = g ^ (doc.astype(np.uint64) * _G)
    s = np.sort(own)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return g
    again = np.flatnonzero(np.isin(own, np.unique(twice)))
    order = again[np.argsort(own[again], kind="stable")]
    v = own[order]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    start = np.flatnonzero(new)
    count = np.arange(len(v)) - np.repeat(start, np.diff(np.concatenate([start, [len(v)]])))
    g = g.copy()
    later = count > 0
    g[order[later]] = mix(g[order[later]] + count[later].astype(np.uint64) * _B)
    return g


def order_minhash(grams: Grams, m: int, ell: int, seed: int = 5) -> np.ndarray:
    """(documents, m, ell) hashes: under each of m hash functions the ell
    smallest grams of a document, put back in text order. A document with
    fewer than ell grams repeats its last; one without any has zeros."""
    n = len(grams.first) - 1
    out = np.zeros((n, m, ell), np.uint64)
    some = np.flatnonzero(np.diff(grams.first))
    if not len(some):
        return out
    starts, h = grams.first[some], grams.hash
    if len(h) > int(POS_MASK):  # places don't fit into POS_BITS: the same order, document by document
        for i, c in enumerate(constants(m, seed)):
            for d in some.tolist():
                own = h[grams.first[d] : grams.first[d + 1]]
                at = np.argsort((own * c) >> POS_BITS, kind="stable")[:ell]
                out[d, i, :] = own[np.sort(np.append(at, np.repeat(at[-1:], ell - len(at))))]
        return out
    pos = np.arange(len(h), dtype=np.uint64)
    key, a = np.empty_like(h), constants(m, seed)
    at = np.empty((ell, len(some)), np.uint64)
    for i in range(m):
        np.multiply(h, a[i], out=key)
        np.bitwise_and(key, ~POS_MASK, out=key)
        np.bitwise_or(key, pos, out=key)
        for j in range(ell):
            low = np.minimum.reduceat(key, starts)
            p = low & POS_MASK
            at[j] = np.where(low == NO_KEY, at[j - 1] if j else 0, p)
            key[p[low != NO_KEY].astype(np.int64)] = NO_KEY
        out[some, i, :] = h[np.sort(at, axis=0).astype(np.int64)].T
    return out


def tuple_hash(sketch: np.ndarray) -> np.ndarray:
    """(documents, m) hash of each tuple; order counts."""
    c = constants(sketch.shape[2], 31)
    with np.errstate(over="ignore"):
        return mix((sketch * c).sum(axis=2, dtype=np.uint64))
