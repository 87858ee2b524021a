"""Suffix arrays by induced sorting, and permuted longest common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their successors.
Substrings between leftmost S suffixes are sorted by inducing from them; their
ranks make a shorter string, which is sorted recursively; its order induces the
whole array. Inducing goes through the buckets in order, several at a time: a
block of buckets is taken as far as none of its suffixes induces another into
the block, so a block is one vector operation, and all work stays linear.
"""

from __future__ import annotations

import numpy as np


def s_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the last one is."""
    n = len(s)
    t = np.empty(n, bool)
    t[-1] = True
    if n > 1:
        differ = s[:-1] != s[1:]
        at = np.where(differ, np.arange(n - 1), n - 1)
        at = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal symbols ends
        less = np.append(s[:-1] < s[1:], True)
        t[:-1] = less[at]
    return t


def _append(sa: np.ndarray, ptr: np.ndarray, at: np.ndarray, symbol: np.ndarray, step: int) -> None:
    """Puts suffixes `at` into their symbols' buckets in order; step 1: from the front, -1: from the back."""
    n = len(at)
    if n < 2:
        if n:
            k = symbol[0]
            sa[ptr[k] - (step < 0)] = at[0]
            ptr[k] += step
        return
    order = np.argsort(symbol, kind="stable")
    sym, at = symbol[order], at[order]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(sym[1:], sym[:-1], out=edge[1:n])
    edge = np.flatnonzero(edge)
    first, count = edge[:-1], edge[1:] - edge[:-1]
    rank = np.arange(n) - np.repeat(first, count)
    heads = sym[first]
    if step > 0:
        sa[ptr[sym] + rank] = at
        ptr[heads] += count
    else:
        sa[ptr[sym] - 1 - rank] = at
        ptr[heads] -= count


def _induce(sa: np.ndarray, s: np.ndarray, wanted: np.ndarray, bounds: np.ndarray, forward: bool) -> None:
    """One pass over sa. wanted: the suffixes that this pass places. bounds: bucket starts and the length."""
    k = len(bounds) - 1
    ptr = (bounds[:-1] if forward else bounds[1:]).copy()
    step, done, room = (1 if forward else -1), (0 if forward else k), 256

    def preceding(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        e = sa[bounds[lo] : bounds[hi]]
        if not forward:
            e = e[::-1]
        e = e[e > 0] - 1
        e = e[wanted[e]]
        return e, s[e]

    while done != (k if forward else 0):
        if forward:
            lo = done
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + room, "right")) - 1)
        else:
            hi = done
            lo = min(hi - 1, int(np.searchsorted(bounds, bounds[hi] - room, "left")))
        at, symbol = preceding(lo, hi)
        inside = symbol < hi if forward else symbol >= lo
        if inside.any():
            edge = int(symbol[inside].min() if forward else symbol[inside].max())
            if hi - lo > 1:
                # up to the first bucket that gets more, or that one alone
                cut = max(edge, lo + 1) if forward else min(edge + 1, hi - 1)
                lo, hi = (lo, cut) if forward else (cut, hi)
                room = max(16, room // 2)
                at, symbol = preceding(lo, hi)
                inside = symbol < hi if forward else symbol >= lo
            if inside.any():  # one bucket, which induces into itself: level by level
                b, begin = lo, int(ptr[lo])
                # suffixes of the other type in the bucket come after all of this type
                if forward:
                    front, rest = sa[bounds[b] : begin], sa[begin : bounds[b + 1]]
                else:
                    front, rest = sa[begin : bounds[b + 1]][::-1], sa[bounds[b] : begin][::-1]
                rest = rest[rest > 0].copy()
                front = front.copy()
                while len(front):
                    e = front[front > 0] - 1
                    e = e[wanted[e]]
                    own_level = e[s[e] == b]
                    _append(sa, ptr, e, s[e], step)
                    front = own_level
                e = rest - 1
                e = e[wanted[e]]
                _append(sa, ptr, e, s[e], step)
                done = hi if forward else lo
                continue
        else:
            room = min(room * 2, 1 << 20)
        _append(sa, ptr, at, symbol, step)
        done = hi if forward else lo


def _same_substrings(s: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether s[a : a + size] equals s[b : b + size], for each."""
    same = np.ones(len(a), bool)
    live, l = np.arange(len(a)), 0
    while len(live):
        differ = s[a[live] + l] != s[b[live] + l]
        same[live[differ]] = False
        l += 1
        live = live[~differ & (size[live] > l)]
    return same


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of s, whose last symbol is 0 and its only 0; symbols are below k."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    t = s_types(s)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=k))])
    is_lms = np.zeros(n, bool)
    is_lms[1:] = t[1:] & ~t[:-1]
    lms = np.flatnonzero(is_lms)

    def induced(order: np.ndarray) -> np.ndarray:
        """The array that these leftmost S suffixes, in this order, induce."""
        sa = np.full(n, -1, np.int64)
        _append(sa, bounds[1:].copy(), order[::-1], s[order[::-1]], -1)
        _induce(sa, s, ~t, bounds, True)
        placed = sa[sa >= 0]
        keep = np.zeros(n, bool)
        keep[placed] = ~t[placed]
        sa[(sa >= 0) & ~keep[np.maximum(sa, 0)]] = -1
        _put_last(sa, n)
        _induce(sa, s, t, bounds, False)
        _put_last(sa, n)
        return sa

    sa = induced(lms)
    order = sa[is_lms[sa]]
    size = np.zeros(n, np.int64)
    size[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = order[:-1], order[1:]
    new = np.ones(len(order), bool)
    alike = np.flatnonzero(size[a] == size[b])
    new[1:][alike] = ~_same_substrings(s, a[alike], b[alike], size[a][alike])
    name = np.empty(n, np.uint16 if len(order) < 1 << 16 else np.int32)
    name[order] = np.cumsum(new) - 1
    if not new.all():
        order = lms[suffix_array(name[lms], int(new.sum()))]
    return induced(order)


def _put_last(sa: np.ndarray, n: int) -> None:
    sa[0] = n - 1


def of_bytes(text: np.ndarray) -> np.ndarray:
    """The suffix array of bytes (without the end mark)."""
    s = np.zeros(len(text) + 1, np.uint16)  # numpy sorts 16-bit keys by radix
    s[:-1] = text
    s[:-1] += 1
    return suffix_array(s, 257)[1:]


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): for each suffix, in text order, the suffix before it in sa
    and the length of their common prefix.

    Only where the preceding bytes differ (irreducible values, whose sum is at
    most 2 n log n) are bytes compared, eight at a time; elsewhere the value is
    one less than at the preceding position."""
    n = len(text)
    phi = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    phi[sa[1:]] = sa[:-1]
    ahead = np.empty(n, np.uint8)  # the byte before each suffix
    ahead[1:], ahead[:1] = text[:-1], 0
    irreducible = (phi <= 0) | (ahead != ahead[phi])
    irreducible[:1] = True
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = text
    words = np.ndarray(n + 1, "<u8", padded, strides=(1,))  # eight bytes from each place on
    x = np.flatnonzero(irreducible & (phi >= 0))
    y = phi[x].astype(np.int64)
    of, value = x, np.zeros(n, np.int64)
    while len(of):
        differ = words[x] ^ words[y]
        same = np.bitwise_count((differ & -differ) - np.uint64(1)) >> 3  # low bytes in common: 8 if all are
        same = np.minimum(same, n - np.maximum(x, y))
        value[of] += same
        on = same == 8
        of, x, y = of[on], x[on] + 8, y[on] + 8
    i = np.arange(n)
    last = np.maximum.accumulate(np.where(irreducible, i, 0))
    plcp = np.maximum(value[last] - (i - last), 0)
    plcp[phi < 0] = 0
    return plcp, phi


def repeated(text: np.ndarray, length: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The valid starts, in text order, of `length` bytes that start at another
    valid place too, and a number for each that equal bytes share."""
    if len(text) <= length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sa = of_bytes(text)
    plcp, _ = permuted_lcp(text, sa)
    group = np.cumsum(plcp[sa] < length, dtype=np.int32)  # suffixes of one group share their first bytes
    here = valid[sa]
    shared = np.bincount(group[here], minlength=group[-1] + 1) > 1
    use = here & shared[group]
    number = np.full(len(text), -1, np.int32)
    number[sa[use]] = group[use]
    found = np.flatnonzero(number >= 0)
    return found, number[found]
