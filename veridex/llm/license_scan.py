"""License scans by fuzzy search for short notices (operator 7).

A notice of L characters may be found with up to k = max(1, L // 12) edits. By
the pigeonhole principle one of k + 1 pieces of it then stands in the text
unchanged: all pieces of all notices are sought at once (Aho-Corasick), each
find names a window, and the `regex` library's bounded-error matching verifies
the window and reports the span and its edits. Where spans of two notices
overlap, the one with fewer edits counts.

Text is folded first: A-Z to lower case, and each run of other bytes than
a-z, 0-9 and those above 7F to one blank; spans are given in words, counted
from 0. Plain phrases (`BASE`) are found in the same pass; their labels always
stay. Null text is empty text; it has no words, labels "" and score 0. Rows are
scanned by themselves: repeated rows give equal rows, an empty table none, and
columns besides doc_id and text aren't read. Of overlapping notices of an equal
share of edits the one that is listed first counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from . import _kernel as K

# Phrases, notices and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("released under the bsd license", "bsd"),
    ("is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved unauthorized copying of this file is strictly prohibited", "proprietary"),
)
LETTERS_PER_EDIT = 12
_WORD = K.word_table(b"")


def edits_allowed(notice: str) -> int:
    return max(1, len(notice) // LETTERS_PER_EDIT)


def pieces(notice: str) -> list[tuple[int, str]]:
    """(offset, text) of the parts, one more than the edits allowed."""
    cut = np.linspace(0, len(notice), edits_allowed(notice) + 2).astype(int).tolist()
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


@dataclass
class Found:
    """A chunk's result. notices: (document, notice, first word, last word, edits)."""

    n_words: np.ndarray
    base: list[list[tuple[int, int, str]]] = field(default_factory=list)
    notices: list[list[tuple[int, int, int, int]]] = field(default_factory=list)


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, base: tuple[tuple[str, str], ...] = BASE):
        self.notices, self.base = notices, base
        self.exact = [regex.compile(r"(?e)(?:%s){e<=%d}" % (regex.escape(n), edits_allowed(n))) for n, _ in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (n, _) in enumerate(notices):
            for at, piece in pieces(n):
                seeds.setdefault(_latin(piece), []).append((k, at))
        for k, (phrase, _) in enumerate(base):
            seeds.setdefault(_latin(phrase), []).append((-1 - k, 0))
        self.seeds = ahocorasick.Automaton()
        for text, what in seeds.items():
            self.seeds.add_word(text, (len(text), what))
        self.seeds.make_automaton()

    def scan(self, buf: np.ndarray, off: np.ndarray) -> Found:
        text, at, s, first = fold(buf, off)
        out = Found(np.diff(first))
        n = len(off) - 1
        out.base, out.notices = [[] for _ in range(n)], [[] for _ in range(n)]
        starts = np.flatnonzero(at < 0)  # the mark before each document
        seen: dict[int, list[tuple[int, int]]] = {}
        maybe: dict[int, list[tuple[int, int, int, int]]] = {}
        for last, (length, what) in self.seeds.iter(text):
            begin = last - length + 1
            for k, shift in what:
                if k < 0:
                    if text[begin - 1] in " \n" and (last + 1 == len(text) or text[last + 1] in " \n"):
                        d = int(np.searchsorted(starts, begin, "right")) - 1
                        w = int(np.searchsorted(s, at[begin])) - int(first[d])
                        out.base[d].append((w, w, self.base[-1 - k][1]))
                    continue
                notice, slack = self.notices[k][0], edits_allowed(self.notices[k][0])
                lo = begin - shift
                if any(a - slack <= lo <= b + slack for a, b in seen.get(k, ())[-4:]):
                    continue
                d = int(np.searchsorted(starts, begin, "right")) - 1
                left, right = int(starts[d]) + 1, int(starts[d + 1]) if d + 1 < n else len(text)
                lo, hi = max(left, lo - slack), min(right, lo + len(notice) + slack)
                m = self.exact[k].search(text, lo, hi)
                if m:
                    seen.setdefault(k, []).append((m.start(), m.start()))
                    maybe.setdefault(d, []).append((sum(m.fuzzy_counts), k, m.start(), m.end()))
        for d, spans in maybe.items():
            taken: list[tuple[int, int]] = []
            for edits, k, a, b in sorted(spans, key=lambda x: (x[0] / len(self.notices[x[1]][0]), x[1:])):
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    inner = [x for x in range(a, b) if text[x] != " "]
                    w = np.searchsorted(s, at[[inner[0], inner[-1]]], "right") - 1 - first[d]
                    out.notices[d].append((k, int(w[0]), int(w[1]), edits))
        return out


def _latin(text: str) -> str:
    return text.encode().decode("latin-1")


def fold(buf: np.ndarray, off: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(folded text of the chunk, a character a byte, with a line break before
    each document; the byte each character comes from, -1 for those breaks;
    word starts; first word of each document)."""
    low = K._LOWER[buf]
    word = _WORD[low]
    s, _, first = K.spans(low, off, _WORD)
    keep = word.copy()
    keep[1:] |= word[:-1]
    if len(cut := off[:-1][off[:-1] < len(buf)]):
        keep[cut] = word[cut]
    idx = np.flatnonzero(keep)
    doc = np.searchsorted(off, idx, "right") - 1
    n = len(off) - 1
    at = np.full(len(idx) + n, -1, np.int64)
    to = np.arange(len(idx)) + doc + 1
    at[to] = idx
    out = np.full(len(at), 10, np.uint8)
    out[to] = np.where(word[idx], low[idx], 32)
    return out.tobytes().decode("latin-1"), at, s, first


COLUMNS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, notices array<struct<label: string, first_word: bigint, last_word: bigint, edits: int>>"
_NOTICE = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """(doc_id, COLUMNS) of every row; one map, no shuffle. score: 1 less the
    share of edits in the best notice; a base phrase counts 0.9."""
    from pyspark.sql.types import StructType

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, base)
        for b in batches:
            buf, off = K.utf8(b.column(1))
            rows: list[tuple] = []
            for _, _, c, o in K.chunks(buf, off):
                f = scanner.scan(c, o)
                for n, hits, found in zip(f.n_words.tolist(), f.base, f.notices, strict=True):
                    if not hits and not found:
                        rows.append((n, 0, None, None, "", "", 0.0, []))
                        continue
                    own = {x[2] for x in hits}
                    spans = [{"label": notices[k][1], "first_word": a, "last_word": z, "edits": e} for k, a, z, e in sorted(found, key=lambda x: x[1:])]
                    best = max([0.9 * bool(hits), *(1 - e / len(notices[k][0]) for k, _, _, e in found)])
                    rows.append((n, len(hits), min((x[0] for x in hits), default=None), max((x[0] for x in hits), default=None), ",".join(sorted(own)), ",".join(sorted(own | {x["label"] for x in spans})), best, spans))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), _NOTICE]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in zip(cols, types, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"])

    return src.transform(_io.arrow_map, run, StructType([src.schema["doc_id"], *StructType.fromDDL(COLUMNS).fields]))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_io.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("notices").cast("bigint").alias("n_notices"))
