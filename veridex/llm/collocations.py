"""Phrase collocation mining with pivot partitioning (operator 12).

1. One pass counts words in a sketch of `WIDTH` counters and the words of each
   language. The sketch is what is broadcast: its size doesn't grow with the
   corpus, and its counters are never below a word's count, so a word whose
   counter is below `least` can be in no frequent phrase. Such words break
   texts into fragments, as punctuation does.
2. Words are ordered by (counter, word). The pivot of an n-gram is its least
   word, the leftmost place of it if there are several. A second pass routes to
   each pivot the fragment around each of its places: up to three words on
   either side, ending before a word that is less than the pivot. All n-grams
   that a place owns lie in its fragment, and no other place owns them. Equal
   fragments of a task go as one row with a count.
3. Rows are partitioned and sorted by pivot, and mined pivot by pivot: an n-gram
   is counted only at its pivot, so its count there is final and it goes no
   further if it is rare. Pivots of very many places are dealt over several
   keys, and groups that don't fit in a block are counted in parts; such counts
   are added up afterwards. A task holds one block of rows at a time.
4. The frequent n-grams, a small table, are scored by their cuts, those that a
   longer one covers are dropped, and each language's first are kept: first
   within parts of a language, then within the language.

The order of words may be any order that all tasks share, so results are exact
whatever the sketch's collisions; they only cost balance.

Null text is empty text, null language is `und` and one with the language of
that name. Repeated rows and repeated ids count each time; ids and other columns
aren't read, whatever their names. Texts without words and an empty table give
no rows. Texts are taken in pieces of about a megabyte with the words around
each cut, so a very long one needs no memory of its own beyond its bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _io
from . import _kernel as K

LEAST, LONGEST, COVERED, TOP, WIDTH = 30, 4, 80, 2000, 1 << 21
UNDETERMINED = "und"
#: Bytes of text that a task takes at once, bytes that it splits at once, rows that a mining task counts at once, and places of a pivot for one key.
TAKEN, SPLIT, ROWS, PLACES = 8 << 20, 1 << 20, 200_000, 1 << 18
_BREAK = b"\xff"  # no byte of UTF-8
_FOLD = bytes(0xFF if chr(i) in ".,;:!?\n\x0b\x0c\r" else 0x20 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_BLANK = re.compile(rb"[ \xff]")
_C = K.constants(16, 121)


class _Ids(dict):
    """Numbers words as they are first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_of(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The words of texts, in stretches; _BREAK stands where a piece ends."""
    raw = _BREAK.join(texts).translate(_FOLD)
    at = 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + SPLIT)
        end = cut.start() if cut else len(raw)
        yield raw[at:end].replace(_BREAK, b" \xff ").split()  # blanks are all that is left of what bytes.split() splits at
        at = end


def word_hash(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def by_language(batches: Iterator[pa.RecordBatch], taken: int = TAKEN) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) of columns (lang, text), some megabytes at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            held.setdefault(lang, []).append(raw := text.as_py())
            size += len(raw)
            if size >= taken:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def sketch(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(lang, slot, n): all counters of words (lang null), and the words of each language (slot -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, total = np.zeros(width, np.int64), Counter()
        for lang, texts in by_language(batches):
            seen: Counter = Counter()
            for words in words_of(texts):
                seen.update(words)
            seen.pop(_BREAK, None)
            n = np.fromiter(seen.values(), np.int64, len(seen))
            total[lang] += int(n.sum())
            np.add.at(counters, (word_hash(lang, list(seen)) % np.uint64(width)).astype(np.int64), n)
        at = np.flatnonzero(counters)
        langs = [x for x in total if total[x]]
        yield pa.RecordBatch.from_arrays([
            pa.array(langs + [None] * len(at), pa.string()), pa.array(np.concatenate([np.full(len(langs), -1), at]).astype(np.int32)),
            pa.array(np.concatenate([np.array([total[x] for x in langs], np.int64), counters[at]])),
        ], names=["lang", "slot", "n"])

    return source(docs).transform(_io.arrow_map, run, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def distinct(columns: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of distinct rows, sum of n of each). Rows are sorted by a hash and compared whole, so no two are taken for one."""
    h = np.zeros(len(n), np.uint64)
    for k, c in enumerate(columns):
        h ^= K.mix(c.astype(np.uint64) + _C[k])
        h *= _C[8 + k]
    order = np.argsort(h)
    new = np.ones(len(n), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    first = np.flatnonzero(new)
    return order[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def places(ids: np.ndarray, rank: np.ndarray, lo: int, hi: int, longest: int = LONGEST) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places of words in ids[lo:hi], words around each): 2 * longest - 1 columns
    with -1 outside of a place's fragment. rank: -1 for breaks and rare words."""
    around = longest - 1
    r = np.full(hi - lo + 2 * around, -1, np.int32)
    left, right = max(0, lo - around), min(len(ids), hi + around)
    r[left - lo + around : right - lo + around] = rank[ids[left:right]]
    m = hi - lo
    own = r[around : around + m]
    at = np.flatnonzero(own >= 0)
    columns: list[np.ndarray] = [np.zeros(0)] * (2 * around + 1)
    columns[around] = ids[lo + at]
    for step, sign in ((-1, 1), (1, 0)):
        inside = np.ones(len(at), bool)
        for k in range(1, around + 1):
            inside &= r[around + at + step * k] >= own[at] + sign  # greater on the left, not less on the right
            other = ids[np.clip(lo + at + step * k, 0, len(ids) - 1)]
            columns[around + step * k] = np.where(inside, other, -1)
    return at + lo, columns


def fragments(docs: DataFrame, counters: np.ndarray, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(key, lang, at, whole, n, words): the fragments, `words`, of each pivot, which is word `at` of it; n places have
    it. whole: all fragments of the pivot have this key."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)
    around = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in by_language(batches):
            known = _Ids()
            stop = known[_BREAK]
            ids = [np.fromiter(map(known.__getitem__, words), np.int32) for words in words_of(texts)]
            ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            words = list(known)
            h = word_hash(lang, words)
            count = shared.value[(h % np.uint64(len(shared.value))).astype(np.int64)]
            count[stop] = 0
            often = np.flatnonzero(count >= least).tolist()
            rank = np.full(len(words), -1, np.int32)
            rank[sorted(often, key=lambda k: (count[k], words[k]))] = np.arange(len(often), dtype=np.int32)
            keys = -(-count // PLACES)
            text = pa.array(words, pa.binary())
            for lo in range(0, len(ids), SPLIT):
                _, columns = places(ids, rank, lo, min(len(ids), lo + SPLIT), longest)
                first, n = distinct(columns, np.ones(len(columns[0]), np.int64))
                columns = [c[first] for c in columns]
                pivot = columns[around]
                spread = np.zeros(len(first), np.uint64)
                for k, c in enumerate(columns):
                    spread = K.mix(spread + np.where(c < 0, np.uint64(0), h[c]) * _C[k])
                salt = spread % np.maximum(keys[pivot], 1).astype(np.uint64)
                taken = [text.take(pa.array(c, mask=c < 0)) for c in columns]
                joined = pc.binary_join_element_wise(*taken, b" ", null_handling="skip").view(pa.string())
                yield from pa.Table.from_arrays([
                    pa.array((h[pivot] + K.mix(salt)).view(np.int64)), pa.array([lang] * len(first), pa.string()), pa.array(sum((c >= 0).astype(np.int32) for c in columns[:around])),
                    pa.array(keys[pivot] <= 1), pa.array(n), joined,
                ], names=["key", "lang", "at", "whole", "n", "words"]).to_batches(50_000)

    return source(docs).transform(_io.arrow_map, run, "key bigint, lang string, at int, whole boolean, n bigint, words string")


def mined(t: pa.Table, final: np.ndarray, least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, size, n) of the n-grams that the pivots of rows of t own; `final` rows hold all there is of theirs."""
    known = _Ids()
    stop = known[_BREAK]
    ids = np.fromiter(map(known.__getitem__, b" \xff ".join(t.column("words").cast(pa.binary()).to_pylist()).split(b" ")), np.int32)
    end = np.append(np.flatnonzero(ids == stop), len(ids))
    begin = np.concatenate([[0], end[:-1] + 1])
    at, n = t.column("at").to_numpy(), t.column("n").to_numpy()
    lang = t.column("lang").combine_chunks().dictionary_encode()
    of = lang.indices.to_numpy()
    pivot, right = begin + at, end - begin - 1 - at
    text = pa.array(list(known), pa.binary())
    for size in range(1, longest + 1):
        for o in range(size):
            has = np.flatnonzero((at >= o) & (right >= size - 1 - o))
            if not len(has):
                continue
            columns = [ids[pivot[has] - o + k] for k in range(size)]
            first, total = distinct([of[has], *columns], n[has])
            keep = (total >= least) | ~final[has[first]]
            first, total = first[keep], total[keep]
            phrase = pc.binary_join_element_wise(*[text.take(pa.array(c[first])) for c in columns], b" ").view(pa.string())
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(of[has[first]])), phrase, pa.array(np.full(len(first), size, np.int32)), pa.array(total)], names=["lang", "phrase", "size", "n"])


def frequent(docs: DataFrame, counters: np.ndarray, least: int = LEAST, longest: int = LONGEST, rows: int = ROWS) -> DataFrame:
    """(lang, phrase, size, a) of all n-grams of up to `longest` words that occur `least` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        open_key = None  # of which a part went before

        def counted(t: pa.Table, more: bool) -> Iterator[pa.RecordBatch]:
            nonlocal open_key
            key = t.column("key").to_numpy()
            final = t.column("whole").to_numpy().copy()
            if open_key is not None:
                final &= key != open_key
            open_key = None
            if more:
                final &= key != key[-1]
                open_key = key[-1]
            yield from mined(t, final, least, longest)

        for b in batches:  # sorted by key
            held.append(b)
            if sum(x.num_rows for x in held) < rows:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1])) or len(key)  # the last key's rows wait, unless there are no others
            yield from counted(t.slice(0, cut), cut == len(key))
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield from counted(pa.Table.from_batches(held), False)

    parts = fragments(docs, counters, least, longest).repartition("key").sortWithinPartitions("key").transform(_io.arrow_map, run, "lang string, phrase string, size int, n bigint")
    return parts.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two words or more: the lowest score of their cuts, the first of equals."""
    part = lambda name: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(f"f_{name}"))
    cuts = phrases.where("size > 1").select("lang", "phrase", "size", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - size)").alias("rest"))
    both = cuts.join(part("first"), ["lang", "first"]).join(part("rest"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    both = both.withColumn("up", wide("a") * F.lit(2000000).cast("decimal(7,0)")).withColumn("down", wide("f_first") + wide("f_rest")).withColumn("score", F.expr("up div down"))
    best = F.min(F.struct("score", "k", "f_first", "f_rest")).alias("b")
    return both.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", F.col("b.f_first").alias("l"), F.col("b.f_rest").alias("r"), F.col("b.score").alias("score"))


def covering(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, over): the largest count of a longer phrase that holds the phrase; phrases of two words or more."""
    w = phrases.where("size > 2").select("lang", "a", F.split("phrase", " ").alias("w"), "size")
    inner = w.select("lang", "a", "w", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("m")).select("lang", "a", "w", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("i"))
    return inner.select("lang", "a", F.expr("array_join(slice(w, i, m), ' ')").alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("over"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP, width: int = WIDTH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two to `longest` words.

    covered: a phrase is dropped if a longer one that holds it has so many
    hundredths of its places. width: counters of the sketch."""
    counts = _io.materialize(sketch(docs, width), "word-sketch")
    counters = np.zeros(width, np.int64)
    held = counts.where((F.col("slot") >= 0) & (F.col("n") >= least)).select("slot", "n").toPandas()  # `width` rows at most
    counters[held["slot"].to_numpy()] = held["n"].to_numpy()
    phrases = _io.materialize(frequent(docs, counters, least, longest), "phrases")
    found = scored(phrases).join(covering(phrases), ["lang", "phrase"], "left")
    over = F.col("over").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * covered
    found = found.where(F.col("over").isNull() | ~over)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    found = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for by in (["lang", "part"], ["lang"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    n = counts.where("slot = -1").select("lang", "n")
    return found.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_io.table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
sizes AS (SELECT unnest(range(1, 5)) AS size),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS i FROM worded, sizes WHERE len(w) >= size)
),
f AS (SELECT lang, phrase, size, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, CAST((2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a::HUGEINT) AS BIGINT) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, CAST(size AS BIGINT))) AS k FROM f WHERE size > 1) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, m, unnest(range(1, CAST(size - m + 2 AS BIGINT))) AS i FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(2, CAST(size AS BIGINT))) AS m FROM f WHERE size > 2))
),
over AS (SELECT lang, phrase, max(a) AS over FROM inner_phrases GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN over o USING (lang, phrase) WHERE o.over IS NULL OR 100::HUGEINT * o.over < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
