"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 10).

Characters are folded to lower case; each run of other characters than letters
counts as one blank. The n-grams of 1 to 3 characters of a text, hashed into
2**16 buckets, are its features. The log-probability matrix (buckets x
languages) is broadcast; a batch is scored in numpy from the buckets that occur.

The model is fitted on a sample of labelled rows of about `max_train` (20,000)
documents, chosen by a hash of doc_id, so it doesn't grow with the corpus; more
than MAX_LANGUAGES (400; half a megabyte of matrix each) are refused.
Every row is scored over its whole text. Null text, empty text and text without
a letter get language `und` and score 0; so does every row if nothing is
labelled. Ties go to the language that is first by code point. Rows are scored
by themselves, so repeated rows give equal rows, and an empty table none. Other
columns are carried; in `identify` a column named as a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from . import _kernel as K
from . import _points as P

NGRAMS, BUCKET_BITS, SMOOTHING, MAX_TRAIN, MAX_LANGUAGES = (1, 2, 3), 16, 0.5, 20_000, 400
#: Likelihoods of longer texts are scaled to so many n-grams, so that scores of mixed texts stay below 1.
FULL_WEIGHT = 300
UNDETERMINED = "und"
_C = K.constants(8, 91)


def features(buf: np.ndarray, off: np.ndarray, ngrams: tuple[int, ...] = NGRAMS, bits: int = BUCKET_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each n-gram, document of each) for each n, letters required."""
    cp, at = P.points(buf, off)
    letter = P.is_letter()[cp]
    x = np.where(letter, P.folded()[cp], np.uint32(32))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    keep = np.ones(len(x), bool)
    keep[1:] = letter[1:] | letter[:-1] | (doc[1:] != doc[:-1])
    x, letter, doc = x[keep].astype(np.uint64), letter[keep], doc[keep]
    for n in ngrams:
        if len(x) < n:
            continue
        m = len(x) - n + 1
        h = x[:m] * _C[0]
        some = letter[:m].copy()
        for j in range(1, n):
            h += x[j : j + m] * _C[j]
            some |= letter[j : j + m]
        some &= doc[:m] == doc[n - 1 :]
        h = ((h + np.uint64(n)) * _C[7]) >> np.uint64(64 - bits)
        yield h[some].astype(np.int64), doc[:m][some]


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    weight: np.ndarray  # languages x buckets
    ngrams: tuple[int, ...] = NGRAMS
    bits: int = BUCKET_BITS

    def score(self, buf: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        n, k = len(off) - 1, len(self.languages)
        total, count = np.zeros((n, max(k, 1))), np.zeros(n, np.int64)
        for h, doc in features(buf, off, self.ngrams, self.bits):
            if not len(h):
                continue
            start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            count[doc[start]] += np.diff(np.concatenate([start, [len(h)]]))
            for j in range(k):
                total[doc[start], j] += np.add.reduceat(self.weight[j][h], start)
        if not k:
            return [UNDETERMINED] * n, np.zeros(n)
        total *= np.minimum(1.0, FULL_WEIGHT / np.maximum(count, 1))[:, None]
        total += self.prior
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        found = count > 0
        return [self.languages[b] if f else UNDETERMINED for b, f in zip(best.tolist(), found.tolist(), strict=True)], np.where(found, p[np.arange(n), best], 0.0)


def remainder(id_col: Column, mod: int) -> Column:
    return F.crc32(id_col.cast("string")) % mod


def sampled(rows: DataFrame, key: Column, about: int) -> DataFrame:
    """About `about` of the rows, chosen by a hash of key: the same ones in every run."""
    n = rows.count()
    if n <= about:
        return rows
    return rows.where(F.pmod(F.xxhash64(key.cast("string"), F.lit(17)), F.lit(1 << 20)) < int((1 << 20) * about / n))


def fit(docs: DataFrame, max_train: int = MAX_TRAIN, smoothing: float = SMOOTHING, ngrams: tuple[int, ...] = NGRAMS, bits: int = BUCKET_BITS) -> Model:
    """A model of the rows of docs (doc_id, text, lang) that have a language."""
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null")
    train = sampled(labelled, F.col("doc_id"), max_train).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for b in batches:
            lang = np.array(b.column(1).to_pylist(), object)
            buf, off = K.utf8(b.column(0))
            for i, j, c, o in K.chunks(buf, off):
                own = lang[i:j]
                for x in set(own.tolist()):
                    sums.setdefault(x, np.zeros(1 << bits, np.int64))
                    seen[x] = seen.get(x, 0) + int((own == x).sum())
                for h, doc in features(c, o, ngrams, bits):
                    for x in set(own.tolist()):
                        sums[x] += np.bincount(h[(own == x)[doc]], minlength=1 << bits)
        for x, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([x] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(v[at], seen[x]))], names=["lang", "bucket", "n"])

    n_languages = train.select("lang").distinct().count()
    if n_languages > MAX_LANGUAGES:
        raise ValueError(f"{n_languages} languages: the matrix that is broadcast is for {MAX_LANGUAGES} at most")
    # the sample is bounded, so a few tasks hold it; the result has at most languages x buckets rows
    counted = train.repartition(8).transform(_io.arrow_map, count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique().tolist())
    weight, prior = np.zeros((len(languages), 1 << bits)), np.zeros(max(1, len(languages)))
    for k, x in enumerate(languages):
        own = counted[counted["lang"] == x]
        hit = own[own["bucket"] >= 0]
        weight[k, hit["bucket"].to_numpy()] = hit["n"].to_numpy()
        prior[k] = own.loc[own["bucket"] < 0, "n"].sum()
    weight += smoothing
    weight = np.log(weight / weight.sum(axis=1, keepdims=True)) if languages else weight
    prior = np.log(prior / prior.sum()) if languages else prior
    return Model(languages, prior, weight, ngrams, bits)


def identify(docs: DataFrame, model: Model, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs (with a column text) and the two columns; one map, no shuffle. A column of either name gives way."""
    src = docs.drop(lang_col, score_col)
    if "text" not in src.columns:
        raise ValueError("a column text is needed")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = src.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.utf8(b.column(at))
            langs, scores = [], []
            for _, _, c, o in K.chunks(buf, off, 1 << 18):
                x, s = shared.value.score(c, o)
                langs += x
                scores.append(s)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*b.schema.names, lang_col, score_col])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return src.transform(_io.arrow_map, run, StructType([*src.schema.fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id, as text, leaves 2 modulo 4; false for a null id."""
    return F.coalesce(remainder(F.col(id_col), 4) == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows that aren't held out (rows without an id are not learnt from either)."""
    docs = _io.table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder(F.col("doc_id"), 4) != 2))
    out = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """The documents whose language is known: those with a letter and a best
    language of at least `least`. All columns are carried, whatever their names."""
    model = fit(docs.where(remainder(F.col("doc_id"), 4) != 2))
    names = [f"c{k}" if c != "text" else c for k, c in enumerate(docs.columns)]
    found = identify(docs.toDF(*names), model)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*names).toDF(*docs.columns)
