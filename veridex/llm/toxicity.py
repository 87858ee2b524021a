"""Toxicity by Levenshtein automata over a lexicon trie (operator 1).

A lexicon of weighted terms forms a trie. Levenshtein automata of its terms,
intersected with it, make one automaton over (trie node, edits) sets, which is
determinised as texts need it and run over all words of a batch at once. It
finds each word that equals a term or is at most `distance` edits from one of
at least `fuzzy_from` letters, so misspelled terms are caught.

Each hit is scored in a window of `window` words on either side: quotation
marks and reporting words speak for a quotation, words of address for abuse. A
logistic model over sums of hits gives the document's score.

Both lexicon and model are learned from labelled rows: a sample of about
`max_train` (20,000) by a hash of doc_id, of which three quarters give the
lexicon and the rest the model's weights, so terms that fit by chance don't
count. A term needs `support` toxic documents and a likelihood ratio that
chance hardly gives. Every document is scored over its whole text. Null, empty
and wordless texts get the score of a text without hits. Without labels, or
with labels of one kind only, no term is learned and all scores are 0.
Several labels of one document count as toxic if one says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from . import _kernel as K
from . import _points as P
from .langid import remainder, sampled

MAX_TRAIN, DISTANCE, FUZZY_FROM, WINDOW = 20_000, 1, 5, 6
SUPPORT, LEAST_RATIO, LEAST_SHARE, MAX_LETTERS = 3, 18.0, 0.5, 40
# Words that report speech, and words of address.
REPORTING = frozenset("said says say quote quoted quotes wrote writes called calls word words term dit disait cite mot sagte sagt zitat wort nannte dijo dice cita palabra".split())
ADDRESS = frozenset("you your yours yourself u ur tu toi vous votre du dich dir ihr euch usted tú ustedes vosotros".split())
QUOTES = frozenset('"“”„«»‹›')


class Automaton:
    """The intersection of the terms' Levenshtein automata with their trie, determinised on demand.

    State 0 is dead, state 1 the start. `run` gives, for each word, the nearest
    term (by edits, then weight, then order) or -1, and the edits.
    """

    def __init__(self, terms: list[str], weights: list[float], distance: int = DISTANCE, fuzzy_from: int = FUZZY_FROM):
        self.terms, self.weights, self.distance = terms, weights, distance
        self.child: list[dict[int, int]] = [{}]
        self.term_at: dict[int, int] = {}
        self.edits_at: list[int] = [0]  # edits that some term below a node allows
        for t, term in enumerate(terms):
            node, allowed = 0, distance if len(term) >= fuzzy_from else 0
            self.edits_at[0] = max(self.edits_at[0], allowed)
            for c in map(ord, term):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.edits_at.append(0)
                node = self.child[node][c]
                self.edits_at[node] = max(self.edits_at[node], allowed)
            self.term_at[node] = t
        self.allowed = [distance if len(t) >= fuzzy_from else 0 for t in terms]
        letters = sorted({c for t in terms for c in map(ord, t)})
        self.letters = [-1, *letters]
        self.of_letter = np.zeros(P.N_POINTS, np.int32)
        for k, c in enumerate(letters):
            self.of_letter[c] = k + 1
        self.longest = max(map(len, terms), default=0) + distance
        self.shortest = max(1, min(map(len, terms), default=1) - distance)
        self.number: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.next = np.full((64, len(self.letters)), -1, np.int32)
        self.next[0] = 0
        self.end: list[tuple[int, int]] = [(-1, 0)]
        self._state(self._closed({(0, 0)}))

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With letters of terms left out of the word; of a node only the fewest edits stay."""
        best: dict[int, int] = {}
        stack = sorted(states, key=lambda s: s[1], reverse=True)
        while stack:
            node, e = stack.pop()
            if best.get(node, 99) <= e or e > self.edits_at[node]:
                continue
            best[node] = e
            stack += [(c, e + 1) for c in self.child[node].values()]
        return frozenset(best.items())

    def _state(self, s: frozenset) -> int:
        if s not in self.number:
            k = self.number[s] = len(self.sets)
            self.sets.append(s)
            if k == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
            ends = [(e, -self.weights[t], t) for node, e in s if (t := self.term_at.get(node, -1)) >= 0 and e <= self.allowed[t]]
            self.end.append((min(ends)[2], min(ends)[0]) if ends else (-1, 0))
        return self.number[s]

    def _step(self, state: int, letter: int) -> int:
        c, out = self.letters[letter], set()
        for node, e in self.sets[state]:
            below = self.child[node]
            if c in below:
                out.add((below[c], e))
            if e < self.edits_at[node]:
                out.add((node, e + 1))
                out.update((x, e + 1) for x in below.values())
        return self._state(self._closed(out))

    def run(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """letters: code points; start, end: of the words. (term or -1, edits) of each word."""
        term, edits = np.full(len(start), -1, np.int32), np.zeros(len(start), np.int32)
        if not self.terms or not len(start):
            return term, edits
        size = end - start
        live = np.flatnonzero((size <= self.longest) & (size >= self.shortest))
        state = np.ones(len(live), np.int32)
        for t in range(self.longest + 1):
            done = size[live] == t
            if done.any():
                ended = np.array(self.end, np.int32)[state[done]]
                term[live[done]], edits[live[done]] = ended[:, 0], ended[:, 1]
                live, state = live[~done], state[~done]
            if not len(live):
                break
            letter = self.of_letter[letters[start[live] + t]]
            new = self.next[state, letter]
            if (unknown := new < 0).any():
                for pair in np.unique(state[unknown].astype(np.int64) * len(self.letters) + letter[unknown]).tolist():
                    s, x = divmod(pair, len(self.letters))
                    to = self._step(s, x)
                    self.next[s, x] = to
                new = self.next[state, letter]
            alive = new > 0
            live, state = live[alive], new[alive]
        return term, edits


#: Columns of a document's features: logarithms of summed weights of terms, of misspelled terms and of either as quotation, and of the number of terms.
FEATURES = ("exact", "misspelled", "quotation", "kinds")
#: A misspelled term's least coefficient, as a share of an exact one's: the sample may hold too few to learn it.
LEAST_MISSPELLED = 0.75


@dataclass
class Model:
    terms: list[str]
    weights: list[float]
    misspelled: list[float]
    coef: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    intercept: float = -50.0
    distance: int = DISTANCE
    fuzzy_from: int = FUZZY_FROM
    window: int = WINDOW

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.coef + self.intercept, -60, 60)))


def _context(cp: np.ndarray, s: np.ndarray, e: np.ndarray, i: int, lo: int, hi: int) -> float:
    """How much the words lo to hi - 1 around hit i look like abuse (1) rather than quotation (to 0)."""
    chars = cp[s[lo] : e[hi - 1]]
    text = chars.tobytes().decode("utf-32-le", "replace")
    rel = s[i] - s[lo]
    words = [text[a - s[lo] : b - s[lo]] for a, b in zip(s[lo:hi].tolist(), e[lo:hi].tolist(), strict=True)]
    quoted = any(c in QUOTES for c in text[:rel]) and any(c in QUOTES for c in text[rel:])
    doubt = 0.6 * quoted + 0.3 * any(w in REPORTING for w in words) - 0.2 * any(w in ADDRESS for w in words)
    return float(np.clip(1.0 - doubt, 0.1, 1.0))


def document_features(buf: np.ndarray, off: np.ndarray, model: Model, automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(documents x FEATURES, hits of each document) of a chunk."""
    cp, at = P.points(buf, off)
    cp = P.folded()[cp]
    s, e, first = P.word_runs(cp, at)
    term, edits = automaton.run(cp, s, e)
    hits = np.flatnonzero(term >= 0)
    out = np.zeros((len(off) - 1, len(FEATURES)))
    doc = np.searchsorted(first, hits, "right") - 1
    exact = edits[hits] == 0
    w = np.where(exact, np.array(model.weights + [0.0])[term[hits]], np.array(model.misspelled + [0.0])[term[hits]])
    hits, doc, w = hits[w > 0], doc[w > 0], w[w > 0]
    for h, d, weight in zip(hits.tolist(), doc.tolist(), w.tolist(), strict=True):
        lo, hi = max(first[d], h - model.window), min(first[d + 1], h + model.window + 1)
        abuse = _context(cp, s, e, h, lo, hi)
        out[d, int(edits[h] > 0)] += weight * abuse
        out[d, 2] += weight * (1.0 - abuse)
    if len(hits):
        each = np.unique(doc * len(model.terms) + term[hits])
        out[:, 3] = np.bincount(each // len(model.terms), minlength=len(out))
    out = np.log1p(out)
    return out, np.bincount(doc, minlength=len(off) - 1)


def featurize(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """`keep` columns, the features as an array, and n_hits; one map, no shuffle."""
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    src = docs.select(*keep, F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        automaton = Automaton(m.terms, m.weights, m.distance, m.fuzzy_from)
        for b in batches:
            buf, off = K.utf8(b.column(b.num_columns - 1))
            x, n = [], []
            for _, _, c, o in K.chunks(buf, off, 1 << 18):
                f, k = document_features(c, o, m, automaton)
                x.append(f)
                n.append(k)
            flat = np.concatenate(x).ravel()
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(FEATURES)), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], rows, pa.array(np.concatenate(n), pa.int64())], names=[*keep, "features", "n_hits"])

    fields = [src.schema[c] for c in keep]
    return src.transform(_io.arrow_map, run, StructType([*fields, StructField("features", ArrayType(DoubleType())), StructField("n_hits", LongType())]))


def learn_lexicon(docs: DataFrame, support: int = SUPPORT, ratio: float = LEAST_RATIO, share: float = LEAST_SHARE) -> tuple[list[str], list[float], list[float]]:
    """Terms of docs (text, toxic) whose documents are toxic more often than
    chance allows, their log odds, and the log odds of words within the allowed
    edits of each (0 if those are no sign). Counts are of documents."""
    words = F.array_distinct(F.split(F.lower(F.col("text")), r"[^\p{L}\p{Nd}]+"))
    per = docs.groupBy().agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).first()
    pos, n = int(per["pos"] or 0), int(per["n"])
    if not pos or pos == n:
        return [], [], []
    counts = docs.select("toxic", F.explode(words).alias("term")).where(F.length("term").between(3, MAX_LETTERS)).groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("t"))
    counts = _io.materialize(counts, "toxicity-words")
    rate = pos / n
    a, t = F.col("a").cast("double"), F.col("t").cast("double")
    term = lambda k, m, q: F.when(k > 0, k * F.log(k / (m * q))).otherwise(0.0)
    found = counts.where((a >= support) & (a / t >= max(share, rate))).withColumn("g", 2 * (term(a, t, rate) + term(t - a, t, 1 - rate))).where(F.col("g") >= ratio).toPandas().sort_values("term")
    prior = np.log(rate / (1 - rate))
    weight = np.log((found["a"] + 0.5) / (found["t"] - found["a"] + 0.5)) - prior
    terms, weights = found["term"].tolist(), weight.clip(lower=0.1).tolist()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms, weights)
        for b in batches:
            cp, at = P.points(*K.utf8(b.column(0)))
            k, edits = automaton.run(cp, at[:-1], at[1:])
            hit = (k >= 0) & (edits > 0)
            yield pa.RecordBatch.from_arrays([pa.array(k[hit]), b.column(1).filter(pa.array(hit)), b.column(2).filter(pa.array(hit))], names=["k", "a", "t"])

    # a row for each term at most
    around = counts.transform(_io.arrow_map, near, "k int, a bigint, t bigint").groupBy("k").agg(F.sum("a").alias("a"), F.sum("t").alias("t")).toPandas().set_index("k")
    _io.discard(counts)
    toxic = np.zeros((len(terms), 2))
    toxic[around.index] = around[["a", "t"]].to_numpy(float)
    # two toxic documents are presumed of a misspelled term, and a quarter of a clean one
    odds = np.log((toxic[:, 0] + 2) / (toxic[:, 1] - toxic[:, 0] + 0.25)) - prior
    return terms, weights, np.clip(np.minimum(odds, weights), 0, None).tolist()


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method on a bounded sample. More
    hits never speak against toxicity: a coefficient that would be negative is 0."""
    use = np.ones(x.shape[1], bool)
    while True:
        x1 = np.hstack([x[:, use], np.ones((len(x), 1))])
        w, ridge = np.zeros(x1.shape[1]), np.full(x1.shape[1], penalty)
        ridge[-1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
            step = np.linalg.solve((x1.T * (p * (1 - p))) @ x1 + np.diag(ridge), x1.T @ (y - p) - ridge * w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        if (w[:-1] >= 0).all():
            coef = np.zeros(x.shape[1])
            coef[use] = w[:-1]
            return coef, float(w[-1])
        use[np.flatnonzero(use)[w[:-1] < 0]] = False


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Lexicon and model from labels (doc_id, toxic) of docs (doc_id, text); the caller leaves out what mustn't be learnt from."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = sampled(known, F.col("doc_id"), max_train)  # bounded, and so is its broadcast
    train = _io.materialize(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "doc_id"), "toxicity-train")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4))
    terms, weights, misspelled = learn_lexicon(train.where(fold != 0))
    model = Model(terms, weights, misspelled)
    if terms:
        sample = featurize(train.where(fold == 0), model, ("toxic",)).select("toxic", "features").toPandas()
        if sample["toxic"].nunique() > 1:
            x = np.array(sample["features"].tolist())
            model.coef, model.intercept = logistic(x, sample["toxic"].to_numpy(float))
            model.coef[1] = max(model.coef[1], LEAST_MISSPELLED * model.coef[0])
    _io.discard(train)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, n_hits) of every row."""
    z = F.aggregate(F.zip_with("features", F.array(*map(F.lit, model.coef.tolist())), lambda a, b: a * b), F.lit(float(model.intercept)), lambda acc, v: acc + v)
    p = 1.0 / (1.0 + F.exp(-F.least(F.lit(60.0), F.greatest(F.lit(-60.0), z))))
    return featurize(docs, model, ("doc_id",)).select("doc_id", p.alias("score"), (p >= 0.5).cast("int").alias("predicted"), "n_hits")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _io.table(spark, sf_dir, "documents")
    model = fit(docs, _io.table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0))
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "n_hits")
