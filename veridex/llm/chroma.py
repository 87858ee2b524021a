"""Chroma audio fingerprints of media columns (operator 3).

1. PCM is cut into frames of `frame` samples every `hop`. Each frame's power
   spectrum is summed by pitch class (12 of them, over `octaves` octaves from
   `lowest` Hz), smoothed over 5 frames and scaled to length 1.
2. Filters compare sums over rectangles of the frames x classes image, read off
   its integral image. Each of 16 filters gives two bits, by three thresholds,
   in Gray code; a frame's 16 pairs of bits make one 32-bit integer.
3. Recordings are aligned by integers they have in common: each such pair votes
   for the difference of their places, the offset of most votes (least first)
   is taken, and the share of different bits at that offset decides.

Recordings of one fingerprint are one class, and classes are searched, so
copies are not paired; a query's links count all recordings of a class. Seeds
are pairs of successive integers, of all classes, however many share one
(silence, hum): a stretch of equal seeds is one row of the search, whatever its
length, and one seed's rows are dealt over many tasks. Alignments need `LEAST_OVERLAP` places in common, or
all of the shorter recording.

Null or empty media, and media shorter than all filters' reach, have no
integers and no links. NaN and infinite samples count as 0. Rows of one id are
judged by their own media; a class is named by its least id. Columns besides the
id and the media aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from . import _io

RATE, FRAME, HOP, LOWEST, OCTAVES = 11025, 4096, 1365, 65.4, 6
SMOOTHING = (0.25, 0.75, 1.0, 0.75, 0.25)
MAX_BIT_ERROR, LEAST_OVERLAP = 0.35, 16
REACH = 16
#: Keys that the runs of one seed are dealt over.
SALTS = 16
#: (first frame, frames, first class, classes, kind): rectangles of the filters' images.
FILTERS = tuple((0, 4 * (1 + k % 4), 3 * (k // 4) % 12, 2 + (k * 5) % 5, k % 3) for k in range(16))
#: Where each filter's value is cut into four.
CUTS = (-0.15, 0.0, 0.15)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def frames_of(pcm: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """(frames, 12) pitch-class images of mono samples."""
    n = (len(pcm) - frame) // hop + 1
    if n <= 0:
        return np.zeros((0, 12))
    x = np.lib.stride_tricks.sliding_window_view(pcm, frame)[: (n - 1) * hop + 1 : hop] * np.hanning(frame)
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2
    hz = np.fft.rfftfreq(frame, 1 / rate)
    use = (hz >= LOWEST) & (hz < min(LOWEST * 2**OCTAVES, rate / 2))
    note = np.round(12 * np.log2(hz[use] / LOWEST)).astype(int) % 12
    image = np.zeros((n, 12))
    for c in range(12):
        image[:, c] = power[:, use][:, note == c].sum(axis=1)
    if n >= len(SMOOTHING):
        w = np.array(SMOOTHING) / sum(SMOOTHING)
        image = np.stack([np.convolve(image[:, c], w, "valid") for c in range(12)], axis=1)
    size = np.sqrt((image**2).sum(axis=1, keepdims=True))
    return np.divide(image, size, out=np.zeros_like(image), where=size > 1e-9)


def integers(image: np.ndarray) -> np.ndarray:
    """The packed 32-bit integers of a frames x 12 image: one for each place that all filters reach."""
    n = len(image) - REACH + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    whole = np.zeros((len(image) + 1, 25))
    whole[1:, 1:] = np.cumsum(np.cumsum(np.hstack([image, image]), axis=0), axis=1)  # classes go round
    at = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return whole[at + t1, c1] - whole[at + t0, c1] - whole[at + t1, c0] + whole[at + t0, c0]

    out = np.zeros(n, np.uint32)
    for t, frames, c, classes, kind in FILTERS:
        if kind == 0:  # earlier against later
            a, b = area(t, t + frames // 2, c, c + classes), area(t + frames // 2, t + frames, c, c + classes)
        elif kind == 1:  # lower against higher classes
            a, b = area(t, t + frames, c, c + classes), area(t, t + frames, c + classes, c + 2 * classes)
        else:  # inside against all
            a = area(t, t + frames, c, c + classes) / classes
            b = area(t, t + frames, 0, 12) / 12
        level = np.digitize(np.log1p(a) - np.log1p(b), CUTS)
        out = (out << np.uint32(2)) | GRAY[level]
    return out.view(np.int32)


def fingerprint(media: DataFrame, id_col: str, pcm_col: str, rate: int = RATE, frame: int = FRAME, hop: int = HOP, render=None) -> DataFrame:
    """(id, fingerprint) of media (id, array of numbers); render: turns a row's array into samples."""
    src = media.select(F.col(id_col), F.col(pcm_col).cast("array<double>").alias("pcm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1):
                x = np.array(v.as_py() or [], float)
                x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
                out.append(integers(frames_of(render(x) if render else x, rate, frame, hop)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=[id_col, "fingerprint"])

    return src.transform(_io.arrow_map, run, StructType([src.schema[id_col], StructField("fingerprint", ArrayType(IntegerType()))]))


def seeds(rows: DataFrame, run: int) -> DataFrame:
    """(class, place, seed, length): hashes of `run` successive integers, `length` equal ones in a row as one, by its first place."""
    at = lambda i: F.slice("fingerprint", i, run)
    n = F.greatest(F.size("fingerprint") - run + 1, F.lit(1))  # shorter rows go, but perhaps only after this
    first = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (at(i) != at(F.greatest(i - 1, F.lit(1)))))
    runs = rows.where(F.size("fingerprint") >= run).select("class", "fingerprint", n.alias("n"), first.alias("f")).select("*", F.posexplode("f").alias("k", "start"))
    length = F.coalesce(F.get("f", F.col("k") + 1), F.col("n") + 1) - F.col("start")
    return runs.select("class", (F.col("start") - 1).alias("place"), F.xxhash64(at(F.col("start"))).alias("seed"), length.alias("length"))


def best_shifts(mine: DataFrame, theirs: DataFrame, salts: int = SALTS) -> DataFrame:
    """(q, class, shift, votes): for each pair with a seed in common the shift of most votes, the least of equals.

    Runs of m and n equal seeds vote for m + n - 1 shifts, in numbers that rise, stay and fall; so a pair of runs sends the four places
    where the slope changes, not its m x n votes. The sum of such shapes is largest, and first so, where some slope changes. Each seed's
    runs are dealt over `salts` keys, and those asked for repeated, so that one seed that all recordings have isn't one task's.
    """
    dealt = theirs.withColumn("salt", F.pmod(F.xxhash64("class", "place"), F.lit(salts)).cast("int"))
    asked = mine.select(F.col("class").alias("q"), F.col("place").alias("p"), "seed", F.col("length").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    between, longer = F.col("place") - F.col("p"), F.col("length") - F.col("m")
    bends = F.array(*[F.struct(at.cast("bigint").alias("shift"), F.lit(c).cast("bigint").alias("bend")) for at, c in ((between - F.col("m"), 1), (between, -1), (between + longer, -1), (between + F.col("length"), 1))])
    each = asked.join(dealt, ["seed", "salt"]).select("q", "class", F.explode(bends).alias("x")).select("q", "class", "x.*")
    bent = each.groupBy("q", "class", "shift").agg(F.sum("bend").alias("bend")).where("bend <> 0")
    so_far = Window.partitionBy("q", "class").orderBy("shift").rowsBetween(Window.unboundedPreceding, 0)
    votes = F.col("shift") * F.sum("bend").over(so_far) - F.sum(F.col("bend") * F.col("shift")).over(so_far)
    counted = bent.select("q", "class", "shift", votes.alias("votes"))
    return counted.groupBy("q", "class").agg(F.min_by("shift", F.struct(-F.col("votes"), "shift")).cast("int").alias("shift"), F.max("votes").alias("votes"))


def search(classes: DataFrame, asked: DataFrame, max_error: float = MAX_BIT_ERROR) -> DataFrame:
    """(q, class, shift, votes, error) for every class that aligns with an asked
    one. classes: (class, fingerprint); asked: (class). A class aligns with itself."""
    best = best_shifts(seeds(classes.join(asked, "class", "left_semi"), 2), seeds(classes, 2))
    side = lambda c, f: classes.select(F.col("class").alias(c), F.col("fingerprint").alias(f))
    both = best.join(side("q", "x"), "q").join(side("class", "y"), "class")
    lo, hi = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("x"), F.size("y") - F.col("shift"))
    both = both.where(hi - lo >= F.least(F.lit(LEAST_OVERLAP), F.size("x"), F.size("y")))
    apart = F.aggregate(F.zip_with(F.slice("x", lo + 1, hi - lo), F.slice("y", lo + F.col("shift") + 1, hi - lo), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, v: acc + v)
    return both.withColumn("error", apart / (32.0 * (hi - lo))).where(F.col("error") <= max_error).select("q", "class", "shift", "votes", "error")


def align(prints: DataFrame, id_col: str, every: int = 50) -> DataFrame:
    """A row for each recording of prints (id, fingerprint): class (least id of
    its fingerprint), asked (id divisible by `every`), and for asked ones with
    integers the number of other recordings that align with it, and of classes
    besides its own the one of least error (then least id), its shift and error."""
    named = prints.withColumn("digest", F.sha2(F.array_join(F.transform("fingerprint", lambda v: v.cast("string")), ","), 256))
    asked = F.coalesce(F.try_mod(F.col(id_col), F.lit(every)) == 0, F.lit(False))
    groups = named.groupBy("digest").agg(F.min(id_col).alias("class"), F.count("*").alias("size"), F.max(asked).alias("asked"), F.first("fingerprint").alias("fingerprint"))
    groups = _io.materialize(groups, "recordings")
    some = groups.where((F.size("fingerprint") > 0) & F.col("class").isNotNull())
    hits = search(some.select("class", "fingerprint"), some.where("asked").select("class"))
    sized = hits.join(some.select("class", "size"), "class")
    other = F.col("class") != F.col("q")
    best = F.min(F.when(other, F.struct("error", "class", "shift"))).alias("best")
    links = sized.groupBy("q").agg((F.sum("size") - 1).alias("n_links"), best).select(F.col("q").alias("class"), "n_links", F.col("best.class").alias("best_class"), F.col("best.shift").alias("best_shift"), F.col("best.error").alias("best_error"))
    per = groups.select("digest", "class").join(links, "class", "left")
    rows = named.select(F.col(id_col), F.size("fingerprint").cast("bigint").alias("n_ints"), "digest", asked.alias("asked")).join(per, "digest")
    blank = lambda c: F.when(F.col("asked"), F.col(c)).alias(c)
    return rows.select(id_col, "n_ints", "digest", F.col("class").alias("class_id"), "asked", *map(blank, ("n_links", "best_class", "best_shift", "best_error")))


def melody(values: np.ndarray) -> np.ndarray:
    """Samples that play each value as a note of one hop, 24 semitones to a unit around 440 Hz."""
    hz = 440.0 * 2 ** (np.clip(np.round(values * 24), -24, 24) / 12)
    return np.sin(2 * np.pi * np.cumsum(np.repeat(hz, HOP_4)) / RATE_4)


#: A quarter of the usual rate, with frames of the same length in time: notes lie below 1,000 Hz.
RATE_4, FRAME_4, HOP_4 = RATE // 4, FRAME // 4, HOP // 4


def op3_chroma_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds audio: each embedding is played as a melody of its values."""
    prints = fingerprint(_io.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", RATE_4, FRAME_4, HOP_4, melody)
    return align(_io.materialize(prints, "fingerprints"), "vec_id")
