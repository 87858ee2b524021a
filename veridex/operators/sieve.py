"""Sets of hashed shingles, and a sieve that leaves out sets which cannot be similar to another.

A set of which more shingles than the threshold allows stand in no other set has
no partner. Counting that for all sets is most of the work of a similarity join
of texts of which few are copies, so shingles are shuffled as packed arrays, in
so many slices of the hashes' range, and counted by numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions import text as T
from .graph import forget, stored

#: Shingles that one bucket has, more or less, and that a task packs at a time.
PER_BUCKET, PACKED = 500_000, 1_000_000
#: Arrow batches are kept small, so that long texts don't fill workers.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
Batches = Iterator[pa.RecordBatch]


@contextmanager
def small_batches(spark: SparkSession):
    was = {key: spark.conf.get(key, None) for key in BATCH}
    try:
        for key, value in BATCH.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in was.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values as unsigned numbers, sizes) of an array of lists without nulls."""
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(lists.offsets.to_numpy())


def grams(words: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): of each row the distinct hashes of its runs of k words, ascending. words: the rows' words, hashed, in order."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(2 * j + 3) + words[j : j + n])
    whole = row[:n] == row[k - 1 : k - 1 + n]
    h, row = h[whole].view(np.int64), row[:n][whole]
    ends = np.cumsum(np.bincount(row, minlength=len(sizes)))
    for i, j in zip((ends - np.diff(ends, prepend=0)).tolist(), ends.tolist(), strict=True):
        h[i:j].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(sizes))


def shingle_sets(sources: DataFrame, k: int) -> DataFrame:
    """(id, s) of every source (id, content) with shingles: their hashes, ascending."""
    hashed = sources.where("content is not null").select("id", F.transform(T.tokens(F.col("content")), lambda w: F.xxhash64(w)).alias("w"))

    def run(batches: Batches) -> Batches:
        for b in batches:
            h, n = grams(*flat(b.column(1)), k)
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(h))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["id", "s"]).filter(pa.array(n > 0))

    return hashed.mapInArrow(run, StructType([hashed.schema["id"], StructField("s", ArrayType(LongType()))]))


def _pieces(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, where it stands) of each distinct key."""
    order = np.argsort(keys, kind="stable")
    names, first = np.unique(keys[order], return_index=True)
    return zip(names.tolist(), np.split(order, first[1:]), strict=True)


def _packed(sets: DataFrame, j: int, slices: int, buckets: int) -> DataFrame:
    """(block, bucket, h, at): the shingles of slice j: 32 bits of each hash beside its bucket, and the place in its block of the set it is of."""

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        no, bucket, h = (np.concatenate(x) for x in zip(*held, strict=True))
        at, out = (no & 0xFFFF).astype(np.uint16), []
        blocks, block = np.unique(no >> 16, return_inverse=True)
        for key, where in _pieces(block * buckets + bucket):
            out.append((blocks[key // buckets], key % buckets, h[where].tobytes(), at[where].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "bucket", "h", "at"])

    def run(batches: Batches) -> Batches:
        held, size = [], 0
        for b in batches:
            h, n = flat(b.column(1))
            piece = ((h >> np.uint64(32)) * np.uint64(slices * buckets) >> np.uint64(32)).astype(np.int64)
            here = piece // buckets == j
            if here.any():
                held.append((np.repeat(b.column(0).to_numpy(), n)[here], piece[here] % buckets, h[here].astype(np.uint32)))
                size += len(held[-1][0])
            if size >= PACKED:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return sets.select("no", "s").mapInArrow(run, "block long, bucket long, h binary, at binary")


def _met(batches: Batches) -> Batches:
    """(block, at, n): for sets of a block, how many of the shingles of these buckets stand in several sets. All rows of a bucket are in one task."""
    rows = [(block, bucket, np.frombuffer(h, np.uint32), np.frombuffer(at, np.uint16)) for b in batches for block, bucket, h, at in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    if not rows:
        return
    sizes = [len(r[2]) for r in rows]
    h = np.repeat(np.array([r[1] for r in rows], np.uint64) << np.uint64(32), sizes) | np.concatenate([r[2] for r in rows])
    no = np.repeat(np.array([r[0] for r in rows], np.int64) << 16, sizes) | np.concatenate([r[3] for r in rows])
    order = np.argsort(h)
    h, again = h[order], np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[:-1] |= again[1:]
    nos, n = np.unique(no[order[again]], return_counts=True)
    if len(nos):
        out = [(block, (nos[where] & 0xFFFF).astype(np.uint16).tobytes(), n[where].astype(np.int32).tobytes()) for block, where in _pieces(nos >> 16)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "at", "n"])


def _summed(block: pa.Table) -> pa.Table:
    total = np.zeros(1 << 16, np.int64)
    for at, n in zip(block["at"].to_pylist(), block["n"].to_pylist(), strict=True):
        total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int32)  # a row names a set once
    at = np.flatnonzero(total)
    return pa.table({"no": (block["block"][0].as_py() << 16) + at, "shared": total[at]})


def possible(sets: DataFrame, n_shingles: int, threshold: float, per_slice: int, most_slices: int) -> DataFrame:
    """(no) of sets (no, n, s), n being their size, that may be similar to another: at least the threshold's share of their shingles stand in several sets. no:
    numbers of sets, best with many to each 65,536. Hashes that agree in about 42 bits count as one, which leaves a set in but never out."""
    slices = max(1, min(most_slices, -(-n_shingles // per_slice)))
    buckets = max(1, -(-n_shingles // (slices * PER_BUCKET)))
    with small_batches(sets.sparkSession):
        met = stored((_packed(sets, j, slices, buckets).repartition(buckets, "bucket").mapInArrow(_met, "block long, at binary, n binary") for j in range(slices)), "shared")
        shared = met.groupBy("block").applyInArrow(_summed, "no long, shared long")
        wanted = sets.select("no", "n").join(shared, "no").where(F.col("shared") >= F.ceil(F.lit(threshold) * F.col("n") - 1e-9))
        out = stored([wanted.select("no")], "possible")
    forget(met)
    return out


def _shared(x: np.ndarray, y: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many values sets x[i] and y[i] share. values: all sets' values, one set after the other."""
    first = np.cumsum(sizes) - sizes
    names, code = np.unique(values, return_inverse=True)
    has, out = np.zeros(len(names), bool), np.zeros(len(x), np.int64)
    for one, where in _pieces(x):
        own = code[first[one] : first[one] + sizes[one]]
        others, n = y[where], sizes[y[where]]
        start = np.cumsum(n) - n
        has[own] = True
        out[where] = np.add.reduceat(has[code[np.repeat(first[others] - start, n) + np.arange(n.sum())]], start, dtype=np.int64)
        has[own] = False
    return out


def overlaps(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of pairs (cell, a, b) at or above the threshold; sets (cell, id, s) has those that a cell's pairs need."""
    of_id = sets.schema["id"].dataType
    types = StructType([StructField("a", of_id), StructField("b", of_id), StructField("jaccard", DoubleType())])

    def run(own: pa.Table, ask: pa.Table) -> pa.Table:
        ids, (values, sizes) = own["id"].combine_chunks(), flat(own["s"].combine_chunks())
        x, y = (pc.index_in(ask[c].combine_chunks(), value_set=ids).to_numpy() for c in ("a", "b"))
        c = _shared(x, y, values, sizes)
        likeness = c / (sizes[x] + sizes[y] - c)
        return ask.select(["a", "b"]).append_column("jaccard", pa.array(likeness)).filter(pa.array(likeness >= threshold))

    return sets.groupBy("cell").cogroup(pairs.groupBy("cell")).applyInArrow(run, types)
