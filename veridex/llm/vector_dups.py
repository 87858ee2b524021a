"""Embedding near-duplicates by product quantisation (operator 13).

1. Equal vectors are one class with a weight, by 128 bits of hash, so copies are
   never compared.
2. Centroids of `lists` inverted lists and, for their residuals, codebooks of 256
   codewords in subspaces of 4 dimensions are fitted on a bounded sample. All
   else covers every vector.
3. A vector is at home in the list of its nearest centroid. Its code, a byte a
   subspace, also goes to every list whose border with its own is nearer than
   `slack`: no number of probes is fixed. Codes travel packed, vectors don't.
4. At home, a vector has a table of inner products with all codewords; looked up
   by a code they give its distance to the vector that the code stands for. With
   the code's known error this bounds the distance to the coded vector itself,
   so no neighbour in a probed list is passed over.
5. Only vectors whose code came near some vector of a block go there themselves,
   and are compared with it by exact cosine in double precision.
6. Counts of links are added up in each block; of the links themselves a block
   returns no more than join its members. Connected components of these are the
   classes.

Two vectors within the radius r of a link (r = sqrt(2 - 2 * 0.9)) in different
lists have distances a, b from the border with a + b <= r, and are found if one
of them is within `slack`. With slack r / 2 no link is ever missed. By default it
is r / 2 * min(1, 3.6 / sqrt(dimensions)): all links up to 12 dimensions, above
that all but those that cross a border nearly at right angles.

A list of more than `BLOCK` vectors is dealt over blocks; a code goes to each.
Nothing is capped. A vector that is null, empty, zero or holds a null, NaN or infinity
links with nothing, nor do vectors of different lengths. Rows with one vec_id count as
separate vectors; a component is named by its least vec_id (null if it has none), and a
row without an id is kept if its component has none. Repeated rows link with each other.
Other columns aren't read, whatever their names. An empty table gives no rows.
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
from .near_dup import components

THRESHOLD, SUBSPACE, CODEWORDS, BLOCK = 0.9, 4, 256, 2048
#: Lists are about the root of the number of vectors, within these bounds; the sample has so many vectors a list.
FEWEST, MOST, SAMPLED = 16, 4096, 64
_EPS = 1e-4  # more than single precision loses


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in double precision, padded by zeros to `width`; their lengths)."""
    off = column.offsets.to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(off)
    out = np.zeros((len(n), width))
    if len(n) and (n == width).all():
        out[:] = flat.reshape(len(n), width)
    else:
        row = np.repeat(np.arange(len(n)), n)
        out[row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], n)] = flat
    return out, n


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """k centroids of the rows of x (all rows, if there are no more than k)."""
    if len(x) <= k:
        return x.copy()
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Index:
    """centroids (lists x dimensions), codebooks (one a subspace) and where subspaces begin."""

    centroids: np.ndarray
    books: list[np.ndarray]
    edges: list[int]
    slack: float
    radius: float

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, threshold: float = THRESHOLD, slack: float | None = None) -> Index:
        """Of unit vectors, one a row."""
        width = sample.shape[1]
        radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        slack = radius / 2 * min(1.0, 3.6 / np.sqrt(width)) if slack is None else slack
        centroids = k_means(sample, lists)
        rest = sample - centroids[nearest(sample, centroids)]
        edges = [*range(0, width, SUBSPACE), width]
        books = [k_means(rest[:, lo:hi], CODEWORDS, seed=2 + lo) for lo, hi in zip(edges, edges[1:], strict=False)]
        return cls(centroids, books, edges, slack, radius)

    def parts(self) -> Iterator[tuple[int, slice, np.ndarray]]:
        for k, book in enumerate(self.books):
            yield k, slice(self.edges[k], self.edges[k + 1]), book

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, whether each list is probed, codes, error and squared norm of what the codes stand for) of unit vectors."""
        c = self.centroids
        d = 1 - 2 * x @ c.T + (c * c).sum(axis=1)
        home = d.argmin(axis=1)
        apart = 2 * np.sqrt(np.maximum(((c * c).sum(axis=1)[home][:, None] + (c * c).sum(axis=1) - 2 * c[home] @ c.T), 1e-12))
        border = (d - d[np.arange(len(x)), home][:, None]) / apart
        border[np.arange(len(x)), home] = 0
        rest = x - c[home]
        codes, stands = np.zeros((len(x), len(self.books)), np.uint8), c[home]
        for k, at, book in self.parts():
            codes[:, k] = nearest(rest[:, at], book)
            stands[:, at] += book[codes[:, k]]
        return home, border <= self.slack, codes, np.linalg.norm(x - stands, axis=1), (stands * stands).sum(axis=1)

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """(codewords x vectors) of inner products, one a subspace."""
        return [(book @ x[:, at].T).astype(np.float32) for _, at, book in self.parts()]

    def near(self, x: np.ndarray, tables: list[np.ndarray], home: np.ndarray, codes: np.ndarray, error: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """(codes x vectors): whether the coded vector can be within the radius of each of the unit vectors x."""
        lists, at = np.unique(home, return_inverse=True)
        dot = (self.centroids[lists] @ x.T).astype(np.float32)[at]
        for k, table in enumerate(tables):
            dot += table[codes[:, k]]
        return 1 + norm[:, None] - 2 * dot <= (self.radius + error[:, None] + _EPS) ** 2


def lists_for(n: int) -> int:
    return 1 << int(np.clip(np.round(np.log2(max(n, 1)) / 2), np.log2(FEWEST), np.log2(MOST)))


def fitted(rows: DataFrame, threshold: float, lists: int | None, slack: float | None) -> Index | None:
    """An index of a sample of the usable vectors: about SAMPLED for each list, chosen by their hash, copies once."""
    n, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return None
    lists = lists or lists_for(n)
    share = min(1 << 30, int((1 << 30) * SAMPLED * lists / n))
    taken = rows.where(F.pmod("k1", F.lit(1 << 30)) < share).select("k1", "k2", "embedding").dropDuplicates(["k1", "k2"]).toArrow()  # bounded: SAMPLED * MOST
    if not taken.num_rows:
        taken = rows.select("k1", "k2", "embedding").limit(1).toArrow()
    taken = taken.sort_by([("k1", "ascending"), ("k2", "ascending")]).combine_chunks()
    x, _ = matrix(taken.column("embedding").chunk(0), width)
    return Index.fit(unit(x), lists, threshold, slack)


def encoded(rows: DataFrame, index: Index) -> DataFrame:
    """(cid, k1, k2, least, n, embedding, home, probes, code, error, norm) of each class of equal vectors, written once."""
    of = rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    of = of.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "least", "n", "embedding")
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, _ = matrix(b.column(5), shared.value.width)
            home, probed, codes, error, norm = shared.value.encode(unit(x))
            at, which = np.nonzero(probed)
            ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(home)))]).astype(np.int32)
            raw = codes.tobytes()
            m = codes.shape[1]
            yield pa.RecordBatch.from_arrays([
                *b.columns, pa.array(home.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(which.astype(np.int32))),
                pa.array([raw[k * m : (k + 1) * m] for k in range(len(home))], pa.binary()), pa.array((error * (1 + 1e-6)).astype(np.float32)), pa.array(norm.astype(np.float32)),
            ], names=[*b.schema.names, "home", "probes", "code", "error", "norm"])

    from pyspark.sql.types import StructType

    extra = StructType.fromDDL("home int, probes array<int>, code binary, error float, norm float")
    return _io.materialize(of.transform(_io.arrow_map, run, StructType([*of.schema.fields, *extra.fields])), "vectors")


@dataclass
class Blocks:
    """Numbers of the blocks of each list."""

    n: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, codes: DataFrame, lists: int, block: int) -> Blocks:
        size = np.zeros(lists, np.int64)
        for r in codes.groupBy("home").count().collect():  # a row for each list
            size[r["home"]] = r["count"]
        n = np.maximum(1, -(-size // block))
        return cls(n, np.concatenate([[0], np.cumsum(n)[:-1]]))

    def own(self, home: np.ndarray, cid: np.ndarray) -> np.ndarray:
        return self.first[home] + (K.mix(cid.astype(np.uint64)) % self.n[home].astype(np.uint64)).astype(np.int64)


def _by_cell(batches: Iterator[pa.RecordBatch], arrive: int) -> Iterator[tuple[int, pa.Table, Iterator[pa.Table]]]:
    """(cell, its own rows, the rows that come to it, some at a time) of batches (cell, comes, ...) sorted by both."""

    def runs() -> Iterator[tuple[int, bool, pa.RecordBatch]]:
        for b in batches:
            cell, comes = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            new = np.flatnonzero((cell[1:] != cell[:-1]) | (comes[1:] != comes[:-1])) + 1
            for lo, hi in zip([0, *new], [*new, len(cell)], strict=True):
                if hi > lo:
                    yield int(cell[lo]), bool(comes[lo]), b.slice(lo, hi - lo)

    ahead = None
    stream = runs()

    def pull():
        nonlocal ahead
        ahead = next(stream, None)

    pull()
    while ahead is not None:
        cell, own = ahead[0], []
        while ahead is not None and ahead[0] == cell and not ahead[1]:
            own.append(ahead[2])
            pull()

        def coming(cell: int = cell) -> Iterator[pa.Table]:
            held, size = [], 0
            while ahead is not None and ahead[0] == cell:
                held.append(ahead[2])
                size += ahead[2].num_rows
                pull()
                if size >= arrive:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
            if held:
                yield pa.Table.from_batches(held)

        rest = coming()
        if own:
            yield cell, pa.Table.from_batches(own), rest
        for _ in rest:
            pass


def hits(codes: DataFrame, index: Index, blocks: Blocks) -> DataFrame:
    """(cell, cid): the vectors whose code is near some other vector of a block."""
    shared = codes.sparkSession.sparkContext.broadcast((index, blocks))
    schema = pa.schema([("cell", pa.int64()), ("comes", pa.bool_()), ("cid", pa.int64()), ("data", pa.binary())])
    head = np.dtype([("cid", "<i8"), ("home", "<i4"), ("error", "<f4"), ("norm", "<f4"), ("code", "u1", (len(index.books),))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, blocks = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            cid, home = b.column(0).to_numpy(), b.column(2).to_numpy()
            raw = unit(matrix(b.column(1), index.width)[0]).astype(np.float32).tobytes()
            w = 4 * index.width
            yield pa.RecordBatch.from_arrays([pa.array(blocks.own(home, cid)), pa.array(np.zeros(len(cid), bool)), b.column(0), pa.array([raw[k * w : (k + 1) * w] for k in range(len(cid))], pa.binary())], schema=schema)
            packed = np.zeros(len(cid), head)
            packed["cid"], packed["home"], packed["error"], packed["norm"] = cid, home, b.column(5).to_numpy(), b.column(6).to_numpy()
            packed["code"] = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(len(cid), -1)
            probes = b.column(3)
            which = probes.flatten().to_numpy()
            who = np.repeat(np.arange(len(cid)), np.diff(probes.offsets.to_numpy()))
            order = np.argsort(which, kind="stable")
            which, who = which[order], who[order]
            new = np.flatnonzero(which[1:] != which[:-1]) + 1
            cells, data = [], []
            for lo, hi in zip([0, *new], [*new, len(which)], strict=True):
                first, n = int(blocks.first[which[lo]]), int(blocks.n[which[lo]])
                cells += range(first, first + n)
                data += [packed[who[lo:hi]].tobytes()] * n
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array([True] * len(cells)), pa.nulls(len(cells), pa.int64()), pa.array(data, pa.binary())], schema=schema)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, _ = shared.value
        for cell, own, rest in _by_cell(batches, 8):
            cid = own.column("cid").to_numpy()
            x = np.frombuffer(b"".join(own.column("data").to_pylist()), np.float32).reshape(len(cid), -1)
            tables = index.tables(x)
            for t in rest:
                y = np.frombuffer(b"".join(t.column("data").to_pylist()), head)
                for i in range(0, len(y), 1024):
                    z = y[i : i + 1024]
                    near = index.near(x, tables, z["home"], z["code"], z["error"], z["norm"])
                    near &= z["cid"][:, None] != cid
                    found = z["cid"][near.any(axis=1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), cell)), pa.array(found)], names=["cell", "cid"])

    src = codes.select("cid", "embedding", "home", "probes", "code", "error", "norm")
    dealt = src.transform(_io.arrow_map, deal, "cell bigint, comes boolean, cid bigint, data binary")
    return dealt.repartition("cell").sortWithinPartitions("cell", "comes").transform(_io.arrow_map, look, "cell bigint, cid bigint")


def links(codes: DataFrame, found: DataFrame, index: Index, blocks: Blocks, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (a, n): n more vectors linked with a, b null; and rows (a, b): links that join what they can join in a block."""
    shared = codes.sparkSession.sparkContext.broadcast((index, blocks))
    src = codes.select("cid", "embedding", "home", "probes", "n")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[1].own(b.column(2).to_numpy(), b.column(0).to_numpy())), *b.columns], names=["cell", *b.schema.names])

    from pyspark.sql.types import LongType, StructField, StructType

    placed = src.transform(_io.arrow_map, place, StructType([StructField("cell", LongType()), *src.schema.fields]))
    at_home = placed.join(found.select("cell").distinct(), "cell", "left_semi").withColumn("comes", F.lit(False))
    coming = found.join(src, "cid").withColumn("comes", F.lit(True))
    columns = ["cell", "comes", "cid", "embedding", "home", "probes", "n"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, _ = shared.value
        for _, own, rest in _by_cell(batches, 512):
            own = own.combine_chunks()
            cid, n = own.column("cid").to_numpy(), own.column("n").to_numpy()
            x, size = matrix(own.column("embedding").chunk(0), index.width)
            x = unit(x)
            probed = np.zeros((len(cid), len(index.centroids)), bool)
            p = own.column("probes").chunk(0)
            probed[np.repeat(np.arange(len(cid)), np.diff(p.offsets.to_numpy())), p.flatten().to_numpy()] = True
            label, count = np.arange(len(cid)), np.zeros(len(cid), np.int64)
            for t in rest:
                t = t.combine_chunks()
                who, home, m = t.column("cid").to_numpy(), t.column("home").to_numpy(), t.column("n").to_numpy()
                y, length = matrix(t.column("embedding").chunk(0), index.width)
                linked = (unit(y) @ x.T >= threshold) & (length[:, None] == size) & (who[:, None] != cid)
                count += m @ linked
                # where the other way round nothing will be compared, the one that came is counted here too
                theirs = (linked & ~probed.T[home]) @ n
                a, b = [], []
                for k in np.flatnonzero(linked.any(axis=1)).tolist():
                    at = np.flatnonzero(linked[k])
                    roots, first = np.unique(label[at], return_index=True)
                    a += [int(who[k])] * len(roots)
                    b += cid[at[first]].tolist()
                    if len(roots) > 1:
                        label[np.isin(label, roots)] = roots[0]
                some = np.flatnonzero(theirs)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array(a, np.int64), who[some]])), pa.array(b + [None] * len(some), pa.int64()), pa.array(np.concatenate([np.zeros(len(a), np.int64), theirs[some]]))], names=["a", "b", "n"])
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.nulls(len(some), pa.int64()), pa.array(count[some])], names=["a", "b", "n"])

    met = at_home.select(*columns).unionByName(coming.select(*columns)).repartition("cell").sortWithinPartitions("cell", "comes")
    return met.transform(_io.arrow_map, compare, "a bigint, b bigint, n bigint")


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, lists: int | None = None, slack: float | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of table (vec_id, embedding)."""
    rows = table.select("vec_id", "embedding", F.when(usable(F.col("embedding")), F.xxhash64("embedding")).alias("k1"), F.xxhash64(F.lit(13), "embedding").alias("k2"))
    good = rows.where("k1 is not null")
    alone = lambda df: df.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    index = fitted(good, threshold, lists, slack)
    if index is None:
        return alone(rows)
    codes = encoded(good, index)
    blocks = Blocks.of(codes, len(index.centroids), block)
    found = _io.materialize(hits(codes, index, blocks), "vector-hits")
    met = _io.materialize(links(codes, found, index, blocks, threshold), "vector-links")
    _io.discard(found)
    label = components(met.where("b is not null and a <> b").select("a", "b"))
    linked = met.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("more"))
    of = codes.select("cid", "k1", "k2", "least", "n").join(linked, "cid", "left").join(label.withColumnRenamed("node", "cid"), "cid", "left")
    of = of.select("k1", "k2", "least", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(named, "root").select("k1", "k2", "n_links", "component_id")
    out = good.select("vec_id", "k1", "k2").join(of, ["k1", "k2"])
    out = out.select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(alone(rows.where("k1 is null")))


def op13_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_io.table(spark, sf_dir, "embeddings"))
