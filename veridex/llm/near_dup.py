"""Near-duplicate detection by Order MinHash and banded alignment (operator 8).

1. Texts that fold to the same words are one content; each goes on once, so
   copies are never paired.
2. A content has `m` signatures: the `ell` smallest occurrence-numbered
   five-word k-mers under a hash function, in text order. Two contents of
   similarity 0.8 agree in one with 0.8**ell or so.
3. Contents of an equal signature form a bucket. Each member is first paired
   with the first and the last content of its buckets, which joins most of a
   class at little cost.
4. Then every pair of mates of a bucket that are not in one class yet is looked
   at: members outside the bucket's largest class meet all members of other
   classes, in cells of `BLOCK` by `BLOCK` members at most (and of about
   BLOCK_SHINGLES shingles on a side). A cell's task counts all overlaps at once
   and returns only the links that join classes, never the pairs.
5. A candidate is verified by banded alignment of the two sequences of numbered
   five-word shingles: similarity is aligned shingles over the union's, and 0.8
   or more makes a link. The band is exact: an alignment of that similarity
   leaves a known number of shingles unmatched, and can't leave the band of so
   many diagonals.
6. Connected components of the links are the classes, by min-label hooking and
   pointer jumping over tables in the shared folder.

Buckets are made by aggregates and joins that Spark can split, never windows or
lists, and a hot one is dealt out in cells, so it needs no memory of its own.

Words are runs of ASCII letters, digits, `_` and non-ASCII characters; ASCII
case doesn't count. A text of 1 to 4 words has one shingle of all of them; texts
without words are alike only if equal. Null text is empty text. Rows of one id
are judged by their texts. A class is named by the least doc_id in it (null if
it has none). Columns besides doc_id and text aren't read; the stage carries
them, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _io
from . import _kernel as K

WORDS, M, ELL, THRESHOLD = 5, 20, 4, 0.8
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
_TABLE = K.word_table()


def _content(buf: np.ndarray, off: np.ndarray) -> tuple[list[bytes], K.Grams]:
    """16 bytes of hash of each document's words (of its bytes, if it has none), and its grams."""
    grams = K.Grams(buf, off, WORDS, _TABLE)
    words, first, n = grams.words, grams.word_first, grams.n_words
    place = (np.arange(len(words)) - first[K.doc_of(first)]).astype(np.uint64)
    bare, out = np.flatnonzero(n == 0), []
    for seed in (3, 4):
        c = K.constants(2, seed)
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(K.mix(words * c[0] + K.mix(place + c[1])), out=total[1:])
        h = K.mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64) * c[1])
        if len(bare):
            h[bare] = K.span_hash(K.prefix_hash(buf, K.constants(256, 100 + seed)), off[:-1][bare], off[1:][bare])
        out.append(h)
    raw = np.stack(out, axis=1).astype(">u8").tobytes()
    return [raw[k : k + 16] for k in range(0, len(raw), 16)], grams


def sketches(docs: DataFrame, m: int = M, ell: int = ELL) -> DataFrame:
    """(doc_id, content, n_shingles, signatures) of every row; one map. content: 16 bytes of hash of the words."""
    from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.utf8(b.column(1))
            for i, j, c, o in K.chunks(buf, off):
                content, grams = _content(c, o)
                n = np.diff(grams.first)
                sig = K.tuple_hash(K.order_minhash(grams, m, ell)).view(np.int64)
                rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, m, 0))]), pa.int32()), pa.array(sig[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(content, pa.binary()), pa.array(n, pa.int64()), rows], names=["doc_id", "content", "n_shingles", "signatures"])

    return src.transform(_io.arrow_map, run, StructType([src.schema["doc_id"], StructField("content", BinaryType()), StructField("n_shingles", LongType()), StructField("signatures", ArrayType(LongType()))]))


def aligned(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Most matches of an alignment of a and b within `limit` diagonals of the
    main one. No element occurs twice in either, so each has one place in the
    band at most, and the alignment is the longest rise of those places."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(j - i) <= limit
    i, j = i[inside], j[inside]
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        return len(j)
    ends: list[int] = []
    for x in j.tolist():
        k = bisect_left(ends, x)
        ends[k : k + 1] = [x]
    return len(ends)


def most_unmatched(n: int, m: int, threshold: float = THRESHOLD) -> int:
    """Elements that may stay unmatched at this similarity: matched / (n + m - matched) >= threshold."""
    return int(np.floor((n + m) * (1 - threshold) / (1 + threshold) + 1e-9))


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned shingles over the union's, or 0 if that is below the threshold."""
    limit = most_unmatched(len(a), len(b), threshold)
    if not len(a) or abs(len(a) - len(b)) > limit:
        return 0.0
    got = aligned(a, b, limit)
    return got / (len(a) + len(b) - got) if len(a) + len(b) - 2 * got <= limit else 0.0


def buckets(reps: DataFrame) -> DataFrame:
    """(bucket, content, n_shingles, low, high) of members of buckets of several
    contents; low and high are the bucket's ends. reps: (content, n_shingles, signatures)."""
    every = reps.select("content", "n_shingles", F.posexplode("signatures").alias("i", "sig"))
    member = every.select(F.xxhash64("i", "sig").alias("bucket"), "content", "n_shingles")
    return member.join(member.groupBy("bucket").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low <> high"), "bucket")


def end_pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b: each member with the ends of its buckets."""
    met = members.select("content", F.explode(F.array("low", "high")).alias("other")).where("content <> other")
    return met.select(F.least("content", "other").alias("a"), F.greatest("content", "other").alias("b")).distinct()


def verify(pairs: DataFrame, sequences: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of pairs (a, b) of contents that reach the threshold. sequences: (content, grams)."""
    side = lambda c, x: sequences.select(F.col("content").alias(c), F.col("grams").alias(x))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([similarity(p, q, threshold) for p, q in zip(_grams_of(b.column(2)), _grams_of(b.column(3)), strict=True)], float)
            keep = pa.array(got >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(got[got >= threshold])], names=["a", "b", "similarity"])

    return both.transform(_io.arrow_map, run, "a binary, b binary, similarity double")


def _grams_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def overlaps(sequences: list[np.ndarray], lead: np.ndarray, room: int = 1 << 22) -> np.ndarray:
    """(leaders, sequences): elements in common of each leader and each other sequence. Elements are distinct within a sequence."""
    n = len(sequences)
    _, code, count = np.unique(np.concatenate(sequences), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(x) for x in sequences])
    shared = count[code] > 1
    column = np.cumsum(count > 1) - 1  # numbers of the elements that several have
    row, code = row[shared], column[code[shared]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((len(lead), n), np.float32)
    width = max(1, room // n)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, (at, at + width))
        has = np.zeros((n, min(width, int(code[-1]) + 1 - at)), np.float32)
        has[row[lo:hi], code[lo:hi] - at] = 1
        out += has[lead] @ has.T
    return out


def joining_links(contents: list[bytes], roots: list[bytes], sequences: list[np.ndarray], lead: np.ndarray, threshold: float) -> list[tuple[bytes, bytes, float]]:
    """Links between leaders and others of different classes, enough to join every class that such links join."""
    n = np.array([len(x) for x in sequences], float)
    _, root = np.unique(np.array(roots, dtype="S"), return_inverse=True)
    common = overlaps(sequences, lead)
    wanted = (common >= (n[lead][:, None] + n[None, :] - common) * (threshold - 1e-9)) & (root[lead][:, None] != root[None, :])
    parent = np.arange(int(root.max()) + 1).tolist()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(wanted)), strict=True):
        p, q = find(root[lead[i]]), find(root[j])
        if p != q and (got := similarity(sequences[lead[i]], sequences[j], threshold)):
            parent[max(p, q)] = min(p, q)
            out.append((contents[lead[i]], contents[j], got))
    return out


def cells(members: DataFrame, labels: DataFrame, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(cell, content, root, lead): what each task compares. members: (bucket, content, n_shingles); labels: (content, root)."""
    own = members.select("bucket", "content", "n_shingles").join(labels, "content")
    by_root = own.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    most = F.max(F.struct("n", "root", "s"))
    shape = by_root.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), most.alias("most"), F.count("*").alias("classes")).where("classes > 1")
    parts = lambda n, s: F.greatest(F.ceil(n / block), F.ceil(s / block_shingles))
    shape = shape.select("bucket", F.col("most.root").alias("main"), parts(F.col("n"), F.col("s")).alias("across"), parts(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("down"))
    dealt = own.join(shape, "bucket").withColumn("lead", F.col("root") != F.col("main"))
    turn = F.xxhash64("content", F.lit(3))
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    rows = dealt.select("bucket", "content", "root", "lead", F.pmod(turn, F.col("down")).alias("r"), F.pmod(turn, F.col("across")).alias("c"), "down", "across")
    # a leader goes to all cells of its row; all others (leaders too, where there are several rows) to all cells of their column
    as_lead = rows.where("lead").select("bucket", "content", "root", "lead", "r", F.explode(upto(F.col("across"))).alias("c"))
    as_mate = rows.where("not lead or down > 1").select("bucket", "content", "root", F.lit(False).alias("lead"), F.explode(upto(F.col("down"))).alias("r"), "c")
    return as_lead.unionByName(as_mate).select(F.xxhash64("bucket", "r", "c").alias("cell"), "content", "root", "lead")


def mates(members: DataFrame, labels: DataFrame, sequences: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity): links between mates of a bucket, enough to join all classes that any pair of mates joins."""
    rows = cells(members, labels, block).join(sequences, "content").select("cell", "content", "root", "lead", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:  # sorted by cell
            of = b.column(0).to_numpy()
            edge = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for lo, hi in zip(edge, edge[1:], strict=False):
                if held and hi > lo and held[0].column(0)[0].as_py() != of[lo]:
                    yield from cell(held)
                    held = []
                held += [b.slice(lo, hi - lo)] * (hi > lo)
        if held:
            yield from cell(held)

    def cell(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        lead = np.flatnonzero(t.column("lead").to_numpy())
        if len(lead) and t.num_rows > 1:
            seqs = [x for c in t.column("grams").chunks for x in _grams_of(c)]
            links = joining_links(t.column("content").to_pylist(), t.column("root").to_pylist(), seqs, lead, threshold)
            if links:
                a, b, got = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(map(min, a, b), pa.binary()), pa.array(map(max, a, b), pa.binary()), pa.array(got)], names=["a", "b", "similarity"])

    return rows.repartition("cell").sortWithinPartitions("cell").transform(_io.arrow_map, run, "a binary, b binary, similarity double")


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) of all nodes of links (a, b): root is the least node of a component.

    Each round hooks every node to the least label among its own and its
    neighbours', then replaces each label by its label's label, so long chains
    halve. Aggregates are partial first, so a node with many links is no hot
    key. Rounds end when no label changes."""
    edges = _io.materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = _io.materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    for _ in range(limit):
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("root").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        # a root is told of what its members have seen too
        hooked = labels.join(near, "node").select("node", "root", F.least("root", "seen").alias("new"))
        told = hooked.groupBy(F.col("root").alias("node")).agg(F.min("new").alias("told"))
        stepped = hooked.join(told, "node", "left").select("node", "root", F.least("new", F.coalesce("told", "new")).alias("new"))
        jump = stepped.select(F.col("node").alias("new"), F.col("new").alias("further"))
        new = _io.materialize(stepped.join(jump, "new", "left").select("node", F.least(F.coalesce("further", "new"), "new").alias("new"), "root"), "labels")
        changed = new.where("new <> root").limit(1).count()
        _io.discard(labels)
        labels = new.select("node", F.col("new").alias("root"))
        labels._veridex_path = new._veridex_path
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {limit} rounds")
    _io.discard(edges)
    return labels


def sequences_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(content, grams): the numbered shingles, in text order, of each content of `wanted`. rows: (doc_id, content)."""
    who = rows.join(wanted, "content").groupBy("content").agg(F.min("doc_id").alias("id"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    found = docs.select("doc_id", text).join(who, F.col("doc_id").eqNullSafe(F.col("id"))).select("content", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # an id may have other texts too
            buf, off = K.utf8(b.column(1))
            for i, j, c, o in K.chunks(buf, off):
                content, grams = _content(c, o)
                want = b.column(0).slice(i, j - i)
                same = [k for k, (x, y) in enumerate(zip(content, want.to_pylist(), strict=True)) if x == y]
                raw = [grams.hash[grams.first[k] : grams.first[k + 1]].tobytes() for k in same]
                yield pa.RecordBatch.from_arrays([want.take(pa.array(same, pa.int64())), pa.array(raw, pa.binary())], names=["content", "grams"])

    return found.transform(_io.arrow_map, own, "content binary, grams binary").dropDuplicates(["content"])


def classify(docs: DataFrame, m: int = M, ell: int = ELL, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (doc_id, content, root, class) of every row, root
    naming the class by a content; links (a, b, similarity) between contents,
    enough of them to join each class."""
    rows = _io.materialize(sketches(docs, m, ell), "sketches")
    reps = rows.groupBy("content").agg(F.first("signatures").alias("signatures"), F.first("n_shingles").alias("n_shingles")).where(F.size("signatures") > 0)
    in_buckets = _io.materialize(buckets(reps), "buckets")
    wanted = in_buckets.select("content").distinct()
    sequences = _io.materialize(sequences_of(docs, rows, wanted), "sequences")
    first = _io.materialize(verify(end_pairs(in_buckets), sequences, threshold), "links")
    joined = components(first).withColumnRenamed("node", "content")
    labels = _io.materialize(wanted.join(joined, "content", "left").select("content", F.coalesce("root", "content").alias("root")), "classes")
    second = _io.materialize(mates(in_buckets, labels, sequences, threshold, block), "links")
    root = lambda c: labels.select(F.col("content").alias(c), F.col("root").alias(f"{c}_root"))
    further = components(second.join(root("a"), "a").join(root("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    roots = labels.join(further.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("content", F.coalesce("further", "root").alias("root"))
    least = rows.groupBy("content").agg(F.min("doc_id").alias("least_id"))
    classes = least.join(roots, "content", "left").withColumn("root", F.coalesce("root", "content"))
    classes = _io.materialize(classes, "classes-named")
    _io.discard(in_buckets, sequences, joined, labels, further)
    named = classes.groupBy("root").agg(F.min("least_id").alias("class"))
    members = rows.select("doc_id", "content").join(classes.select("content", "root").join(named, "root").select("content", "root", "class"), "content")
    return members.select("doc_id", "content", "root", "class"), first.unionByName(second)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) of every document."""
    members, _ = classify(_io.table(spark, sf_dir, "documents"))
    return members.select("doc_id", F.col("class").alias("class_id"))


def one_of_each_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: of the rows of its least doc_id (null last) the one of the least content."""
    members, _ = classify(docs)
    least = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("of"))
    kept = least.select(F.col("of.content").alias("_content"), id_key(F.col("of.doc_id")).alias("_id"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    src = docs.toDF(*names)
    at, id_at = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.utf8(b.column(at))
            content = [x for _, _, c, o in K.chunks(buf, off) for x in _content(c, o)[0]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(content, pa.binary())], names=[*names, "_content"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    tagged = src.transform(_io.arrow_map, run, StructType([*src.schema.fields, StructField("_content", BinaryType())])).withColumn("_id", id_key(F.col(names[id_at])))
    once = Window.partitionBy("_content", "_id").orderBy(F.lit(0))
    return tagged.join(kept, ["_content", "_id"], "left_semi").withColumn("_n", F.row_number().over(once)).where("_n = 1").select(*names).toDF(*docs.columns)


def id_key(doc_id: Column) -> Column:
    """Never null, and different for null and any id."""
    return F.coalesce(doc_id.cast("string"), F.lit("null"))
