"""Removal of repeated substrings by suffix arrays (operator 6).

A byte goes if a string of `length` (400) bytes that covers it starts anywhere
else too, in any document; strings don't cross documents, and are judged on the
input. All is exact up to collisions of hashes (64 bits among runs of one key,
128 among windows of hot keys).

1. Each document's windows of `length` bytes are put into runs by their least
   k-gram (see _windows); equal windows have one key. Runs of equal bytes are
   counted. A run that occurs twice is repeated as a whole.
2. What is left are runs whose key occurs with other bytes too (ends of
   passages, places of edits) or twice in the run itself (periodic text). Each
   distinct run of such a key is fetched once, and runs are dealt by key into
   shards of about a megabyte. Each shard's suffix array is made by induced
   sorting, and its permuted longest common prefixes show which windows stand
   twice.
3. A key of more than MOST_RUNS distinct runs (the edge of a passage that very
   many documents share) would need too large a shard: of such keys each window
   is counted by its own hash instead, which Spark spreads over all tasks.
4. Spans are gathered by document and cut out.

Besides, repeated passages of `words` (51) words or more are found, however
short the words are: words are runs of bytes other than ASCII blanks, and take
the place of bytes in step 1; all windows of runs that need a closer look are
counted by hash, as in step 3. The query counts them in columns of their own;
the pipeline's stage cuts them out with the rest.

Each repeated window has a first place, by hash of doc_id, hash of text and
position. The stage cuts out all places, but where nothing except blanks would
be left of a document, its first places stay: a text whose every part stands
elsewhere too is kept once.

Null text is empty. Rows of one id are told apart by their texts; equal rows
repeat each other (and share their first places). Documents shorter than
`length` bytes and `words` words never lose anything. An empty table gives no
rows. Other columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from . import _io
from . import _kernel as K
from ._windows import run_keys
from .suffix_array import repeated

LENGTH, GRAM, SHARD_BYTES, MOST_RUNS = 400, 200, 1 << 20, 2000
PASSAGE, PASSAGE_GRAM = 51, 25
BYTES, WORDS = 0, 1
_WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Never in UTF-8.
END = 255
_RUN = K.constants(256, 202)
_SALT = np.uint64(0x9E3779B97F4A7C15)


def text_hash(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    return K.span_hash(K.prefix_hash(buf), off[:-1], off[1:]).view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """docs' id as r1 and text; with the text's hash, r1 tells rows apart."""
    return docs.select(F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("r1"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _words(buf: np.ndarray, off: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(starts, ends, first word of each document and the total) of words, and two prefix hashes over them."""
    s, e, first = K.spans(buf, off, _WORD)
    return s, e, first, [K.prefix_of(K.span_hash(x, s, e) if len(s) else np.zeros(0, np.uint64)) for x in (p, q)]


def runs(docs: DataFrame, length: int, gram: int, words: int, word_gram: int) -> DataFrame:
    """The runs of windows of each document, in bytes and in words: (r1, r2, kind,
    p, n, key, run, again, start, end), n windows from p on (in bytes or words),
    a hash of all they cover, whether windows may repeat within, and (of words) the bytes they cover."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r1 = b.column(0).to_numpy()
            buf, off = K.utf8(b.column(1))
            for i, j, c, o in K.chunks(buf, off, 1 << 18):
                p, q = K.prefix_hash(c), K.prefix_hash(c, _RUN)
                r2 = K.span_hash(p, o[:-1], o[1:]).view(np.int64)
                doc, at, n, key, again = run_keys(c, o, length, gram, p)
                if len(doc):
                    end = at + n + length - 1
                    yield batch(r1[i:j][doc], r2[doc], BYTES, at - o[doc], n, key, K.span_hash(q, at, end), again, None, None)
                s, e, first, prefix = _words(c, o, p, q)
                doc, at, n, key, again = run_keys(s, first, words, word_gram, prefix[0])
                if len(doc):
                    last = at + n + words - 1
                    yield batch(r1[i:j][doc], r2[doc], WORDS, at - first[doc], n, key ^ _SALT, K.span_hash(prefix[1], at, last), again, s[at] - o[doc], e[last - 1] - o[doc])

    def batch(r1, r2, kind, p, n, key, run, again, start, end) -> pa.RecordBatch:
        cols = r1, r2, np.full(len(r1), kind, np.int8), p, n, key.view(np.int64), run.view(np.int64), again, start, end
        return pa.RecordBatch.from_arrays([pa.nulls(len(r1), pa.int64()) if x is None else pa.array(x) for x in cols], names=["r1", "r2", "kind", "p", "n", "key", "run", "again", "start", "end"])

    return keyed(docs).transform(_io.arrow_map, each, "r1 long, r2 long, kind byte, p long, n long, key long, run long, again boolean, start long, end long")


def _structs(column: pa.ListArray, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(offsets of n + 1, fields) of a column of lists of structs; null is an empty list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(size)]), [flat.field(x).to_numpy(zero_copy_only=False) for x in names]


def _every(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i] .. start[i] + n[i] - 1 for all i in turn."""
    total = np.cumsum(n)
    return np.arange(int(total[-1]) if len(n) else 0) + np.repeat(start - (total - n), n)


def fetched(docs: DataFrame, look: DataFrame, length: int, words: int) -> DataFrame:
    """What of the runs `look` (r1, r2, kind, p, n, key, hot) is to be looked at:
    runs with their bytes, or (words, and hot keys) each window with two hashes.
    (r1, r2, kind, key, start, end, n, bytes, h1, h2); each document's runs meet its text once."""
    places = look.groupBy("r1", "r2").agg(F.collect_set(F.struct("kind", "p", "n", "key", "hot")).alias("places"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.utf8(b.column(1))
            h = [text_hash(c, o) for _, _, c, o in K.chunks(buf, off)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(h)), b.column(1)], names=["r1", "r2", "text"])

    schema = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("kind", pa.int8()), ("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary()), ("h1", pa.int64()), ("h2", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            buf, off = K.utf8(b.column("text"))
            of, (kind, p, n, key, hot) = _structs(b.column("places"), ("kind", "p", "n", "key", "hot"))
            for k, (r1, r2) in enumerate(zip(b.column("r1").to_pylist(), b.column("r2").to_pylist(), strict=True)):
                own, at = buf[off[k] : off[k + 1]], slice(of[k], of[k + 1])
                spread = (kind[at] == BYTES) & ~hot[at]
                for x, m, name in zip(p[at][spread].tolist(), n[at][spread].tolist(), key[at][spread].tolist(), strict=True):
                    rows.append((r1, r2, name, x, x + m + length - 1, m, own[x : x + m + length - 1].tobytes()))
                if len(rows) >= 4096:
                    yield pack(rows)
                    rows = []
                if spread.all():
                    continue
                hashes = K.prefix_hash(own), K.prefix_hash(own, _RUN)
                for one in (BYTES, WORDS):
                    these = (kind[at] == one) & ~spread
                    each = _every(p[at][these], n[at][these])
                    if not len(each):
                        continue
                    if one == BYTES:
                        yield windows(r1, r2, one, each, each + length, [K.span_hash(x, each, each + length) for x in hashes])
                    else:
                        s, e, _, prefix = _words(own, np.array([0, len(own)]), *hashes)
                        yield windows(r1, r2, one, s[each], e[each + words - 1], [K.span_hash(x, each, each + words) ^ _SALT for x in prefix])
        if rows:
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        r1, r2, key, start, end, n, data = zip(*rows, strict=True)
        m = len(rows)
        return pa.RecordBatch.from_arrays([*(pa.array(x, t.type) for x, t in zip((r1, r2, [BYTES] * m, key, start, end, n, data), schema, strict=False)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], schema=schema)

    def windows(r1: int, r2: int, kind: int, start: np.ndarray, end: np.ndarray, h: list[np.ndarray]) -> pa.RecordBatch:
        m = len(start)
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, r1)), pa.array(np.full(m, r2)), pa.array(np.full(m, kind, np.int8)), pa.nulls(m, pa.int64()), pa.array(start), pa.array(end), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), *(pa.array(x.view(np.int64)) for x in h)], schema=schema)

    joined = keyed(docs).transform(_io.arrow_map, hashed, "r1 long, r2 long, text string").join(places, ["r1", "r2"])
    return joined.transform(_io.arrow_map, cut, "r1 long, r2 long, kind byte, key long, start long, end long, n long, bytes binary, h1 long, h2 long")


def in_shards(cuts: DataFrame, length: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(r1, r2, kind, start, end, first): repeated windows of `cuts` (r1, r2, key, start, n, bytes), found shard by shard."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:  # sorted by key, so a key's runs are together
            while b.num_rows:
                key, off = b.column("key").to_numpy(), K.utf8(b.column("bytes"))[1]
                at = int(np.searchsorted(off, max(0, shard_bytes - size)))
                if at > b.num_rows - 1:
                    held.append(b)
                    size += int(off[-1])
                    break
                # the shard ends where a key does
                last = key[max(0, at - 1)] if at else held[-1].column("key")[-1].as_py() if held else key[0]
                end = int(np.argmax(np.append(key[at:] != last, True))) + at
                held.append(b.slice(0, end))
                size += int(off[end])
                if end < b.num_rows:
                    yield from shard(held)
                    held, size = [], 0
                b = b.slice(end)
        if held:
            yield from shard(held)

    def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        buf, off = K.utf8(t.column("bytes"))
        r1, r2, p, n = (t.column(x).to_numpy() for x in ("r1", "r2", "start", "n"))
        count = len(n)
        to = off[:-1] + np.arange(count)  # an end mark after each run
        text = np.full(len(buf) + count, END, np.uint8)
        text[np.arange(len(buf)) + np.repeat(np.arange(count), np.diff(off))] = buf
        valid = np.zeros(len(text), np.int8)
        np.add.at(valid, to, 1)
        np.add.at(valid, to + n, -1)
        found, group = repeated(text, length, np.cumsum(valid, dtype=np.int8) > 0)
        if len(found):
            row = np.searchsorted(to, found, "right") - 1
            order = np.lexsort((p, r2, r1))
            differ = [(x[order][1:] != x[order][:-1]) for x in (r1, r2, p)]
            rank = np.empty(count, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(differ[0] | differ[1] | differ[2])])
            place = rank[row] * (len(text) + 1) + found - to[row]
            least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, place)
            is_first = place == least[group]
            new = np.concatenate([[True], (found[1:] != found[:-1] + 1) | (row[1:] != row[:-1]) | (is_first[1:] != is_first[:-1])])
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(found)))
            k = row[begin]
            start = p[k] + found[begin] - to[k]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r1[k], r2[k], np.zeros(len(k), np.int8), start, start + size + length - 1, is_first[begin])], names=["r1", "r2", "kind", "start", "end", "first"])

    total = cuts.agg(F.sum("n") + F.count("*") * length).first()[0] or 0
    return cuts.select("r1", "r2", "key", "start", "n", "bytes").repartition(_io.partitions_for(total, 4 * shard_bytes), "key").sortWithinPartitions("key").transform(_io.arrow_map, sort, "r1 long, r2 long, kind byte, start long, end long, first boolean")


def by_window(cuts: DataFrame) -> DataFrame:
    """As in_shards, of windows (r1, r2, kind, start, end, h1, h2) counted by their hashes."""
    place = F.struct("r1", "r2", "start")
    twice = cuts.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(place).alias("least")).where("times > 1")
    return cuts.join(twice, ["h1", "h2"]).select("r1", "r2", "kind", "start", "end", (place == F.col("least")).alias("first"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_runs: int = MOST_RUNS, words: int = PASSAGE, word_gram: int = PASSAGE_GRAM) -> DataFrame:
    """(r1, r2, spans) of each document that has some: (kind, start, end, first) of repeated strings of `length`
    bytes or `words` words, in bytes; they may overlap. first: none of its windows stands at an earlier place,
    as far as no other span of it says so."""
    rows = _io.materialize(runs(docs, length, gram, words, word_gram), "runs")
    distinct = _io.materialize(rows.groupBy("key", "run").agg(F.count("*").alias("times"), F.max("again").alias("again")), "runs-distinct")
    open_keys = distinct.groupBy("key").agg(F.count("*").alias("n_runs"), F.min("times").alias("least"), F.max(F.col("again") & (F.col("times") == 1)).alias("again")).where("n_runs > 1 and least = 1 or again").select("key", "n_runs")
    wanted = _io.materialize(distinct.select("key", "run", "times").join(open_keys, "key", "left").where("times > 1 or n_runs is not null"), "runs-wanted")
    _io.discard(distinct)
    hits = _io.materialize(rows.drop("again").join(wanted, ["key", "run"]), "runs-hit")
    _io.discard(rows, wanted)
    place = F.struct("r1", "r2", "p")
    least = hits.where("times > 1").groupBy("key", "run").agg(F.min(place).alias("least"))
    marked = hits.join(least, ["key", "run"], "left").withColumn("first", F.coalesce(place == F.col("least"), F.lit(True)))
    end = F.coalesce("end", F.col("p") + F.col("n") + F.lit(length - 1))
    whole = _io.materialize(marked.where("times > 1").select("r1", "r2", "kind", F.coalesce("start", "p").alias("start"), end.alias("end"), "first"), "spans")
    look = marked.where("n_runs is not null and first").select("r1", "r2", "kind", "p", "n", "key", (F.col("n_runs") > most_runs).alias("hot"))
    cuts = _io.materialize(fetched(docs, look, length, words), "runs-to-look-at")
    _io.discard(hits)
    parts = [_io.materialize(in_shards(cuts.where("bytes is not null"), length), "spans"), _io.materialize(by_window(cuts.where("bytes is null")), "spans")]
    _io.discard(cuts)
    every = whole.unionByName(parts[0]).unionByName(parts[1])
    return every.groupBy("r1", "r2").agg(F.collect_set(F.struct("kind", "start", "end", "first")).alias("spans"))


def cut_out(docs: DataFrame, spans: DataFrame, kinds: tuple[int, ...] = (BYTES,), as_text: bool = False, keep_first: bool = False) -> DataFrame:
    """docs, with _spans (removed byte ranges, half open), _kept (the bytes that
    remain; as_text: their whole characters; keep_first: the first place of each
    string stays) and _passages (byte ranges of repeated passages of words,
    whether removed or not)."""
    schema = docs.schema
    at = docs.columns.index("text")
    names = [f"c{k}" for k in range(len(docs.columns))]
    id_name = names[docs.columns.index("doc_id")]
    src = docs.toDF(*names).withColumn("r1", F.xxhash64(id_name, F.col(id_name).isNull())).withColumn(names[at], F.col(names[at]).cast("string"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.utf8(b.column(at))
            h = [text_hash(c, o) for _, _, c, o in K.chunks(buf, off)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(h))], names=[*b.schema.names, "r2"])

    with_hash = src.transform(_io.arrow_map, hashed, StructType([*src.schema.fields, StructField("r2", LongType())]))
    joined = with_hash.join(spans, ["r1", "r2"], "left").select(*names, "spans")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def without(text: np.ndarray, cuts: list[tuple[int, int]]) -> bytes:
        return b"".join(text[x:y].tobytes() for x, y in zip([0, *(y for _, y in cuts)], [*(x for x, _ in cuts), len(text)], strict=True))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.utf8(b.column(at))
            kept, removed, said = [], [], []
            of, (kind, start, end, first) = _structs(b.column("spans"), ("kind", "start", "end", "first"))
            cut_of = np.isin(kind, kinds)
            for k in range(b.num_rows):
                text, here = buf[off[k] : off[k + 1]], slice(of[k], of[k + 1])
                if of[k] == of[k + 1]:
                    kept.append(text.tobytes())
                    removed.append([])
                    said.append([])
                    continue
                s, e, own = start[here], end[here], cut_of[here] & ~(first[here] & keep_first)
                cuts = merged(s[own], e[own])
                rest = without(text, cuts)
                words = kind[here] == WORDS
                kept.append(rest)
                removed.append([{"start": x, "end": y} for x, y in cuts])
                said.append([{"start": x, "end": y} for x, y in merged(s[words], e[words])])
            left = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(removed, span), left, pa.array(said, span)], names=[*names, "_spans", "_kept", "_passages"])

    pair = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    fields = [joined.schema[c] for c in names]
    out = joined.transform(_io.arrow_map, cut, StructType([*fields, StructField("_spans", pair), StructField("_kept", StringType() if as_text else BinaryType()), StructField("_passages", pair)]))
    return out.toDF(*schema.names, "_spans", "_kept", "_passages")


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans as maximal runs, in order."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    s, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > reach[:-1]]))
    return list(zip(s[new].tolist(), reach[np.append(new[1:] - 1, len(s) - 1)].tolist(), strict=True))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_runs: int = MOST_RUNS, words: int = PASSAGE, word_gram: int = PASSAGE_GRAM) -> DataFrame:
    """docs (doc_id, text and others), with _spans, _kept and _passages."""
    return cut_out(docs, repeats(docs, length, gram, most_runs, words, word_gram))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the number and bytes of repeated passages of PASSAGE words (which it doesn't remove)."""
    docs = _io.table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    in_passages = F.aggregate("_passages", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    return dedup(docs).select(
        "doc_id", n.alias("n_bytes"), (n - F.octet_length("_kept")).alias("n_removed"), F.size("_spans").cast("bigint").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"),
        F.size("_passages").cast("bigint").alias("n_passages"), in_passages.alias("n_passage_bytes"),
    )


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repetitions of passages of PASSAGE words or of LENGTH
    bytes: the first place of each stays, all others are cut out (a character
    cut in part goes whole), and n_chars is counted anew. First is least by a
    hash of id and text, then by place, so documents that share several passages
    agree on the first. A document of which only blanks are left goes, as all of
    it is kept in others."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = {c: names[k] for k, c in enumerate(docs.columns)}
    out = cut_out(docs, repeats(docs), (BYTES, WORDS), as_text=True, keep_first=True).toDF(*names, "spans", "kept", "passages")
    text = F.when(F.size("spans") == 0, F.col(at["text"])).otherwise(F.col("kept"))
    cols = [text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(at[c]).alias(c) for c in docs.columns]
    return out.where((F.size("spans") == 0) | F.col("kept").rlike(r"[^\t-\r ]")).select(*cols)
