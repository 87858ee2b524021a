"""Document fingerprints by Order MinHash (operator 9).

A fingerprint has `m` signatures. Each comes from one hash function: the `ell`
smallest occurrence-numbered word k-mers of the text, put back in text order
and hashed as a tuple. Order and repetition count, so it follows edit
distance, not only the set of k-mers. Words are runs of ASCII letters and
digits, `_` and all non-ASCII characters; ASCII case doesn't count.

Null text is empty text. A text of fewer than `k` words has one k-mer of all
its words; a text without words gets signatures from its bytes, so that equal
texts, and only those, agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from . import _kernel as K

WORDS, M, ELL, HASH_BITS = 5, 64, 2, 16
_TABLE = K.word_table()


def signatures(buf: np.ndarray, off: np.ndarray, k: int = WORDS, m: int = M, ell: int = ELL) -> np.ndarray:
    """(documents, m) 16-bit signatures of a chunk."""
    grams = K.Grams(buf, off, k, _TABLE)
    sig = K.tuple_hash(K.order_minhash(grams, m, ell))
    if len(bare := np.flatnonzero(np.diff(grams.first) == 0)):
        whole = K.span_hash(K.prefix_hash(buf), off[:-1][bare], off[1:][bare])
        sig[bare] = K.mix(whole[:, None] ^ K.constants(m, 41)[None, :])
    return (sig >> np.uint64(64 - HASH_BITS)).astype(np.uint16)


def as_hex(sig: np.ndarray) -> list[str]:
    width = sig.shape[1] * 4
    whole = sig.astype(">u2").tobytes().hex()  # big-endian: as numbers are written
    return [whole[i : i + width] for i in range(0, len(whole), width)]


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u2").astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray, ell: int = ELL) -> np.ndarray:
    """Share of k-mers in common that the share of equal signatures suggests:
    a signature agrees if all its ell k-mers do, hence the root."""
    return (a == b).mean(axis=-1) ** (1.0 / ell)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, m: int = M, ell: int = ELL) -> DataFrame:
    """(id, fingerprint) of every row; one map, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = K.utf8(b.column(1))
            out = [x for i, j, c, o in K.chunks(buf, off) for x in as_hex(signatures(c, o, k, m, ell))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[id_col, "fingerprint"])

    src = docs.select(F.col(id_col), F.col(text_col))
    return src.transform(_io.arrow_map, run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, fingerprint string")


class _Texts:
    """A chunk's texts with their code points found."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        self.starts = np.flatnonzero((buf & 0xC0) != 0x80)
        self.first = np.searchsorted(self.starts, off)
        self.n_chars = np.diff(self.first)

    def head(self, i: int, chars: int) -> bytes:
        """The first `chars` code points of text i, or all."""
        end = self.off[i + 1] if chars >= self.n_chars[i] else self.starts[self.first[i] + chars]
        return self.buf[self.off[i] : end].tobytes()


def _edited(this: _Texts, i: int, following: _Texts, j: int) -> bytes:
    half = int(this.n_chars[i]) // 2
    return this.head(i, int(this.n_chars[i]) - half) + following.head(j, half)


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer(b"".join(texts), np.uint8), off


def _signatures_of(texts: list[bytes], **kw) -> np.ndarray:
    buf, off = _pack(texts)
    return np.concatenate([signatures(c, o, **kw) for _, _, c, o in K.chunks(buf, off)])


def with_edit(docs: DataFrame, k: int = WORDS, m: int = M, ell: int = ELL, rows_per_task: int = 5000) -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document by descending doc_id; the last
    is followed by the first. Null ids come last; rows of one id go by text.
    Texts are shuffled once, by range of id. Neighbours within a range are at
    hand there; each range's first and last rows are joined afterwards.
    An empty table gives no rows; a single row is its own successor.
    """
    kw = {"k": k, "m": m, "ell": ell}
    id_type = docs.schema["doc_id"].dataType.simpleString()
    n = docs.select("doc_id").count()
    order = F.col("doc_id").desc_nulls_last()
    ranged = (
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .repartitionByRange(_io.partitions_for(n, rows_per_task), order)
        .sortWithinPartitions(order, F.col("text"))
    )
    schema = f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kind int, part int, payload string"
    arrow = pa.schema([("doc_id", _arrow_type(docs)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("kind", pa.int32()), ("part", pa.int32()), ("payload", pa.string())])

    def whole(ids: list, n_chars: list[int], edited: list[bytes], own: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        new = _signatures_of(edited, **kw)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, arrow.field(0).type), pa.array(n_chars, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
            pa.array(as_hex(own)), pa.array(as_hex(new)), pa.array(likeness(own, new, ell)), pa.array(likeness(own, after, ell)),
            pa.array([0] * len(ids), pa.int32()), pa.array([0] * len(ids), pa.int32()), pa.nulls(len(ids), pa.string()),
        ], schema=arrow)

    def edge(doc_id, sig: np.ndarray, kind: int, part: int, text: bytes) -> pa.RecordBatch:
        values = (doc_id, None, None, as_hex(sig[None, :])[0], None, None, None, kind, part, text.decode())
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = None  # (id, texts of one, signatures)
        for b in batches:
            ids, (buf, off) = b.column(0).to_pylist(), K.utf8(b.column(1))
            for i, j, c, o in K.chunks(buf, off):
                t, sig = _Texts(c, o), signatures(c, o, **kw)
                if last is None:
                    yield edge(ids[i], sig[0], 2, part, c[: o[1]].tobytes())
                n_here = j - i
                edited = [_edited(t, x, t, x + 1) for x in range(n_here - 1)]
                own, after, who, size = sig[:-1], sig[1:], ids[i : j - 1], t.n_chars[:-1].tolist()
                if last is not None:
                    edited.insert(0, _edited(last[1], 0, t, 0))
                    own, after = np.concatenate([last[2][None, :], own]), sig
                    who, size = [last[0], *who], [int(last[1].n_chars[0]), *size]
                if edited:
                    yield whole(who, size, edited, own, after)
                tail = c[o[-2] :].copy()
                last = ids[j - 1], _Texts(tail, np.array([0, len(tail)])), sig[-1].copy()
        if last is not None:
            yield edge(last[0], last[2], 1, part, last[1].buf.tobytes())

    rows = _io.materialize(ranged.transform(_io.arrow_map, neighbours, schema), "fingerprint-rows")
    # one number for each range that has rows: bounded by the number of tasks
    parts = sorted(r[0] for r in rows.where("kind = 2").select("part").collect())
    if not parts:
        return rows.drop("kind", "part", "payload")
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, follower int")
    tails = rows.where("kind = 1").select("part", "doc_id", "fingerprint", "payload").join(follows, "part")
    heads = rows.where("kind = 2").select(F.col("part").alias("follower"), F.col("fingerprint").alias("next_fingerprint"), F.col("payload").alias("next_payload"))
    pairs = tails.join(heads, "follower").select("doc_id", "fingerprint", "payload", "next_fingerprint", "next_payload")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                a, z = (_Texts(*_pack([r[x].encode()])) for x in ("payload", "next_payload"))
                yield whole([r["doc_id"]], a.n_chars.tolist(), [_edited(a, 0, z, 0)], from_hex(r["fingerprint"])[None, :], from_hex(r["next_fingerprint"])[None, :])

    return rows.where("kind = 0").unionByName(pairs.transform(_io.arrow_map, finish, schema)).drop("kind", "part", "payload")


def _arrow_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def op9_order_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edit(_io.table(spark, sf_dir, "documents"))
