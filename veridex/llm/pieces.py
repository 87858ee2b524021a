"""SentencePiece encoding and decoding on the tokenizers library (operator 5).

The model's protobuf is parsed here, field by field; normaliser, metaspace
marker, scores (unigram) or merges in order of score (BPE), and byte fallback
are rebuilt from it for the `tokenizers` library, which encodes batches with
several threads.

Where no piece of the model has a marker after another character (so no merge
crosses from one word into the next), a text's words can be encoded apart: each
distinct word of a task is encoded once and looked up afterwards. The lookup is
emptied at MEMO_WORDS words, so memory is bounded. Otherwise whole texts are
encoded.

Parity with the sentencepiece library is verified for every row. Where words
are encoded apart and the normaliser only turns blanks into markers, each word
is held against sentencepiece when it is learnt, and a row has parity if all its
words have: sentencepiece, too, merges no further than a word. Other models'
texts are held against it whole. `verify` compares whole texts with any model.

Null text is empty text and has no ids. Text that the normaliser changes, or
that has the marker U+2581 itself, doesn't decode to itself: `round_trip`, which
is of the decoded ids and the text, says so. Rows are encoded by themselves, so
repeated rows give equal rows and an empty table none; merges of equal score go
by the ids of their parts. Columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io
from . import _kernel as K

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MEMO_WORDS = 150_000
#: Threads that a worker encodes with, where RAYON_NUM_THREADS isn't set. Workers share a machine, and each thread keeps memory of its own.
THREADS = 2
#: Words that are encoded as one text.
JOINED = 1000
# Model and piece types of the format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_SPLIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


@dataclass
class Spec:
    """What of a model's protobuf encoding needs."""

    pieces: list[tuple[str, float, int]]
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Spec:
        s = cls([])
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                s.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in fields(value):
                    if n == 3:
                        s.model_type = v
                    elif n == 35:
                        s.byte_fallback = bool(v)
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        s.charsmap = v
                    elif n == 3:
                        s.dummy_prefix = bool(v)
                    elif n == 4:
                        s.remove_extra = bool(v)
        return s


class Codec:
    """Encodes and decodes as the model does."""

    def __init__(self, data: bytes, memo_words: int = MEMO_WORDS):
        self.data, self.spec, self.memo_words = data, Spec.parse(data), memo_words
        self._forget()

    @cached_property
    def tokenizer(self):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        s = self.spec
        unk = next((p for p, _, k in s.pieces if k == UNKNOWN), None)
        if s.model_type == BPE:
            ids = {p: i for i, (p, _, _) in enumerate(s.pieces)}
            merges = sorted((-score, ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for p, score, k in s.pieces if k == NORMAL for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids)
            model = models.BPE(vocab=ids, merges=[m[3:] for m in merges], unk_token=unk, fuse_unk=True, byte_fallback=s.byte_fallback)
        elif s.model_type == UNIGRAM:
            at = next((i for i, (_, _, k) in enumerate(s.pieces) if k == UNKNOWN), None)
            model = models.Unigram([(p, score) for p, score, _ in s.pieces], unk_id=at, byte_fallback=s.byte_fallback)
        else:
            raise ValueError(f"model type {s.model_type}: only unigram and BPE models are rebuilt")
        t = Tokenizer(model)
        steps = [normalizers.Precompiled(s.charsmap)] if s.charsmap else []
        if s.remove_extra:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        steps += [normalizers.Prepend(MARK)] * s.dummy_prefix + [normalizers.Replace(" ", MARK)]
        self.normalizer = normalizers.Sequence(steps)
        if self.by_word:
            t.pre_tokenizer = pre_tokenizers.Split(Regex(_SPLIT.pattern), "isolated")
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if s.dummy_prefix else [])])
        t.add_tokens([AddedToken(p, normalized=False) for p, _, k in s.pieces if k == USER_DEFINED])
        return t

    @cached_property
    def by_word(self) -> bool:
        return not any(MARK in p.lstrip(MARK) for p, _, k in self.spec.pieces if k in (NORMAL, USER_DEFINED))

    @cached_property
    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """(all pieces' bytes, offsets): what each id decodes to."""
        out = [bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in self.spec.pieces]
        off = np.zeros(len(out) + 1, np.int64)
        np.cumsum([len(x) for x in out], out=off[1:])
        return np.frombuffer(b"".join(out), np.uint8), off

    def normalized(self, text: str) -> str:
        s = self.spec
        if not s.charsmap and not s.remove_extra:  # a blank is all that changes
            return (MARK if s.dummy_prefix and text else "") + text.replace(" ", MARK)
        return self.normalizer.normalize_str(text)

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids, self.at = [np.zeros(0, np.int32)], [0]
        self.agrees = np.zeros(0, bool)

    @cached_property
    def peer(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.data)

    @cached_property
    def verified_by_word(self) -> bool:
        s = self.spec
        return self.by_word and s.dummy_prefix and not s.charsmap and not s.remove_extra

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of n + 1)."""
        return self._encoded(texts)[:2]

    def encode_verified(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As encode, and whether sentencepiece gives each text the same ids."""
        if not self.verified_by_word:
            ids, off = self.encode(texts)
            return ids, off, np.array(self._same(texts, ids, off), bool)
        ids, off, words, first = self._encoded(texts)
        if len(self.agrees) < len(self.at) - 1:
            self._verify_words()
        wrong = np.concatenate([[0], np.cumsum(~self.agrees[words])])
        return ids, off, wrong[first[1:]] == wrong[first[:-1]]

    def _verify_words(self) -> None:
        """Holds the words learnt since the last time against sentencepiece."""
        known = len(self.agrees)
        new = sorted((i, w) for w, i in self.memo.items() if i >= known)
        ids, at = self.ids[0].tolist(), self.at
        front = self.peer.encode("a")  # markers alone are held against what follows this: an empty text would get no marker
        theirs = self.peer.encode(["a" + w.replace(MARK, " ") if w.strip(MARK) == "" else w.removeprefix(MARK).replace(MARK, " ") for _, w in new], num_threads=1)
        ok = [w[0] == MARK and (front if w.strip(MARK) == "" else []) + ids[at[i] : at[i + 1]] == x for (i, w), x in zip(new, theirs, strict=True)]
        self.agrees = np.concatenate([self.agrees, np.array(ok, bool)])

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of n + 1, known words of all texts, first word of each text and the total)."""
        t = self.tokenizer
        norm = [self.normalized(x) for x in texts]
        if not self.by_word:
            found = [e.ids for e in t.encode_batch_fast(norm, add_special_tokens=False)]
            off = np.zeros(len(found) + 1, np.int64)
            np.cumsum([len(x) for x in found], out=off[1:])
            none = np.zeros(0, np.int64)
            return np.array([i for x in found for i in x], np.int32), off, none, none
        words = [_SPLIT.findall(x) for x in norm]
        if len(self.memo) > self.memo_words:
            self._forget()
        memo = self.memo
        if new := set().union(*words).difference(memo):
            self._learn(list(new))
        flat, at = self.ids[0], np.array(self.at, np.int64)
        per_text = [len(ws) for ws in words]
        w = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.int64, sum(per_text))
        per_word = at[w + 1] - at[w]
        end = np.concatenate([[0], np.cumsum(per_word)])
        first = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)
        return flat[ragged(at[w], per_word)], end[first], w, first

    def _learn(self, words: list[str]) -> None:
        """Encodes words that aren't known yet. Those with a marker in front and
        none at the end are encoded joined, many to a text, and told apart by the
        bytes their pieces cover; where those don't tile (unknown characters), one by one."""
        data_at = self.piece_bytes[1]
        whole = [w for w in words if w[0] == MARK and w[-1] != MARK]
        apart = [w for w in words if w[0] != MARK or w[-1] == MARK]
        groups = [whole[i : i + JOINED] for i in range(0, len(whole), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            covered = np.cumsum(data_at[ids + 1] - data_at[ids])
            blank = np.frombuffer("".join(group).replace(MARK, " ").encode(), np.uint8) == 32  # other blanks have become markers
            end = np.append(np.flatnonzero(blank[1:] & ~blank[:-1]) + 1, len(blank))
            last = np.searchsorted(covered, end)
            if last[-1] >= len(ids) or (covered[last] != end).any():
                apart += group
                continue
            self.memo.update(zip(group, range(len(self.at) - 1, len(self.at) - 1 + len(group)), strict=True))
            self.at += (self.at[-1] + last + 1).tolist()
            self.ids.append(ids)
        for w, e in zip(apart, self.tokenizer.encode_batch_fast(apart, add_special_tokens=False), strict=True):
            self.memo[w] = len(self.at) - 1
            self.at.append(self.at[-1] + len(e.ids))
            self.ids.append(np.array(e.ids, np.int32))
        self.ids = [np.concatenate(self.ids)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 of all texts, offsets of n + 1)."""
        data, at = self.piece_bytes
        size = at[ids + 1] - at[ids]
        end = np.concatenate([[0], np.cumsum(size)])[off]
        flat = data[ragged(at[ids], size)]
        if self.spec.dummy_prefix and len(flat):  # the blank that the prefix has become
            first = end[:-1][np.diff(end) > 0]
            drop = first[flat[first] == 32]
            keep = np.ones(len(flat), bool)
            keep[drop] = False
            end = end - np.searchsorted(drop, end)
            flat = flat[keep]
        return flat, end

    def verify(self, texts: list[str]) -> list[bool]:
        """Whether sentencepiece itself gives the same ids."""
        return self._same(texts, *self.encode(texts))

    def _same(self, texts: list[str], ids: np.ndarray, off: np.ndarray) -> list[bool]:
        return [ids[off[i] : off[i + 1]].tolist() == x for i, x in enumerate(self.peer.encode(texts, num_threads=1))]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start[i] .. start[i] + size[i] - 1 for all i in turn."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return np.arange(total) + np.repeat(start - (end - size), size)


def encode(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, ids, round_trip, parity) of every row; one map, no shuffle."""
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

    with open(model_path, "rb") as f:
        data = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)  # the model's file: about half a megabyte
    src = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        codec = Codec(shared.value)
        for b in batches:
            buf, off = K.utf8(b.column(1))
            for i, j, c, o in K.chunks(buf, off, 1 << 20):  # a larger chunk has fewer new words each
                raw = c.tobytes()
                texts = [raw[x:y].decode() for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                ids, at, parity = codec.encode_verified(texts)
                back, end = codec.decode(ids, at)
                back = back.tobytes()
                same = [back[end[k] : end[k + 1]] == raw[o[k] : o[k + 1]] for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(same, pa.bool_()), pa.array(parity, pa.bool_())], names=["doc_id", "ids", "round_trip", "parity"])

    return src.transform(_io.arrow_map, run, StructType([src.schema["doc_id"], StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType()), StructField("parity", BooleanType())]))


def decode(rows: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids). Null ids give empty text; bytes that aren't UTF-8 are replaced."""
    with open(model_path, "rb") as f:
        data = f.read()
    shared = rows.sparkSession.sparkContext.broadcast(data)
    src = rows.select("doc_id", F.coalesce(F.col("ids"), F.array().cast("array<int>")).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for b in batches:
            col = b.column(1)
            off = col.offsets.to_numpy().astype(np.int64)
            ids = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
            flat, end = codec.decode(ids.astype(np.int64), off - off[0])
            raw = flat.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)])], names=["doc_id", "text"])

    from pyspark.sql.types import StringType, StructField, StructType

    return src.transform(_io.arrow_map, run, StructType([src.schema["doc_id"], StructField("text", StringType())]))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_io.table(spark, sf_dir, "documents")).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "round_trip", "parity")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage's rows: each pass over a document with its ids."""
    return encode(docs)
