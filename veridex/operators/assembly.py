"""Receipts built from relations: canonical JSON of any length, written in order and hashed as it goes by.

A receipt's body is an object of plain members, from a row for each audit, and
of sections, arrays whose items are rows of other relations. Members go by name,
items by their section's order. Nothing gathers an audit's rows: they are
partitioned by audit and sorted, and one pass feeds the text to the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .receipt import canonical_json

_OPEN, _ITEM, _CLOSE = 0, 1, 2


@dataclass(frozen=True)
class Section:
    """rows: a relation with the audits' key; item: what stands in the array, a struct or a plain value. Items go by `number`,
    then by `name` (text, by UTF-16 code units as JavaScript compares), then by their own text. nulls: whether null fields are written."""

    rows: DataFrame
    item: Column
    number: Column | None = None
    name: Column | None = None
    nulls: bool = True


def _json(value: Column, name: str, nulls: bool) -> Column:
    """{"name":value} in canonical form."""
    return canonical_json(F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": str(not nulls).lower()}))


def pieces(audits: DataFrame, sections: dict[str, Section], key: str = "audit_id") -> DataFrame:
    """(key, at, part, number, name, text): the body's text in pieces. at: the member's place; text of an item has no comma.
    audits: the key and a column for each plain member; rows of sections without an audit there are left out."""
    plain = [c for c in audits.columns if c != key]
    members = sorted([*plain, *sections], key=lambda k: k.encode("utf-16-be"))
    if len(set(members)) < len(members):
        raise ValueError("a member and a section, or two members, have one name")
    none = (F.lit(None).cast("bigint").alias("number"), F.lit(None).cast("binary").alias("name"))
    heads = []
    for at, member in enumerate(members):
        if member in sections:
            heads += [(at, _OPEN, F.lit(f'"{member}":[')), (at, _CLOSE, F.lit("]"))]
        else:
            text = _json(F.col(member), member, True)
            heads.append((at, _OPEN, F.substr(text, F.lit(2), F.length(text) - 2)))
    each = F.explode(F.array(*[F.struct(F.lit(at).alias("at"), F.lit(part).alias("part"), text.alias("text")) for at, part, text in heads]))
    out = audits.select(key, each.alias("p")).select(key, "p.at", "p.part", *none, "p.text")
    ids = audits.select(key)
    for name, s in sections.items():
        text = _json(s.item, "v", s.nulls)
        number = F.lit(None) if s.number is None else s.number
        spelt = F.lit(None) if s.name is None else F.encode(s.name, "UTF-16BE")
        rows = s.rows.select(key, F.lit(members.index(name)).alias("at"), F.lit(_ITEM).alias("part"), number.cast("bigint").alias("number"), spelt.cast("binary").alias("name"), F.substr(text, F.lit(6), F.length(text) - 6).alias("text"))
        out = out.unionByName(rows.join(ids, key, "left_semi"))
    return out


def built(audits: DataFrame, sections: dict[str, Section], key: str = "audit_id") -> DataFrame:
    """(key, n_items, n_bytes, receipt_hash) of every audit: SHA-256 of the body's canonical JSON. One task writes one audit, as the digest
    is of one text, but holds no more than a batch of its rows."""
    rows = pieces(audits, sections, key)
    ordered = rows.repartition(key).sortWithinPartitions(key, "at", "part", "number", "name", "text").select(key, "at", "part", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, digest, n_items, n_bytes = None, None, None, 0, 0
        started = False

        def done() -> pa.RecordBatch:
            digest.update(b"}")
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([n_items]), pa.array([n_bytes + 1]), pa.array([digest.hexdigest()])], names=[key, "n_items", "n_bytes", "receipt_hash"])

        for b in batches:
            kind = b.schema.field(0).type
            said: list[bytes] = []

            def flush() -> None:
                nonlocal n_bytes
                raw = b"".join(said)
                digest.update(raw)
                n_bytes += len(raw)
                said.clear()

            for audit, at, part, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not started or audit != now:
                    if started:
                        flush()
                        yield done()
                    now, state, digest, n_items, n_bytes, started = audit, None, hashlib.sha256(), 0, 0, True
                    said.append(b"{")
                if state and (part == _ITEM == state[1] or at != state[0]):
                    said.append(b",")
                said.append(text.encode())
                n_items += part == _ITEM
                state = (at, part)
            if started:
                flush()
        if started:
            yield done()

    types = f"{key} {audits.schema[key].dataType.simpleString()}, n_items bigint, n_bytes bigint, receipt_hash string"
    return ordered.mapInArrow(run, types)
