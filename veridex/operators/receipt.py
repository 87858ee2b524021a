"""Receipts: canonical JSON, hashes that show tampering, and the rules a receipt keeps."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from . import storage as S

HASH = "^[0-9a-f]{64}$"


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks. Whole numbers have no fraction, as
    JavaScript prints them. Numbers that aren't finite and other types are refused."""
    if value is None or isinstance(value, bool | str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int | float):
        if not math.isfinite(value):
            raise ValueError("a number isn't finite")
        return N.plain(value)
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        # by UTF-16 code units, as JavaScript sorts
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    raise TypeError(f"{type(value).__name__} has no canonical form")


def canonical_json(text: Column) -> Column:
    """The canonical form of JSON text; null where it is none."""

    def each(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            try:
                out.append(None if x is None else canonical(json.loads(x)))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(each, "string")(text)


def sealed(bodies: DataFrame, body: str = "body") -> DataFrame:
    """bodies with their canonical form and its hash."""
    return bodies.withColumn("canonical", canonical_json(F.col(body))).withColumn("receipt_hash", F.sha2("canonical", 256))


def tampered(receipts: DataFrame, body: str = "body") -> DataFrame:
    """Receipts whose hash isn't that of their body."""
    again = receipts.withColumn("_hash", F.sha2(canonical_json(F.col(body)), 256))
    return again.where(~F.col("_hash").eqNullSafe(F.col("receipt_hash"))).drop("_hash")


def rule_violations(verdicts: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """(rule, subject). verdicts: claim_id, verdict, supporting, contradicting
    (arrays of evidence ids), numeric_disproof. evidence: id, claim_id, source_id,
    stance, excerpt, excerpt_hash. sources: id, content_hash."""
    side = lambda c, s: verdicts.select("claim_id", F.explode(c).alias("id"), F.lit(s).alias("need"))
    used = side("supporting", "supports").unionByName(side("contradicting", "contradicts"))
    known = evidence.select("id", F.col("claim_id").alias("of"), "stance")
    n_s, n_c = F.size("supporting"), F.size("contradicting")
    lacking = (
        (F.col("verdict").isin("supported", "supported_with_qualifications") & (n_s == 0))
        | ((F.col("verdict") == "contradicted") & (n_c == 0) & ~F.coalesce("numeric_disproof", F.lit(False)))
        | (F.col("verdict").isin("disputed", "outdated") & ((n_s == 0) | (n_c == 0)))
    )
    return S.violations(
        repeated_verdict=S.duplicate_keys(verdicts, ["claim_id"]),
        repeated_evidence=S.duplicate_keys(evidence, ["id"]),
        repeated_source=S.duplicate_keys(sources, ["id"]),
        unknown_claim=S.missing_references(evidence, "claim_id", verdicts, "claim_id").select("id"),
        unknown_source=S.missing_references(evidence, "source_id", sources, "id").select(evidence["id"]),
        changed_excerpt=evidence.where(~F.sha2("excerpt", 256).eqNullSafe(F.col("excerpt_hash"))).select("id"),
        malformed_hash=sources.where(~F.coalesce(F.col("content_hash").rlike(HASH), F.lit(False))).select("id"),
        both_sides=verdicts.where(F.arrays_overlap("supporting", "contradicting")).select("claim_id"),
        wrong_side=used.join(known, "id", "left").where(~((F.col("of") == F.col("claim_id")) & (F.col("stance") == F.col("need"))) | F.col("of").isNull()).select("claim_id"),
        lacking_evidence=verdicts.where(lacking).select("claim_id"),
    )
