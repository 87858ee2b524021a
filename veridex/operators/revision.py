"""Revisions: which sentence may replace a claim that doesn't hold, and what is left when none may.

A change cites few pieces of evidence; only those are joined to it. What else
its rules need of a claim's evidence is one flag, and the best excerpt of each
stance is a `min_by`, so no claim's evidence is gathered.

claims: claim_id, text. verdicts: claim_id, verdict, supporting, contradicting,
required_correction (null: nothing to revise, no row). evidence: id, claim_id,
stance, relevance, excerpt, validated, qualifiers_omitted. checks: claim_id,
kind, inputs, claimed_result, computed_result, grounded, matches,
source_evidence_ids (see numeric.py); claims without a check need none. Nulls
among arrays and texts count as empty.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import revising as V
from ..functions import text as T
from .evidence import change_kind

_OUT = "ok:boolean,reason:string,citations:array<string>,numeric_used:boolean"
CHECK = ("kind", "inputs", "claimed_result", "computed_result", "grounded", "matches", "source_evidence_ids")


def unique_validated(evidence: DataFrame) -> DataFrame:
    """Validated evidence whose id occurs once."""
    once = evidence.groupBy("id").count().where("count = 1").select("id")
    return evidence.where("validated").join(once, "id", "left_semi")


def _check(x: object) -> V.Check | None:
    if x is None or x["kind"] is None:
        return None
    inputs = {k: v for k, v in dict(x["inputs"] or {}).items() if v is not None}
    number = lambda v: None if v is None or pd.isna(v) else float(v)
    return V.Check(x["kind"], inputs, number(x["claimed_result"]), number(x["computed_result"]), bool(x["grounded"]), None if x["matches"] is None else bool(x["matches"]), list(x["source_evidence_ids"] if x["source_evidence_ids"] is not None else []))


def _rows(s: pd.Series | pd.DataFrame) -> list:
    return s.to_dict("records") if isinstance(s, pd.DataFrame) else s.tolist()


def validated(changes: DataFrame, evidence: DataFrame, checks: DataFrame) -> DataFrame:
    """changes (claim_id, original, replacement, verdict, citations) with `outcome`: ok, the first reason
    against it, its citations, and whether arithmetic grounds it. evidence: what is eligible, each id once."""

    def judge(original: pd.Series, replacement: pd.Series, verdict: pd.Series, citations: pd.Series, cited: pd.Series, qualifying: pd.Series, check: pd.DataFrame) -> pd.DataFrame:
        out = []
        for o, r, v, ids, ev, q, c in zip(original, replacement, verdict, citations, cited, qualifying, _rows(check), strict=True):
            by_id = {x["id"]: V.Cited(x["excerpt"] or "", x["stance"] or "", bool(x["qualifiers_omitted"])) for x in (ev if ev is not None else [])}
            got = V.validate(o or "", r or "", v or "", list(ids if ids is not None else []), by_id, _check(c), bool(q))
            out.append((got.ok, got.reason, got.citations, got.numeric_used))
        return pd.DataFrame(out, columns=["ok", "reason", "citations", "numeric_used"])

    c = changes.withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))
    each = c.select("claim_id", F.explode(F.array_distinct("citations")).alias("id")).distinct()
    known = evidence.select("id", "claim_id", "excerpt", "stance", F.coalesce("qualifiers_omitted", F.lit(False)).alias("qualifiers_omitted"))
    cited = each.join(known, ["id", "claim_id"]).groupBy("claim_id").agg(F.collect_list(F.struct("id", "excerpt", "stance", "qualifiers_omitted")).alias("cited"))
    qualifying = evidence.groupBy("claim_id").agg(F.bool_or(F.col("stance") == "qualifies").alias("qualifying"))
    numeric = checks.select("claim_id", F.struct(*CHECK).alias("numeric"))
    blank = F.struct(*[F.lit(None).cast(checks.schema[k].dataType).alias(k) for k in CHECK])
    rows = c.join(cited, "claim_id", "left").join(qualifying, "claim_id", "left").join(numeric, "claim_id", "left").withColumn("numeric", F.coalesce("numeric", blank))
    outcome = F.pandas_udf(judge, f"struct<{_OUT}>")("original", "replacement", "verdict", "citations", "cited", "qualifying", "numeric")
    return rows.withColumn("outcome", outcome).select(*changes.columns, "outcome")


def eligible(verdicts: DataFrame, evidence: DataFrame, checks: DataFrame) -> DataFrame:
    """The evidence that a claim's revision may use: what its verdict names, what qualifies it (if that is the verdict), and the sources of a grounded check."""
    named = verdicts.join(checks.select("claim_id", F.when(F.col("grounded"), F.col("source_evidence_ids")).alias("sources")), "claim_id", "left")
    none = F.array().cast("array<string>")
    ids = F.array_union(F.array_union(F.coalesce("supporting", none), F.coalesce("contradicting", none)), F.coalesce("sources", none))
    allowed = named.select("claim_id", F.col("verdict").alias("_verdict"), ids.alias("_allowed"))
    usable = F.array_contains("_allowed", F.col("id")) | ((F.col("_verdict") == "supported_with_qualifications") & (F.col("stance") == "qualifies"))
    return unique_validated(evidence).join(allowed, "claim_id").where(usable).drop("_verdict", "_allowed")


def rank(verdict: Column, stance: Column, relevance: Column) -> Column:
    """Order in which evidence serves a verdict: least first."""
    against, limited = verdict.isin("contradicted", "outdated"), verdict == "supported_with_qualifications"
    first = F.when(against, "contradicts").when(limited, "qualifies").otherwise("supports")
    second = F.when(against, "qualifies").when(limited, "supports").otherwise("contradicts")
    return F.when(stance == first, 0).when(stance == second, 2).otherwise(4) + F.when(relevance == "strong", 0).otherwise(1)


def excerpt_sentence(excerpt: Column) -> Column:
    """An excerpt as one finished sentence, or null."""
    return F.when(~excerpt.rlike(V.PLACEHOLDER), T.polished(excerpt))


def numeric_sentence(checks: DataFrame) -> DataFrame:
    """(claim_id, numeric_text, numeric_sources) of checks that disprove their claim."""

    def each(x: pd.DataFrame) -> pd.Series:
        return pd.Series([(s[0] if (s := c.summary()) else None) if (c := _check(r)) else None for r in _rows(x)], dtype=object)

    text = F.pandas_udf(each, "string")(F.struct(*CHECK))
    return checks.select("claim_id", text.alias("numeric_text"), F.col("source_evidence_ids").alias("numeric_sources")).where("numeric_text is not null")


def deterministic(claims: DataFrame, verdicts: DataFrame, evidence: DataFrame, checks: DataFrame) -> DataFrame:
    """claim_id, kind, original, replacement ('' if no evidence serves), note, citations, source and numeric_check_claim_id of every claim to revise."""
    due = verdicts.where("required_correction is not null")
    usable = eligible(due, evidence, checks)
    ranked = usable.join(due.select("claim_id", "verdict"), "claim_id").withColumn("sentence", excerpt_sentence(F.col("excerpt"))).withColumn("rank", rank(F.col("verdict"), F.col("stance"), F.col("relevance")))
    best = lambda s: F.min_by(F.struct("id", "sentence"), F.when((F.col("stance") == s) & F.col("sentence").isNotNull(), F.struct("rank", "id"))).alias(s)
    picked = ranked.groupBy("claim_id").agg(best("supports"), best("contradicts"), best("qualifies"), F.collect_set("id").alias("available"))
    none = F.array().cast("array<string>")
    rows = claims.select("claim_id", F.col("text").alias("original")).join(due, "claim_id").join(picked, "claim_id", "left").join(numeric_sentence(checks), "claim_id", "left")
    s, c, q, v = (F.col(x) for x in ("supports", "contradicts", "qualifies", "verdict"))
    sources = F.coalesce("numeric_sources", none)
    can_compute = F.col("numeric_text").isNotNull() & (F.size(F.array_except(sources, F.coalesce("available", none))) == 0)
    limited = v == "supported_with_qualifications"
    cases = (
        ((v == "disputed") & s.isNotNull() & c.isNotNull(), F.concat(s["sentence"], F.lit(" "), c["sentence"]), F.array(s["id"], c["id"])),
        (limited & q.isNotNull(), q["sentence"], F.array(q["id"])),
        (limited & s.isNotNull(), F.concat(F.lit(V.LIMITED), s["sentence"]), F.array(s["id"])),
        (v.isin("outdated", "contradicted") & c.isNotNull(), c["sentence"], F.array(c["id"])),
        ((v == "contradicted") & can_compute, F.col("numeric_text"), sources),
    )
    text = ids = None
    for when, said, by in cases:
        text, ids = (F.when(when, said), F.when(when, by)) if text is None else (text.when(when, said), ids.when(when, by))
    proposed = rows.select("claim_id", "original", F.coalesce(text, F.lit("")).alias("replacement"), "verdict", F.coalesce(ids, none).alias("citations"), "required_correction")
    done = validated(proposed, usable, checks)
    ok = F.col("outcome.ok") & (F.col("replacement") != "")
    return done.select(
        "claim_id", change_kind(F.col("verdict")).alias("kind"), "original", F.when(ok, F.col("replacement")).otherwise("").alias("replacement"), F.col("required_correction").alias("note"),
        F.when(ok, F.col("citations")).otherwise(none).alias("citations"), F.lit("deterministic_revision").alias("source"), F.when(ok & F.col("outcome.numeric_used"), F.col("claim_id")).alias("numeric_check_claim_id"),
    )


def revised(proposals: DataFrame, claims: DataFrame, verdicts: DataFrame, evidence: DataFrame, checks: DataFrame) -> DataFrame:
    """As deterministic, but a model's proposal (claim_id, replacement, citations) that is valid stands instead. Failed claims and those without evidence take none."""
    fallback = deterministic(claims, verdicts, evidence, checks)
    due = verdicts.where("required_correction is not null and verdict not in ('failed', 'insufficient_evidence')")
    asked = proposals.select("claim_id", "replacement", "citations").join(claims.select("claim_id", F.col("text").alias("original")), "claim_id").join(due.select("claim_id", "verdict"), "claim_id")
    good = validated(asked, eligible(due, evidence, checks), checks).where("outcome.ok")
    new = good.select("claim_id", F.struct("replacement", F.col("outcome.citations").alias("citations"), F.col("outcome.numeric_used").alias("numeric_used")).alias("new"))
    took = F.col("new").isNotNull()
    return fallback.join(new, "claim_id", "left").select(
        "claim_id", "kind", "original", F.coalesce("new.replacement", "replacement").alias("replacement"), "note", F.coalesce("new.citations", "citations").alias("citations"),
        F.when(took, "revision_agent").otherwise(F.col("source")).alias("source"), F.when(took, F.when(F.col("new.numeric_used"), F.col("claim_id"))).otherwise(F.col("numeric_check_claim_id")).alias("numeric_check_claim_id"),
    )
