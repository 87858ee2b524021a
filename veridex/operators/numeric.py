"""Grounding of numeric relations: is what a model read from a claim really said there, or in its evidence?

Each claim's text and each excerpt is judged by itself (one Arrow pass over
claims, one over evidence); aggregates by claim then decide. No claim's
evidence is ever gathered into one task, so a claim may have any number of it.

Relations have claim_id, kind, inputs (map of doubles), claimed_result and
explanation, one a claim; nulls among the inputs count as missing, a null kind
as `none`. Relations of kind `none` give no row. Claims without a text ground
nothing. Evidence that isn't citation-validated doesn't count.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grounding as G
from ..functions import numeric as N

_OF_CLAIM = "used array<string>, bad array<string>, shown map<string,string>, found array<string>, cue boolean, roles boolean, units boolean, claimed_there boolean, asserted boolean, claimed_shown string, result double, expression string"
_OF_TEXT = "found array<string>, cue boolean, roles boolean, units boolean"


def _clean(inputs: object) -> dict[str, float]:
    return {k: v for k, v in (dict(inputs) if inputs is not None else {}).items() if v is not None}


def _finite(x: float | None) -> bool:
    return x is not None and math.isfinite(x)


def _in_text(kind: str, inputs: dict[str, float], claimed: float | None, text: str) -> dict:
    there = {q.value for q in G.quantities(text)}
    roles, units = G.said(kind, inputs, claimed, text)
    return {"found": [k for k in G.used(kind, inputs) if inputs.get(k) in there and _finite(inputs.get(k))], "cue": bool(G.CUES[kind].search(text)), "roles": roles, "units": roles and units, "there": there}


def _number(x: object) -> float | None:
    return None if x is None or pd.isna(x) else float(x)


def judged_claims(relations: DataFrame, claims: DataFrame) -> DataFrame:
    """relations with `own`: what the claim's text says of them. claims: claim_id, text."""

    def judge(kind: pd.Series, inputs: pd.Series, claimed: pd.Series, text: pd.Series) -> pd.DataFrame:
        out = []
        for k, raw, c, t in zip(kind, inputs, claimed, text, strict=True):
            values, c, t = _clean(raw), _number(c), t or ""
            seen, names = _in_text(k, values, c, t), G.used(k, values)
            exact, how = G.compute(k, values)
            out.append(
                {
                    "used": names, "bad": [x for x in names if not _finite(values.get(x))], "shown": {x: G.shown(v) for x, v in values.items() if _finite(v)}, "found": seen["found"], "cue": seen["cue"], "roles": seen["roles"],
                    "units": seen["units"], "claimed_there": c is None or c in seen["there"], "asserted": G.asserted(k, c, t), "claimed_shown": G.shown(c) if _finite(c) else None, "result": exact, "expression": how,
                }
            )
        return pd.DataFrame(out, columns=[x.split(" ")[0] for x in _OF_CLAIM.split(", ")])

    own = F.pandas_udf(judge, f"struct<{_OF_CLAIM}>".replace(" ", ":").replace(",:", ","))
    known = relations.where(F.col("kind").isin(*[k for k in G.INPUTS if k != "none"]))
    return known.join(claims.select("claim_id", F.col("text").alias("claim_text")), "claim_id", "left").withColumn("own", own("kind", "inputs", "claimed_result", "claim_text"))


def grounded(relations: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, kind, expression, computed_result, claimed_result, matches (null
    unless grounded), grounded, issues (in order) and source_evidence_ids of every
    relation. evidence: id, claim_id, excerpt, validated."""

    def judge(kind: pd.Series, inputs: pd.Series, claimed: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = [_in_text(k, _clean(v), _number(c), t or "") for k, v, c, t in zip(kind, inputs, claimed, text, strict=True)]
        return pd.DataFrame(rows, columns=["found", "cue", "roles", "units"])

    said = F.pandas_udf(judge, f"struct<{_OF_TEXT}>".replace(" ", ":").replace(",:", ","))
    own = judged_claims(relations, claims)
    texts = evidence.where("validated").select("id", "claim_id", "excerpt").join(own.select("claim_id", "kind", "inputs", "claimed_result", F.array_except("own.used", "own.found").alias("sought")), "claim_id")
    texts = texts.withColumn("said", said("kind", "inputs", "claimed_result", "excerpt"))
    is_source = F.arrays_overlap("said.found", "sought") | F.col("said.units")
    facts = texts.groupBy("claim_id").agg(
        F.bool_or("said.cue").alias("cue"), F.bool_or("said.roles").alias("roles"), F.bool_or("said.units").alias("units"),
        F.array_distinct(F.flatten(F.collect_set("said.found"))).alias("found"), F.array_sort(F.collect_set(F.when(is_source, F.col("id")))).alias("sources"),
    )
    r = own.join(facts, "claim_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("cue", "roles", "units")})
    no_text = F.array().cast("array<string>")
    r = r.withColumns({"found": F.coalesce("found", no_text), "sources": F.coalesce("sources", no_text)})
    kind, claimed = F.col("kind"), F.col("claimed_result")
    clash = (F.col("own.roles") & ~F.col("own.units")) | (~F.col("own.roles") & F.col("roles") & ~F.col("units"))
    per_input = F.transform(
        "own.used",
        lambda k: F.when(F.array_contains("own.bad", k), F.concat(F.lit("required input "), k, F.lit(" is missing or non-finite"))).when(
            ~F.array_contains("own.found", k) & ~F.array_contains("found", k), F.concat(F.lit("input "), k, F.lit("="), F.col("own.shown")[k], F.lit(" was not found in the claim or validated evidence"))
        ),
    )
    # What is said of a relation that isn't grounded.
    issues = F.array_compact(
        F.concat(
            F.array(
                F.when(F.size("own.used") == 0, F.concat(F.lit("no inputs were supplied for "), kind)),
                F.when(~F.col("own.cue") & ~F.col("cue"), F.concat(F.lit("the "), kind, F.lit(" relationship was not verified in the claim or validated evidence"))),
            ),
            per_input,
            F.array(
                F.when(clash, "the numeric units or magnitude scales were incompatible or unverified").when(
                    ~F.col("own.units") & ~F.col("units"),
                    F.concat(F.lit("the "), F.when(kind.isin("percent_change", "date_interval"), "from and to").otherwise("numeric"), F.lit(" roles were not verified in the claim or validated evidence")),
                ),
                F.when(~F.col("own.claimed_there"), F.concat(F.lit("claimed result "), "own.claimed_shown", F.lit(" was not found in the claim"))).when(
                    ~F.col("own.asserted"),
                    F.concat(F.lit("claimed result "), "own.claimed_shown", F.lit(" was not verified as the asserted "), F.when(kind == "percent_change", "percent").otherwise(kind), F.lit(" result")),
                ),
                F.when(F.col("own.result").isNull(), "the calculation could not produce a finite result"),
            ),
        )
    )
    r = r.withColumn("issues", issues)
    agrees = N.matches(kind, F.col("own.result"), claimed)
    way = N.direction(F.col("claim_text"))
    against = (kind == "percent_change") & claimed.isNotNull() & (((way == "increase") & (F.col("own.result") < 0)) | ((way == "decrease") & (F.col("own.result") > 0)))
    ok = F.size("issues") == 0
    return r.select(
        "claim_id", "kind", F.col("own.expression").alias("expression"), N.significant(F.col("own.result")).alias("computed_result"), "claimed_result",
        F.when(ok, agrees & ~F.coalesce(against, F.lit(False))).alias("matches"), ok.alias("grounded"), "issues", F.col("sources").alias("source_evidence_ids"),
    )
