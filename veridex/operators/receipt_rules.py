"""Every rule that a receipt keeps, over the receipts of any number of audits at once.

A receipt is a set of relations that share audit_id. A rule is a plan that
yields the rows which break it; `violations` is their union, and a receipt is
valid if it has none. References are anti-joins and joins on (audit_id, id),
repeated keys are partial aggregates, orders are windows within an audit.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grounding as G
from ..functions import numeric as N
from ..functions import text as T
from ..functions import urls as U
from . import citation as C
from .evidence import VERDICTS
from .graph import kept
from .receipt import HASH

# What closed fields may say.
WORKFLOW, MODES, AGENTS = "1", ("live", "demo"), ("investigator", "skeptic")
CONFIDENCE = ("high", "medium", "low")
CHANGE_KINDS = ("remove", "update", "qualify", "flag")
CHANGE_SOURCES = ("revision_agent", "deterministic_marker", "deterministic_revision")
SAFETY_KINDS, SAFETY_ACTIONS = ("instruction_injection", "role_override", "exfiltration", "hidden_content", "script_stripped"), ("quarantined", "sanitized")
CRITERIA = ("supporting_met", "contradicting_met", "primary_met", "preferred_met", "origins_met", "temporal_met")
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"


@dataclass
class Receipts:
    """header: audit_id, mode, workflow_version, model_provider, model_id, search_provider, document_hash, final_draft_hash, started_at, completed_at.
    searches: audit_id, sequence, claim_id, agent, query. sources: audit_id, id, content_hash. retrievals: audit_id, source_id, claim_id, agent,
    query, original_url, final_url, accessed_at, content_hash. evidence: audit_id, id, claim_id, source_id, stance, excerpt, excerpt_hash,
    exact_match, relation and citation.FACETS. verdicts: audit_id, claim_id, verdict, confidence, supporting, contradicting. checks: audit_id,
    claim_id, kind, inputs, claimed_result, computed_result, expression, grounded, matches, issues, source_evidence_ids. contracts: audit_id,
    claim_id, CRITERIA, triggered, explanation. revisions: audit_id, change_id, claim_id, kind, original_hash, replacement_hash, citations,
    source, numeric_check_claim_id. approved: audit_id, change_id. safety: audit_id, source_id, kind, action. failures: audit_id, sequence,
    claim_id, agent, operation, query, url, error."""

    header: DataFrame
    searches: DataFrame
    sources: DataFrame
    retrievals: DataFrame
    evidence: DataFrame
    verdicts: DataFrame
    checks: DataFrame
    contracts: DataFrame
    revisions: DataFrame
    approved: DataFrame
    safety: DataFrame
    failures: DataFrame


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def no_hash(c: str) -> Column:
    return ~F.coalesce(F.col(c).rlike(HASH), F.lit(False))


def no_time(c: str) -> Column:
    """Not a timestamp in its one canonical form, of a day that there is."""
    return ~F.coalesce(F.col(c).rlike(_ISO) & F.try_to_timestamp(F.col(c)).isNotNull(), F.lit(False))


def outside(c: str, values: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(c).isin(*values), F.lit(False))


def change_id(claim_id: Column, kind: Column, original_hash: Column, replacement_hash: Column, citations: Column, source: Column, numeric: Column) -> Column:
    """A revision's id, of its hashes and grounding."""
    return T.hash_id("chg", claim_id, kind, original_hash, replacement_hash, F.array_join(F.sort_array(citations), ","), source, F.coalesce(numeric, F.lit("")))


def revisions_of(changes: DataFrame) -> DataFrame:
    """Receipt rows of changes (audit_id, claim_id, kind, original, replacement, citations, source, numeric_check_claim_id)."""
    r = changes.select("audit_id", "claim_id", "kind", F.sha2("original", 256).alias("original_hash"), F.sha2("replacement", 256).alias("replacement_hash"), F.sort_array("citations").alias("citations"), "source", "numeric_check_claim_id")
    return r.withColumn("change_id", change_id(*[F.col(c) for c in ("claim_id", "kind", "original_hash", "replacement_hash", "citations", "source", "numeric_check_claim_id")]))


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy("audit_id", key).count().where("count > 1").select("audit_id", key)


def _unknown(rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    return rows.join(target.select("audit_id", F.col(key).alias(column)).distinct(), ["audit_id", column], "left_anti")


def _out_of_order(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("audit_id").orderBy("sequence")
    return rows.withColumn("_place", F.row_number().over(w)).where("sequence <> _place")


def _recomputed(checks: DataFrame) -> DataFrame:
    def each(kind: pd.Series, inputs: pd.Series) -> pd.DataFrame:
        out = []
        for k, v in zip(kind, inputs, strict=True):
            values = {a: b for a, b in dict(v or {}).items() if b is not None}
            out.append(G.compute(k, values) if k in G.INPUTS else (None, ""))
        return pd.DataFrame(out, columns=["exact", "how"])

    return checks.withColumn("_now", F.pandas_udf(each, "struct<exact:double,how:string>")("kind", "inputs"))


def rules(t: Receipts) -> tuple[list[tuple[str, DataFrame, str]], list[tuple[DataFrame, str, dict[str, Column]]]]:
    """(of joins and orders, of single rows): rules with the rows that break them and the column that names those, and relations with
    that column and the condition on which a row breaks each rule, so that a relation is read once for all of its own rules."""
    named = t.verdicts.select("audit_id", "claim_id").distinct()
    live = t.header.where("mode = 'live'").select("audit_id")
    out: list[tuple[str, DataFrame, str]] = []
    single: dict[tuple[int, str], tuple[DataFrame, str, dict[str, Column]]] = {}

    def add(rule: str, rows: DataFrame, subject: str) -> None:
        out.append((rule, rows, subject))

    def flag(rule: str, rows: DataFrame, broken: Column, subject: str) -> None:
        single.setdefault((id(rows), subject), (rows, subject, {}))[2][rule] = broken

    h = t.header
    flag("header_blank", h, reduce(Column.__or__, map(blank, ("audit_id", "model_provider", "model_id", "search_provider"))), "audit_id")
    flag("header_mode", h, outside("mode", MODES), "audit_id")
    flag("header_version", h, outside("workflow_version", (WORKFLOW,)), "audit_id")
    flag("header_hash", h, no_hash("document_hash") | no_hash("final_draft_hash"), "audit_id")
    flag("header_time", h, no_time("started_at") | no_time("completed_at"), "audit_id")
    flag("header_order", h, ~no_time("started_at") & ~no_time("completed_at") & (F.col("completed_at") < F.col("started_at")), "audit_id")

    executed = t.searches.select("audit_id", "claim_id", "agent", "query").distinct()
    triple = ["audit_id", "claim_id", "agent", "query"]
    add("search_sequence", _out_of_order(t.searches), "sequence")
    flag("search_blank", t.searches, blank("claim_id") | blank("query"), "sequence")
    flag("search_agent", t.searches, outside("agent", AGENTS), "sequence")
    add("search_claim", t.searches.join(named, ["audit_id", "claim_id"], "left_anti"), "sequence")

    add("source_repeated", _repeated(t.sources, "id"), "id")
    flag("source_hash", t.sources, blank("id") | no_hash("content_hash"), "id")
    add("source_without_retrieval", _unknown(t.sources, "id", t.retrievals, "source_id"), "id")
    r = t.retrievals
    flag("retrieval_blank", r, blank("claim_id") | blank("query"), "source_id")
    flag("retrieval_agent", r, outside("agent", AGENTS), "source_id")
    add("retrieval_search", r.where(~outside("agent", AGENTS)).join(executed, triple, "left_anti"), "source_id")
    flag("retrieval_url", r, ~F.coalesce(U.is_http(F.col("original_url")) & U.is_http(F.col("final_url")), F.lit(False)), "source_id")
    flag("retrieval_time", r, no_time("accessed_at"), "source_id")
    flag("retrieval_hash", r, no_hash("content_hash"), "source_id")
    add("retrieval_id", r.join(live, "audit_id", "left_semi").where(T.hash_id("src", F.col("final_url"), F.col("content_hash")) != F.col("source_id")), "source_id")
    add("retrieval_claim", r.join(named, ["audit_id", "claim_id"], "left_anti"), "source_id")

    v = t.verdicts
    add("verdict_repeated", _repeated(v, "claim_id"), "claim_id")
    flag("verdict_kind", v, blank("claim_id") | outside("verdict", VERDICTS), "claim_id")
    flag("verdict_confidence", v, outside("confidence", CONFIDENCE), "claim_id")

    e, relation = t.evidence, F.col("relation")
    add("evidence_repeated", _repeated(e, "id"), "id")
    add("evidence_claim", e.join(named, ["audit_id", "claim_id"], "left_anti"), "id")
    add("evidence_source", _unknown(e, "source_id", t.sources, "id"), "id")
    flag("evidence_hash", e, no_hash("excerpt_hash") | ~F.sha2("excerpt", 256).eqNullSafe(F.col("excerpt_hash")), "id")
    flag("evidence_validated", e, ~F.coalesce("exact_match", F.lit(False)) | reduce(Column.__or__, [F.col(f).isNull() for f in C.FACETS]), "id")
    flag("evidence_stance", e, ~C.stance(relation)["stance"].eqNullSafe(F.col("stance")), "id")
    flag("evidence_entity", e, ~F.col("same_entity") | ~F.col("same_metric"), "id")
    flag("evidence_scope", e, relation.isin("direct_support", "partial_support", "direct_contradiction") & (~F.col("same_period") | ~F.col("same_population")), "id")
    flag("evidence_qualification", e, ((relation == "direct_support") & (F.col("claim_stronger_than_source") | F.col("qualifiers_omitted"))) | ((relation == "partial_support") & F.col("qualifiers_omitted")), "id")

    none = F.array().cast("array<string>")
    sides = v.select("audit_id", "claim_id", "verdict", F.coalesce("supporting", none).alias("supporting"), F.coalesce("contradicting", none).alias("contradicting"))
    twice = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    flag("verdict_ids_repeated", sides, twice("supporting") | twice("contradicting"), "claim_id")
    flag("verdict_both_sides", sides, F.arrays_overlap("supporting", "contradicting"), "claim_id")
    known = e.select("audit_id", "id", F.col("claim_id").alias("of"), F.col("stance").alias("has"))
    for rule, column, need in (("verdict_support", "supporting", "supports"), ("verdict_contradiction", "contradicting", "contradicts")):
        used = sides.select("audit_id", "claim_id", F.explode(column).alias("id")).join(known, ["audit_id", "id"], "left")
        add(rule, used.where(~F.coalesce((F.col("of") == F.col("claim_id")) & (F.col("has") == need), F.lit(False))).select("audit_id", "claim_id").distinct(), "claim_id")

    k = t.checks
    finite = lambda c: c.isNull() | (~F.isnan(c) & (F.abs(c) < float("inf")))
    now = _recomputed(k).withColumn("_result", N.significant(F.col("_now.exact"))).withColumn("_agrees", N.matches(F.col("kind"), F.col("_now.exact"), F.col("claimed_result")))
    steered = F.coalesce(F.col("grounded") & (F.col("kind") == "percent_change") & F.col("_agrees") & ~F.col("matches"), F.lit(False))
    add("check_repeated", _repeated(k, "claim_id"), "claim_id")
    add("check_claim", k.join(named, ["audit_id", "claim_id"], "left_anti"), "claim_id")
    flag("check_finite", k, ~finite(F.col("computed_result")) | ~finite(F.col("claimed_result")) | F.exists(F.map_values("inputs"), lambda x: x.isNull() | ~finite(x)), "claim_id")
    flag("check_calculation", now, ~F.col("_now.how").eqNullSafe(F.col("expression")) | ~F.col("_result").eqNullSafe(F.col("computed_result")), "claim_id")
    flag("check_grounding", k, F.col("grounded") != (F.size("issues") == 0), "claim_id")
    flag("check_ungrounded", k, ~F.col("grounded") & F.col("matches").isNotNull(), "claim_id")
    flag("check_match", now, F.col("grounded") & ~steered & ~F.col("matches").eqNullSafe(F.col("_agrees")), "claim_id")
    flag("check_ids_repeated", k, twice("source_evidence_ids"), "claim_id")
    of_claim = e.select("audit_id", "id", "claim_id")
    add("check_evidence", k.select("audit_id", "claim_id", F.explode("source_evidence_ids").alias("id")).join(of_claim, ["audit_id", "id", "claim_id"], "left_anti").select("audit_id", "claim_id").distinct(), "claim_id")

    disproved = k.where(F.col("grounded") & ~F.col("matches")).select("audit_id", "claim_id", F.lit(True).alias("_disproved")).distinct()
    needs = sides.join(disproved, ["audit_id", "claim_id"], "left")
    n_s, n_c = F.size("supporting"), F.size("contradicting")
    flag("verdict_unsupported", needs, F.col("verdict").isin("supported", "supported_with_qualifications") & (n_s == 0), "claim_id")
    flag("verdict_undisproved", needs, (F.col("verdict") == "contradicted") & (n_c == 0) & F.col("_disproved").isNull(), "claim_id")
    flag("verdict_one_sided", needs, F.col("verdict").isin("disputed", "outdated") & ((n_s == 0) | (n_c == 0)), "claim_id")

    c = t.contracts
    add("contract_repeated", _repeated(c, "claim_id"), "claim_id")
    add("contract_claim", c.join(named, ["audit_id", "claim_id"], "left_anti"), "claim_id")
    flag("contract_form", c, reduce(Column.__or__, [F.col(x).isNull() for x in (*CRITERIA, "triggered", "explanation")]) | F.exists("triggered", lambda x: x.isNull()), "claim_id")
    add("contract_missing", named.join(c, ["audit_id", "claim_id"], "left_anti"), "claim_id")

    s = t.revisions
    add("revision_repeated", _repeated(s, "claim_id"), "claim_id")
    add("change_repeated", _repeated(s, "change_id"), "change_id")
    add("revision_claim", s.join(named, ["audit_id", "claim_id"], "left_anti"), "claim_id")
    flag("revision_hash", s, no_hash("original_hash") | no_hash("replacement_hash"), "claim_id")
    flag("revision_kind", s, outside("kind", CHANGE_KINDS), "claim_id")
    flag("revision_source", s, outside("source", CHANGE_SOURCES), "claim_id")
    add("revision_marker", s.where("source = 'deterministic_marker'").join(live, "audit_id", "left_semi"), "claim_id")
    flag("revision_ids_repeated", s, twice("citations"), "claim_id")
    add("revision_evidence", s.select("audit_id", "claim_id", F.explode("citations").alias("id")).join(of_claim, ["audit_id", "id", "claim_id"], "left_anti").select("audit_id", "claim_id").distinct(), "claim_id")
    checked = k.select("audit_id", "claim_id").distinct()
    by_number = s.where("numeric_check_claim_id is not null")
    add("revision_check", by_number.where("numeric_check_claim_id <> claim_id").unionByName(by_number.where("numeric_check_claim_id = claim_id").join(checked, ["audit_id", "claim_id"], "left_anti")), "claim_id")
    flag("revision_ungrounded", s, (F.col("source") == "revision_agent") & (F.size("citations") == 0) & F.col("numeric_check_claim_id").isNull(), "claim_id")
    flag("revision_id", s, F.col("change_id") != change_id(*[F.col(x) for x in ("claim_id", "kind", "original_hash", "replacement_hash", "citations", "source", "numeric_check_claim_id")]), "claim_id")

    add("safety_source", _unknown(t.safety, "source_id", t.sources, "id"), "source_id")
    flag("safety_form", t.safety, outside("kind", SAFETY_KINDS) | outside("action", SAFETY_ACTIONS), "source_id")
    add("approved_repeated", _repeated(t.approved, "change_id"), "change_id")
    add("approved_unknown", _unknown(t.approved, "change_id", s, "change_id"), "change_id")

    f, operation = t.failures, F.col("operation")
    of_search = f.where("operation <> 'claim'")
    add("failure_sequence", _out_of_order(f), "sequence")
    add("failure_claim", f.join(named, ["audit_id", "claim_id"], "left_anti"), "sequence")
    flag("failure_error", f, blank("error"), "sequence")
    flag("failure_of_claim", f, (operation == "claim") & ((F.col("agent") != "pipeline") | F.col("query").isNotNull() | F.col("url").isNotNull()), "sequence")
    flag("failure_agent", of_search, outside("agent", AGENTS), "sequence")
    flag("failure_operation", f, outside("operation", ("claim", "search", "search_result", "fetch")), "sequence")
    flag("failure_query", of_search, blank("query"), "sequence")
    add("failure_search", of_search.where(~blank("query") & ~outside("agent", AGENTS)).join(executed, triple, "left_anti"), "sequence")
    wrong_url = ((operation == "search") & F.col("url").isNotNull()) | ((operation == "search_result") & F.col("url").isNotNull() & blank("url")) | ((operation == "fetch") & ~F.coalesce(U.is_http(F.col("url")), F.lit(False)))
    flag("failure_url", f, wrong_url, "sequence")
    return out, list(single.values())


def violations(t: Receipts) -> DataFrame:
    """(audit_id, rule, subject) of every broken rule."""
    joined, single = rules(Receipts(**{f.name: kept(getattr(t, f.name)) for f in fields(t)}))  # each is read by many rules
    found = [rows.select("audit_id", F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject")) for rule, rows, subject in joined]
    for rows, subject, flags in single:
        broken = F.array_compact(F.array(*[F.when(condition, rule) for rule, condition in flags.items()]))
        found.append(rows.select("audit_id", F.explode(broken).alias("rule"), F.col(subject).cast("string").alias("subject")))
    return reduce(DataFrame.unionByName, found)


#: Fixed order in which a receipt is checked: each line is one pass over a relation's rows, and a row is held to all rules of the line
#: before the next row is.
PASSES = (
    "header_mode header_version header_blank header_hash header_time header_order",
    "search_sequence search_blank search_agent",
    "source_repeated",
    "source_hash source_without_retrieval retrieval_blank retrieval_agent retrieval_search retrieval_url retrieval_time retrieval_hash retrieval_id",
    "verdict_repeated",
    "verdict_kind verdict_confidence",
    "evidence_repeated",
    "evidence_claim evidence_source evidence_hash evidence_validated evidence_stance evidence_entity evidence_scope evidence_qualification",
    "verdict_ids_repeated verdict_both_sides verdict_support verdict_contradiction",
    "check_repeated",
    "check_claim check_finite check_calculation check_grounding check_ungrounded check_match check_ids_repeated check_evidence",
    "verdict_unsupported verdict_undisproved verdict_one_sided",
    "contract_repeated",
    "contract_claim contract_form",
    "contract_missing",
    "revision_repeated",
    "change_repeated",
    "revision_claim revision_hash revision_kind revision_source revision_marker revision_ids_repeated revision_evidence revision_check revision_ungrounded revision_id",
    "safety_source safety_form",
    "approved_repeated",
    "approved_unknown",
    "search_claim",
    "retrieval_claim",
    "failure_sequence failure_claim failure_error failure_of_claim failure_agent failure_operation failure_query failure_search failure_url",
)


def first_broken(broken: DataFrame) -> DataFrame:
    """(audit_id, rule, subject): of violations (audit_id, rule, subject) the one that is met first: by pass, then by row (numbers as
    numbers, ids as text), then by rule. One aggregate, partial first."""
    turn = F.create_map(*[F.lit(x) for k, line in enumerate(PASSES) for j, rule in enumerate(line.split()) for x in (rule, 100 * k + j)])[F.col("rule")]
    number = F.col("subject").try_cast("bigint")
    place = F.struct(F.floor(turn / 100).alias("pass"), F.coalesce(number, F.lit(1 << 62)).alias("number"), F.col("subject").alias("name"), turn.alias("turn"))
    return broken.groupBy("audit_id").agg(F.min_by(F.struct("rule", "subject"), place).alias("x")).select("audit_id", "x.rule", "x.subject")


def verified(t: Receipts, sealed: DataFrame) -> DataFrame:
    """(audit_id, valid, reason) of sealed receipts (audit_id, canonical, receipt_hash): the hash first, then the broken rule that is met first."""
    first = first_broken(violations(t)).select("audit_id", "rule")
    intact = F.sha2("canonical", 256).eqNullSafe(F.col("receipt_hash"))
    reason = F.when(~intact, "receipt hash does not match its contents; the receipt was modified").otherwise(F.coalesce("rule", F.lit("receipt hash, provenance, and grounding references are intact")))
    return sealed.join(first, "audit_id", "left").select("audit_id", (intact & F.col("rule").isNull()).alias("valid"), reason.alias("reason"))


def parity(result: dict[str, DataFrame], receipt: dict[str, DataFrame]) -> DataFrame:
    """(audit_id, relation, side, n): rows of any relation that a result and its receipt don't share, as multisets, whatever their order.
    Relations are matched by name, columns by the result's."""
    parts = []
    for name, mine in result.items():
        theirs = receipt[name].select(*mine.columns)
        for side, diff in (("result", mine.exceptAll(theirs)), ("receipt", theirs.exceptAll(mine))):
            parts.append(diff.groupBy("audit_id").count().select("audit_id", F.lit(name).alias("relation"), F.lit(side).alias("side"), F.col("count").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def coverage(mapped: DataFrame, audited: DataFrame) -> DataFrame:
    """(audit_id, claim_id, side): claims mapped but not audited, audited but not mapped, or either twice."""
    a, b = mapped.select("audit_id", "claim_id"), audited.select("audit_id", "claim_id")
    return a.exceptAll(b).withColumn("side", F.lit("mapped")).unionByName(b.exceptAll(a).withColumn("side", F.lit("audited")))
