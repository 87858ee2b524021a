"""Reports as text, assembled in plans: flight logs and audit reports, a row a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of verdicts and statuses; marks of flight events.
VERDICT_LABELS = {
    "supported": "Supported", "supported_with_qualifications": "Supported with qualifications", "contradicted": "Contradicted", "disputed": "Disputed", "outdated": "Outdated",
    "insufficient_evidence": "Insufficient evidence", "not_verifiable": "Not objectively verifiable", "failed": "Audit failed",
}
STATUS_LABELS = {"strongly_supported": "Strongly supported", "mostly_supported": "Mostly supported", "revision_required": "Revision required", "insufficiently_supported": "Insufficiently supported", "materially_contradicted": "Materially contradicted"}
WARNINGS, QUIET = ("INJECTION_QUARANTINED", "SOURCE_REJECTED", "CONTRADICTION_FOUND", "TEMPORAL_FLAGGED"), ("QUERY_EXECUTED", "CONTRACT_DEFINED", "CLAIM_CLASSIFIED")
#: What each event says: text with {claim} for its claim and {name} for a field of its detail.
LINES = {
    "CLAIMS_EXTRACTED": "Extracted {count} verifiable claims from the document", "CLAIM_CLASSIFIED": "Claim {claim} classified as time-sensitive", "INJECTION_QUARANTINED": "Prompt injection quarantined from {sourceId} ({kind})",
    "QUERY_EXECUTED": "{agent} searched claim {claim}, {found} passage(s)", "PRIMARY_SOURCE_FOUND": "Primary source found for {claim}: {sourceId}", "SOURCE_REJECTED": "Source {sourceId} rejected for {claim}: {reason}",
    "CONTRADICTION_FOUND": "Skeptic found {count} contradiction(s) for {claim}", "TEMPORAL_FLAGGED": "{claim} flagged outdated: {note}", "VERDICT_REACHED": "Verdict for {claim}: {verdict} ({confidence} confidence)",
    "AUDIT_COMPLETED": "Audit complete: {documentStatus}, {claimsRequiringRevision} claim(s) need revision",
}


def label(value: Column, labels: dict[str, str]) -> Column:
    """A value's label, or itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[value], value)


def spaced(value: Column) -> Column:
    return F.replace(value, F.lit("_"), F.lit(" "))


def _filled(template: str, claim: Column, detail: Column) -> Column:
    parts = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        else:
            parts.append(F.coalesce(claim if piece == "claim" else F.get_json_object(detail, f"$.{piece}"), F.lit("")))
    return F.concat(*parts)


def event_mark(kind: Column) -> Column:
    return F.when(kind.isin(*WARNINGS), "!").when(kind.isin(*QUIET), ".").otherwise("+")


def event_line(kind: Column, claim: Column, detail: Column) -> Column:
    """A flight event as a sentence; detail is JSON. Kinds without one say their name."""
    primary = F.when(F.get_json_object(detail, "$.primaryRequired") == "true", " (primary source required)").otherwise("")
    out = F.when(kind == "CONTRACT_DEFINED", F.concat(F.lit("Evidence contract defined for "), F.coalesce(claim, F.lit("")), primary))
    n = F.size(F.from_json(F.get_json_object(detail, "$.sourceIds"), "array<string>"))
    out = out.when(kind == "LINEAGE_GROUP_DETECTED", F.concat(n.cast("string"), F.lit(" sources traced to one origin: "), F.coalesce(F.get_json_object(detail, "$.originLabel"), F.lit(""))))
    for name, template in LINES.items():
        out = out.when(kind == name, _filled(template, claim, detail))
    return out.otherwise(kind)


def _joined(lines: Column, order: str = "at") -> Column:
    """Lines of structs (order, line) as one text."""
    return F.array_join(F.transform(F.sort_array(lines), lambda x: x["line"]), "\n")


def flight_log(events: DataFrame) -> DataFrame:
    """(audit_id, log) of events (audit_id, seq, claim_id, type, detail). One audit's events are as many as its steps."""
    line = F.concat(F.lit("  "), event_mark(F.col("type")), F.lit(" "), event_line(F.col("type"), F.col("claim_id"), F.col("detail")))
    return events.groupBy("audit_id").agg(_joined(F.collect_list(F.struct(F.col("seq").alias("at"), line.alias("line")))).alias("log"))


def claim_sections(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(audit_id, position, section) of claims (audit_id, claim_id, position, text, claim_type, risk, time_sensitive, verdict, confidence, rationale,
    origins, superseded, note, required_correction). evidence: audit_id, claim_id, ordinal, source_id, stance, excerpt."""
    item = F.concat(F.lit("  - ["), F.col("source_id"), F.when(F.col("stance") == "supports", "").otherwise(F.concat(F.lit(", "), F.col("stance"))), F.lit('] "'), F.coalesce("excerpt", F.lit("")), F.lit('"'))
    one = lambda when, name: _joined(F.collect_list(F.when(when, F.struct(F.col("ordinal").alias("at"), item.alias("line"))))).alias(name)
    listed = evidence.groupBy("audit_id", "claim_id").agg(one(F.col("stance") == "supports", "for_it"), one(F.col("stance").isin("contradicts", "qualifies"), "against_it"))
    c = claims.join(listed, ["audit_id", "claim_id"], "left")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("### "), label(F.col("verdict"), VERDICT_LABELS), F.lit(" ("), F.col("confidence"), F.lit(" confidence)")),
            F.concat(F.lit('- Claim: "'), F.col("text"), F.lit('"')),
            F.concat(F.lit("- Type: "), F.col("claim_type"), F.lit(", risk: "), F.col("risk"), F.when(F.col("time_sensitive"), ", time-sensitive").otherwise("")),
            F.concat(F.lit("- Rationale: "), F.col("rationale")), F.concat(F.lit("- Independent origins behind support: "), F.col("origins").cast("string")),
            F.when(has("for_it"), F.concat(F.lit("- Supporting evidence:\n"), F.col("for_it"))), F.when(has("against_it"), F.concat(F.lit("- Contradicting or qualifying evidence:\n"), F.col("against_it"))),
            F.when(F.col("superseded"), F.concat(F.lit("- Temporal: "), F.col("note"))), F.when(has("required_correction"), F.concat(F.lit("- Required correction: "), F.col("required_correction"))),
        )
    )
    return c.select("audit_id", "position", F.array_join(lines, "\n").alias("section"))


def report(passports: DataFrame, lineage: DataFrame, safety: DataFrame, sections: DataFrame, changes: DataFrame, title: str = "# Audit") -> DataFrame:
    """(audit_id, report): the whole report of each audit.

    passports: audit_id, status, total, the counts of evidence.passport, primary_sources, origins, to_revise, verified_at. lineage: audit_id,
    n_sources, origins, groups (array of lines). safety: audit_id, ordinal, kind, action, source_id, excerpt. changes: audit_id, position,
    kind, claim_id, note, original, replacement."""
    p = passports
    # The passport's lines.
    lines = [("Total claims", "total"), ("Supported", "supported"), ("Supported with qualifications", "supported_with_qualifications"), ("Contradicted", "contradicted"), ("Disputed", "disputed"), ("Outdated", "outdated"), ("Insufficient evidence", "insufficient_evidence"), ("Not objectively verifiable", "not_verifiable"), ("Primary sources cited", "primary_sources"), ("Independent evidence origins", "origins"), ("Claims requiring revision", "to_revise"), ("Last verified", "verified_at")]
    head = F.concat_ws("\n", F.lit(title), F.lit(""), F.concat(F.lit("Document status: **"), label(F.col("status"), STATUS_LABELS), F.lit("**")), F.lit(""), F.lit("## Trust Passport"), *[F.concat(F.lit(f"- {name}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for name, c in lines])
    traced = lineage.select("audit_id", F.concat_ws("\n", F.concat(F.col("n_sources").cast("string"), F.lit(" sources cited, but only "), F.col("origins").cast("string"), F.lit(" independent evidence origins.")), F.array_join(F.transform("groups", lambda g: F.concat(F.lit("- "), g)), "\n")).alias("traced"))
    unsafe = F.concat(F.lit("- "), F.col("kind"), F.lit(" "), F.col("action"), F.lit(" in "), F.col("source_id"), F.lit(': "'), F.coalesce("excerpt", F.lit("")), F.lit('"'))
    said = safety.groupBy("audit_id").agg(_joined(F.collect_list(F.struct(F.col("ordinal").alias("at"), unsafe.alias("line")))).alias("unsafe"))
    body = sections.groupBy("audit_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "section"))), lambda x: x["section"]), "\n\n").alias("body"))
    change = F.concat(F.lit("- **"), F.col("kind"), F.lit("** ["), F.col("claim_id"), F.lit("]: "), F.coalesce("note", F.lit("")), F.lit('\n  - was: "'), F.col("original"), F.lit('"\n  - now: "'), F.col("replacement"), F.lit('"'))
    draft = changes.groupBy("audit_id").agg(_joined(F.collect_list(F.struct(F.col("position").alias("at"), change.alias("line")))).alias("draft"))
    whole = p.select("audit_id", head.alias("head")).join(traced, "audit_id", "left").join(said, "audit_id", "left").join(body, "audit_id", "left").join(draft, "audit_id", "left")
    or_else = lambda c, text: F.coalesce(F.nullif(c, F.lit("")), F.lit(text))
    text = F.concat_ws(
        "\n\n", "head", F.concat(F.lit("## Source lineage\n"), or_else("traced", "No sources were cited.")), F.concat(F.lit("## Safety\n"), or_else("unsafe", "No unsafe content detected in retrieved sources.")),
        F.concat(F.lit("## Claim-level audit\n"), or_else("body", "No claims.")), F.concat(F.lit("## Corrected draft (proposed, pending approval)\n"), or_else("draft", "No changes proposed.")),
    )
    return whole.select("audit_id", text.alias("report"))


def write_reports(reports: DataFrame, folder: str) -> None:
    """One text file a partition of audits, reports separated by line breaks; folders by audit, so that one is found by its name."""
    reports.select("audit_id", F.col("report").alias("value")).write.mode("overwrite").partitionBy("audit_id").text(folder)
