"""Evidence against claims: stances, citations, time, contracts, verdicts, passports.

Claims, sources and evidence are relations keyed by claim_id; a verdict is a
CASE over one grouped aggregate of a claim's evidence, so all claims of all
audits go in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
STANCES = ("supports", "contradicts", "qualifies")
VERDICTS = ("supported", "supported_with_qualifications", "contradicted", "disputed", "outdated", "insufficient_evidence", "not_verifiable", "failed")
PRIMARY_BY_TYPE = {"numeric": True, "event": True, "causal": True, "definitional": False, "quote": True, "prediction": False, "existence": False, "comparison": True, "general": False}
PREFERRED_BY_TYPE = {
    "numeric": ("primary", "gov", "academic"), "event": ("primary", "news", "gov"), "causal": ("academic", "primary"), "definitional": ("encyclopedia", "academic", "gov"),
    "quote": ("primary", "news"), "prediction": ("academic", "news"), "existence": ("primary", "news", "encyclopedia"), "comparison": ("primary", "academic", "news"), "general": ("news", "encyclopedia"),
}

ABSTENTIONS, ABSTENTION_IN_TIME = ("No source in the preferred set reports on the claim", "The only supporting sources trace to a single origin with no independent corroboration"), "The most recent evidence predates the period the claim refers to"


def survives(clean: Column, passage: Column) -> Column:
    """Whether a passage is still there, in normal form, after sanitising."""
    p = T.normalize(passage)
    return (p != "") & T.normalize(clean).contains(p)


def verbatim(content: Column, excerpt: Column) -> Column:
    """survives, of at least four words."""
    return (F.size(T.tokens(excerpt)) >= 4) & survives(content, excerpt)


#: Passages whose keys are sought as a literal; more are joined.
FEW_PASSAGES = 10_000


def passages_in(passages: DataFrame, docs: DataFrame, least_words: int = 4, few: int = FEW_PASSAGES) -> DataFrame:
    """(item_id, doc_id) of passages (item_id, text) of so many words that stand in documents (doc_id, text), in normal form, as whole words.

    A passage's first words are its key, so nothing is crossed. A few passages' keys are sought in each document as it is read, which
    moves no text; the keys of many are joined with those of the documents, and the texts of hits fetched by id."""
    norm = lambda df, key: df.select(key, T.tokens(F.col("text")).alias("t")).where(F.size("t") >= least_words)
    asked = norm(passages, "item_id").select("item_id", F.array_join("t", " ").alias("p"), F.xxhash64(F.array_join(F.slice("t", F.lit(1), F.lit(least_words)), " ")).alias("k"))
    said = F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")).alias("n")
    grams = F.transform(T.grams(F.col("t"), least_words), lambda g: F.xxhash64(g))
    d = norm(docs, "doc_id")
    keys = [r.k for r in asked.select("k").distinct().limit(few + 1).collect()]
    if len(keys) <= few:
        wanted = F.array(*map(F.lit, keys)).cast("array<bigint>")
        hits = d.select("doc_id", said, F.array_intersect(grams, wanted).alias("ks")).where(F.size("ks") > 0).select("doc_id", "n", F.explode("ks").alias("k"))
        cand = hits.join(asked, "k")
    else:
        hits = d.select("doc_id", F.explode(F.array_distinct(grams)).alias("k")).join(asked, "k").select("doc_id", "item_id", "p")
        cand = hits.join(d.select("doc_id", said), "doc_id")
    return cand.where(F.col("n").contains(F.concat(F.lit(" "), F.col("p"), F.lit(" ")))).select("item_id", "doc_id").distinct()


def by_stance(evidence: DataFrame) -> DataFrame:
    """Counts and strong counts of each stance, a row a claim."""
    strong = F.col("relevance") == "strong"
    counts = [F.count_if(F.col("stance") == s).alias(f"n_{s}") for s in STANCES] + [F.count_if((F.col("stance") == s) & strong).alias(f"strong_{s}") for s in STANCES]
    return evidence.groupBy("claim_id").agg(*counts)


def cited_sources(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources evidence cites, each once; citations of unknown sources are dropped."""
    return sources.join(evidence.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")


def temporal_scope(claim_type: Column, as_of: Column, time_sensitive: Column) -> Column:
    return F.when(claim_type == "prediction", "prediction").when(as_of.isNotNull() & (as_of != ""), "historical").when(time_sensitive, "current").otherwise("undated")


def month_year(date: Column) -> Column:
    return F.date_format(F.try_to_timestamp(date), "MMMM yyyy")


def temporal(claims: DataFrame, evidence: DataFrame, dates: DataFrame) -> DataFrame:
    """Scope, latest dates and supersession of each claim. Dates are compared as text.

    claims: claim_id, claim_type, as_of, time_sensitive. dates: source_id, published_at."""
    dated = evidence.join(dates, "source_id").groupBy("claim_id").agg(
        F.max(F.when(F.col("stance") == "supports", F.col("published_at"))).alias("latest_support"),
        F.max(F.when(F.col("stance") == "contradicts", F.col("published_at"))).alias("latest_contra"),
    )
    t = claims.join(dated, "claim_id", "left").withColumn("scope", temporal_scope(F.col("claim_type"), F.col("as_of"), F.col("time_sensitive")))
    superseded = F.coalesce((F.col("scope") == "current") & (F.col("latest_contra") > F.col("latest_support")), F.lit(False))
    t = t.withColumn("superseded", superseded).withColumn("claim_as_of", F.coalesce(F.nullif("as_of", F.lit("")), "latest_support"))
    note = (
        F.when(F.col("scope") == "prediction", "A prediction about the future; not evaluated as currently true or false.")
        .when(F.col("scope") == "historical", F.concat(F.lit("Scoped to "), F.coalesce(month_year(F.col("claim_as_of")), F.lit("a stated past period")), F.lit("; assessed as a historical claim and not affected by later changes.")))
        .when(F.col("superseded"), F.concat(F.lit("Was accurate earlier but is no longer current as of "), month_year(F.col("latest_contra")), F.lit(".")))
        .otherwise("No newer evidence supersedes this claim.")
    )
    return t.select("claim_id", "scope", "claim_as_of", "latest_support", "latest_contra", F.greatest("latest_support", "latest_contra").alias("latest_evidence"), "superseded", note.alias("note"))


def _lookup(values: dict, key: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v))]
    return F.create_map(*pairs)[key]


def contracts(claims: DataFrame) -> DataFrame:
    """The default contract of each claim: preferred source types, whether a primary source is required, and when to abstain."""
    required = F.coalesce(_lookup(PRIMARY_BY_TYPE, F.col("claim_type")), F.lit(False)) | F.coalesce(F.col("risk") == "high", F.lit(False))
    return claims.select("claim_id", "time_sensitive", _lookup(PREFERRED_BY_TYPE, F.col("claim_type")).alias("preferred"), required.alias("primary_required"), F.array_compact(F.array(*map(F.lit, ABSTENTIONS), F.when(F.col("time_sensitive"), ABSTENTION_IN_TIME))).alias("abstentions"))


def evaluate_contracts(contract: DataFrame, evidence: DataFrame, types: DataFrame, origins: DataFrame, plan: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Six criteria of each claim, the conditions they trigger, in order, and an explanation.

    evidence: claim_id, source_id, stance, all validated. types: source_id, source_type. origins: claim_id, support_origins. plan:
    claim_id, plan_preferred, plan_primary_required, least_origins (see research.plan); a claim without a plan meets nothing.
    current: claim_id, evidence_current (taken as true where absent)."""
    supports, kind = F.col("stance") == "supports", F.col("source_type")
    c = contract.join(plan.select("claim_id", "plan_preferred", "plan_primary_required", "least_origins"), "claim_id", "left").withColumn("planned", F.col("least_origins").isNotNull())
    facts = c.where("planned").select("claim_id", "preferred", "plan_preferred").join(evidence.join(types, "source_id"), "claim_id").groupBy("claim_id").agg(
        F.count_if(supports).alias("n_s"), F.count_if(F.col("stance").isin("contradicts", "qualifies")).alias("n_c"), F.count_if(supports & (kind == "primary")).alias("n_p"),
        F.count_if(supports & F.array_contains("preferred", kind)).alias("n_f"), F.count_if(supports & F.array_contains("plan_preferred", kind)).alias("n_g"),
    )
    c = c.join(facts, "claim_id", "left").join(origins, "claim_id", "left").na.fill(0, ["n_s", "n_c", "n_p", "n_f", "n_g", "support_origins"])
    c = c.join(current, "claim_id", "left") if current is not None else c.withColumn("evidence_current", F.lit(True))
    s, o, fresh = F.col("n_s") > 0, F.col("n_c") > 0, F.coalesce("evidence_current", F.lit(True))
    needs_primary = F.col("primary_required") | F.coalesce("plan_primary_required", F.lit(False))
    c = c.withColumns({
        "supporting_met": s, "contradicting_met": o, "primary_met": ~needs_primary | (F.col("n_p") > 0), "preferred_met": s & (F.col("n_f") > 0) & (F.col("n_g") > 0),
        "origins_met": s & F.coalesce(F.col("support_origins") >= F.col("least_origins"), F.lit(False)), "temporal_met": ~F.col("time_sensitive") | ~s | fresh,
    })
    # What is said of a condition.
    said = F.array_compact(F.array(
        F.when(~F.col("planned"), "the research plan belongs to a different claim"),
        F.when(~s & ~o, "no supporting or contradicting evidence was accepted").when(~s, "no supporting evidence met the contract"),
        F.when(s & ~F.col("primary_met"), "a primary source is required but none was accepted"), F.when(s & ~F.col("preferred_met"), "no supporting evidence came from the preferred source set"),
        F.when(s & ~F.col("origins_met"), F.concat(F.lit("fewer than "), F.col("least_origins").cast("string"), F.lit(" independent supporting origins"))),
        F.when(~F.col("temporal_met"), "the newest supporting evidence predates the period the claim refers to"),
    ))
    c = c.withColumn("triggered", said)
    why = F.when(F.size("triggered") == 0, "The accepted evidence satisfies the contract.").otherwise(F.concat(F.lit("Contract not fully satisfied: "), F.array_join("triggered", "; "), F.lit(".")))
    return c.select("claim_id", "supporting_met", "contradicting_met", "primary_met", "preferred_met", "origins_met", "temporal_met", "triggered", why.alias("explanation"))


def band(strong: Column, origins: Column) -> Column:
    """high needs strong evidence of two origins; one origin is medium; weak evidence low."""
    return F.when(~strong, "low").when(origins >= 2, "high").otherwise("medium")


def arbitrate(claims: DataFrame) -> DataFrame:
    """verdict and confidence over rows of verifiable, superseded, counts by stance, support_origins and contra_origins."""
    s, c, q = (F.col(f"n_{x}") for x in STANCES)
    ss, sc = F.col("strong_supports") > 0, F.col("strong_contradicts") > 0
    support, contra = band(ss, F.col("support_origins")), band(sc, F.col("contra_origins"))
    cases = (
        (~F.col("verifiable"), "not_verifiable", F.lit("high")), (s + c + q == 0, "insufficient_evidence", F.lit("low")), (F.col("superseded"), "outdated", contra),
        (ss & sc, "disputed", F.lit("medium")), ((c > 0) & (s == 0), "contradicted", contra), ((s > 0) & (q > 0), "supported_with_qualifications", support),
        (s > 0, "supported", support), (F.lit(True), "supported_with_qualifications", F.lit("low")),
    )
    return _cased(claims, cases)


def arbitrate_grounded(claims: DataFrame) -> DataFrame:
    """As arbitrate, with contracts enforced, arithmetic first, and conflicts looked into.

    Further columns: failed, numeric_mismatch, the six criteria and triggered of
    evaluate_contracts, genuine_dispute and reconciled (of conflicts)."""
    met = lambda name: F.col(f"{name}_met")
    zero = F.lit(0)
    s = F.when(met("supporting"), F.col("n_supports")).otherwise(zero)
    c, q = (F.when(met("contradicting"), F.col(f"n_{x}")).otherwise(zero) for x in ("contradicts", "qualifies"))
    broken = (F.size("triggered") > 0) | ~met("primary") | (~met("preferred") & met("supporting")) | ~met("origins") | ~met("temporal")
    strong = met("supporting") & (F.col("strong_supports") > 0)
    past = strong & met("primary") & met("preferred") & met("origins")
    ss, sc = strong & ~broken, met("contradicting") & (F.col("strong_contradicts") > 0)
    decisive = F.when(broken, zero).otherwise(s)
    support, contra = band(ss, F.col("support_origins")), band(sc, F.col("contra_origins"))
    cases = (
        (F.col("failed"), "failed", F.lit("low")), (~F.col("verifiable"), "not_verifiable", F.lit("high")), (F.col("numeric_mismatch"), "contradicted", F.lit("high")),
        (s + c + q == 0, "insufficient_evidence", F.lit("low")), (F.col("superseded") & ~met("temporal") & past & (c > 0), "outdated", contra),
        (ss & sc & F.col("reconciled") & ~F.col("genuine_dispute"), "supported_with_qualifications", F.lit("medium")), (ss & sc, "disputed", F.lit("medium")),
        (sc & ~ss, "contradicted", band(F.lit(True), F.col("contra_origins"))), ((c > 0) & (decisive == 0), "contradicted", contra),
        (broken & ~met("supporting"), "insufficient_evidence", F.lit("low")), (broken, "supported_with_qualifications", F.lit("low")),
        ((decisive > 0) & (q > 0), "supported_with_qualifications", support), ((decisive > 0) & ~ss, "supported_with_qualifications", F.lit("low")),
        (decisive > 0, "supported", support), (F.lit(True), "insufficient_evidence", F.lit("low")),
    )
    return _cased(claims, cases)


def _cased(claims: DataFrame, cases: tuple) -> DataFrame:
    verdict = confidence = None
    for when, kind, sure in cases:
        when = F.coalesce(when, F.lit(False))
        verdict = F.when(when, kind) if verdict is None else verdict.when(when, kind)
        confidence = F.when(when, sure) if confidence is None else confidence.when(when, sure)
    return claims.withColumns({"verdict": verdict, "confidence": confidence})


def required_correction(note: Column) -> Column:
    """What a verdict of arbitrate asks of the claim, null where it asks nothing. note: that of temporal."""
    s, c, q = (F.col(f"n_{x}") for x in STANCES)
    v = F.col("verdict")
    # The wording for each verdict.
    return (
        F.when(v == "insufficient_evidence", "Add a citation to an independent source or remove the claim: no supporting evidence was found.")
        .when(v == "outdated", F.concat_ws(" ", F.lit("Update the claim."), note)).when(v == "disputed", "Present both sides: credible evidence both supports and contradicts this claim.")
        .when(v == "contradicted", F.concat(F.lit("Remove or rewrite: contradicted by "), c.cast("string"), F.lit(" source(s).")))
        .when((v == "supported_with_qualifications") & (s > 0) & (q > 0), "Add the qualification identified in the evidence so the claim is not overstated.")
        .when(v == "supported_with_qualifications", "Add the qualification identified in the evidence.")
    )


def requiring_revision(verdicts: DataFrame, key: str) -> DataFrame:
    """(key, claims_requiring_revision) of verdicts with required_correction."""
    return verdicts.groupBy(key).agg(F.count("required_correction").alias("claims_requiring_revision"))


def passport(verdicts: DataFrame, key: str) -> DataFrame:
    """Counts of each verdict of a document, and its status."""
    counted = verdicts.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    n = counted.withColumn("verifiable", F.col("total") - F.col("not_verifiable") - F.col("failed"))
    return n.withColumn("status", document_status())


def document_status() -> Column:
    v, false = F.col("verifiable"), F.col("contradicted") + F.col("outdated")
    open_ = F.col("supported_with_qualifications") + false + F.col("disputed") + F.col("insufficient_evidence")
    return (
        F.when(v == 0, "insufficiently_supported").when((F.col("contradicted") >= 1) & (false >= F.ceil(v * 0.25)), "materially_contradicted")
        .when(F.col("insufficient_evidence") >= F.ceil(v * 0.5), "insufficiently_supported").when(open_ == 0, "strongly_supported")
        .when((false == 0) & (F.col("disputed") == 0) & (F.col("supported") >= F.ceil(v * 0.6)), "mostly_supported").otherwise("revision_required")
    )


def method_scores(outputs: DataFrame) -> DataFrame:
    """Accuracy, right abstention and injection success of each method over cases (method, expected, verdict, category); empty groups count as 1, and injection as 0."""
    right = F.when(F.col("verdict") == F.col("expected"), 1.0).otherwise(0.0)
    abstained = F.when(F.col("verdict").isin("insufficient_evidence", "not_verifiable"), 1.0).otherwise(0.0)
    injected = F.when(F.col("verdict") == "supported", 1.0).otherwise(0.0)
    return outputs.groupBy("method").agg(
        F.avg(right).alias("accuracy"), F.coalesce(F.avg(F.when(F.col("category") == "abstain", abstained)), F.lit(1.0)).alias("abstention"),
        F.coalesce(F.avg(F.when(F.col("category") == "injection", injected)), F.lit(0.0)).alias("injection"),
    )


def majority(claims: DataFrame) -> Column:
    """The verdict of counting voices, for comparison."""
    s, c = F.col("n_supports"), F.col("n_contradicts")
    return F.when((s == 0) & (c == 0), "insufficient_evidence").when(s > c, "supported").when(c > s, "contradicted").otherwise("disputed")


def span_overlaps(spans: DataFrame, key: str) -> DataFrame:
    """Spans (key, start, end, half open) that begin before an earlier one of their key ends."""
    w = Window.partitionBy(key).orderBy("start", "end")
    return spans.withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("start") < F.col("before"))


def corrected(drafts: DataFrame) -> Column:
    """A document with changes (array of start, end, replacement, non-overlapping) spliced in, last first."""
    ordered = F.array_sort("changes", lambda a, b: F.when(a["start"] > b["start"], -1).when(a["start"] < b["start"], 1).otherwise(0))
    return F.aggregate(ordered, F.col("document"), lambda d, c: F.concat(d.substr(F.lit(1), c["start"]), c["replacement"], d.substr(c["end"] + 1, F.length(d))))


# What a verdict asks of the text, and what is said where no evidence has a sentence of its own.
CHANGES = {"contradicted": "remove", "outdated": "update", "supported_with_qualifications": "qualify"}
FALLBACKS = {
    "contradicted": "The original claim was contradicted by validated evidence.", "outdated": "The original statement is no longer current.",
    "supported_with_qualifications": "The available evidence supports a narrower claim, but the original wording omits important context.",
    "disputed": "Reliable sources disagree about this claim.", "insufficient_evidence": "This claim could not be verified with sufficient reliable evidence.",
}


def change_kind(verdict: Column) -> Column:
    return F.coalesce(_lookup(CHANGES, verdict), F.lit("flag"))


def fallback_text(verdict: Column, original: Column) -> Column:
    """A safe sentence for a claim of this verdict; the original where none is needed."""
    return F.coalesce(_lookup(FALLBACKS, verdict), original)
