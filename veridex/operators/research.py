"""Research of claims: plans and budgets, retrieval rounds, conflicts, labelled corpora, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from . import evidence as E
from . import models as M
from .graph import kept

# By mode, least independent origins, most iterations, most sources; and limits of calls.
BUDGETS = {"quick": (1, 1, 4), "deep": (2, 2, 8), "high_stakes": (3, 3, 12)}
LIMITS = {"quick": (4, 16, 100, 32), "deep": (8, 64, 400, 128), "high_stakes": (12, 144, 900, 288)}
RESOURCES = ("claims", "searches", "model_calls", "page_fetches")
# Causes of disagreement that no difference of scope explains; facets that a cause must show.
UNRESOLVED = ("genuine_dispute", "different_methodology")
FACET_OF = {"different_period": ("same_period",), "different_population": ("same_population",), "different_region": ("same_population",), "global_vs_segment": ("same_population",), "different_definition": ("same_entity", "same_metric")}
#: Kinds of safety event that are attempts to instruct a reader (stripped scripts are not).
INJECTIONS = ("instruction_injection", "role_override", "exfiltration", "hidden_content")


def by_mode(mode: Column, place: int, table: dict = BUDGETS) -> Column:
    return F.create_map(*[x for m, v in table.items() for x in (F.lit(m), F.lit(v[place]))])[mode]


def plan(contracts: DataFrame, mode: Column) -> DataFrame:
    """Budgets of each claim before anything is retrieved. contracts: claim_id, primary_required, preferred."""
    origins, rounds, sources = (by_mode(mode, k) for k in range(3))
    stop = F.array(
        F.concat(origins.cast("string"), F.lit(" independent supporting origin(s) satisfy the contract")), F.concat(sources.cast("string"), F.lit(" sources examined")), F.concat(rounds.cast("string"), F.lit(" search iteration(s) completed"))
    )
    return contracts.select(
        "claim_id", F.col("preferred").alias("plan_preferred"), (F.col("primary_required") | (mode == "high_stakes")).alias("plan_primary_required"), origins.alias("least_origins"), rounds.alias("most_rounds"), sources.alias("most_sources"), stop.alias("stop_when")
    )


def mapped_contracts(claims: DataFrame, mode: Column) -> DataFrame:
    """Contracts of a submitted document's claims: none in quick mode; high stakes always want a primary source."""
    c = E.contracts(claims.withColumn("_mode", mode)).join(claims.select("claim_id", mode.alias("_mode")), "claim_id")
    return c.where("_mode <> 'quick'").withColumn("primary_required", F.col("primary_required") | (F.col("_mode") == "high_stakes")).drop("_mode")


def input_safety(documents: DataFrame, key: str) -> DataFrame:
    """(key, source_id 'input', kind, excerpt, action): instruction-like text of submitted documents (key, document), which stay as they are."""
    return documents.select(key, F.explode(H.sanitized(F.col("document"))["events"]).alias("e")).select(key, F.lit("input").alias("source_id"), "e.*")


def injections(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind").isin(*INJECTIONS))


def genuine(has_conflict: Column, cause: Column) -> Column:
    return has_conflict & cause.isin(*UNRESOLVED)


def reconciled(has_conflict: Column, cause: Column) -> Column:
    return has_conflict & ~cause.isin(*UNRESOLVED, "none")


def resolve_conflicts(claims: DataFrame, evidence: DataFrame, provider: M.Provider) -> DataFrame:
    """claim_id, has_conflict, cause, reconciled, genuine_dispute, explanation and error of every claim (claim_id, text).

    evidence: claim_id, stance, relevance, excerpt, same_period, same_population, same_entity, same_metric, all validated. Only
    claims with evidence on both sides are asked about; a cause that no facet of their evidence shows is a genuine dispute."""
    sides = evidence.where(F.col("stance").isin("supports", "contradicts"))
    shows = {f: F.bool_or(~F.col(f)).alias(f"no_{f}") for f in ("same_period", "same_population", "same_entity", "same_metric")}
    strongest = lambda s: F.min_by("excerpt", F.when(F.col("stance") == s, F.struct(F.when(F.col("relevance") == "strong", 0).otherwise(1), "excerpt"))).alias(s)
    facts = sides.groupBy("claim_id").agg(strongest("supports"), strongest("contradicts"), *shows.values()).where("supports is not null and contradicts is not null")
    asked = M.ask(claims.join(facts, "claim_id"), "conflict_analysis", provider, {"claim": F.col("text"), "supporting": F.col("supports"), "contradicting": F.col("contradicts")})
    cause = F.coalesce("answer.cause", F.lit("genuine_dispute"))
    fits = F.lit(True)
    for name, facets in FACET_OF.items():
        seen = F.lit(False)
        for f in facets:
            seen = seen | F.col(f"no_{f}")
        fits = F.when(cause == name, seen).otherwise(fits)
    kept_cause = F.when(fits, cause).otherwise("genuine_dispute")
    told = F.when(fits, F.col("answer.explanation")).otherwise(F.concat(F.lit("The proposed "), cause, F.lit(" reconciliation conflicts with the validated citation facets; treat the disagreement as unresolved.")))
    done = asked.select("claim_id", F.lit(True).alias("has_conflict"), kept_cause.alias("cause"), told.alias("explanation"), "error")
    rest = claims.select("claim_id").join(done, "claim_id", "left")
    has = F.coalesce("has_conflict", F.lit(False))
    final = rest.select("claim_id", has.alias("has_conflict"), F.coalesce("cause", F.lit("none")).alias("cause"), F.coalesce("explanation", F.when(~has, "evidence on only one side; no conflict to resolve")).alias("explanation"), "error")
    return final.withColumns({"reconciled": reconciled(F.col("has_conflict"), F.col("cause")), "genuine_dispute": genuine(F.col("has_conflict"), F.col("cause"))})


def corpus_evidence(corpus: DataFrame, clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, rejected) of a labelled corpus (source_id, relates_to, stance, passage, relevance) whose sources' sanitised
    texts are clean (source_id, clean): supporting passages by the investigator, contradicting and qualifying ones by the skeptic;
    passages that didn't survive, or whose source is unknown, are rejected."""
    each = corpus.where(F.col("stance").isin(*E.STANCES)).withColumn("claim_id", F.explode("relates_to")).join(clean, "source_id", "left")
    alive = F.coalesce(E.survives(F.col("clean"), F.col("passage")), F.lit(False))
    relevance = F.when(F.col("stance") == "qualifies", "weak").otherwise(F.col("relevance"))
    relation = F.when(F.col("stance") == "supports", F.when(relevance == "strong", "direct_support").otherwise("partial_support")).when(F.col("stance") == "contradicts", "direct_contradiction").otherwise("qualification")
    good = each.where(alive).select(
        T.hash_id("ev", F.col("claim_id"), F.col("source_id"), F.col("stance")).alias("id"), "claim_id", "source_id", "stance", F.col("passage").alias("excerpt"), relevance.alias("relevance"),
        F.when(F.col("stance") == "supports", "investigator").otherwise("skeptic").alias("captured_by"), relation.alias("relation"), (relation == "partial_support").alias("claim_stronger_than_source"),
    )
    return good, each.where(~alive).select("claim_id", "source_id", F.lit("cited passage was quarantined by the Safety Sentinel").alias("reason"))


def both_streams(investigator: DataFrame, skeptic: DataFrame) -> DataFrame:
    """Evidence of both agents, the investigator's first (side 0), as bags: nothing is dropped."""
    return investigator.withColumn("side", F.lit(0)).unionByName(skeptic.withColumn("side", F.lit(1)))


def candidates(evidence: DataFrame, quality: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence whose source is known and was not rejected. quality: claim_id, source_id, accepted."""
    out = quality.where(~F.col("accepted")).select("claim_id", "source_id")
    return evidence.join(out, ["claim_id", "source_id"], "left_anti").join(sources.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")


def merged_sources(sources: DataFrame) -> DataFrame:
    """Sources (id, ordinal, ..., retrievals): each once, its first form, with all retrievals in order, repeated ones too."""
    rest = [c for c in sources.columns if c not in ("id", "ordinal", "retrievals")]
    ordered = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.coalesce("retrievals", F.array().cast(sources.schema["retrievals"].dataType)).alias("r")))), lambda x: x["r"]))
    return sources.groupBy("id").agg(*[F.min_by(c, "ordinal").alias(c) for c in rest], ordered.alias("retrievals"))


def numbered(rows: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """rows with `sequence`: their place within an audit, claim by claim."""
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(owner).orderBy(*order)))


def investigate(claims: DataFrame, results: DataFrame, pages: DataFrame, provider: M.Provider, agent: str = "investigator") -> tuple[DataFrame, DataFrame]:
    """(evidence, rejected): rounds of search and assessment until a claim's origins suffice or its rounds are used up.

    claims: claim_id, text, queries, least_origins, most_rounds, most_sources. results: query, rank, url, title. pages: url, text,
    content_hash, as fetched. Rounds are as many as the largest budget, three at most; each is one plan over all open claims."""
    purpose = f"{agent}_assess"
    open_, found, refused, seen = claims, None, None, None
    rounds = claims.agg(F.max("most_rounds")).first()[0] or 0
    clean = pages.select("url", "title", T.hash_id("src", F.col("url"), F.col("content_hash")).alias("source_id"), H.sanitized(F.col("text"))["clean"].alias("content"))
    for turn in range(rounds):
        asked = open_.select("claim_id", "text", "most_sources", F.posexplode("queries").alias("q", "query")).join(results.select("query", "rank", "url"), "query")
        first = asked.groupBy("claim_id", "url").agg(F.min(F.struct("q", "rank")).alias("at"), F.first("text").alias("text"), F.first("most_sources").alias("most_sources"))
        place = F.row_number().over(Window.partitionBy("claim_id").orderBy("at", "url"))
        took = first.withColumn("place", place).where("place <= most_sources").join(clean, "url").drop("url", "at", "place", "most_sources")
        if seen is not None:
            took = took.join(seen, ["claim_id", "source_id"], "left_anti")
        a = kept(M.ask(took, purpose, provider, {"claim": F.col("text"), "title": F.col("title"), "content": F.col("content")}))
        stance = F.when(F.col("answer.supports"), "supports") if agent == "investigator" else F.when(F.col("answer.stance") != "none", F.col("answer.stance"))
        real = E.verbatim(F.col("content"), F.col("answer.excerpt"))
        reason = (
            F.when(F.col("error").isNotNull(), F.col("error")).when(~F.col("answer.relevant"), "not relevant to the claim")
            .when(stance.isNull(), "does not support the claim" if agent == "investigator" else "does not contradict or qualify the claim").when(~real, "excerpt not found verbatim in the sanitized source")
        )
        judged = a.select("claim_id", "source_id", stance.alias("stance"), F.col("answer.excerpt").alias("excerpt"), F.col("answer.relevance").alias("relevance"), F.lit(agent).alias("captured_by"), reason.alias("reason"))
        good = judged.where("reason is null").drop("reason").withColumn("id", T.hash_id("ev", F.col("claim_id"), F.col("source_id"), F.col("stance")))
        bad = judged.where("reason is not null").select("claim_id", "source_id", "reason")
        found, refused = (good, bad) if found is None else (found.unionByName(good), refused.unionByName(bad))
        seen = judged.select("claim_id", "source_id") if seen is None else seen.unionByName(judged.select("claim_id", "source_id"))
        if turn + 1 == rounds:
            break
        counts = found.groupBy("claim_id").agg(F.count("*").alias("_n"))
        lacking = open_.join(counts, "claim_id", "left").where((F.coalesce("_n", F.lit(0)) < F.col("least_origins")) & (F.col("most_rounds") > turn + 1)).drop("_n")
        again = M.ask(lacking, f"{agent}_revise", provider, {"claim": F.col("text"), "queries": F.array_join("queries", ", ")})
        open_ = kept(again.where("error is null").withColumn("queries", F.col("answer.queries")).select(*claims.columns))
        if not open_.limit(1).count():
            break
    return found, refused


def over_budget(usage: DataFrame, mode: Column) -> DataFrame:
    """(audit_id, resource, used, allowed) of usage (audit_id and RESOURCES) beyond its mode's limits."""
    each = F.array(*[F.struct(F.lit(r).alias("resource"), F.col(r).cast("bigint").alias("used"), by_mode(mode, k, LIMITS).cast("bigint").alias("allowed")) for k, r in enumerate(RESOURCES)])
    return usage.select("audit_id", F.explode(each).alias("x")).select("audit_id", "x.*").where("used > allowed")


def cost(model_calls: Column, searches: Column, page_fetches: Column, rates: tuple[float, float, float] | None) -> Column:
    """Estimated cost to six decimals; null without rates."""
    if rates is None:
        return F.lit(None).cast("double")
    total = model_calls * F.lit(rates[0]) + searches * F.lit(rates[1]) + page_fetches * F.lit(rates[2])
    return F.floor((total + F.lit(2.0**-52)) * 1e6 + 0.5) / 1e6


def terminal_status(verdicts: DataFrame, key: str) -> DataFrame:
    """failed if all of an audit's claims failed, partially_completed if some did, else completed."""
    failed = F.col("verdict") == "failed"
    return verdicts.groupBy(key).agg(F.when(F.bool_and(failed), "failed").when(F.bool_or(failed), "partially_completed").otherwise("completed").alias("status"))


def hidden_label_scores(results: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: right, and all, verdicts of results (case_id, verdict) against labels (case_id, expected); a case without a result is wrong."""
    both = labels.join(results, "case_id", "left")
    return both.agg(F.count_if(F.col("verdict").eqNullSafe(F.col("expected"))).alias("correct"), F.count("*").alias("total"))
