"""Citations: strict matching, relation and stance, admissibility, retrieval, merging."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

# What a relation means for a claim.
RELATIONS = {"direct_support": ("supports", "strong"), "partial_support": ("supports", "weak"), "qualification": ("qualifies", "weak"), "direct_contradiction": ("contradicts", "strong")}
FACETS = ("same_entity", "same_metric", "same_period", "same_population", "claim_stronger_than_source", "qualifiers_omitted")
_FOLD = str.maketrans({**dict.fromkeys("‘’", "'"), **dict.fromkeys("“”", '"'), **dict.fromkeys("‐‑‒–—−", "-")})


def folded(value: str | None) -> str:
    """NFKC, plain quotes and dashes, single blanks, lower case; signs stay."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value or "").translate(_FOLD)).strip().lower()


def strictly_verbatim(excerpt: Column, content: Column) -> Column:
    """An excerpt of at least four words, word for word in the content. NFKC has no built-in form, hence Arrow."""

    def match(e: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([len(re.findall(r"[^\W_]+", x := folded(a))) >= 4 and x in folded(b) for a, b in zip(e, c, strict=True)])

    return F.pandas_udf(match, "boolean")(excerpt, content)


def adjusted(relation: Column) -> Column:
    """A relation with the downgrades that its facets (columns FACETS) force."""
    f = {k: F.col(k) for k in FACETS}
    support = relation.isin("direct_support", "partial_support")
    elsewhere = ~f["same_period"] | ~f["same_population"]
    return (
        F.when(~f["same_entity"] | ~f["same_metric"], "irrelevant")
        .when(elsewhere & support, "qualification").when(elsewhere & (relation == "direct_contradiction"), "context_only")
        .when(support & f["qualifiers_omitted"], "qualification")
        .when((relation == "direct_support") & f["claim_stronger_than_source"], "partial_support").otherwise(relation)
    )


def stance(relation: Column) -> Column:
    """Struct of stance and relevance; null for relations that are no evidence."""
    out = None
    for name, (s, r) in RELATIONS.items():
        is_ = F.struct(F.lit(s).alias("stance"), F.lit(r).alias("relevance"))
        out = F.when(relation == name, is_) if out is None else out.when(relation == name, is_)
    return out


def validated() -> Column:
    """Whether evidence (relation, stance, relevance, exact_match and FACETS) passed: its relation needs no downgrade and gives its stance."""
    relation = F.col("relation")
    of = stance(relation)
    kept = adjusted(relation) == relation
    return F.coalesce(F.col("exact_match") & kept & (of["stance"] == F.col("stance")) & (of["relevance"] == F.col("relevance")), F.lit(False))


def reject_reason(verbatim: Column, relation: Column) -> Column:
    """Why a candidate (claim_id, asked_claim, source_id, known_source) is no evidence; null if it is."""
    return (
        F.when(F.col("claim_id") != F.col("asked_claim"), "wrong claim").when(~F.col("known_source"), "wrong source")
        .when(~verbatim, "not verbatim").when(stance(relation).isNull(), "unusable relation")
    )


def admissible(promotional: Column, directness: Column) -> Column:
    """A promotional page that gives context only proves nothing."""
    return ~(promotional & (directness == "contextual"))


def rank(verdict: Column) -> Column:
    """Order of evidence (stance, relevance) in a revision: the verdict's side first, strong before weak."""
    s = F.col("stance")
    first = F.when(verdict.isin("contradicted", "outdated"), "contradicts").when(verdict == "supported_with_qualifications", "qualifies").otherwise("supports")
    second = F.when(first == "contradicts", "qualifies").when(first == "qualifies", "supports").otherwise("contradicts")
    return F.when(s == first, 0).when(s == second, 2).otherwise(4) + F.when(F.col("relevance") == "strong", 0).otherwise(1)


def ranked(evidence: DataFrame) -> DataFrame:
    """evidence (claim_id, verdict, source_id, stance, relevance) with its place in its claim's revision."""
    w = Window.partitionBy("claim_id").orderBy(rank(F.col("verdict")), "source_id")
    return evidence.withColumn("place", F.row_number().over(w))


def retrieved(results: DataFrame, pages: DataFrame, most: int) -> DataFrame:
    """Sources of search results (claim_id, query_no, rank, url, title) and fetched
    pages (url, text, content_hash): HTTP only, each canonical URL once at its
    first place, the first `most` of a claim, and whole pages only."""
    r = results.where(U.is_http(F.col("url"))).withColumn("canonical", U.canonical(F.col("url")))
    first = r.groupBy("claim_id", "canonical").agg(F.min(F.struct("query_no", "rank", "url", "title")).alias("_r")).select("claim_id", "canonical", "_r.*")
    kept = first.withColumn("place", F.row_number().over(Window.partitionBy("claim_id").orderBy("query_no", "rank"))).where(F.col("place") <= most)
    whole = pages.where(F.sha2("text", 256) == F.col("content_hash"))
    return kept.join(whole, "url").withColumn("source_id", T.hash_id("src", F.col("url"), F.col("content_hash")))


def merged(sources: DataFrame) -> DataFrame:
    """Sources (id, ordinal, title, content_hash, retrieval): each once, its first
    title, the set of its retrievals, and whether its content differs."""
    return sources.groupBy("id").agg(F.min_by("title", "ordinal").alias("title"), F.array_sort(F.collect_set("retrieval")).alias("retrievals"), (F.count_distinct("content_hash") > 1).alias("divergent"))


def snippets(results: DataFrame) -> DataFrame:
    """One text a URL from results (url, ordinal, snippet): each snippet that the text so far hasn't, in order."""
    s = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "snippet"))), lambda x: x["snippet"])
    add = lambda acc, v: F.when(acc.contains(v), acc).when(acc == "", v).otherwise(F.concat(acc, F.lit(" "), v))
    return results.groupBy("url").agg(s.alias("s")).select("url", F.aggregate("s", F.lit(""), add).alias("snippet"))
