"""Claims of documents: a deterministic mapper, and what any mapper's claims must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .evidence import span_overlaps

# Most claims of a document, kinds and risks; the least characters of a sentence's claim is our choice.
MOST_CLAIMS, LEAST_LETTERS = 12, 20
KINDS = ("numeric", "event", "causal", "definitional", "quote", "prediction", "existence", "comparison", "general")
RISKS = ("low", "medium", "high")
RAW = "original_text string, normalized string, claim_type string, verifiable boolean, time_sensitive boolean, risk string, as_of string"


def assembled(raw: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(claims, refused) of raw (key, document, claims: an array of structs RAW, as a model gives them, in its order).

    Claims are taken in turn. One is left out if its text isn't in the document verbatim, if it overlaps one that was taken, or if it has the
    id of one; its place is the first where its text stands. What isn't a known kind or risk is `general` and `medium`. An answer of
    more than MOST_CLAIMS claims, or with one of no text, is none at all: refused (key, reason). A fold within each row, by built-in functions.
    """
    said = F.coalesce("claims", F.array().cast(f"array<struct<{RAW.replace(' ', ':').replace(',:', ',')}>>"))
    blank = F.exists(said, lambda c: F.coalesce(c["original_text"], F.lit("")) == "")
    reason = F.when(F.size(said) > MOST_CLAIMS, "too many claims").when(blank, "a claim without text")
    judged = raw.select(key, "document", said.alias("claims"), reason.alias("reason"))
    found = F.transform("claims", lambda c, i: F.struct(
        i.alias("i"), T.hash_id("claim", F.coalesce(F.nullif(c["normalized"], F.lit("")), c["original_text"])).alias("claim"),
        (F.instr(F.col("document"), c["original_text"]) - 1).alias("lo"), (F.instr(F.col("document"), c["original_text"]) - 1 + F.length(c["original_text"])).alias("hi"),
    ))

    def take(taken: Column, x: Column) -> Column:
        clash = F.exists(taken, lambda y: (y["claim"] == x["claim"]) | ((x["lo"] < y["hi"]) & (x["hi"] > y["lo"])))
        return F.when((x["lo"] < 0) | clash, taken).otherwise(F.concat(taken, F.array(x)))

    none = F.array().cast("array<struct<i:int,claim:string,lo:int,hi:int>>")
    good = judged.where("reason is null and document is not null").withColumn("taken", F.aggregate(found, none, take))
    each = good.select(key, "claims", F.explode("taken").alias("t")).select(key, "t", F.col("claims")[F.col("t.i")].alias("c"))
    listed = lambda c, values, default: F.when(F.col(c).isin(*values), F.col(c)).otherwise(default)
    claims = each.select(
        key, F.col("t.claim").alias("claim_id"), F.col("c.original_text").alias("text"), F.coalesce(F.nullif("c.normalized", F.lit("")), F.lower("c.original_text")).alias("normalized"),
        listed("c.claim_type", KINDS, "general").alias("claim_type"), F.col("t.lo").alias("start"), F.col("t.hi").alias("end"), F.coalesce("c.verifiable", F.lit(False)).alias("verifiable"),
        F.coalesce("c.time_sensitive", F.lit(False)).alias("time_sensitive"), listed("c.risk", RISKS, "medium").alias("risk"), F.lit("contracted").alias("status"), F.col("c.as_of").alias("as_of"),
    )
    return claims, judged.where("reason is not null").select(key, "reason")


def sentence_claims(docs: DataFrame, key: str) -> DataFrame:
    """(key, claim_id, text, start, end) of docs (key, document): a sentence is a claim, at its first place, each once."""
    said = F.slice(F.filter(T.sentences(F.col("document")), lambda s: F.length(s) >= LEAST_LETTERS), 1, MOST_CLAIMS)
    each = docs.select(key, "document", F.explode(F.array_distinct(said)).alias("text"))
    at = F.expr("instr(document, text)") - 1
    return each.select(key, T.hash_id("claim", F.col("text")).alias("claim_id"), "text", at.alias("start"), (at + F.length("text")).alias("end")).where("start >= 0")


def invalid_claims(claims: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, claim_id, rule): claims whose span isn't in the document or has other text, repeated ids, and overlaps."""
    c = claims.join(docs, key)
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("document"))
    same = F.col("document").substr(F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    tag = lambda df, rule: df.select(key, "claim_id", F.lit(rule).alias("rule"))
    twice = claims.groupBy(key, "claim_id").agg(F.count("*").alias("n")).where("n > 1")
    return tag(c.where(~inside), "span").unionByName(tag(c.where(inside & ~same), "text")).unionByName(tag(twice, "repeated")).unionByName(tag(span_overlaps(claims, key), "overlap"))
