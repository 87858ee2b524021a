"""The driver's tables as the engine's relations. The oracle SQL of plans/catalog uses the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
EVENT_WORDS = {"signup": "STAGED", "click": "CALLED", "view": "COMPENSATED", "purchase": "COMMITTED", "error": "ABORTED"}
SOURCE_TYPES = ("primary", "press_release", "news", "gov", "academic", "encyclopedia", "blog", "social")
CLAIM_TYPES = ("numeric", "event", "causal", "definitional", "quote", "prediction", "existence", "comparison", "general")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: a saga for each user, an action for each user and k."""
    word = F.create_map(*[F.lit(x) for pair in EVENT_WORDS.items() for x in pair])[F.col("event_type")]
    action = F.concat_ws(":", F.col("user_id").cast("string"), F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("saga_id"), action.alias("action_id"), word.alias("event"), F.col("props").alias("payload"), F.col("ts").alias("at"))


def vendor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one vendor, one a key: that of the least order."""
    key = F.concat_ws(":", (F.col("o_custkey") % 200).cast("string"), (F.col("o_orderkey") % 100).cast("string"))
    item = F.concat_ws("|", "o_orderstatus", (F.col("o_orderkey") % 97).cast("string"), "o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy(key.alias("key")).agg(F.lit("vendor").alias("vendor"), F.min_by(item, "o_orderkey").alias("item"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources, published an hour apart."""
    kinds = F.array(*map(F.lit, SOURCE_TYPES))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("title"), at.alias("published_at"),
        F.element_at(kinds, (F.col("doc_id") % 8 + 1).cast("int")).alias("source_type"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as evidence on 50 claims."""
    stance = F.when(F.col("toxic") == 1, "contradicts").when(F.col("quality") == 1, "supports").otherwise("qualifies")
    return table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("claim_id"), F.col("doc_id").alias("source_id"), stance.alias("stance"), F.when(F.col("doc_id") % 3 != 0, "strong").otherwise("weak").alias("relevance"))


def claims(spark: SparkSession) -> DataFrame:
    """The 50 claims: kinds in turn, every fifth dated, every other time-sensitive, every seventh an opinion."""
    kinds = F.array(*map(F.lit, CLAIM_TYPES))
    return spark.range(50).select(
        F.col("id").alias("claim_id"), F.element_at(kinds, (F.col("id") % 9 + 1).cast("int")).alias("claim_type"),
        F.when(F.col("id") % 5 == 0, "2024-01-15T00:00:00Z").alias("as_of"), (F.col("id") % 2 == 0).alias("time_sensitive"),
        F.when(F.col("id") % 4 == 0, "high").otherwise("low").alias("risk"), (F.col("id") % 7 != 0).alias("verifiable"),
    )
