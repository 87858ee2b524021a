"""Changes of audits' statuses that name the version they saw: which are accepted, which come too late, which aren't legal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import kept

# The statuses of an audit, in order; those that end it; those from which it may be tried again.
STATUSES = (
    "created", "mapping_claims", "planning_research", "researching_support", "researching_counterevidence", "validating_evidence", "analyzing_lineage", "validating_temporal",
    "validating_numeric", "arbitrating", "generating_revision", "completed", "partially_completed", "failed", "cancelled",
)
TERMINAL = ("completed", "partially_completed", "failed", "cancelled")
RETRYABLE = ("partially_completed", "failed", "cancelled")
#: Where an audit stands before it is created; versions of updates are greater.
NOTHING = -1


def may_follow(status: Column, new: Column) -> Column:
    """Creation comes first or after an end that may be tried again; all else while an audit runs."""
    again = status.isNull() | status.isin(*RETRYABLE)
    return F.coalesce(F.when(new == "created", again).otherwise(new.isin(*STATUSES) & ~status.isin(*TERMINAL)), F.lit(False))


def decided(updates: DataFrame, most_rounds: int = 60) -> DataFrame:
    """updates with their outcome: accepted, lost (the version it saw wasn't the audit's when it came) or illegal (it was, but the status may not follow).

    updates: (audit_id, version, seen, status): an update makes version, which is greater than all before it in its audit, if seen is the
    audit's version at that moment; null for an audit that isn't there. So of the legal updates that saw one version the first is its
    successor, each version has one predecessor, and those accepted are the chain that begins at nothing. Pointers to predecessors double,
    so rounds grow with the logarithm of the longest chain and an audit of any size is spread over all tasks.

    Rows without an audit or with a version that is null or below 0 are illegal. An update that is delivered again has the outcome of the
    first delivery; of different ones with one version that of the least (seen, status) counts and the others are lost. Other columns stay.
    """
    sound = F.col("audit_id").isNotNull() & (F.col("version") >= 0)
    mine = F.struct(F.coalesce(F.col("seen"), F.lit(NOTHING)).cast("bigint").alias("seen"), "status")
    each = kept(updates.where(sound).groupBy("audit_id", "version").agg(F.min(mine).alias("x")).select("audit_id", F.col("version").cast("bigint").alias("version"), "x.*"))
    # what was seen: nothing, or an update that came before
    made = each.select("audit_id", F.col("version").alias("seen"), F.col("status").alias("before"))
    begun = each.where(F.col("seen") == NOTHING).withColumn("before", F.lit(None).cast("string"))
    going = each.where((F.col("seen") >= 0) & (F.col("seen") < F.col("version"))).join(made, ["audit_id", "seen"])
    asked = kept(begun.unionByName(going).withColumn("legal", may_follow(F.col("before"), F.col("status"))).drop("before"))
    successor = kept(asked.where("legal").groupBy("audit_id", "seen").agg(F.min("version").alias("version")))
    # a version's root: NOTHING if it is on the chain, null if that breaks off
    open_, ended = successor.select("audit_id", "version", F.col("seen").alias("up")), []
    for _ in range(most_rounds):
        ended.append(open_.where(F.col("up") == NOTHING).select("audit_id", "version"))
        links = open_.select("audit_id", F.col("version").alias("up"), F.col("up").alias("further"))
        for before in ended[:-1]:
            links = links.unionByName(before.select("audit_id", F.col("version").alias("up"), F.lit(NOTHING).cast("bigint").alias("further")))
        open_ = kept(open_.where(F.col("up") != NOTHING).join(links, ["audit_id", "up"]).select("audit_id", "version", F.col("further").alias("up")))
        if not open_.limit(1).count():
            break
    else:
        raise RuntimeError(f"chains don't end after {most_rounds} rounds")
    accepted = kept(reduce(DataFrame.unionByName, ended))
    current = accepted.select("audit_id", F.col("version").alias("seen")).unionByName(asked.where(F.col("seen") == NOTHING).select("audit_id", "seen").distinct())
    after = current.join(successor.withColumnRenamed("version", "next"), ["audit_id", "seen"], "left")
    judged = asked.join(after, ["audit_id", "seen"]).where(F.col("next").isNull() | (F.col("next") >= F.col("version")))
    outcome = F.when(F.col("legal"), "accepted").otherwise("illegal")
    judged = judged.select("audit_id", "version", outcome.alias("_outcome"))
    first = each.select("audit_id", "version", F.col("seen").alias("_own"), F.col("status").alias("_asked")).join(judged, ["audit_id", "version"], "left")
    out = updates.join(first, ["audit_id", "version"], "left")
    same = F.col("_own").eqNullSafe(F.coalesce(F.col("seen"), F.lit(NOTHING))) & F.col("_asked").eqNullSafe(F.col("status"))
    result = F.when(~F.coalesce(sound, F.lit(False)), "illegal").when(same & F.col("_outcome").isNotNull(), F.col("_outcome")).otherwise("lost")
    return out.withColumn("outcome", result).select(*updates.columns, "outcome")
