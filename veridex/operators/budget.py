"""Budgets that admit: running sums over groups of any size, and calls cut off where a limit is reached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept


def running_sums(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "before") -> DataFrame:
    """rows with the sum of `value` over the rows of the same keys that come earlier by `order`, which is unique within keys.

    Rows are dealt by ranges of keys and order, so a group of any size is spread over tasks: each range sums its own part of
    a group, the parts' sums are added up, which is a row for each range, and each row adds those before it in its part.
    """
    dealt = kept(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    own = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    same = within["_part"] == parts["_part"]
    for k in keys:
        same = same & within[k].eqNullSafe(parts[k])
    return within.join(parts, same).select(*[within[c] for c in rows.columns], (within["_own"] + parts["_ahead"]).alias(name))


def admitted(calls: DataFrame, allowed: Column, order: list[str], keys: tuple[str, ...] = ("audit_id", "resource")) -> DataFrame:
    """calls (keys, order, attempts: how many each would make) with `before`, the attempts asked for earlier, `admitted`, how many of
    its own the limit leaves, and `outcome`: admitted, cut (some of them) or refused. Each attempt counts, as a retry costs what a call does."""
    asked = running_sums(calls, list(keys), order, "attempts").withColumn("allowed", allowed.cast("bigint"))
    left = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("attempts").cast("bigint"), F.col("allowed") - F.col("before")))
    asked = asked.withColumn("admitted", left)
    outcome = F.when(F.col("admitted") == F.col("attempts"), "admitted").when(F.col("admitted") > 0, "cut").otherwise("refused")
    return asked.withColumn("outcome", outcome)
