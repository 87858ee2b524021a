"""Append logs and stored relations: idempotent appends, upserts, latest records, integrity.

Without a table format there is no MERGE; each operator gives the new state of
a relation from its old state and what comes in, by anti-joins and aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept

def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or ignore: rows of new whose key old doesn't have."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def append_conflicts(old: DataFrame, new: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Keys that both have with different payloads: an append that isn't a repetition."""
    return new.select(*keys, F.col(payload).alias("new_payload")).join(old.select(*keys, F.col(payload).alias("old_payload")), keys).where(~F.col("new_payload").eqNullSafe(F.col("old_payload")))


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def ordered_upsert(old: DataFrame, new: DataFrame, owner: str, key: str, payload: str = "payload", position: str = "position") -> DataFrame:
    """Known keys keep their position and take the new payload; new ones follow
    after the owner's greatest position, in their own order (`position` of new)."""
    top = old.groupBy(owner).agg((F.max(position) + 1).alias("_base"))
    mine = old.select(owner, key, F.col(position).alias("_old"), F.col(payload).alias("_was"))
    both = mine.join(new.select(owner, key, F.col(position).alias("_turn"), F.col(payload).alias("_is")), [owner, key], "full_outer").join(top, owner, "left")
    fresh = F.row_number().over(Window.partitionBy(owner, F.col("_old").isNull()).orderBy("_turn")) - 1
    return both.select(owner, key, F.coalesce("_old", F.coalesce("_base", F.lit(0)) + fresh).alias(position), F.when(F.col("_turn").isNull(), F.col("_was")).otherwise(F.col("_is")).alias(payload))


def latest(records: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last version of each record of an append log."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def next_sequence(new: DataFrame, last: int, order: list[str]) -> DataFrame:
    """Sequence numbers after `last`, in order. The order is total, so this sorts once and numbers in two steps,
    over one written copy of the sorted rows: both steps see the same ranges, whatever is lost meanwhile."""
    ranged = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    part, own = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    tagged = kept(ranged.withColumns({"_p": part, "_i": own}).drop("_m"))
    sizes = tagged.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a partition
    base = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))
    return tagged.join(F.broadcast(base), "_p").withColumn("seq", F.col("_base") + F.col("_i") + 1 + F.lit(last)).drop("_p", "_i", "_base")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def missing_references(rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target; null references have none to look for."""
    return rows.where(F.col(column).isNotNull()).join(target.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def violations(**found: DataFrame) -> DataFrame:
    """(rule, subject) of several rules' findings, each a DataFrame of one column."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(rule).alias("rule"), df[df.columns[0]].cast("string").alias("subject")) for rule, df in found.items()])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other hasn't, with their side: multisets, whatever the order."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
