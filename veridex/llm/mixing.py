"""Mixing sources to target weights along a time-varying curriculum (operator 2).

Source s has the weight schedule w_s(t) = weight_s * (1 + tilt_s * (2t - 1))
over training time t in [0, 1]. Its integral, weight_s, gives the source's
share of the mix; its running integral, D_s(t) = t + tilt_s * (t**2 - t), the
part of its tokens that training has taken by t. A document's tokens lie at a
known place in its source's demand, and D_s inverted there is its training
position; a range sort by position gives the training order.

Sources in code-point order, null last, take `weights` (and `tilts`) in turn.
Targets stop at `max_passes` times a source's size; what is above is reshared
by weight among the others until none is above (water filling, in closed form
over the sources sorted by cap per weight). Within a source, documents come in
the order of a hash of doc_id, so reruns agree; whole passes are taken as often
as the target holds them, and then a last part, whose last document may be
taken in part.

A document's size is its number of runs of other bytes than 20 and 09 to 0D;
null text has 0. A source of size 0 has target 0. Rows of equal ids are
ordered by size; equal rows are interchangeable. An empty table gives no rows.

Running sums go in two steps, over hash buckets of each source and then within
each bucket, so a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _io

WEIGHTS, TILTS, SHARE, MAX_PASSES = (5, 2, 1), (-0.5, 0.0, 0.5), 1.5, 2
#: Hexadecimal digits of the order's hash that number a source's buckets: 4,096 for each source.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(doc_id: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":7")))


def source_key(source: Column) -> Column:
    """Never null, and different for null and any string."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def by_turn(n: Column, values: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), ((n % len(values)) + 1).cast("int"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS, share: float = SHARE, max_passes: int = MAX_PASSES) -> DataFrame:
    """sources: (_source, source_size), a row each. Adds target and tilt. Windows over all rows: as many as sources."""
    # "n" (null) sorts before "s...", so it is put last expressly
    turn = F.row_number().over(Window.orderBy(F.col("_source") == "n", "_source")) - 1
    s = sources.withColumn("_turn", turn).withColumn("_w", by_turn(F.col("_turn"), weights)).withColumn("tilt", by_turn(F.col("_turn"), tilts))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(max_passes))
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("_cap").cast("double") / F.col("_w"), "_turn")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    level = left / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    s = s.withColumn("_n", F.row_number().over(filled)).withColumn("_level", level)
    s = s.withColumn("_first", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_n"))).over(everything))
    s = s.withColumn("_level", F.max(F.when(F.col("_n") == F.col("_first"), F.col("_level"))).over(everything))
    target = F.when(F.col("_first").isNull() | (F.col("_n") < F.col("_first")), F.col("_cap").cast("double")).otherwise(F.col("_level") * F.col("_w"))
    return s.select("_source", "source_size", target.alias("target"), "tilt")


def position(u: Column, tilt: Column) -> Column:
    """The time by which the share u of a source's tokens has been taken: u + tilt * (t**2 - t) inverted."""
    root = (tilt - 1 + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u)) / (2 * tilt)
    return F.when(tilt == 0, u).otherwise(root)


def mix(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), named: tuple[str, str, str] = ("doc_id", "text", "source"), weights: tuple[int, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS, share: float = SHARE, max_passes: int = MAX_PASSES) -> DataFrame:
    """`carry` columns of every row of docs (whose id, text and source are `named`), and _size,
    _source_size, _target, _taken, _passes (begun), _start (of the first pass,
    in words), _tilt and _position (of the first pass; null if nothing is taken)."""
    of_id, of_text, of_source = (F.col(c) for c in named)
    sized = docs.select(*carry, size_of(of_text).alias("_size"), source_key(of_source).alias("_source"), order_key(of_id).alias("_key"), of_id.alias("_id"))
    if named[1] in carry:
        small = _io.materialize(sized.select("_size", "_source", F.substring("_key", 1, BUCKET_DIGITS).alias("_bucket")), "mix-sizes")
    else:
        sized = _io.materialize(sized, "mix-sizes")
        small = sized.select("_size", "_source", F.substring("_key", 1, BUCKET_DIGITS).alias("_bucket"))
    buckets = small.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
    sources = targets(buckets.groupBy("_source").agg(F.sum("_sum").alias("source_size")), weights, tilts, share, max_passes)
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = buckets.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")).join(sources, "_source")
    within = Window.partitionBy("_source", "_bucket").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS)).withColumn("_in", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    r = rows.join(base, ["_source", "_bucket"]).withColumn("_start", F.col("_base") + F.col("_in"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    r = r.withColumn("_whole", whole).withColumn("_rest", F.floor("target").cast("bigint") - F.col("_whole") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_start"))).cast("bigint")
    taken = F.col("_whole") * F.col("_size") + part
    u = F.least(F.lit(1.0), (F.col("_start") + F.col("_size") / F.lit(2.0)) / F.col("target"))
    return r.select(
        *carry, "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), taken.alias("_taken"),
        F.when(F.col("_size") > 0, F.col("_whole") + (part > 0).cast("bigint")).otherwise(F.lit(0)).alias("_passes"), "_start", F.col("tilt").alias("_tilt"),
        F.when(taken > 0, position(u, F.col("tilt"))).alias("_position"),
    )


def op2_curriculum_mix(spark: SparkSession, sf_dir: str, rows_per_task: int = 20_000) -> DataFrame:
    """Every document, sorted by the training position of its first pass (those of which nothing is taken are first)."""
    docs = _io.table(spark, sf_dir, "documents")
    n = _io.partitions_for(docs.select("doc_id").count(), rows_per_task)
    return mix(docs).repartitionByRange(n, "_position", "doc_id").sortWithinPartitions("_position", "doc_id").select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.col("_position").alias("position"))


def curriculum(docs: DataFrame, rows_per_task: int = 20_000) -> DataFrame:
    """The mix itself: a row for each pass over a document that the mix begins,
    sorted by training position. A document of which nothing is taken goes. All
    columns are carried, whatever their names."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    named = tuple(names[docs.columns.index(c)] for c in ("doc_id", "text", "source"))
    m = mix(docs.toDF(*names), tuple(names), named).where(F.col("_passes") > 0)
    each = m.withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_passes") - 1)))
    u = F.least(F.lit(1.0), (F.col("_start") + F.col("_pass") * F.col("_source_size") + F.col("_size") / F.lit(2.0)) / F.col("_target"))
    at = each.withColumn("_at", position(u, F.col("_tilt")))
    n = _io.partitions_for(docs.select("doc_id").count(), rows_per_task)
    return at.repartitionByRange(n, "_at", named[0]).sortWithinPartitions("_at", named[0], "_pass").select(*names).toDF(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum(docs)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7') AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), turned AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM totals
), weighed AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         CASE turn % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS tilt, source_size * 2 AS cap
  FROM turned
), filled AS (
  SELECT *, row_number() OVER o AS n,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / w, turn)
), first_free AS (
  SELECT min(n) AS n FROM filled WHERE level * w <= cap
), sources AS (
  SELECT f.source, f.source_size, f.tilt,
         CASE WHEN g.n IS NULL OR f.n < g.n THEN f.cap::DOUBLE ELSE (SELECT level FROM filled x WHERE x.n = g.n) * f.w END AS target
  FROM filled f, first_free g
), placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.tilt,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         CASE WHEN s.source_size > 0 THEN CAST(floor(floor(s.target) / s.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source
), cut AS (
  SELECT *, whole * size + CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size - start)) AS BIGINT) AS taken,
         CASE WHEN target > 0 THEN least(1.0::DOUBLE, (start + size / 2.0::DOUBLE) / target) END AS u
  FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN CASE WHEN tilt = 0 THEN u ELSE (tilt - 1 + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u)) / (2 * tilt) END END AS position
FROM cut
"""
