"""Graphs as edge tables: connected components and breadth-first propagation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edge kinds along which a failure spreads. Fixed values.
FOUNDATIONAL = ("depends_on", "derived_from", "assumes", "calculated_from")

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder, or on one machine (tests) a local one where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not own and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="veridex-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder, which a lost executor doesn't take away."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(parts: Iterable[DataFrame], name: str = "part") -> DataFrame:
    """The rows of all parts as one Parquet table in the shared folder, for what is too large to checkpoint: written one part after the other,
    and the shuffle files of each go when it is written, so that parts take the disk of one."""
    path, schema = None, None
    for df in parts:
        spark = df.sparkSession
        if path is None:
            path, schema = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", df.schema
        was = spark.conf.get(CLEANUP, None)
        try:
            spark.conf.set(CLEANUP, "true")
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(CLEANUP, was) if was is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(schema).parquet(path)
    out._stored = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) of nodes (id) under edges (a, b): root is the least id of a component.

    Labels hook to the least label around them and then jump to their label's
    label, so the number of rounds is about the logarithm of the longest chain.
    """
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = nodes.select("id", F.col("id").alias("root"))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), F.col("root").alias("seen")), "b").groupBy(F.col("a").alias("id")).agg(F.min("seen").alias("seen"))
        hooked = labels.join(near, "id", "left").select("id", "root", F.least("root", F.coalesce("seen", "root")).alias("new"))
        told = hooked.groupBy(F.col("root").alias("id")).agg(F.min("new").alias("told"))
        stepped = hooked.join(told, "id", "left").select("id", "root", F.least("new", F.coalesce("told", "new")).alias("new"))
        jump = stepped.select(F.col("id").alias("new"), F.col("new").alias("further"))
        after = kept(stepped.join(jump, "new", "left").select("id", "root", F.least("new", F.coalesce("further", "new")).alias("new")))
        labels = after.select("id", F.col("new").alias("root"))
        if not after.where("new <> root").limit(1).count():
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (source, target, kind) between different ones of nodes (id)."""
    ids = lambda c: nodes.select(F.col("id").alias(c)).distinct()
    return edges.where("source <> target").join(ids("source"), "source", "left_semi").join(ids("target"), "target", "left_semi")


def _together(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (p for _, p in parts))


def reevaluate(failed: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth, by_kind, by_id, reason) of all that stands on failed ids (id), breadth first, however deep.

    edges: (source, target, kind), source standing on target. The reason names
    the kind and the parent of the first discovery: least depth, then least
    parent, then kind. Failed ids themselves are left out. Levels are merged in
    twos, fours and so on, so a row is written again a few times only, however
    many levels follow it, and a round reads few tables.
    """
    e = edges.where(F.col("kind").isin(*FOUNDATIONAL) & (F.col("source") != F.col("target"))).select("source", "target", "kind").distinct()
    none = [F.lit(None).cast(t).alias(c) for c, t in (("by_kind", "string"), ("by_id", e.schema["target"].dataType))]
    front, depth = kept(failed.select("id", F.lit(0).alias("depth"), *none).distinct()), 0
    found_so_far = [(0, front)]
    while True:  # ends when a round finds nothing: each row is found once
        depth += 1
        found = front.select(F.col("id").alias("target")).join(e, "target").groupBy(F.col("source").alias("id")).agg(F.min(F.struct("target", "kind")).alias("by"))
        fresh = found.join(_together(found_so_far), "id", "left_anti").select("id", F.lit(depth).alias("depth"), F.col("by.kind").alias("by_kind"), F.col("by.target").alias("by_id"))
        front = kept(fresh)
        if not front.limit(1).count():
            break
        found_so_far.append((0, front))
        while len(found_so_far) > 1 and found_so_far[-1][0] == found_so_far[-2][0]:  # as many levels each: one table of both
            merged = kept(_together(found_so_far[-2:]))
            found_so_far[-2:] = [(found_so_far[-1][0] + 1, merged)]
    seen = _together(found_so_far)
    reason = F.concat(F.lit("may be weakened: "), F.replace("by_kind", F.lit("_"), F.lit(" ")), F.lit(" "), F.col("by_id").cast("string"), F.lit(", which did not hold; re-evaluation recommended"))
    return seen.where("depth > 0").withColumn("reason", reason)
