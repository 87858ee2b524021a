"""Reading tables, intermediate tables in the shared folder, and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and there is one machine (tests)."""
    sc = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not own:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veridex-"))
        own = sc.getCheckpointDir()
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: it cuts the
    lineage, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veridex/{name}-{uuid.uuid4().hex}"
    conf, was = spark.conf, spark.conf.get(_CLEANUP, None)
    try:
        conf.set(_CLEANUP, "true")  # this write's shuffle files go once it has ended
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, was) if was is not None else conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._veridex_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_veridex_path", None):
            jvm, spark = t.sparkSession._jvm, t.sparkSession
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Arrow batches are kept small, so that a few very long texts or wide rows don't fill an executor.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
Batches = Iterator[pa.RecordBatch]


def arrow_map(df: DataFrame, f: Callable[[Batches], Batches], schema) -> DataFrame:
    """df.mapInArrow(f, schema) with small batches; a task gives its memory back when it ends."""
    for key, value in BATCH.items():
        df.sparkSession.conf.set(key, value)

    def run(batches: Batches) -> Batches:
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Returns freed memory to the system: workers are kept for later tasks, and so would be what they once held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def partitions_for(n_rows: int, per: int, least: int = 1) -> int:
    return max(least, -(-n_rows // per))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
