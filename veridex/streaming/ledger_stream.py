"""The ledger as a stream: tailing an append-only folder, running state, exactly-once, legality."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import FOLLOWS

EVENT_SCHEMA = "seq long, saga_id string, action_id string, event string, payload string, at timestamp"


def tail(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(events: DataFrame, keys: tuple[str, ...] = ("saga_id", "seq"), delay: str | None = None) -> DataFrame:
    """Each event once; with a delay, state of older keys is dropped."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(list(keys)) if delay else events.dropDuplicates(list(keys))


def running_state(events: DataFrame) -> DataFrame:
    """Latest event and attempts of each action, for update mode."""
    return events.groupBy("action_id").agg(F.max_by("event", "seq").alias("state"), F.max("seq").alias("last_seq"), F.count_if(F.col("event") == "CALLED").alias("attempts"))


def illegal(events: DataFrame) -> DataFrame:
    """Events that may not follow the one before in their action, as they arrive.
    Within a batch events go by seq; across batches they must arrive in order."""
    legal = {(a or "", b) for a, b in FOLLOWS}

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else ""
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, event in zip(rows["seq"], rows["event"], strict=True):
            if (before, event) not in legal:
                out.append((key[0], int(seq), before or None, event))
            before = event
        state.update((before,))
        yield pd.DataFrame(out, columns=["action_id", "seq", "before", "event"])

    return events.groupBy("action_id").applyInPandasWithState(check, "action_id string, seq long, before string, event string", "before string", "append", GroupStateTimeout.NoTimeout)


def deliver(events: DataFrame, write, checkpoint: str, keys: tuple[str, ...] = ("saga_id", "seq"), every: str | None = None):
    """Hands each micro-batch, once and in order of seq, to write(batch, batch_id); the running query. A batch that is tried again
    after a failure comes with the same id, so a writer that skips ids it has seen delivers exactly once. every: a processing
    interval such as '500 milliseconds'; without it, what is there is delivered and the query ends."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write(batch.dropDuplicates(list(keys)).sort("seq"), batch_id)

    out = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def run_available(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that is there, into an in-memory table (for tests and small state)."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)
