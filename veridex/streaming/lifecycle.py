"""Audits as a stream: events in any order within a delay, legality, time-outs and cancellation, with state that ends.

Events are (seq, saga_id, action_id, event, at); a saga is an audit here. `at`
doesn't fall as seq rises. An audit is open from its first event until one of
`CANCEL` arrives or nothing has for `idle`; what follows is a new one. State
holds of each audit the events that wait for the watermark and the last event
of each action, has one timer for the audits of a key, and is gone when they end.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import shared_folder
from ..operators.ledger import FOLLOWS, TERMINAL

CANCEL = "CANCELLED"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys over which audits are dealt, at any number of partitions up to it.
KEYS = 512
#: Of the audits of a key: the rows that wait for the watermark, the last event of each open audit's actions, and the last row taken of each open audit.
STATE = "waits array<string>, at array<long>, seq array<long>, action_id array<string>, event array<string>, acts array<string>, actions array<string>, events array<string>, lasts array<string>, last_at array<long>, last_seq array<long>"
FOUND = "saga_id string, kind string, seq long, action_id string, before string, event string"
_COLUMNS = [c.split()[0] for c in FOUND.split(", ")]
_LEGAL = {(a or "", b) for a, b in FOLLOWS}


def judge(saga_id: str, rows: list[tuple], last: tuple | None, actions: dict[str, str], watermark: int, idle_ms: int) -> tuple[list[tuple], list[tuple], tuple | None]:
    """(rows of FOUND, rows that still wait, last) of an audit's waiting rows (at, seq, action_id, event), in order: those which nothing
    earlier can still overtake are taken, and the audit ends if its time is over. `actions`, the last event of each, is brought up to date."""
    out, due = [], sum(r[0] <= watermark for r in rows)
    for at, seq, action_id, event in rows[:due]:
        if last and at - last[0] > idle_ms:
            out.append(_end(saga_id, last[1], actions))
            actions.clear()
        last = (at, seq)
        if event == CANCEL:
            out.append((saga_id, "cancelled", seq, None, None, None))
            last = None
            actions.clear()
            continue
        was = actions.get(action_id, "")
        if (was, event) not in _LEGAL:
            out.append((saga_id, "illegal", seq, action_id, was or None, event))
        actions[action_id] = event
    if last and watermark > last[0] + idle_ms:
        out.append(_end(saga_id, last[1], actions))
        last = None
        actions.clear()
    return out, rows[due:], last


def _end(saga_id: str, seq: int, actions: dict[str, str]) -> tuple:
    return saga_id, "finished" if all(e in TERMINAL for e in actions.values()) else "timed_out", seq, None, None, None


def lifecycle(events: DataFrame, idle: str = "12 hours", delay: str = "1 hour", keys: int = KEYS) -> DataFrame:
    """FOUND of a stream of events that come up to `delay` late; later ones are dropped by the watermark. Its rows: illegal events with the one before in
    their action, and the end of each audit (finished, timed_out while an action is open, cancelled) with its last seq. Audits are dealt over so many keys,
    since a call of Python for each audit and batch takes milliseconds, however few events it has."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # what waits stays out of the executors' heap
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def advance(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, open_, lasts = _held(state)
        if not state.hasTimedOut:
            for pdf in batches:
                pdf = pdf.dropna(subset=["saga_id", "seq", "at"])  # rows without an audit only move the watermark; what has no place in the order is passed over
                for saga_id, *row in zip(pdf["saga_id"], pdf["at"].astype("datetime64[ms]").astype("int64").tolist(), pdf["seq"].astype("int64").tolist(), pdf["action_id"], pdf["event"], strict=True):
                    waiting[saga_id].append(tuple(row))
        watermark, out, times = state.getCurrentWatermarkMs(), [], []
        for saga_id in waiting.keys() | lasts.keys():
            rows = sorted(waiting[saga_id], key=lambda r: r[:2])
            found, rest, last = judge(saga_id, rows, lasts.pop(saga_id, None), open_[saga_id], watermark, idle_ms)
            out += found
            waiting[saga_id] = rest
            if last:
                lasts[saga_id] = last
            times += [r[0] for r in rest[:1]] + ([last[0] + idle_ms + 1] if last else [])
        if times:
            state.update(_columns(((a, *r) for a, rows in waiting.items() for r in rows), 5) + _columns(((a, *x) for a, own in open_.items() for x in own.items()), 3) + _columns(((a, *x) for a, x in lasts.items()), 3))
            state.setTimeoutTimestamp(min(times) - 1)  # called when the watermark has passed that, so at the first row that waits, or after an audit's idle time
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"seq": "int64"})

    rows = events.select(F.pmod(F.xxhash64("saga_id"), F.lit(keys)).alias("key"), "saga_id", "seq", "action_id", "event", "at").withWatermark("at", delay)
    return rows.groupBy("key").applyInPandasWithState(advance, FOUND, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _held(state: GroupState) -> tuple[dict[str, list[tuple]], dict[str, dict], dict[str, tuple]]:
    """What STATE holds, by audit: rows that wait, the last event of each action, the last row taken."""
    waiting, open_, lasts = defaultdict(list), defaultdict(dict), {}
    if state.exists:
        held = state.get
        for saga_id, *row in zip(*held[:5], strict=True):
            waiting[saga_id].append(tuple(row))
        for saga_id, action_id, event in zip(*held[5:8], strict=True):
            open_[saga_id][action_id] = event
        lasts = {saga_id: (at, seq) for saga_id, at, seq in zip(*held[8:], strict=True)}
    return waiting, open_, lasts


def _columns(rows: Iterable[tuple], n: int) -> tuple[list, ...]:
    return tuple(map(list, zip(*rows, strict=True))) or ([],) * n


def heartbeat(spark: SparkSession, at, schema: str) -> DataFrame:
    """A row without an audit: it moves the watermark on when nothing else does."""
    return spark.createDataFrame([(at,)], "at timestamp").select(*[F.col("at") if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema])


def collected(found: DataFrame, name: str = "stream") -> tuple[DataFrame, list]:
    """(all rows that a stream gives for what is there, its progress reports): written by the file sink, which
    takes each batch once however often it is tried, to a table in the shared folder."""
    spark = found.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    running = found.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/rows"), running.recentProgress
