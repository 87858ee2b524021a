"""Sagas driven to their end: calls that are tried again, answers from the world, compensation newest first.

No answer of a call is trusted: only what the world says afterwards commits, ends
or undoes an action. Where it says nothing the action is parked as it stands, and
a later run takes it up again. All actions of all sagas advance together, one step
a round; a round reads the open actions only. An action is written when it is read, and
once more for each command; nothing that waits is written again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored

#: Fixed value: calls of one action at most.
MOST_ATTEMPTS = 2
#: commands (saga_id, action_id, step, attempt; step: call, reconcile or compensate) to (action_id, landed, error). landed says whether
#: the world shows the effect now, null if it doesn't say; error is that of a compensation. A command without an answer is one of null.
Answer = Callable[[DataFrame], DataFrame]


def _asked(commands: DataFrame, answer: Answer) -> DataFrame:
    """commands with landed and error; written, so that no command is given twice."""
    out = answer(commands.select("saga_id", "action_id", "step", "attempt"))
    return stored([commands.join(out.select("action_id", "landed", "error"), "action_id", "left")], "asked")


def _events(rows: DataFrame, turn: int, *steps: tuple[int, str, Column]) -> DataFrame:
    """(saga_id, action_id, turn, step, event) where the step's condition holds."""
    each = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(k).alias("step"), F.lit(event).alias("event"))) for k, event, holds in steps]))
    return rows.select("saga_id", "action_id", F.lit(turn).alias("turn"), F.explode(each).alias("x")).select("saga_id", "action_id", "turn", "x.step", "x.event")


def executed(actions: DataFrame, answer: Answer, most_attempts: int = MOST_ATTEMPTS) -> tuple[DataFrame, DataFrame, int]:
    """(actions, events, turns) after every action that was staged, called or reconciled has come as far as the world lets it.

    actions: (saga_id, action_id, state, attempts, commit_turn, commit_seq). A staged action is called. One that was called may have had its
    effect, so the world is asked first, and it is called again only if nothing landed and attempts are left; if none are, it is aborted.
    """
    idle = actions.where(~F.col("state").isin("STAGED", "CALLED", "RECONCILED")).withColumn("parked", F.lit(False))
    front = actions.where(F.col("state").isin("STAGED", "CALLED", "RECONCILED")).withColumn("step", F.when(F.col("state") == "STAGED", "call").otherwise("reconcile"))
    ended, events = [idle], []
    columns = idle.columns
    for turn in range(1, most_attempts + 2):
        call = F.col("step") == "call"
        done = _asked(front.withColumn("attempt", F.col("attempts") + call.cast("int")), answer)
        none, spent = F.col("landed").isNull(), F.col("attempt") >= most_attempts
        events.append(_events(done, turn, (1, "CALLED", call), (2, "RECONCILED", ~none), (3, "COMMITTED", F.col("landed")), (3, "ABORTED", ~F.col("landed") & spent)))
        state = F.when(none & call, "CALLED").when(none, F.col("state")).when(F.col("landed"), "COMMITTED").when(spent, "ABORTED").otherwise("RECONCILED")
        done = done.withColumn("attempts", F.col("attempt")).withColumn("state", state).withColumn("commit_turn", F.when(F.col("landed"), turn)).withColumn("parked", none)
        again = ~none & ~F.col("landed") & ~spent
        ended.append(done.where(~F.coalesce(again, F.lit(False))).select(*columns))
        front = done.where(again).withColumn("step", F.lit("call")).select(*columns[:-1], "step")
        if not front.limit(1).count():
            break
    return reduce(DataFrame.unionByName, ended), reduce(DataFrame.unionByName, events), turn


def cancelled(actions: DataFrame, sagas: DataFrame, answer: Answer, turn: int = 0) -> tuple[DataFrame, DataFrame]:
    """(actions, events) after `sagas` (saga_id) are undone: their committed actions, newest commit first, one a round for each saga. An action
    counts as undone when the world no longer shows it; if it still does, or doesn't say, or the compensation fails, it stays at
    COMPENSATION_CALLED and the saga's older actions aren't touched."""
    undone = stored([sagas.select("saga_id").distinct()], "undone")
    held = F.coalesce(F.col("state").isin("COMMITTED", "COMPENSATION_CALLED"), F.lit(False))
    newest = Window.partitionBy("saga_id").orderBy(F.col("commit_turn").desc_nulls_last(), F.col("commit_seq").desc_nulls_last(), F.col("action_id").desc())
    left = stored([actions.where(held).join(undone, "saga_id", "left_semi").withColumn("place", F.row_number().over(newest))], "left")
    ended, events, stops, place, columns = [actions.where(~held), actions.where(held).join(undone, "saga_id", "left_anti")], [], [], 0, actions.columns
    while True:  # ends with the longest saga, or when no saga goes on
        place += 1
        now = left.where(F.col("place") == place)
        if stops:
            now = now.join(reduce(DataFrame.unionByName, stops).select("saga_id"), "saga_id", "left_anti")
        done = _asked(now.withColumn("step", F.lit("compensate")).withColumn("attempt", F.col("attempts")), answer)
        if not done.limit(1).count():
            break
        gone = F.col("error").isNull() & F.coalesce(~F.col("landed"), F.lit(False))
        events.append(_events(done, turn + place, (1, "COMPENSATION_CALLED", F.col("state") == "COMMITTED"), (2, "COMPENSATED", gone)))
        ended.append(done.withColumn("parked", ~gone).withColumn("state", F.when(gone, "COMPENSATED").otherwise("COMPENSATION_CALLED")).select(*columns))
        stops.append(done.where(~gone).select("saga_id", F.col("place").alias("stop")))
    if not stops:
        return reduce(DataFrame.unionByName, ended), _events(done, turn + place, (1, "COMPENSATED", F.lit(False)))
    behind = left.join(reduce(DataFrame.unionByName, stops), "saga_id").where("place > stop")  # a saga stops once
    ended.append(behind.select(*columns))
    return reduce(DataFrame.unionByName, ended), reduce(DataFrame.unionByName, events)


def driven(events: DataFrame, answer: Answer, sagas: DataFrame | None = None, most_attempts: int = MOST_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(actions, new events) of a ledger recovered and, for `sagas`, undone. actions: (saga_id, action_id, state, attempts, parked). Events are
    (saga_id, action_id, turn, step, event), in order of turn and step, for appending after those that were there."""
    event = F.col("event")
    folded = events.groupBy("saga_id", "action_id").agg(F.max_by("event", "seq").alias("state"), F.count_if(event == "CALLED").cast("int").alias("attempts"), F.min(F.when(event == "COMMITTED", F.col("seq"))).alias("commit_seq"))
    actions = stored([folded.select("saga_id", "action_id", "state", "attempts", F.lit(None).cast("int").alias("commit_turn"), "commit_seq")], "actions")
    done, new, turn = executed(actions, answer, most_attempts)
    if sagas is not None:
        done, undone = cancelled(done, sagas, answer, turn)
        new = new.unionByName(undone)
    return done.select("saga_id", "action_id", "state", "attempts", "parked"), new
