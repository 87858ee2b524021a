"""An append-only event ledger: folds, status, legality, compensation, reconciliation.

Events are (seq, saga_id, action_id, event, payload, at). All state is derived
by aggregates over them; order is by seq alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Event words, and which of them end an action.
EVENTS = ("STAGED", "CALLED", "RECONCILED", "COMMITTED", "COMPENSATION_CALLED", "COMPENSATED", "ABORTED")
TERMINAL = ("COMMITTED", "COMPENSATED", "ABORTED")
#: Which event may follow which within an action; None: the first.
FOLLOWS = (
    (None, "STAGED"), ("STAGED", "CALLED"), ("CALLED", "RECONCILED"), ("CALLED", "CALLED"), ("RECONCILED", "COMMITTED"), ("RECONCILED", "CALLED"),
    ("RECONCILED", "ABORTED"), ("COMMITTED", "COMPENSATION_CALLED"), ("COMPENSATION_CALLED", "COMPENSATED"), ("COMPENSATION_CALLED", "COMPENSATION_CALLED"),
)
#: What recovery does with an action in a state.
NEXT_STEP = {"STAGED": "execute", "CALLED": "reconcile", "RECONCILED": "reconcile", "COMPENSATION_CALLED": "compensate"}


def with_vendor(events: DataFrame) -> DataFrame:
    """The fold keyed by action alone, with the vendor that its last STAGED payload (JSON) names."""
    return fold(events, ("action_id",)).withColumn("vendor", F.get_json_object("staged_payload", "$.vendor"))


def fold(events: DataFrame, keys: tuple[str, ...] = ("saga_id", "action_id")) -> DataFrame:
    """The state of each action: last event, payload of the last STAGED, counts; partial aggregates only."""
    staged = F.col("event") == "STAGED"
    return events.groupBy(*keys).agg(
        F.max_by("event", "seq").alias("state"),
        F.max_by(F.when(staged, F.col("payload")), F.when(staged, F.col("seq"))).alias("staged_payload"),
        F.count("*").alias("n_events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.count_if(F.col("event") == "CALLED").alias("attempts"),
    )


def in_flight(actions: DataFrame) -> DataFrame:
    return actions.where(~F.col("state").isin(*TERMINAL))


def saga_status(actions: DataFrame) -> DataFrame:
    """committed, compensated, mixed, or in_flight while any action has not ended."""
    every = lambda s: F.bool_and(F.col("state") == s)
    status = F.when(F.bool_or(~F.col("state").isin(*TERMINAL)), "in_flight").when(every("COMMITTED"), "committed").when(every("COMPENSATED"), "compensated").otherwise("mixed")
    return actions.groupBy("saga_id").agg(status.alias("status"), F.count("*").alias("n_actions"))


def transitions(events: DataFrame) -> DataFrame:
    """Each event with the one before it in its action."""
    w = Window.partitionBy("action_id").orderBy("seq")
    return events.select("action_id", "seq", F.lag("event").over(w).alias("before"), "event")


def transition_violations(events: DataFrame) -> DataFrame:
    legal = None
    for before, event in FOLLOWS:
        one = (F.col("before").isNull() if before is None else F.col("before") == before) & (F.col("event") == event)
        legal = one if legal is None else legal | one
    return transitions(events).where(~F.coalesce(legal, F.lit(False)))


def recovery_steps(actions: DataFrame) -> DataFrame:
    step = None
    for state, what in NEXT_STEP.items():
        step = F.when(F.col("state") == state, what) if step is None else step.when(F.col("state") == state, what)
    return in_flight(actions).select("saga_id", "action_id", "state", step.alias("next_step"))


def compensation_order(events: DataFrame) -> DataFrame:
    """Committed actions of each saga, newest commit first."""
    commits = events.where(F.col("event") == "COMMITTED").groupBy("saga_id", "action_id").agg(F.min("seq").alias("commit_seq"))
    w = Window.partitionBy("saga_id").orderBy(F.col("commit_seq").desc(), "action_id")
    return commits.withColumn("step", F.row_number().over(w))


def timelines(events: DataFrame, payload: bool = False) -> DataFrame:
    """One row an action: its events in order."""
    one = F.struct("seq", "event", "at", *(["payload"] if payload else []))
    return events.groupBy("saga_id", "action_id").agg(F.sort_array(F.collect_list(one)).alias("timeline"))


def vendor_counts(rows: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows and ledger actions of each vendor, 0 where one side has none."""
    a = rows.groupBy("vendor").agg(F.count("*").alias("vendor_rows"))
    b = staged.groupBy("vendor").agg(F.count("*").alias("ledger_actions"))
    return a.join(b, "vendor", "full_outer").select("vendor", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("vendor_rows", "ledger_actions")))


def settle(actions: DataFrame, world: DataFrame, most_attempts: int = 2) -> DataFrame:
    """What follows for actions that were called but not committed, from a snapshot of the world (action_id, landed): commit what
    landed, call again what didn't while attempts are left, abort it otherwise, and park what the world says nothing of."""
    open_ = actions.where(F.col("state").isin("CALLED", "RECONCILED")).join(world, "action_id", "left")
    step = F.when(F.col("landed").isNull(), "park").when(F.col("landed"), "commit").when(F.col("attempts") < most_attempts, "call").otherwise("abort")
    return open_.select("saga_id", "action_id", "state", "attempts", "landed", step.alias("settlement"))


def saga_receipts(events: DataFrame) -> DataFrame:
    """Each saga's status, with its actions, their states and their events in order."""
    actions = fold(events)
    each = actions.join(timelines(events), ["saga_id", "action_id"]).groupBy("saga_id").agg(F.sort_array(F.collect_list(F.struct("first_seq", "action_id", "state", "timeline"))).alias("actions"))
    return saga_status(actions).join(each, "saga_id")


def findings_report(findings: DataFrame, vendor: str | None = None) -> DataFrame:
    """Findings (kind, subject, twin, vendor), those of one vendor if asked, in a compact form: kind, subject, evidence."""
    own = findings if vendor is None else findings.where(F.col("vendor") == vendor)
    return own.select("kind", "subject", F.array_compact(F.array("subject", "twin")).alias("evidence"))


def reconcile(actions: DataFrame, rows: DataFrame, order: str = "key") -> DataFrame:
    """Findings (kind, subject, twin) of actions (action_id, state) against vendor rows (key, vendor, item).

    Rows without an action duplicate a known row of their vendor and item (the
    last by `order`, a column of rows), or are shadows. Compensated actions whose row is
    still there are phantoms. Actions that haven't ended, or were aborted, are wedged.
    """
    ids = actions.select(F.col("action_id").alias("key"))
    known, unknown = rows.join(ids, "key", "left_semi"), rows.join(ids, "key", "left_anti")
    twins = known.groupBy("vendor", "item").agg(F.max_by("key", order).alias("twin"))
    extra = unknown.join(twins, ["vendor", "item"], "left").select(F.when(F.col("twin").isNull(), "SHADOW_EFFECT").otherwise("DUPLICATE_CHARGE").alias("kind"), F.col("key").alias("subject"), "twin")
    none = F.lit(None).cast("string").alias("twin")
    phantom = actions.where("state = 'COMPENSATED'").join(rows.select(F.col("key").alias("action_id")), "action_id", "left_semi")
    wedged = actions.where(~F.col("state").isin(*TERMINAL) | (F.col("state") == "ABORTED"))
    return extra.unionByName(phantom.select(F.lit("PHANTOM_COMPENSATION").alias("kind"), F.col("action_id").alias("subject"), none)).unionByName(wedged.select(F.lit("WEDGED_SAGA").alias("kind"), F.col("action_id").alias("subject"), none))


def sequence_gaps(rows: DataFrame, key: str, number: str, start: int = 1) -> DataFrame:
    """Rows whose number isn't their place within the key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(number)) + (start - 1)
    return rows.select(key, number, place.alias("place")).where(F.col(number) != F.col("place"))


def spread_times(events: DataFrame, first: Column, last: Column) -> DataFrame:
    """Times laid evenly from first to last by seq, as imported histories have them. One aggregate gives the ends of seq."""
    low, high = events.agg(F.min("seq"), F.max("seq")).first()
    share = (F.col("seq") - F.lit(low)) / F.lit(max((high or 0) - (low or 0), 1))
    # whole milliseconds before they are added: a double of today's size has few digits left behind the point, and would round up
    return events.withColumn("at", F.timestamp_millis(F.unix_millis(first) + F.floor(share * (F.unix_millis(last) - F.unix_millis(first)))))
