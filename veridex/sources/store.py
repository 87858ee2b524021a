"""Stored audits and ledgers as Parquet folders: appends with sequence numbers, upserts, whole audits, deletes.

Rows lie in `SLOTS` folders by a hash of their audit, so that a change rewrites
the slots of the audits it touches and nothing else, and no audit has a folder
of its own. New states are computed from the old (operators/storage) and written
to the checkpoint folder before their slot is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import storage as S
from ..operators.graph import kept
from ..operators.receipt import canonical_json

SLOTS = 64
# Tables of a store; children have an id, a position and a JSON payload.
RECORDS, CHILDREN = "audit_id string, status string, error string, document string, updated_at timestamp, version long", "audit_id string, id string, position long, payload string"
EVENTS, RESULTS = "audit_id string, seq long, type string, claim_id string, detail string, at timestamp", "audit_id string, result string"
TABLES = {"records": RECORDS, "claims": CHILDREN, "sources": CHILDREN, "evidence": CHILDREN, "events": EVENTS, "results": RESULTS}
#: Columns that only labelled fixtures have; live input must not have them.
LABELS = ("stance", "relates_to", "relevance")


class MissingAudit(LookupError):
    pass


def slot_of(audit_id: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(audit_id), F.lit(slots)).cast("int")


class AuditStore:
    """Audits in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, slots: int = SLOTS):
        self.spark, self.folder, self.slots = spark, folder.rstrip("/"), slots

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _there(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(path) and len(fs.listStatus(path)) > 0

    def table(self, name: str) -> DataFrame:
        schema = f"{TABLES[name]}, slot int"
        if not self._there(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name))

    def _slotted(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("slot", slot_of(F.col("audit_id"), self.slots))

    def _touched(self, name: str, rows: DataFrame) -> DataFrame:
        """The stored rows of the slots that rows (with slot) lie in."""
        return self.table(name).join(F.broadcast(rows.select("slot").distinct()), "slot", "left_semi")  # at most SLOTS rows

    def _replace(self, name: str, new: DataFrame) -> None:
        """new holds all rows of its slots from now on."""
        columns = [c.split(" ")[0] for c in TABLES[name].split(", ")]
        kept(new.select(*columns, "slot")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(self._path(name))

    def create(self, records: DataFrame) -> None:
        """Records (audit_id, status, error, document, updated_at, version) as new versions; nothing is overwritten."""
        self._slotted(records).write.mode("append").partitionBy("slot").parquet(self._path("records"))

    update = create

    def records(self) -> DataFrame:
        """The last version of each record."""
        return S.latest(self.table("records").drop("slot"), ["audit_id"], F.struct("version", "updated_at"))

    def require(self, audit_id: str) -> DataFrame:
        """The record of an audit; MissingAudit if there is none. Only its slot is read."""
        own = self.table("records").where((F.col("slot") == slot_of(F.lit(audit_id), self.slots)) & (F.col("audit_id") == audit_id)).drop("slot")
        found = S.latest(own, ["audit_id"], F.struct("version", "updated_at"))
        if not found.limit(1).count():
            raise MissingAudit(f"audit {audit_id} not found")
        return found

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Children (audit_id, id, position, payload): known ids keep their position, new ones follow."""
        new = self._slotted(rows)
        old = self._touched(name, new)
        state = S.ordered_upsert(old.select("audit_id", "id", "position", "payload"), rows, "audit_id", "id")
        self._replace(name, self._slotted(state))

    def append_events(self, rows: DataFrame) -> None:
        """Events with their seq: those that are stored already are left out; another payload for a stored seq is an error."""
        new = self._slotted(rows)
        old = self._touched("events", new)
        if S.append_conflicts(old, rows, ["audit_id", "seq"], "detail").limit(1).count():
            raise ValueError("a stored event has another payload")
        fresh = new.join(old.select("audit_id", "seq"), ["audit_id", "seq"], "left_anti")
        kept(fresh).write.mode("append").partitionBy("slot").parquet(self._path("events"))

    def save_results(self, results: DataFrame) -> None:
        """Results (audit_id, result) whose JSON has a canonical form; others are an error."""
        canonical = results.withColumn("again", canonical_json(F.col("result")))
        if canonical.where("again is null").limit(1).count():
            raise ValueError("a result isn't JSON that can be read back")
        new = self._slotted(canonical.select("audit_id", F.col("again").alias("result")))
        self._replace("results", S.replace(self._touched("results", new).select("audit_id", "result", "slot"), new.select("audit_id", "result", "slot"), ["audit_id"]))

    def assembled(self) -> DataFrame:
        """Each audit whole: its record, and its claims, sources and evidence in order, and its events by seq."""
        out = self.records()
        for name in ("claims", "sources", "evidence"):
            rows = self.table(name).groupBy("audit_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "payload"))), lambda x: x["payload"]).alias(name))
            out = out.join(rows, "audit_id", "left")
        events = self.table("events").groupBy("audit_id").agg(F.sort_array(F.collect_list(F.struct("seq", "type", "claim_id", "detail", "at"))).alias("events"))
        return out.join(events, "audit_id", "left").join(self.table("results").drop("slot"), "audit_id", "left")

    def delete(self, audits: DataFrame) -> None:
        """All rows of audits (audit_id), in all tables; a slot that gets empty goes."""
        gone = self._slotted(audits.select("audit_id").distinct())
        for name in TABLES:
            if self._there(name):
                old = self._touched(name, gone)
                left = kept(old.join(gone.select("audit_id"), "audit_id", "left_anti"))
                empty = [r.slot for r in old.select("slot").distinct().join(left.select("slot").distinct(), "slot", "left_anti").collect()]  # at most SLOTS
                self._replace(name, left)
                for slot in empty:
                    self._drop(f"{self._path(name)}/slot={slot}")

    def truncate(self, name: str) -> None:
        self._drop(self._path(name))

    def _drop(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def append_log(spark: SparkSession, folder: str, rows: DataFrame, order: list[str], schema: str) -> int:
    """Appends rows to a log with sequence numbers after its last; that is returned. One writer at a time."""
    try:
        last = spark.read.schema(schema).parquet(folder).agg(F.max("seq")).first()[0] or 0
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        last = 0
    numbered = S.next_sequence(rows, last, order)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    numbered.select(*names).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder).agg(F.max("seq")).first()[0] or 0


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, document) of text files, each whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("document"))


def unlabelled(rows: DataFrame) -> DataFrame:
    """rows, if they have no column that only labelled fixtures have: live audits don't read labels."""
    found = [c for c in LABELS if c in rows.columns]
    if found:
        raise ValueError(f"live input has fixture labels: {', '.join(found)}")
    return rows


def booking(rows: DataFrame, key: str) -> DataFrame:
    """The stored booking of a key (at most one), its item parsed."""
    return bookings(rows).where(F.col("key") == key)


def bookings(rows: DataFrame) -> DataFrame:
    """Bookings (key, vendor, item as JSON, created_at) with their item's fields as a map, by key."""
    return rows.withColumn("fields", F.from_json("item", "map<string,string>")).orderBy("key")


def catalogue(spark: SparkSession) -> DataFrame:
    """What the two vendors sell. Fixed values of our own."""
    rows = [("flights", f"F{100 * k}", f'{{"stops":{k - 1}}}') for k in (1, 2, 3)] + [("hotels", f"H{100 * k}", f'{{"stars":{k + 2}}}') for k in (1, 2, 3)]
    return spark.createDataFrame(rows, "vendor string, id string, item string")


def seeded_history(spark: SparkSession, n_sagas: int = 40) -> tuple[DataFrame, DataFrame]:
    """(events, vendor rows) of a made-up past with five planted breaks: two shadow bookings, a duplicate, a phantom, a wedged action.

    Each saga books a flight, a hotel and, two times in three, a calendar entry; every eighth is cancelled, newest commit first.
    All is arithmetic on the saga's number, so a history of any size is one plan and always the same."""
    n = F.col("saga")
    types = F.array(*[F.struct(F.lit(i).alias("leg"), F.lit(v).alias("vendor")) for i, v in enumerate(("flights", "hotels", "calendar"))])
    legs = spark.range(n_sagas).select(F.col("id").alias("saga")).withColumn("x", F.explode(types)).select("saga", "x.*").where((F.col("leg") < 2) | (F.pmod(F.xxhash64("saga"), F.lit(3)) > 0))
    action = F.concat(F.lit("a"), F.substring(F.sha2(F.concat_ws("-", n.cast("string"), "vendor"), 256), 1, 25))
    item = F.to_json(F.struct(F.concat(F.upper(F.substring("vendor", 1, 1)), (F.pmod(F.xxhash64("saga", "leg"), F.lit(3)) + 1).cast("string"), F.lit("00")).alias("id"), n.alias("trip")))
    a = legs.select("saga", "leg", "vendor", action.alias("action_id"), item.alias("item"), (n % 8 == 7).alias("cancelled"))
    steps = [F.struct(F.lit(k).alias("k"), F.lit(e).alias("event")) for k, e in enumerate(("STAGED", "CALLED", "RECONCILED", "COMMITTED", "COMPENSATION_CALLED", "COMPENSATED"))]
    each = a.withColumn("s", F.explode(F.array(*steps))).where(F.col("cancelled") | (F.col("s.k") < 4))
    # staged first, then leg by leg; cancellation goes back from the last leg
    turn = F.when(F.col("s.k") == 0, F.col("leg")).when(F.col("s.k") < 4, 3 + F.col("leg") * 3 + F.col("s.k")).otherwise(20 + (2 - F.col("leg")) * 2 + F.col("s.k"))
    payload = F.when(F.col("s.k") == 0, F.to_json(F.struct("vendor", "item")))
    name = F.concat(F.lit("hist-"), F.lpad((n + 1).cast("string"), 6, "0"))
    events = each.select((n * 40 + turn + 1).cast("long").alias("seq"), name.alias("saga_id"), "action_id", F.col("s.event").alias("event"), payload.alias("payload"))
    last = n_sagas * 40
    wedged = spark.createDataFrame([(last + 1, "hist-wedged", "wedged", "STAGED", '{"vendor":"hotels"}'), (last + 2, "hist-wedged", "wedged", "CALLED", None)], events.schema)
    span = F.lit(1781136000.0) + F.col("seq") / F.lit(last + 2.0) * F.lit(2505600.0)
    events = events.unionByName(wedged).withColumn("at", F.timestamp_millis((span * 1000).cast("long")))
    rows = a.where("not cancelled").select(F.col("action_id").alias("key"), "vendor", "item")
    twin = a.where("vendor = 'hotels' and saga = 0").select(F.lit("duplicate").alias("key"), "vendor", "item")
    ghost = a.where("vendor = 'hotels' and saga = 7").select(F.col("action_id").alias("key"), "vendor", F.lit('{"id":"H900"}').alias("item"))
    shadows = spark.createDataFrame([("shadow-1", "hotels", '{"id":"H901"}'), ("shadow-2", "hotels", '{"id":"H902"}')], "key string, vendor string, item string")
    return events, rows.unionByName(twin).unionByName(ghost).unionByName(shadows)
