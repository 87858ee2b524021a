"""Queries of what happens over time: audits as streams, sagas driven to their end, admitted calls, redirects, with their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import assembly as RA
from ..operators import budget as BU
from ..operators import mapper as M
from ..operators import redirects as RD
from ..operators import research as RS
from ..operators import saga as SG
from ..operators.graph import shared_folder
from ..sources import adapters as A
from ..streaming import ledger_stream as ST
from ..streaming import lifecycle as LC
from .catalog import LEDGER
from .registry import query

# ---- streams -------------------------------------------------------------------

CHUNKS = 6


def _cancelling(ledger):
    """An audit is cancelled where an action of a k of 0 is aborted."""
    return ledger.withColumn("at", F.col("at").cast("timestamp")).withColumn("saga_id", F.col("saga_id").cast("string")).withColumn("event", F.when((F.col("event") == "ABORTED") & F.col("action_id").endswith(":0"), LC.CANCEL).otherwise(F.col("event")))


def _arriving(spark, d, name="arriving"):
    """The ledger as files that come one after the other; a third of the events a file late. The span of a file is returned too."""
    events = _cancelling(A.ledger(spark, d))
    low, high = events.agg(F.min("at"), F.max("at")).first()
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    span = (high - low) / CHUNKS
    ms = F.unix_millis("at") - F.unix_millis(F.lit(low))
    late = (F.pmod(F.xxhash64("seq"), F.lit(3)) == 0).cast("int")
    chunk = F.least(F.floor(ms / (span.total_seconds() * 1000)), F.lit(CHUNKS - 1)) + late
    for k in range(CHUNKS + 1):
        events.where(chunk == k).repartition(F.xxhash64("seq")).sortWithinPartitions(F.xxhash64("seq")).write.mode("append").parquet(folder)
    LC.heartbeat(spark, high + 100 * span, ST.EVENT_SCHEMA).write.mode("append").parquet(folder)
    # half of the files a batch, so that the number of batches doesn't grow with the table
    return ST.tail(spark, folder, files_per_trigger=max(4, -(-len(spark.read.schema(ST.EVENT_SCHEMA).parquet(folder).inputFiles()) // 2))), span


@query(f"""WITH {LEDGER}, e AS (SELECT seq, saga_id, action_id, l."at" AS t, CASE WHEN event = 'ABORTED' AND action_id LIKE '%:0' THEN 'CANCELLED' ELSE event END AS event FROM ledger l),
p AS (SELECT *, lag(t) OVER w AS prev_at, lag(event) OVER w AS prev_event FROM e WINDOW w AS (PARTITION BY saga_id ORDER BY seq)),
s AS (SELECT *, sum(CASE WHEN prev_at IS NULL OR epoch_ms(t) - epoch_ms(prev_at) > 43200000 OR prev_event = 'CANCELLED' THEN 1 ELSE 0 END) OVER (PARTITION BY saga_id ORDER BY seq) AS audit FROM p),
b AS (SELECT *, lag(event) OVER (PARTITION BY saga_id, audit, action_id ORDER BY seq) AS before FROM s WHERE event <> 'CANCELLED'),
a AS (SELECT saga_id, audit, action_id, arg_max(event, seq) AS state FROM s WHERE event <> 'CANCELLED' GROUP BY ALL),
o AS (SELECT saga_id, audit, bool_or(state NOT IN ('COMMITTED', 'COMPENSATED', 'ABORTED')) AS is_open FROM a GROUP BY ALL),
x AS (SELECT saga_id, audit, max(seq) AS seq, arg_max(event, seq) AS last FROM s GROUP BY ALL)
SELECT CAST(saga_id AS VARCHAR) AS saga_id, 'illegal' AS kind, seq, action_id, before, event FROM b WHERE coalesce(before, '') || '>' || event NOT IN ('>STAGED', 'STAGED>CALLED', 'CALLED>RECONCILED', 'CALLED>CALLED', 'RECONCILED>COMMITTED',
  'RECONCILED>CALLED', 'RECONCILED>ABORTED', 'COMMITTED>COMPENSATION_CALLED', 'COMPENSATION_CALLED>COMPENSATED', 'COMPENSATION_CALLED>COMPENSATION_CALLED')
UNION ALL SELECT CAST(saga_id AS VARCHAR), CASE WHEN last = 'CANCELLED' THEN 'cancelled' WHEN is_open THEN 'timed_out' ELSE 'finished' END, x.seq, NULL, NULL, NULL FROM x LEFT JOIN o USING (saga_id, audit)""")
def stream_audit_lifecycle(spark, d):
    """All events as a stream of files out of order: illegal events, and audits that finish, time out after 12 hours or are cancelled."""
    stream, span = _arriving(spark, d)
    return LC.collected(LC.lifecycle(stream, "12 hours", f"{int(2 * span.total_seconds()) + 1} seconds"))[0]


# ---- receipts ------------------------------------------------------------------


@query("""WITH e AS (SELECT *, 'u' || user_id AS audit_id FROM events),
n AS (SELECT *, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS v FROM e),
items AS (SELECT audit_id, event_type, event_id,
  CASE event_type WHEN 'view' THEN '{"query":' || to_json(props)::VARCHAR || ',"sequence":' || event_id || '}'
    WHEN 'click' THEN '{"excerpt":' || to_json(props)::VARCHAR || ',"excerptHash":"' || sha256(props) || '","id":"e' || event_id || '","value":' || v || '}'
    WHEN 'error' THEN '{"reason":null,"sequence":' || event_id || '}' WHEN 'purchase' THEN '"c' || event_id || '"' ELSE '{"kind":"signup"}' END AS item FROM n),
s AS (SELECT audit_id, string_agg(item, ',' ORDER BY 'c' || event_id) FILTER (WHERE event_type = 'purchase') AS approved, string_agg(item, ',' ORDER BY 'e' || event_id) FILTER (WHERE event_type = 'click') AS evidence,
  string_agg(item, ',' ORDER BY event_id) FILTER (WHERE event_type = 'error') AS failures, string_agg(item, ',' ORDER BY event_id) FILTER (WHERE event_type = 'signup') AS safety,
  string_agg(item, ',' ORDER BY event_id) FILTER (WHERE event_type = 'view') AS searches, count(*) AS n_items, CAST(substr(audit_id, 2) AS BIGINT) AS u FROM items GROUP BY audit_id),
b AS (SELECT audit_id, n_items, '{"approvedChangeIds":[' || coalesce(approved, '') || '],"auditId":"' || audit_id || '","documentHash":"' || sha256('document ' || u) || '","evidence":[' || coalesce(evidence, '')
  || '],"failures":[' || coalesce(failures, '') || '],"mode":"' || ['quick', 'deep', 'high_stakes'][u % 3 + 1] || '","modelId":null,"promptVersions":{"citation":"2","mapper":"1"},"safetyEvents":[' || coalesce(safety, '')
  || '],"searches":[' || coalesce(searches, '') || '],"startedAt":"2024-01-01T00:00:00.000Z","verdicts":[]}' AS body FROM s)
SELECT audit_id, n_items, CAST(strlen(body) AS BIGINT) AS n_bytes, sha256(body) AS receipt_hash FROM b""")
def receipt_built(spark, d):
    """An audit for each user: receipts written from six relations of events."""
    audit, text = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_id").cast("string")
    e = A.table(spark, d, "events").withColumn("audit_id", audit)
    of = lambda kind: e.where(F.col("event_type") == kind)
    mode = F.element_at(F.array(*map(F.lit, ("quick", "deep", "high_stakes"))), (F.col("user_id") % 3 + 1).cast("int"))
    audits = e.groupBy("audit_id", "user_id").agg(F.count("*")).select(
        "audit_id", F.col("audit_id").alias("auditId"), F.sha2(F.concat(F.lit("document "), F.col("user_id").cast("string")), 256).alias("documentHash"), mode.alias("mode"),
        F.lit(None).cast("string").alias("modelId"), F.struct(F.lit("1").alias("mapper"), F.lit("2").alias("citation")).alias("promptVersions"), F.lit("2024-01-01T00:00:00.000Z").alias("startedAt"),
    )
    e_id, sequence = F.concat(F.lit("e"), text), F.col("event_id").alias("sequence")
    return RA.built(audits, {
        "searches": RA.Section(of("view"), F.struct(sequence, F.col("props").alias("query")), number=F.col("event_id")),
        "evidence": RA.Section(of("click"), F.struct(e_id.alias("id"), F.col("props").alias("excerpt"), F.sha2("props", 256).alias("excerptHash"), "value"), name=e_id),
        "failures": RA.Section(of("error"), F.struct(sequence, F.lit(None).cast("string").alias("reason")), number=F.col("event_id")),
        "safetyEvents": RA.Section(of("signup"), F.struct(F.lit("signup").alias("kind"), F.lit(None).cast("string").alias("note")), number=F.col("event_id"), nulls=False),
        "approvedChangeIds": RA.Section(of("purchase"), F.concat(F.lit("c"), text), name=F.concat(F.lit("c"), text)),
        "verdicts": RA.Section(of("none"), F.lit(0)),
    })


# ---- sagas -----------------------------------------------------------------------

#: A saga for each order, an action for each of its lines, with a history by supplier; the world's answer is by a hash of action, step and attempt.
LINES = """line AS (SELECT l_orderkey AS saga_id, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS action_id, min(l_suppkey % 5) AS past, min(l_linenumber) AS n FROM lineitem GROUP BY ALL),
world AS (SELECT *, CAST('0x' || substr(md5(action_id || 'call1'), 1, 2) AS BIGINT) AS c1, CAST('0x' || substr(md5(action_id || 'call2'), 1, 2) AS BIGINT) AS c2,
  CAST('0x' || substr(md5(action_id || 'reconcile1'), 1, 2) AS BIGINT) AS r1, CAST('0x' || substr(md5(action_id || 'compensate'), 1, 2) AS BIGINT) AS u FROM line)"""


def _history(spark, d):
    """STAGED; also CALLED; also RECONCILED; also COMMITTED; or under compensation: by supplier."""
    t = A.table(spark, d, "lineitem")
    action = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = t.groupBy(F.col("l_orderkey").alias("saga_id"), action.alias("action_id")).agg(F.min(F.col("l_suppkey") % 5).alias("past"), F.min("l_linenumber").alias("n"))
    words = F.array(*map(F.lit, ("STAGED", "CALLED", "RECONCILED", "COMMITTED", "COMPENSATION_CALLED")))
    each = lines.select("saga_id", "action_id", "n", F.posexplode(F.slice(words, F.lit(1), (F.col("past") + 1).cast("int"))).alias("k", "event"))
    return each.select((F.col("n") * 10 + F.col("k")).cast("bigint").alias("seq"), "saga_id", "action_id", "event", F.lit(None).cast("string").alias("payload"))


def _world(commands):
    """landed if the byte is below 128, not if below 240, else nothing is said; a compensation fails for bytes divisible by 16."""
    compensating = F.col("step") == "compensate"
    said = F.concat("action_id", "step", F.when(compensating, F.lit("")).otherwise(F.col("attempt").cast("string")))
    byte = F.conv(F.substring(F.md5(said), 1, 2), 16, 10).cast("int")
    landed = F.when(compensating, F.when(byte >= 240, None).otherwise(byte >= 200)).otherwise(F.when(byte >= 240, None).otherwise(byte < 128))
    return commands.select("action_id", landed.alias("landed"), F.when(compensating & (byte % 16 == 0), "refused").alias("error"))


@query(f"""WITH RECURSIVE {LINES},
steps AS (
  SELECT saga_id, action_id, n, u, 1 AS turn, CASE WHEN past = 0 THEN 0 WHEN past < 3 THEN 1 ELSE 9 END AS attempts, ['STAGED', 'CALLED', 'RECONCILED', 'COMMITTED', 'COMPENSATION_CALLED'][past + 1] AS state,
    past IN (1, 2) AS ask_first, past >= 3 AS ended, false AS parked, c1, c2, r1, NULL::INTEGER AS commit_turn FROM world
  UNION ALL
  SELECT saga_id, action_id, n, u, turn + 1, CASE WHEN ask_first THEN attempts ELSE attempts + 1 END,
    CASE WHEN b >= 240 THEN CASE WHEN ask_first THEN state ELSE 'CALLED' END WHEN b < 128 THEN 'COMMITTED' WHEN CASE WHEN ask_first THEN attempts ELSE attempts + 1 END >= 2 THEN 'ABORTED' ELSE 'RECONCILED' END,
    false, b >= 240 OR b < 128 OR CASE WHEN ask_first THEN attempts ELSE attempts + 1 END >= 2, b >= 240, c1, c2, r1, CASE WHEN b < 128 THEN turn END
  FROM (SELECT *, CASE WHEN ask_first THEN r1 WHEN attempts = 0 THEN c1 ELSE c2 END AS b FROM steps) WHERE NOT ended
),
over AS (SELECT * FROM steps WHERE ended),
undo AS (SELECT *, CASE WHEN u % 16 = 0 OR u >= 200 THEN 1 ELSE 0 END AS stuck FROM over WHERE state IN ('COMMITTED', 'COMPENSATION_CALLED') AND saga_id % 2 = 0),
placed AS (SELECT *, coalesce(sum(stuck) OVER (PARTITION BY saga_id ORDER BY commit_turn DESC NULLS LAST, CASE WHEN commit_turn IS NULL THEN n * 10 + 3 END DESC NULLS LAST, action_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM undo)
SELECT saga_id, action_id, state, parked FROM over WHERE NOT (state IN ('COMMITTED', 'COMPENSATION_CALLED') AND saga_id % 2 = 0)
UNION ALL SELECT saga_id, action_id, CASE WHEN before > 0 THEN state WHEN stuck = 1 THEN 'COMPENSATION_CALLED' ELSE 'COMPENSATED' END, CASE WHEN before > 0 THEN false ELSE stuck = 1 END FROM placed""")
def saga_driven(spark, d):
    """All sagas recovered, and those of even orders undone, newest commit first."""
    events = _history(spark, d)
    done, _ = SG.driven(events, _world, events.where(F.col("saga_id") % 2 == 0))
    return done.select("saga_id", "action_id", "state", F.coalesce("parked", F.lit(False)).alias("parked"))


# ---- budgets -----------------------------------------------------------------------


@query("""WITH c AS (SELECT l_suppkey AS audit_id, ['searches', 'model_calls', 'page_fetches'][l_linenumber % 3 + 1] AS resource, l_orderkey, l_linenumber, l_partkey, max(CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END) AS attempts FROM lineitem GROUP BY ALL),
r AS (SELECT *, CAST(coalesce(sum(attempts) OVER (PARTITION BY audit_id, resource ORDER BY l_orderkey, l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
  CASE resource WHEN 'searches' THEN [16, 64, 144] WHEN 'model_calls' THEN [100, 400, 900] ELSE [32, 128, 288] END[audit_id % 3 + 1] AS allowed FROM c),
a AS (SELECT *, CAST(greatest(0, least(attempts, allowed - before)) AS BIGINT) AS admitted FROM r)
SELECT audit_id, resource, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, before, admitted, CASE WHEN admitted = attempts THEN 'admitted' WHEN admitted > 0 THEN 'cut' ELSE 'refused' END AS outcome FROM a""")
def budget_admission(spark, d):
    """Calls of three kinds, an audit for each supplier: what its mode's limits let through, in order."""
    kinds = F.array(*map(F.lit, ("searches", "model_calls", "page_fetches")))
    t = A.table(spark, d, "lineitem").withColumn("resource", F.element_at(kinds, (F.col("l_linenumber") % 3 + 1).cast("int")))
    calls = t.groupBy(F.col("l_suppkey").alias("audit_id"), "resource", "l_orderkey", "l_linenumber", "l_partkey").agg(F.max(F.when(F.col("l_quantity") > 25, 2).otherwise(1)).alias("attempts"))
    mode = F.element_at(F.array(*map(F.lit, RS.LIMITS)), (F.col("audit_id") % 3 + 1).cast("int"))
    allowed = F.coalesce(*[F.when(F.col("resource") == r, RS.by_mode(mode, k, RS.LIMITS)) for k, r in enumerate(RS.RESOURCES)])
    out = BU.admitted(calls, allowed, ["l_orderkey", "l_linenumber", "l_partkey"])
    return out.select("audit_id", "resource", "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.col("before").cast("bigint").alias("before"), "admitted", "outcome")


# ---- claims ------------------------------------------------------------------------

#: Ten raw claims of each document (thirteen of every fiftieth): spans that overlap, repeat, or stand elsewhere first; two that aren't there.
RAW = """raw AS (SELECT doc_id, text, i, CASE WHEN i = 4 THEN 'never ' || doc_id ELSE substr(text, CAST((doc_id * 7 + i * i * 13) % greatest(length(text) - 20, 1) + 1 AS BIGINT), CAST(9 + (i * 5) % 20 AS BIGINT)) END AS q,
  CASE WHEN i % 3 = 0 THEN '' WHEN i = 8 THEN 'same' WHEN i = 7 THEN 'same' ELSE 'n' || i || ' ' || doc_id END AS nrm, CASE WHEN i % 2 = 0 THEN 'event' ELSE 'rumour' END AS kind, CASE WHEN i % 4 = 0 THEN 'high' WHEN i % 4 = 1 THEN 'grave' END AS risk
  FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN doc_id % 50 = 49 THEN 13 ELSE 10 END)) AS i FROM documents WHERE text <> ''))"""


@query(f"""WITH RECURSIVE {RAW},
loc AS (SELECT *, strpos(text, q) - 1 AS s, strpos(text, q) - 1 + length(q) AS e, 'claim_' || substr(sha256(CASE WHEN nrm = '' THEN q ELSE nrm END), 1, 16) AS id FROM raw WHERE doc_id NOT IN (SELECT doc_id FROM raw WHERE i > 11 OR q = '')),
fold AS (
  SELECT doc_id, 0 AS i, []::STRUCT(i BIGINT, id VARCHAR, s BIGINT, e BIGINT)[] AS taken FROM (SELECT DISTINCT doc_id FROM loc)
  UNION ALL
  SELECT f.doc_id, f.i + 1, CASE WHEN a.s < 0 OR len(list_filter(f.taken, lambda t: t.id = a.id OR (a.s < t.e AND a.e > t.s))) > 0 THEN f.taken ELSE list_append(f.taken, {{'i': a.i, 'id': a.id, 's': a.s, 'e': a.e}}) END
  FROM fold f JOIN loc a ON a.doc_id = f.doc_id AND a.i = f.i
),
ends AS (SELECT doc_id, unnest(taken) AS t FROM fold WHERE i = 10)
SELECT a.doc_id, a.id AS claim_id, a.s AS start, a.e AS finish, CASE WHEN nrm = '' THEN lower(q) ELSE nrm END AS normalized, CASE kind WHEN 'event' THEN 'event' ELSE 'general' END AS claim_type, CASE risk WHEN 'high' THEN 'high' ELSE 'medium' END AS risk
FROM ends JOIN loc a ON a.doc_id = ends.doc_id AND a.i = t.i""")
def claims_assembled(spark, d):
    """Model-like answers over whole documents, located and thinned to claims that don't overlap."""
    docs = A.table(spark, d, "documents").where("text <> ''").select("doc_id", F.col("text").alias("document"))

    def one(i):
        place = (F.col("doc_id") * 7 + i * i * 13) % F.greatest(F.length("document") - 20, F.lit(1)) + 1
        text = F.when(i == 4, F.concat(F.lit("never "), F.col("doc_id").cast("string"))).otherwise(F.substr(F.col("document"), place.cast("int"), (9 + (i * 5) % 20).cast("int")))
        normalized = F.when(i % 3 == 0, "").when(i.isin(7, 8), "same").otherwise(F.concat(F.lit("n"), i.cast("string"), F.lit(" "), F.col("doc_id").cast("string")))
        return F.struct(
            text.alias("original_text"), normalized.alias("normalized"), F.when(i % 2 == 0, "event").otherwise("rumour").alias("claim_type"), F.lit(True).alias("verifiable"),
            F.lit(None).cast("boolean").alias("time_sensitive"), F.when(i % 4 == 0, "high").when(i % 4 == 1, "grave").alias("risk"), F.lit(None).cast("string").alias("as_of"),
        )

    raw = docs.withColumn("claims", F.transform(F.sequence(F.lit(0), F.when(F.col("doc_id") % 50 == 49, 12).otherwise(9)), one))
    claims, _ = M.assembled(raw, "doc_id")
    return claims.select("doc_id", "claim_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("finish"), "normalized", "claim_type", "risk")


# ---- redirects -----------------------------------------------------------------------

#: Pages by their number: short chains, a chain of nine, loops, an unsafe target, a wrong type, one too large.
SENT = """sent AS (SELECT page_id, 'https://site.example/' || page_id AS url, CASE
    WHEN page_id % 100 BETWEEN 10 AND 18 OR page_id % 10 < 4 THEN 'https://site.example/' || (page_id + 1) WHEN page_id % 100 = 55 THEN 'http://localhost/x' WHEN page_id % 10 = 5 THEN 'https://site.example/' || page_id
    WHEN page_id % 10 = 6 THEN 'https://site.example/' || (page_id + 1) WHEN page_id % 10 = 7 THEN 'https://site.example/' || (page_id - 1) END AS location,
  CASE WHEN page_id % 10 = 8 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type, strlen(html) + CASE WHEN page_id % 10 = 9 THEN 3000000 ELSE 0 END AS n_bytes FROM pages)"""


@query(f"""WITH RECURSIVE {SENT},
walk AS (
  SELECT url AS start, url AS here, [url] AS path, 0 AS hops, NULL::VARCHAR AS error, false AS ended FROM sent
  UNION ALL
  SELECT start, CASE WHEN s.location IS NULL OR problem IS NOT NULL THEN here ELSE s.location END, list_append(path, s.location), CASE WHEN s.location IS NULL OR problem IS NOT NULL THEN hops ELSE hops + 1 END,
    CASE WHEN s.url IS NULL THEN 'no response' WHEN s.location IS NOT NULL THEN problem WHEN s.content_type = 'application/pdf' THEN 'unsupported content type application/pdf' WHEN s.n_bytes > 2000000 THEN 'response too large' END,
    s.location IS NULL OR problem IS NOT NULL
  FROM (SELECT w.*, CASE WHEN w.hops >= 5 THEN 'too many redirects' WHEN t.location LIKE 'http://localhost%' THEN 'blocked host' WHEN list_contains(w.path, t.location) THEN 'redirect loop' END AS problem FROM walk w LEFT JOIN sent t ON t.url = w.here WHERE NOT w.ended) w
  LEFT JOIN sent s ON s.url = w.here
)
SELECT start AS url, here AS final_url, CAST(hops AS BIGINT) AS hops, error FROM walk WHERE ended""")
def page_redirects(spark, d):
    """Every page asked for, through the redirects planted among them."""
    n = F.col("page_id")
    to = lambda k: F.concat(F.lit("https://site.example/"), (n + k).cast("string"))
    location = (
        F.when((n % 100).between(10, 18) | (n % 10 < 4), to(1)).when(n % 100 == 55, "http://localhost/x").when(n % 10 == 5, to(0)).when(n % 10 == 6, to(1)).when(n % 10 == 7, to(-1))
    )
    kind = F.when(n % 10 == 8, "application/pdf").otherwise("text/html; charset=utf-8")
    responses = A.table(spark, d, "pages").select(
        to(0).alias("url"), F.when(location.isNull(), 200).otherwise(302).alias("status"), location.alias("location"), kind.alias("content_type"),
        (F.octet_length("html") + F.when(n % 10 == 9, 3_000_000).otherwise(0)).alias("n_bytes"),
    )
    return RD.followed(responses, responses).withColumn("hops", F.col("hops").cast("bigint"))
