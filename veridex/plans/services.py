"""Queries of what an audit service takes in and stores: requests, status changes, searches, with their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intake as IN
from ..operators import updates as UP
from ..operators.graph import shared_folder
from ..sources import adapters as A
from ..sources import search as SE
from .registry import query

# ---- status changes ----------------------------------------------------------------

#: Clients of an audit for each user: most see the last version; one in ten of an audit's updates is late by one and loses; each tenth
#: user's see whatever came last, accepted or not. Errors ask to begin anew in mid-audit;
#: the audits of another tenth are completed, which ends them for good.
CLIENTS = """e AS (SELECT user_id AS audit_id, event_id AS version, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
p AS (SELECT *, k % 10 = 4 OR (event_type = 'error' AND k % 10 = 5) AS odd, CASE WHEN event_type = 'error' AND k % 10 = 5 THEN 'created' WHEN k % 10 = 1 THEN 'created' WHEN k % 10 = 0 THEN CASE WHEN audit_id % 10 = 1 AND k > 30 THEN 'completed' WHEN event_type = 'view' THEN 'failed' WHEN event_type = 'click' THEN 'cancelled' ELSE 'partially_completed' END
  ELSE ['mapping_claims', 'planning_research', 'researching_support', 'researching_counterevidence', 'validating_evidence', 'arbitrating', 'generating_revision', 'validating_numeric'][k % 10 - 1] END AS status FROM e),
a AS (SELECT *, last_value(CASE WHEN NOT odd THEN version END IGNORE NULLS) OVER (PARTITION BY audit_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS good, lag(version) OVER (PARTITION BY audit_id ORDER BY k) AS prev FROM p),
u AS (SELECT *, CASE WHEN audit_id % 10 = 0 THEN prev WHEN k % 10 = 4 THEN last_value(CASE WHEN NOT odd THEN good END IGNORE NULLS) OVER (PARTITION BY audit_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE good END AS seen FROM a)"""


@query(f"""WITH RECURSIVE {CLIENTS},
walk AS (
  SELECT audit_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS version, CAST(NULL AS BIGINT) AS seen, CAST(NULL AS VARCHAR) AS asked, CAST(NULL AS BIGINT) AS current, CAST(NULL AS VARCHAR) AS status, '' AS outcome FROM (SELECT DISTINCT audit_id FROM u)
  UNION ALL
  SELECT audit_id, k, version, seen, asked, CASE outcome WHEN 'accepted' THEN version ELSE current END, CASE outcome WHEN 'accepted' THEN asked ELSE status END, outcome FROM (
    SELECT u.audit_id, u.k, u.version, u.seen, u.status AS asked, w.current, w.status, CASE WHEN u.seen IS DISTINCT FROM w.current THEN 'lost'
      WHEN CASE WHEN u.status = 'created' THEN w.status IS NULL OR w.status IN ('partially_completed', 'failed', 'cancelled') ELSE w.status NOT IN ('completed', 'partially_completed', 'failed', 'cancelled') END THEN 'accepted' ELSE 'illegal' END AS outcome
    FROM walk w JOIN u ON u.audit_id = w.audit_id AND u.k = w.k + 1)
)
SELECT audit_id, version, seen, asked AS status, outcome FROM walk WHERE k > 0""")
def audit_updates(spark, d):
    """Every event as a change of its user's audit, under the version that its client saw."""
    rows = Window.partitionBy("audit_id").orderBy("version")
    past = rows.rowsBetween(Window.unboundedPreceding, -1)
    k = F.col("k") % 10
    stages = ("mapping_claims", "planning_research", "researching_support", "researching_counterevidence", "validating_evidence", "arbitrating", "generating_revision", "validating_numeric")
    restart = (F.col("event_type") == "error") & (k == 5)
    end = F.when((F.col("audit_id") % 10 == 1) & (F.col("k") > 30), "completed").when(F.col("event_type") == "view", "failed").when(F.col("event_type") == "click", "cancelled").otherwise("partially_completed")
    e = A.table(spark, d, "events").select(F.col("user_id").alias("audit_id"), F.col("event_id").alias("version"), "event_type").withColumn("k", F.row_number().over(rows))
    status = F.when(restart | (k == 1), "created").when(k == 0, end).otherwise(F.get(F.array(*map(F.lit, stages)), k - 2))
    late = k == 4
    e = e.withColumn("status", status).withColumn("odd", late | restart)
    e = e.withColumn("good", F.last(F.when(~F.col("odd"), F.col("version")), True).over(past)).withColumn("prev", F.lag("version").over(rows))
    before = F.last(F.when(~F.col("odd"), F.col("good")), True).over(past)
    seen = F.when(F.col("audit_id") % 10 == 0, F.col("prev")).when(late, before).otherwise(F.col("good"))
    return UP.decided(e.withColumn("seen", seen).select("audit_id", "version", "seen", "status"))


# ---- requests ------------------------------------------------------------------------

SENT = """doc AS (SELECT doc_id, doc_id % 16 AS k, coalesce(text, '') AS text FROM documents),
plain AS (SELECT *, CASE WHEN k = 2 THEN '{"document":' || to_json(text) || '}' WHEN k = 7 THEN '{"document":7,"mode":"quick"}' WHEN k = 8 THEN '{"document":" \\n ","mode":"quick"}' WHEN k = 14 THEN '{"mode":"quick"}'
  ELSE '{"document":' || to_json(text) || ',"mode":"' || CASE k WHEN 0 THEN 'deep' WHEN 3 THEN 'fast' ELSE 'quick' END || '"' || CASE WHEN k = 6 THEN ',"force":true}' ELSE '}' END END AS whole FROM doc),
sent AS (SELECT doc_id, CASE k WHEN 4 THEN substr(whole, 1, length(whole) - 1) WHEN 5 THEN '[' || whole || ']' WHEN 9 THEN '' WHEN 10 THEN whole || ' x' WHEN 13 THEN 'null' ELSE whole END AS body,
  CASE k WHEN 11 THEN 'text/plain' WHEN 12 THEN 'Application/JSON; charset=utf-8' ELSE 'application/json' END AS content_type, CASE WHEN k = 15 THEN 300000 END AS declared FROM plain),
ends AS (SELECT *, lower(trim(split_part(content_type, ';', 1))) AS media, greatest(strlen(body), coalesce(declared, 0)) AS n, json_valid(body) AND body <> '' AS ok, unnest(['service', 'public']) AS endpoint FROM sent),
read AS (SELECT *, CASE WHEN ok THEN json_type(body) END AS kind, CASE WHEN ok AND json_type(body) = 'OBJECT' THEN json_keys(body) END AS names, CASE WHEN ok THEN json_type(body, '$.document') END AS doc_kind,
  CASE WHEN ok THEN json_extract_string(body, '$.document') END AS document, CASE WHEN ok THEN json_extract_string(body, '$.mode') END AS mode FROM ends),
judged AS (SELECT *, CASE WHEN media <> 'application/json' THEN '415 content-type must be application/json' WHEN endpoint = 'service' AND n > 200000 THEN '413 request body exceeds 200000 bytes' WHEN endpoint = 'public' AND n > 13000 THEN '413 request body is too large'
  WHEN endpoint = 'service' AND body = '' THEN '400 request body must contain JSON' WHEN NOT ok THEN '400 request body contains invalid JSON' WHEN kind <> 'OBJECT' THEN '400 request body must be a JSON object'
  WHEN len(list_filter(names, lambda x: x NOT IN ('document', 'mode'))) > 0 THEN '400 unsupported field: ' || list_filter(names, lambda x: x NOT IN ('document', 'mode'))[1]
  WHEN doc_kind IS DISTINCT FROM 'VARCHAR' OR regexp_full_match(document, '\\s*') THEN '400 document must be a non-empty string' WHEN endpoint = 'public' AND strlen(document) > 12000 THEN '413 document exceeds 12000 bytes'
  WHEN endpoint = 'service' AND coalesce(mode, '') NOT IN ('quick', 'deep', 'high_stakes') THEN '400 mode must be quick, deep, or high_stakes; this endpoint is live only' WHEN endpoint = 'public' AND coalesce(mode, 'quick') <> 'quick' THEN '400 public Live audits support quick mode only' END AS problem FROM read)"""


@query(f"""WITH {SENT}
SELECT doc_id, endpoint, CASE WHEN problem IS NOT NULL THEN CAST(substr(problem, 1, 3) AS INTEGER) WHEN endpoint = 'service' THEN 202 ELSE 200 END AS status, substr(problem, 5) AS error,
  CASE WHEN problem IS NULL THEN sha256(document) END AS document_hash, CASE WHEN problem IS NULL THEN coalesce(mode, 'quick') END AS mode FROM judged""")
def intake_requests(spark, d):
    """Every document sent to both endpoints, most of them with something wrong about the request."""
    k = F.col("doc_id") % 16
    field = F.substr(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("document"))), F.lit(2))  # without its first brace
    mode = F.when(k == 0, "deep").when(k == 3, "fast").otherwise("quick")
    rest = F.concat(F.lit(',"mode":"'), mode, F.when(k == 6, '","force":true}').otherwise('"}'))
    own = F.concat(F.lit("{"), F.when(k == 2, field).otherwise(F.concat(F.substr(field, F.lit(1), F.length(field) - 1), rest)))
    whole = F.when(k == 7, '{"document":7,"mode":"quick"}').when(k == 8, '{"document":" \\n ","mode":"quick"}').when(k == 14, '{"mode":"quick"}').otherwise(own)
    sent = A.table(spark, d, "documents").select("doc_id", whole.alias("whole")).select(
        "doc_id",
        F.when(k == 4, F.expr("substr(whole, 1, length(whole) - 1)")).when(k == 5, F.concat(F.lit("["), "whole", F.lit("]"))).when(k == 9, "").when(k == 10, F.concat("whole", F.lit(" x"))).when(k == 13, "null").otherwise(F.col("whole")).alias("body"),
        F.when(k == 11, "text/plain").when(k == 12, "Application/JSON; charset=utf-8").otherwise("application/json").alias("content_type"), F.when(k == 15, 300_000).cast("bigint").alias("declared_bytes"),
    )
    ends = [IN.judged(sent.withColumn("endpoint", F.lit(name)), end) for name, end in (("service", IN.SERVICE), ("public", IN.PUBLIC))]
    return ends[0].unionByName(ends[1]).select("doc_id", "endpoint", "status", "error", F.sha2("document", 256).alias("document_hash"), "mode")


# ---- searches ------------------------------------------------------------------------


@query("""WITH r AS (SELECT n_name AS query, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_suppkey) AS rank, s_name AS title, 'https://suppliers.example/' || s_suppkey AS url FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT query, CAST(rank AS INTEGER) AS rank, title, url, 'balance of ' || title AS snippet FROM r WHERE rank <= 20""")
def stored_searches(spark, d):
    """Results of a search for each nation and each region, stored; then those of all nations through the source, which opens only their files."""
    nation = A.table(spark, d, "nation").join(A.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    either = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.explode(F.array("n_name", "r_name")).alias("query"))
    best = Window.partitionBy("query").orderBy(F.desc("s_acctbal"), "s_suppkey")
    found = A.table(spark, d, "supplier").join(F.broadcast(either), "s_nationkey").withColumn("rank", F.row_number().over(best))  # nations: 25 rows
    folder = f"{shared_folder(spark)}/searches-{uuid.uuid4().hex}"
    url, snippet = F.concat(F.lit("https://suppliers.example/"), "s_suppkey"), F.concat(F.lit("balance of "), "s_name")
    SE.published(found.select("query", "rank", F.col("s_name").alias("title"), url.alias("url"), snippet.alias("snippet")), folder)
    SE.pushing(spark)
    names = [r.n_name for r in nation.select("n_name").collect()]  # 25
    return spark.read.format("stored_search").option("path", folder).load().where(F.col("query").isin(names))
