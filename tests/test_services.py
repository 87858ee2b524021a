"""Status changes under versions, requests and stored searches, against plain programs on small tables."""

import json
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from veridex.functions import schemas as SC
from veridex.operators import evidence as E
from veridex.operators import intake as IN
from veridex.operators import updates as UP
from veridex.sources import search as SE

UPDATE = "audit_id string, version long, seen long, status string, note string"


# ---- status changes


def walked(updates):
    """The outcome of each (audit, version), by a pass over each audit in order."""
    out = {}
    for audit in {u[0] for u in updates}:
        version, status = None, None
        for _, v, seen, new, _ in sorted((u for u in updates if u[0] == audit), key=lambda u: u[1]):
            may = (status is None or status in UP.RETRYABLE) if new == "created" else new in UP.STATUSES and status is not None and status not in UP.TERMINAL
            out[audit, v] = "lost" if seen != version else "accepted" if may else "illegal"
            if out[audit, v] == "accepted":
                version, status = v, new
    return out


@pytest.mark.parametrize("seed", range(4))
def test_updates_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = []
    for a in range(30):
        version, status, seen_before = None, None, [None]
        for v in sorted(rng.sample(range(200), rng.randrange(1, 40))):
            new = rng.choice((*UP.STATUSES[1:5], "created", "completed", "failed", "cancelled", "unknown")) if rng.random() < 0.4 else ("created" if status is None or status in UP.RETRYABLE else rng.choice((*UP.STATUSES[1:11], "failed")))
            seen = version if rng.random() < 0.75 else rng.choice([*seen_before, 500])
            rows.append((f"a{a}", v, seen, new, f"n{v}"))
            seen_before.append(v)
            if walked([r for r in rows if r[0] == f"a{a}"])[f"a{a}", v] == "accepted":
                version, status = v, new
    got = {(r.audit_id, r.version): r.outcome for r in UP.decided(spark.createDataFrame(rows, UPDATE)).collect()}
    assert got == walked(rows)
    assert {"accepted", "lost", "illegal"} == set(got.values())


def test_a_long_audit_takes_few_rounds(spark):
    n = 5000
    chain = spark.range(n).select(F.lit("a").alias("audit_id"), F.col("id").alias("version"), F.when(F.col("id") > 0, F.col("id") - 1).alias("seen"), F.when(F.col("id") == 0, "created").otherwise("arbitrating").alias("status"))
    assert UP.decided(chain, most_rounds=15).where("outcome = 'accepted'").count() == n


def test_odd_updates_have_outcomes(spark):
    rows = [
        ("a", 0, None, "created", "x"), ("a", 0, None, "created", "delivered again"), ("a", 3, 0, "arbitrating", "first"), ("a", 3, 0, "failed", "another of its version"), ("a", 4, 4, "failed", "saw itself"),
        ("a", 5, 9, "failed", "saw the future"), (None, 1, None, "created", None), ("b", None, None, "created", None), ("b", -2, None, "created", None), ("c", 1, None, None, None), ("c", 2, None, "created", None),
        ("c", 3, None, "created", None), ("d", 1, None, "failed", None),
    ]
    got = [r.outcome for r in UP.decided(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {UPDATE}")).orderBy("i").collect()]
    assert got == ["accepted", "accepted", "accepted", "lost", "lost", "lost", "illegal", "illegal", "illegal", "illegal", "accepted", "lost", "illegal"]
    assert UP.decided(spark.createDataFrame([], UPDATE)).collect() == []


# ---- requests

BODIES = [
    ('{"document":"x","mode":"deep"}', None), ('{"mode":"quick","document":"a","document":"b"}', None), (' {"document":"\\ud800","mode":"quick"} ', None),
    ('{"document":"x","mode":"deep"', "request body contains invalid JSON"), ('{"document":"x","mode":"deep"} x', "request body contains invalid JSON"), ('{"document":NaN,"mode":"deep"}', "request body contains invalid JSON"),
    ("[" * 9000, "request body contains invalid JSON"), (None, "request body must contain JSON"), ("", "request body must contain JSON"), ("3", "request body must be a JSON object"), ("null", "request body must be a JSON object"),
    ('{"z":1,"a":2,"document":"x","mode":"deep"}', "unsupported field: z"), ('{"document":{"a":1},"mode":"deep"}', "document must be a non-empty string"), ('{"document":" \\u00a0\\ufeff\\u2003\\n","mode":"deep"}', "document must be a non-empty string"),
    ('{"document":"x"}', "mode must be quick, deep, or high_stakes; this endpoint is live only"), ('{"document":"x","mode":null}', "mode must be quick, deep, or high_stakes; this endpoint is live only"),
    (json.dumps({"document": "é" * 100_001, "mode": "deep"}, ensure_ascii=False), "request body exceeds 200000 bytes"),
]


def test_each_bad_body_is_named_and_none_is_lost(spark):
    rows = [(i, body, "application/json; charset=utf-8", None) for i, (body, _) in enumerate(BODIES)] + [(90, BODIES[0][0], None, None), (91, BODIES[0][0], "text/html", 300_000), (92, BODIES[0][0], "application/json", 300_000)]
    got = {r.i: r for r in IN.judged(spark.createDataFrame(rows, "i int, body string, content_type string, declared_bytes long")).collect()}
    assert [got[i].error for i in range(len(BODIES))] == [e for _, e in BODIES]
    assert (got[0].document, got[0].mode, got[0].status) == ("x", "deep", 202) and got[1].document == "b" and got[2].document == "�"
    assert (got[90].status, got[91].status, got[92].status) == (415, 415, 413)
    assert all((r.error is None) == (r.document is not None) == (r.mode is not None) for r in got.values())


def test_the_public_endpoint_is_stricter(spark):
    bodies = ['{"document":"x"}', '{"document":"x","mode":"quick"}', '{"document":"x","mode":"deep"}', '{"document":"x","mode":null}', json.dumps({"document": "a" * 12_001}), json.dumps({"document": "a" * 13_001}), ""]
    rows = spark.createDataFrame([(i, b, "application/json", None) for i, b in enumerate(bodies)], "i int, body string, content_type string, declared_bytes long")
    got = [(r.status, r.error) for r in IN.judged(rows, IN.PUBLIC).orderBy("i").collect()]
    assert [s for s, _ in got] == [200, 200, 400, 400, 413, 413, 400]
    assert got[4][1] == "document exceeds 12000 bytes" and got[5][1] == "request body is too large" and got[6][1] == "request body contains invalid JSON"


def test_lines_of_files_keep_their_file(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"document":"x","mode":"deep"}\n{"document":\n')
    (tmp_path / "two.json").write_text("[]\n")
    got = sorted((r.file.rsplit("/", 1)[1], r.status) for r in IN.judged(IN.requests(spark, str(tmp_path))).collect())
    assert got == [("one.json", 202), ("one.json", 400), ("two.json", 400)]


def test_modes_and_guests(spark):
    audits = spark.createDataFrame([("live", "guest"), ("demo", "guest"), ("live", "team"), (None, "guest")], "mode string, workspace_id string")
    assert IN.visible(audits).count() == 1
    assert {r.m for r in audits.where("mode is null or mode = 'live'").select(IN.of_mode(F.col("mode"), "live").alias("m")).collect()} == {"live"}
    with pytest.raises(Exception, match="only live audits"):
        audits.select(IN.of_mode(F.col("mode"), "live")).collect()


# ---- stored searches


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(f"query {q} é", rank, f"t{rank}", f"https://x.example/{q}/{rank}", "line\nbreak" if rank == 1 else None) for q in range(200) for rank in range(1, 24)] + [(None, 1, "t", "u", "s")]
    folder = str(tmp_path / "with blank")
    SE.published(spark.createDataFrame(rows, "query string, rank int, title string, url string, snippet string"), folder, buckets=16)
    SE.pushing(spark)
    return folder


def test_stored_results_come_back_whole(spark, stored):
    got = spark.read.format("stored_search").option("path", stored).load()
    assert got.count() == 200 * 20
    assert spark.read.format("stored_search").option("path", stored).option("limit", 3).load().count() == 600
    assert got.where("rank = 1").select("snippet").distinct().collect()[0][0] == "line\nbreak"


def test_only_files_of_the_queries_asked_for_are_opened(spark, stored):
    reader = SE.StoredReader(stored, 20)
    everything = len(reader.partitions())
    left = list(reader.pushFilters([SE.EqualTo(("query",), "query 7 é"), SE.EqualTo(("rank",), 2)]))
    files = [p.value for p in reader.partitions()]
    assert [f.attribute for f in left] == [("rank",)]
    assert everything == 16 and len(files) == 1 and f"bucket={zlib.crc32('query 7 é'.encode()) % 16}/" in files[0]
    assert {r[0] for p in reader.partitions() for r in reader.read(p)} == {"query 7 é"}
    list(reader.pushFilters([SE.In(("query",), ("query 8 é",))]))
    assert [p.value for p in reader.partitions()] == [None] and list(reader.read(reader.partitions()[0])) == []


def test_a_filter_reaches_the_source(spark, stored):
    asked = spark.read.format("stored_search").option("path", stored).load().where(F.col("query").isin("query 1 é", "query 2 é", "nothing") & (F.col("rank") < 4))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Filter .*query", plan.split("BatchScan")[0])  # only the rank is left to Spark
    assert asked.rdd.getNumPartitions() <= 3
    assert sorted((r.query, r["rank"]) for r in asked.collect()) == [(f"query {q} é", k) for q in (1, 2) for k in (1, 2, 3)]


# ---- schemas and corrections


def test_schemas_keep_known_keywords_at_any_depth(spark):
    schema = {"$schema": "x", "type": "object", "properties": {"pattern": {"type": "string", "pattern": "a+"}, "properties": {"default": 1, "minimum": 0}}, "anyOf": [{"const": 1, "enum": [1]}], "$defs": {"not": {"not": {}, "title": "n"}}, "items": None}
    want = {"type": "object", "properties": {"pattern": {"type": "string"}, "properties": {"minimum": 0}}, "anyOf": [{"enum": [1]}], "$defs": {"not": {"title": "n"}}, "items": None}
    rows = [(0, json.dumps(schema)), (1, "{"), (2, None), (3, "[1]"), (4, '{"properties":[{"const":1,"type":"a"}]}'), (5, "[" * 100_000)]
    got = [r.s for r in spark.createDataFrame(rows, "i int, s string").orderBy("i").select(SC.known_keywords(F.col("s")).alias("s")).collect()]
    assert got == [json.dumps(want, separators=(",", ":")), None, None, "[1]", '{"properties":[{"type":"a"}]}', None]


def test_what_each_verdict_asks_for(spark):
    rows = [("supported", 1, 0, 0, None), ("supported_with_qualifications", 1, 0, 2, None), ("supported_with_qualifications", 0, 0, 2, None), ("contradicted", 0, 3, 0, None), ("outdated", 0, 1, 0, "Newer."), ("not_verifiable", 0, 0, 0, None)]
    v = spark.createDataFrame([(i, i % 2, *r) for i, r in enumerate(rows)], "i int, document int, verdict string, n_supports int, n_contradicts int, n_qualifies int, note string").withColumn("required_correction", E.required_correction(F.col("note")))
    got = [r.required_correction for r in v.orderBy("i").collect()]
    assert got[0] is None and got[5] is None and "overstated" in got[1] and "overstated" not in got[2] and "by 3 source(s)" in got[3] and got[4] == "Update the claim. Newer."
    assert {r.document: r.claims_requiring_revision for r in E.requiring_revision(v, "document").collect()} == {0: 2, 1: 2}
