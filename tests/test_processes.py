"""Audits as streams, receipts from relations, sagas, budgets, claims and redirects, against plain programs on small tables."""

import datetime as dt
import hashlib
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from veridex.operators import assembly as RA
from veridex.operators import budget as BU
from veridex.operators import mapper as M
from veridex.operators import receipt as R
from veridex.operators import receipt_rules as RR
from veridex.operators import redirects as RD
from veridex.operators import saga as SG
from veridex.operators.ledger import FOLLOWS, TERMINAL
from veridex.streaming import ledger_stream as ST
from veridex.streaming import lifecycle as LC

AT = dt.datetime(2024, 1, 1)
EVENT = "seq long, saga_id string, action_id string, event string, payload string, at timestamp"


# ---- streams


def judged(events, idle):
    """All rows of LC.FOUND, by a plain pass over each audit in order."""
    legal, out = {(a or "", b) for a, b in FOLLOWS}, []
    for saga in {e[1] for e in events}:
        last, state = None, {}

        def end(seq, state, saga=saga):
            out.append((saga, "finished" if all(x in TERMINAL for x in state.values()) else "timed_out", seq, None, None, None))

        for seq, _, action, event, _, at in sorted(e for e in events if e[1] == saga):
            if last and at - last[0] > idle:
                end(last[1], state)
                state = {}
            last = (at, seq)
            if event == LC.CANCEL:
                out.append((saga, "cancelled", seq, None, None, None))
                last, state = None, {}
                continue
            before = state.get(action, "")
            if (before, event) not in legal:
                out.append((saga, "illegal", seq, action, before or None, event))
            state[action] = event
        if last:
            end(last[1], state)
    return sorted(out, key=repr)


def fed(spark, folder, files):
    for rows in files:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)
    return ST.tail(spark, folder, files_per_trigger=1)


def test_lifecycle_of_events_out_of_order(spark, tmp_path):
    rng = random.Random(1)
    words = ["STAGED", "CALLED", "RECONCILED", "COMMITTED", "ABORTED", LC.CANCEL]
    events, at = [], AT
    for seq in range(300):
        at += dt.timedelta(minutes=rng.choice([1, 5, 30, 200]))
        events.append((seq, f"s{rng.randrange(4)}", f"a{rng.randrange(3)}", rng.choices(words, [6, 6, 4, 4, 2, 1])[0], None, at))
    dealt = [[] for _ in range(7)]
    for k, e in enumerate(events):
        dealt[k // 50 + (rng.random() < 0.3)].append(e)  # up to a file late
    for rows in dealt:
        rng.shuffle(rows)
    dealt[3].append((None, "s1", "a0", "CALLED", None, at))  # without a place in the order
    span = max(events[min(k + 100, 299)][5] - events[k][5] for k in range(0, 300, 50))
    stream = fed(spark, f"{tmp_path}/in", [*dealt, [(None, None, None, None, None, at + dt.timedelta(days=99))]])
    rows, progress = LC.collected(LC.lifecycle(stream, "4 hours", f"{int(span.total_seconds()) + 60} seconds"))
    assert sorted((tuple(r) for r in rows.collect()), key=repr) == judged(events, dt.timedelta(hours=4))
    assert progress[-1].stateOperators[0].numRowsTotal == 0  # every audit has ended, and nothing of it is left


def test_state_of_a_long_stream_is_bounded(spark, tmp_path):
    """A new audit every minute: what is held doesn't grow with what has been seen."""
    files = [[(100 * k + i, f"s{100 * k + i}", "a", "STAGED", None, AT + dt.timedelta(minutes=100 * k + i)) for i in range(100)] for k in range(6)]
    rows, progress = LC.collected(LC.lifecycle(fed(spark, f"{tmp_path}/in", files), "30 minutes", "5 minutes"))
    held = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators and p.numInputRows]
    assert max(held[1:]) <= held[1] * 1.2 and rows.where("kind = 'timed_out'").count() >= 500


def test_many_audits_share_few_keys(spark, tmp_path):
    """State and calls of Python go by keys, not by audits; audits of a key don't touch one another."""
    rng = random.Random(5)
    events = [(n, f"s{rng.randrange(400)}", f"a{rng.randrange(2)}", rng.choice(["STAGED", "CALLED", "COMMITTED", LC.CANCEL]), None, AT + dt.timedelta(minutes=n)) for n in range(1200)]
    files = [events[:700:2], events[1:700:2] + events[700:], [(None, None, None, None, None, AT + dt.timedelta(days=99))]]
    rows, progress = LC.collected(LC.lifecycle(fed(spark, f"{tmp_path}/in", files), "4 hours", "1 day"))
    assert sorted((tuple(r) for r in rows.collect()), key=repr) == judged(events, dt.timedelta(hours=4))
    few, progress = LC.collected(LC.lifecycle(ST.tail(spark, f"{tmp_path}/in", files_per_trigger=1), "4 hours", "1 day", keys=3))
    assert sorted(map(repr, few.collect())) == sorted(map(repr, rows.collect()))
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in progress) <= 3 and progress[-1].stateOperators[0].numRowsTotal == 0


# ---- receipts


def test_receipts_against_a_plain_program(spark):
    rng = random.Random(2)
    audits = [(a, f"m{a}", None if a == 2 else 1.5 * a) for a in range(4)]
    odd = ["", "é", "🙂", "￿", "a\"b\\c\n\t\x01", "z", "Z", "10", "9"]
    notes = [(rng.randrange(3), rng.choice(odd), rng.choice([1.0, 2.5, 1e21, None]), rng.randrange(5)) for _ in range(200)] + [(7, "nobody's", 1.0, 1)]
    a = spark.createDataFrame(audits, "audit_id long, zeta string, Alpha double")
    n = spark.createDataFrame(notes, "audit_id long, note string, weight double, place long")

    def built(notes_):
        return {r.audit_id: r for r in RA.built(a, {"notes": RA.Section(notes_, F.struct("weight", "note"), name=F.col("note")), "beta": RA.Section(notes_, F.col("note"), number=F.col("place")), "bare": RA.Section(notes_, F.struct("weight"), number=F.col("place"), nulls=False)}).collect()}

    got = built(n)
    utf16 = lambda s: s.encode("utf-16-be", "surrogatepass")
    for audit, zeta, alpha in audits:
        own = [x for x in notes if x[0] == audit]
        text = lambda items: "[" + ",".join(t for *_, t in sorted(items)) + "]"
        body = f'{{"Alpha":{R.canonical(alpha)},"bare":' + text([(p, R.canonical({"weight": w} if w is not None else {})) for _, _, w, p in own])
        body += ',"beta":' + text([(p, R.canonical(s)) for _, s, _, p in own]) + ',"notes":' + text([(utf16(s), R.canonical({"note": s, "weight": w})) for _, s, w, _ in own]) + f',"zeta":{R.canonical(zeta)}}}'
        assert (got[audit].receipt_hash, got[audit].n_bytes, got[audit].n_items) == (hashlib.sha256(body.encode()).hexdigest(), len(body.encode()), 3 * len(own))
    changed = built(n.withColumn("note", F.when((F.col("audit_id") == 1) & (F.col("note") == "z"), "y").otherwise(F.col("note"))))
    assert changed[1].receipt_hash != got[1].receipt_hash and all(changed[k] == got[k] for k in (0, 2, 3))
    assert built(n.repartition(7, "place")) == got
    with pytest.raises(ValueError):
        RA.pieces(a, {"zeta": RA.Section(n, F.col("note"))})
    assert RA.built(a.limit(0), {"notes": RA.Section(n, F.col("note"))}).count() == 0


def test_a_receipt_of_very_many_rows(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit(1).alias("audit_id"), F.col("id"))
    out = RA.built(spark.createDataFrame([(1, "x")], "audit_id int, mode string"), {"ids": RA.Section(rows, F.col("id"), number=-F.col("id"))}).first()
    body = '{"ids":[' + ",".join(str(k) for k in range(n - 1, -1, -1)) + '],"mode":"x"}'
    assert (out.n_items, out.receipt_hash) == (n, hashlib.sha256(body.encode()).hexdigest())


def test_the_first_broken_rule(spark):
    broken = [("a", "failure_url", "1"), ("a", "evidence_hash", "e2"), ("a", "evidence_qualification", "e1"), ("b", "search_agent", "9"), ("b", "search_blank", "10"), ("c", "approved_unknown", None), ("c", "contract_missing", "x")]
    got = {r.audit_id: (r.rule, r.subject) for r in RR.first_broken(spark.createDataFrame(broken, "audit_id string, rule string, subject string")).collect()}
    assert got == {"a": ("evidence_qualification", "e1"), "b": ("search_agent", "9"), "c": ("contract_missing", "x")}


# ---- sagas


def run_saga(history, world, undo, most=2):
    """States, parked actions and events of one saga, step by step."""
    state = {a: (h[-1], h.count("CALLED")) for a, h in history.items()}
    commits, parked, said = {}, set(), {a: [] for a in history}
    for a, (s, n) in state.items():
        commits[a] = (-1, a) if "COMMITTED" in history[a] else None
        if s not in ("STAGED", "CALLED", "RECONCILED"):
            continue
        step, turn = ("call", 1) if s == "STAGED" else ("reconcile", 1)
        while True:
            if step == "call":
                n += 1
                said[a].append("CALLED")
                s = "CALLED"
            landed = world(a, step, n)[0]
            if landed is None:
                parked.add(a)
                break
            said[a].append("RECONCILED")
            s = "RECONCILED"
            if landed or n >= most:
                s = "COMMITTED" if landed else "ABORTED"
                said[a].append(s)
                commits[a] = (turn, a) if landed else None
                break
            step, turn = "call", turn + 1
        state[a] = (s, n)
    if undo:
        targets = sorted((a for a, (s, _) in state.items() if s in ("COMMITTED", "COMPENSATION_CALLED")), key=lambda a: commits[a], reverse=True)
        for a in targets:
            s, n = state[a]
            said[a] += ["COMPENSATION_CALLED"] * (s == "COMMITTED")
            landed, error = world(a, "compensate", n)
            state[a] = ("COMPENSATION_CALLED", n)
            if error or landed is not False:
                parked.add(a)
                break
            said[a].append("COMPENSATED")
            state[a] = ("COMPENSATED", n)
    return {a: (s, n, a in parked, said[a]) for a, (s, n) in state.items()}


def test_what_waits_is_written_once(spark):
    """Undoing a saga of 6 actions takes 6 rounds, which write the commands of each and not the rest again."""
    from pathlib import Path

    from veridex.operators.graph import shared_folder

    events = spark.createDataFrame([(k, 1, f"a{k}", "COMMITTED", None, AT) for k in range(6)], "seq long, saga_id long, action_id string, event string, payload string, at timestamp")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    was = set(folder.iterdir())
    done, new = SG.driven(events, lambda c: c.select("action_id", (F.col("action_id") == "a1").alias("landed"), F.lit(None).cast("string").alias("error")), events)
    assert {r.action_id: (r.state, r.parked) for r in done.collect()} == {"a0": ("COMMITTED", False), "a1": ("COMPENSATION_CALLED", True)} | {f"a{k}": ("COMPENSATED", False) for k in range(2, 6)}
    assert new.where("event = 'COMPENSATED'").count() == 4
    written = {p.name: spark.read.parquet(str(p)).count() for p in set(folder.iterdir()) - was if not p.name.startswith("rdd-")}
    of = lambda name: sum(n for p, n in written.items() if p.startswith(name))
    assert (of("actions"), of("left"), of("asked")) == (6, 6, 5) and not [p for p in set(folder.iterdir()) - was if p.name.startswith("rdd-")]


def test_sagas_against_a_plain_program(spark):
    rng = random.Random(3)
    flow = ["STAGED", "CALLED", "RECONCILED", "COMMITTED", "COMPENSATION_CALLED", "COMPENSATED"]
    sagas = {s: {f"{s}-{k}": rng.choice([flow[:n] for n in range(1, 7)] + [["STAGED", "CALLED", "CALLED"], ["STAGED", "CALLED", "RECONCILED", "CALLED", "RECONCILED", "ABORTED"]]) for k in range(rng.randint(1, 6))} for s in range(40)}
    answers = {}

    def world(a, step, n):
        return answers.setdefault((a, step, n), (rng.choice([True, False, False, None]) if step != "compensate" else rng.choice([False, False, False, True, None]), rng.choice([None] * 8 + ["no"]) if step == "compensate" else None))

    want = {a: x for s, h in sagas.items() for a, x in run_saga(h, world, s % 2).items()}
    # all that could be asked has an answer
    table = spark.createDataFrame([(a, step, n, *world(a, step, n)) for h in sagas.values() for a in h for step in ("call", "reconcile", "compensate") for n in range(4)], "action_id string, step string, attempt int, landed boolean, error string")
    asked = []

    def answer(commands):
        asked.extend(tuple(r) for r in commands.select("action_id", "step", "attempt").collect())
        return commands.join(table, ["action_id", "step", "attempt"]).select("action_id", "landed", "error")

    rows = [(100 * k + i, s, a, e, None, AT) for s, h in sagas.items() for k, (a, es) in enumerate(sorted(h.items())) for i, e in enumerate(es)]
    events = spark.createDataFrame(rows, "seq long, saga_id long, action_id string, event string, payload string, at timestamp")
    done, new = SG.driven(events, answer, spark.createDataFrame([(s,) for s in sagas if s % 2], "saga_id long"))
    said = {}
    for r in sorted(new.collect(), key=lambda r: (r.turn, r.step)):
        said.setdefault(r.action_id, []).append(r.event)
    assert {r.action_id: (r.state, r.attempts, bool(r.parked), said.get(r.action_id, [])) for r in done.collect()} == want
    assert len(asked) == len(set(asked))  # no command is given twice
    assert any(x[2] for x in want.values()) and {"COMPENSATED", "ABORTED", "COMMITTED"} <= {x[0] for x in want.values()}


def test_a_parked_action_is_taken_up_again(spark):
    events = spark.createDataFrame([(1, 1, "a", "STAGED", None, AT)], "seq long, saga_id long, action_id string, event string, payload string, at timestamp")
    silent = lambda c: c.select("action_id", F.lit(None).cast("boolean").alias("landed"), F.lit(None).cast("string").alias("error")).limit(0)
    done, new = SG.driven(events, silent)
    assert [(r.state, r.attempts, r.parked) for r in done.collect()] == [("CALLED", 1, True)]
    later = events.unionByName(new.select((F.col("turn") * 10 + F.col("step")).cast("long").alias("seq"), "saga_id", "action_id", "event", F.lit(None).cast("string").alias("payload"), F.lit(AT).alias("at")))
    landed = lambda c: c.select("action_id", F.lit(True).alias("landed"), F.lit(None).cast("string").alias("error"))
    done, new = SG.driven(later, landed)
    assert [(r.state, r.attempts, r.parked) for r in done.collect()] == [("COMMITTED", 1, False)] and [r.event for r in new.orderBy("step").collect()] == ["RECONCILED", "COMMITTED"]


# ---- budgets


def test_running_sums_of_one_large_group(spark):
    n = 1_000_000
    calls = spark.range(n).select(F.lit(1).alias("audit_id"), F.lit("searches").alias("resource"), F.col("id"), (F.col("id") % 3 + 1).alias("attempts")).repartition(16)
    out = BU.admitted(calls, F.lit(1_000_001), ["id"])
    got = out.agg(F.sum("admitted").alias("s"), F.count_if(F.col("outcome") == "cut").alias("cut"), F.count("*").alias("n"), F.max(F.abs(F.col("before") - (F.floor(F.col("id") / 3) * 6 + F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 1).otherwise(3)))).alias("off")).first()
    assert (got.s, got.cut, got.n, got.off) == (1_000_001, 1, n, 0)
    assert out.where("before >= 1000001 and outcome <> 'refused'").count() == 0


def test_budgets_with_nulls_and_cuts(spark):
    rows = [(None, "m", 1, 2), (None, "m", 2, 2), (1, "m", 1, 5), (1, "m", 2, 0), (1, None, 1, 1), (2, "m", 1, 3)]
    out = BU.admitted(spark.createDataFrame(rows, "audit_id int, resource string, k int, attempts int"), F.lit(3), ["k"]).collect()
    assert sorted(((r.audit_id, r.resource, r.k, r.before, r.admitted, r.outcome) for r in out), key=repr) == sorted([
        (None, "m", 1, 0, 2, "admitted"), (None, "m", 2, 2, 1, "cut"), (1, "m", 1, 0, 3, "cut"), (1, "m", 2, 5, 0, "admitted"), (1, None, 1, 0, 1, "admitted"), (2, "m", 1, 0, 3, "admitted"),
    ], key=repr)
    assert BU.admitted(spark.createDataFrame([], "audit_id int, resource string, k int, attempts int"), F.lit(3), ["k"]).count() == 0


# ---- claims


def test_claims_against_a_plain_program(spark):
    rng = random.Random(4)
    rows = []
    for k in range(200):
        doc = "".join(rng.choices("abé ", k=rng.randint(0, 60)))
        said = [(doc[(i := rng.randrange(max(1, len(doc)))) : i + rng.randint(1, 9)] if rng.random() < 0.9 else "zz", rng.choice(["", None, "n1", "n2", f"n{rng.random()}"]), rng.choice(["event", "rumour", None]), rng.choice([True, None]), None, rng.choice(["high", "grave"]), None) for _ in range(rng.choice([0, 3, 12, 12, 13]))]
        rows.append((k, doc, said))
    rows += [(200, None, [("a", "", "event", True, True, "low", "2024")]), (201, "abc", None)]
    claims, refused = M.assembled(spark.createDataFrame(rows, f"id int, document string, claims array<struct<{M.RAW.replace(' ', ':').replace(',:', ',')}>>"), "id")
    want, bad = [], {}
    for k, doc, said in rows:
        said = said or []
        if len(said) > 12 or any(not c[0] for c in said):
            bad[k] = "too many claims" if len(said) > 12 else "a claim without text"
            continue
        taken = {}
        for text, normal, kind, sure, timely, risk, as_of in said if doc is not None else []:
            start = doc.find(text)
            ident = "claim_" + hashlib.sha256((normal or text).encode()).hexdigest()[:16]
            if start < 0 or ident in taken or any(start < y[1] and start + len(text) > y[0] for y in taken.values()):
                continue
            taken[ident] = (start, start + len(text), normal or text.lower(), "event" if kind == "event" else "general", bool(sure), bool(timely), "high" if risk == "high" else "medium", as_of)
        want += [(k, i, *t) for i, t in taken.items()]
    got = [(r["id"], r.claim_id, r.start, r.end, r.normalized, r.claim_type, r.verifiable, r.time_sensitive, r.risk, r.as_of) for r in claims.collect()]
    assert sorted(got) == sorted(want) and {r["id"]: r.reason for r in refused.collect()} == bad and len(want) > 300


# ---- redirects


def test_redirects_against_a_plain_program(spark):
    rng = random.Random(5)
    urls = [f"https://h{k % 3}.example/d/{k}" for k in range(60)]
    pages = {}
    for k, u in enumerate(urls):
        location = rng.choice([None, None, None, rng.choice(urls), rng.choice(urls), str(rng.randrange(60)), f"../d/{rng.randrange(60)}#x", f"//h0.example/d/{3 * rng.randrange(20)}", "http://127.0.0.1/", "ftp://h0.example/", "http://[", ""])
        pages[u] = (rng.choice([301, 302, 308]) if location is not None else 200, location, rng.choice(["text/html", "Text/HTML; charset=x", "text/plain", "image/png", None]), rng.choice([10, 10, 2_000_001]))

    def walk(url):
        here, seen = url, [url]
        for hop in range(9):
            if here not in pages:
                return here, hop, "no response"
            status, location, kind, size = pages[here]
            if not (300 <= status < 400 and location):
                kind = (kind or "").split(";")[0].strip().lower()
                error = f"unsupported content type {kind}" if kind not in ("text/html", "text/plain") else "response too large" if size > 2_000_000 else None
                return here, hop, error
            if hop >= 5:
                return here, hop, "too many redirects"
            try:
                new = urljoin(here, location).partition("#")[0]
            except ValueError:
                return here, hop, "invalid redirect location"
            unsafe = "blocked address" if "127.0.0.1" in new else "unsupported scheme" if new.startswith("ftp") else None
            if unsafe or new in seen:
                return here, hop, unsafe or "redirect loop"
            seen.append(new)
            here = new

    responses = spark.createDataFrame([(u, *x) for u, x in pages.items()], "url string, status int, location string, content_type string, n_bytes long")
    requests = spark.createDataFrame([(u,) for u in [*urls, urls[0], "https://gone.example/", "http://localhost/"]], "url string")
    got = {r.url: (r.final_url, r.hops, r.error) for r in RD.followed(requests, responses).collect()}
    want = {u: walk(u) for u in [*urls, "https://gone.example/"]} | {"http://localhost/": ("http://localhost/", 0, "blocked host")}
    assert got == want and len({e for _, _, e in want.values()}) >= 6
    assert RD.followed(requests.limit(0), responses).count() == 0
