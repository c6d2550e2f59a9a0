"""Streams with timers, replayed in micro-batches of several sizes, against plain folds over the same rows."""

import random
import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from recollect.plans.catalogue import QUERIES
from recollect.streaming import timers as T

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SF = "/root/testdata/sf0.001"


def replay(spark, rows, schema, run, parts):
    """The stream's rows when ``rows``, in order, come in so many files, one a micro-batch."""
    folder = tempfile.mkdtemp(prefix="spark-")
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").json(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("timeZone", "UTC").json(f"{folder}/in")
    writer = run(stream).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("json")
    query = T.started(writer, f"{folder}/out")
    query.awaitTermination()
    return query, spark.read.schema(run(stream).schema).json(f"{folder}/out").collect()


def due(events, now, idle, wait, most, count):
    why = []
    if now is not None and now - max(e[0] for e in events) >= idle:
        why.append("idle")
    if sum(e[2] for e in events) >= most:
        why.append("tokens")
    if len(events) >= count:
        why.append("events")
    if now is not None and now - min(e[0] for e in events) >= wait:
        why.append("max_wait")
    return ",".join(why)


def plain_batches(events, end, idle, wait, most, count):
    """events: (scope, seconds, id, tokens); what each scope sends till ``end``."""
    out = []
    for scope in {e[0] for e in events}:
        held, no = [], 0

        def send(now):
            nonlocal held, no
            while held and due(held, now, idle, wait, most, count):
                why, taken = due(held, now, idle, wait, most, count), []
                while held and len(taken) < count and (not taken or sum(e[2] for e in taken) + held[0][2] <= most):
                    taken.append(held.pop(0))
                out.extend((scope, no, i, n, why) for _, i, n in taken)
                no += 1

        for _, at, i, n in sorted(e for e in events if e[0] == scope):
            send(at)
            held.append((at, i, n))
            send(None)
        send(end)
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 5])
def test_batches_close_when_full_idle_or_old(spark, parts):
    rng = random.Random(parts)
    events = sorted(((rng.randrange(6), rng.randrange(40_000), i, rng.randrange(1, 60)) for i in range(300)), key=lambda e: e[1])
    rows = [(s, START + timedelta(seconds=at), i, n) for s, at, i, n in events]
    limits = 900, 2500, 150, 6
    run = lambda e: T.due_batches(e, "0 seconds", *limits)
    _, got = replay(spark, rows, "scope_id long, completed_at timestamp, event_id long, tokens long", run, parts)
    found = sorted((r.scope_id, r.batch_no, r.event_id, r.tokens, r.reasons) for r in got)
    assert found == plain_batches(events, events[-1][1], *limits)
    assert {w for r in found for w in r[4].split(",")} == {"idle", "tokens", "events", "max_wait"}
    # at the last watermark nothing that is still pending is due
    sent = {r[2] for r in found}
    for s in range(6):
        left = [(at, i, n) for x, at, i, n in events if x == s and i not in sent]
        assert not left or not due(left, events[-1][1], *limits)


def test_query_of_due_batches_against_a_plain_fold(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/events.parquet").withColumn("s", F.unix_millis(F.col("ts").cast("timestamp")) / 1000).collect()]
    tokens = lambda r: max(1, (len(r.props) + int(r.value // 1) * 10 + 3) // 4)
    events = [(r.user_id, r.s, r.event_id, tokens(r)) for r in rows]
    got = QUERIES["stream_due_batches"](spark, SF).collect()
    end = max(e[1] for e in events)
    assert sorted((r.scope_id, r.batch_no, r.event_id, r.tokens, r.reasons) for r in got) == plain_batches(events, end, 7_200, 86_400, 16_000, 20)


def plain_queue(log, capacity, lease, wait, attempts):
    """One queue's log of (line_no, seconds, action, job, session, version, through, token), by lists."""
    jobs, line, behind, out = {}, [], [], []  # jobs: id -> dict; line, behind: ids in order
    for no, at, action, job, session, version, through, token in log:
        ended = sorted((j["until"], k) for k, j in jobs.items() if j.get("lease") and j["until"] <= at)
        over = sorted((j["until"], k) for k, j in jobs.items() if j.get("delayed") and j["until"] <= at)
        for group, word in ((ended, "expired"), (over, "due")):
            for _, k in group:
                jobs[k].update(lease=None, delayed=False)
                line.append(k)
                out.append((None, k, word))
        behind.sort(key=lambda k: (jobs[k]["session"], k))
        while behind and len(line) < capacity:
            line.append(behind.pop(0))
            out.append((None, line[-1], "ready"))
        if action == "enqueue":
            new = {"session": session, "version": version, "through": through, "tries": 0}
            mine = [k for k in behind if jobs[k]["session"] == session]
            if job in jobs:
                old = jobs[job]
                said = "idempotent" if old["session"] == session and old["version"] >= version and old["through"] >= through else "conflict"
            elif len(line) < capacity:
                jobs[job] = new
                line.append(job)
                said = "ready"
            elif mine and jobs[mine[0]]["version"] >= version and jobs[mine[0]]["through"] >= through:
                said = "coalesced"
            else:
                for k in mine:
                    new["version"], new["through"] = max(version, jobs[k]["version"]), max(through, jobs[k]["through"])
                    behind.remove(k)
                    del jobs[k]
                jobs[job] = new
                behind.append(job)
                said = "pending"
            out.append((no, job, said))
        elif action == "lease":
            if line:
                k = line.pop(0)
                jobs[k].update(lease=token, until=at + lease)
                out.append((no, k, "leased"))
            else:
                out.append((no, None, "empty"))
        elif job not in jobs or jobs[job].get("lease") != token:
            out.append((no, job, "lost"))
        elif action == "ack":
            del jobs[job]
            out.append((no, job, "done"))
        else:
            j = jobs[job]
            j["lease"] = None
            j["tries"] += action == "fail"
            if action == "fail" and j["tries"] >= attempts:
                out.append((no, job, "dead"))
                continue
            j.update(delayed=True, until=at + wait * (2 ** (j["tries"] - 1) if action == "fail" else 1))
            out.append((no, job, "retry" if action == "fail" else "returned"))
    return out


QUEUE = "queue string, line_no long, at timestamp, action string, job_id string, session_id string, version long, through long, token string"


@pytest.mark.parametrize("parts", [1, 6])
def test_queue_against_plain_lists(spark, parts):
    rng = random.Random(2)
    log, at, tokens = [], 0, ["t0"]
    for no in range(10_000):
        at += rng.choice([0, 0, 1, 1, 2, 9])
        action = rng.choice(["enqueue", "enqueue", "lease", "lease", "ack", "fail", "return"])
        if action == "lease":
            tokens.append(f"t{no}")
        session = rng.randrange(12)
        job = f"{session}-{rng.randrange(6)}"
        log.append((no, at, action, job, str(session), rng.randrange(4), rng.randrange(40), tokens[-1] if action == "lease" else rng.choice(tokens[-6:])))
    # acks and failures that meet a lease: of the job leased last
    leased, real = {}, []
    for q in range(2):
        mine = [r for r in log if r[0] % 2 == q]
        for i, r in enumerate(mine):
            if r[2] in ("ack", "fail", "return") and rng.random() < 0.7:
                so_far = [o for o in plain_queue(mine[max(0, i - 40) : i], 4, 30, 5, 3) if o[2] == "leased"]
                if so_far:
                    mine[i] = (*r[:3], so_far[-1][1], *r[4:7], next(x[7] for x in mine if x[0] == so_far[-1][0]))
        real += [(f"q{q}", r) for r in mine]
    real.sort(key=lambda x: x[1][0])
    rows = [(q, no, START + timedelta(seconds=at), *rest) for q, (no, at, *rest) in real]
    run = lambda x: T.job_queue(x, "0 seconds", 4, 30, 5, 3)
    _, got = replay(spark, rows, QUEUE, run, parts)
    for q in ("q0", "q1"):
        want = plain_queue([r for x, r in real if x == q], 4, 30, 5, 3)
        mine = [(r.line_no, r.job_id, r.outcome) for r in got if r.queue == q]
        key = lambda r: (r[0], r[1] or "", r[2])
        assert sorted((r for r in mine if r[0] is not None), key=key) == sorted((r for r in want if r[0] is not None), key=key)
        assert {r[2] for r in want} >= {"ready", "pending", "coalesced", "idempotent", "conflict", "leased", "done", "retry", "dead", "returned", "lost", "expired", "due"}


def test_query_of_the_queue_against_plain_lists(spark):
    log = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").withColumn("s", F.unix_millis(F.col("ts").cast("timestamp")) / 1000).orderBy("event_id").collect():
        i = r.event_id
        action = ("enqueue", "lease", "enqueue", "ack", "fail", "return", "lease")[i % 7]
        log.setdefault(f"q{r.user_id % 32}", []).append((i, r.s, action, f"{r.user_id}-{i // 7 % 3}", str(r.user_id), int(r.value // 1), i, str(i - i % 7 + 1)))
    got = QUERIES["stream_job_queue"](spark, SF).where("line_no IS NOT NULL").collect()
    want = {(no, job, said) for rows in log.values() for no, job, said in plain_queue(rows, 8, 60, 5, 5) if no is not None}
    assert {(r.line_no, r.job_id, r.outcome) for r in got} == want and len(got) == len(want)


def test_a_lease_ends_by_the_watermark_alone(spark):
    at = lambda s: START + timedelta(seconds=s)
    job = lambda q, no, s, action, token="": (q, no, at(s), action, "j", "s", 1, 1, token)
    rows = [job("a", 1, 0, "enqueue"), job("a", 2, 1, "lease", "x"), job("b", 3, 500, "enqueue")]
    _, got = replay(spark, rows, QUEUE, lambda x: T.job_queue(x, lease_s=30), 1)
    assert sorted(((r.line_no or 0, r.outcome) for r in got if r.queue == "a")) == [(0, "expired"), (1, "ready"), (2, "leased")]


def plain_reservations(rows, ttl, end):
    """rows: (session, line_no, seconds, action, event, sha, sequence)."""
    out, known, last = [], {}, {}

    def forget(s, now):
        for e in sorted((e for e in known.setdefault(s, {}) if known[s][e]["at"] + ttl <= now), key=lambda e: known[s][e]["n"]):
            old = known[s].pop(e)
            if not old["committed"]:
                out.append((s, e, old["n"], "expired"))

    for s, _, at, action, e, sha, n in sorted(rows, key=lambda r: (r[2], r[1])):
        forget(s, at)
        k = known[s].get(e)
        if action == "reserve" and k is None:
            last[s] = last.get(s, 0) + 1
            known[s][e] = {"n": last[s], "sha": sha, "committed": False, "at": at}
            out.append((s, e, last[s], "reserved"))
        elif action == "reserve":
            out.append((s, e, k["n"], "conflict" if k["sha"] != sha else "duplicate" if k["committed"] else "reserved"))
        elif k is None:
            out.append((s, e, None, "missing"))
        elif k["n"] != n or k["sha"] != sha:
            out.append((s, e, k["n"], "sequence_conflict" if k["n"] != n else "digest_conflict"))
        else:
            out.append((s, e, n, "duplicate" if k["committed"] else "committed"))
            if not k["committed"]:
                k.update(committed=True, at=at)
    for s in list(known):
        forget(s, end)
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 4])
def test_reservations_and_commits_against_a_plain_fold(spark, parts):
    rng = random.Random(parts)
    rows = sorted(((str(rng.randrange(5)), no, rng.randrange(3000), rng.choice(["reserve", "commit"]), f"e{rng.randrange(30)}", rng.choice("aab"), rng.randrange(1, 25)) for no in range(1500)), key=lambda r: r[2])
    given = {}
    for i, r in enumerate(rows):  # most commits ask for the number that was given
        if r[3] == "commit" and rng.random() < 0.8:
            given = {(s, e): n for s, e, n, o in plain_reservations(rows[:i][-60:], 300, 0) if o == "reserved"} if i % 9 == 0 else given
            rows[i] = (*r[:6], given.get((r[0], r[4]), r[6]))
    schema = "session_id string, line_no long, at timestamp, action string, event_id string, sha256 string, sequence long"
    run = lambda x: T.two_phase(x.where("action = 'reserve'").drop("action", "sequence"), x.where("action = 'commit'").drop("action"), ttl_s=300)
    _, got = replay(spark, [(s, no, START + timedelta(seconds=at), *rest) for s, no, at, *rest in rows], schema, run, parts)
    found = sorted(((r.session_id, r.event_id, r.sequence, r.outcome) for r in got), key=repr)
    want = plain_reservations(rows, 300, rows[-1][2])
    assert found == want
    assert {r[3] for r in want} >= {"reserved", "committed", "conflict", "missing", "sequence_conflict", "digest_conflict", "expired"}


def test_a_queue_of_many_jobs_takes_an_action_without_going_through_them():
    """40,000 jobs wait behind a full line: what an action costs must not grow with them."""
    from types import SimpleNamespace
    from time import process_time

    from recollect.streaming.timers import _Queue

    class Kept(dict):
        def iterator(self):
            return iter([((k,), v) for k, v in self.items()])

    q = _Queue(8, 60_000, 5_000, 5)
    q.jobs = Kept({f"j{i:05}": (f"s{i:05}", 0, 0, 0, "ready" if i < 8 else "pending", i if i < 8 else 0, 0, "") for i in range(40_000)})
    q.line = SimpleNamespace(exists=lambda: True, get=lambda: (8,))
    q._load()
    begun, out = process_time(), []
    for i in range(2_000):
        out += q._moved(i)
        out.append(q._done(SimpleNamespace(action="lease", token=f"t{i}", job_id=None), i))
        out.append(q._done(SimpleNamespace(action="ack", token=f"t{i}", job_id=f"j{i:05}"), i))
    out += q._moved(2_000)
    assert [k for k, o in out if o == "leased"] == [k for k, o in out if o == "done"] == [f"j{i:05}" for i in range(2_000)]
    assert [k for k, o in out if o == "ready"] == [f"j{i:05}" for i in range(8, 2_008)]
    assert process_time() - begun < 2
