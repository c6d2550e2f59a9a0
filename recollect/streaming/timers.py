"""Streams whose state moves on by itself: event-time timers close batches, end leases and forget what was never committed.

All three keep one key's state machine (a scope's open batch, a queue, a session's reservations) and give a row for each
thing that happens. Times come from the rows; the watermark moves them on where no row comes. A row with a time also
counts as a clock for its own key, so the rows do not depend on how a stream is cut into micro-batches, as long as those of a key come
in order of time. The queries need the state store that keeps timers: start them with ``started``.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from heapq import heapify, heappop, heappush
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recollect.operators.scheduling import IDLE_S, MAX_EVENTS, MAX_TOKENS, MAX_WAIT_S

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def started(writer, path: str | None = None):
    """Starts a stream with the state store that these operators need; the session's setting is as before afterwards."""
    from pyspark.sql import SparkSession

    conf, name = SparkSession.getActiveSession().conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, PROVIDER)
    try:
        return writer.start(path) if path else writer.start()
    finally:
        conf.set(name, before)


class _Timed(StatefulProcessor):
    """One timer a key at most, set anew after each call to when the state changes next (milliseconds, none for never)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def _set(self, at: int | None) -> None:
        there = list(self.handle.listTimers())
        for t in there:
            if t != at:
                self.handle.deleteTimer(t)
        if at is not None and at not in there:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def _ms(at: datetime) -> int:
    return round(at.timestamp() * 1000)


# --- batches that close when they are full, idle or old


class _Batches(_Timed):
    def __init__(self, idle_ms: int, wait_ms: int, max_tokens: int, max_events: int) -> None:
        self.idle, self.wait, self.most, self.events = idle_ms, wait_ms, max_tokens, max_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pending = handle.getListState("pending", "at long, event_id long, tokens long")
        self.number = handle.getValueState("number", "no int")

    def _reasons(self, held: list[tuple], now: int | None) -> list[str]:
        total = sum(n for *_, n in held)
        idle, old = (now - held[-1][0] >= self.idle, now - held[0][0] >= self.wait) if now is not None else (False, False)
        return [r for r, on in (("idle", idle), ("tokens", total >= self.most), ("events", len(held) >= self.events), ("max_wait", old)) if on]

    def _sent(self, key: tuple, held: list[tuple], no: int, now: int | None) -> Iterator[Row]:
        """The batches that are due, taken off ``held`` one after the other."""
        while held and (why := self._reasons(held, now)):
            size, used = 1, held[0][2]
            while size < len(held) and size < self.events and used + held[size][2] <= self.most:
                used, size = used + held[size][2], size + 1
            yield from (Row(scope_id=key[0], batch_no=no, event_id=i, tokens=n, reasons=",".join(why)) for _, i, n in held[:size])
            del held[:size]
            no += 1
        self.no = no

    def _kept(self, held: list[tuple]) -> None:
        self.number.update((self.no,))
        if held:
            self.pending.put(held)
        else:
            self.pending.clear()
        self._set(min(held[-1][0] + self.idle, held[0][0] + self.wait) if held else None)

    def _held(self) -> list[tuple]:
        self.no = self.number.get()[0] if self.number.exists() else 0
        return [tuple(x) for x in self.pending.get()]

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self._held()
        for at, event_id, tokens in sorted((_ms(r.completed_at), r.event_id, r.tokens) for r in rows):
            yield from self._sent(key, held, self.no, at)  # by then it had been idle, or too old
            held.append((at, event_id, tokens))
            yield from self._sent(key, held, self.no, None)
        self._kept(held)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self._held()
        yield from self._sent(key, held, self.no, timerValues.getCurrentWatermarkInMs())
        self._kept(held)


def due_batches(events: DataFrame, late: str = "0 seconds", idle_s: int = IDLE_S, max_wait_s: int = MAX_WAIT_S, max_tokens: int = MAX_TOKENS, max_events: int = MAX_EVENTS) -> DataFrame:
    """Review batches of a stream of scope_id, event_id, completed_at and tokens: scope_id, batch_no, event_id, tokens, reasons (STR8).

    A scope is due when it has been idle, its events are too many or have too many tokens, or the first has waited too long; then a batch is
    taken from the front, filled up to the limits, until it is due no more. What is pending is bounded by the limits.
    """
    processor, kind = _Batches(idle_s * 1000, max_wait_s * 1000, max_tokens, max_events), events.schema["scope_id"].dataType.simpleString()
    return events.withWatermark("completed_at", late).groupBy("scope_id").transformWithState(processor, f"scope_id {kind}, batch_no int, event_id long, tokens long, reasons string", "Append", "EventTime")


# --- a queue of jobs with leases


class _Queue(_Timed):
    """Jobs wait in line (ready), for another try (delayed), under a lease, or behind a full line, one a session (pending)."""

    def __init__(self, capacity: int, lease_ms: int, wait_ms: int, attempts: int) -> None:
        self.capacity, self.lease, self.wait, self.attempts = capacity, lease_ms, wait_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.jobs = handle.getMapState("jobs", "job_id string", "session_id string, version long, through long, attempts int, status string, since long, until long, token string")
        self.line = handle.getValueState("line", "next long")

    def _load(self) -> None:
        self.held = {k[0]: list(v) for k, v in self.jobs.iterator()}
        self.first = {k: tuple(v) for k, v in self.held.items()}
        self.next = self.line.get()[0] if self.line.exists() else 0
        # what comes next, by heaps whose entries count only while the job is as they say: ends of leases and waits, the line, and those behind it
        self.ends = [(v[6], k) for k, v in self.held.items() if v[4] in ("leased", "delayed")]
        self.ready = [(v[5], k) for k, v in self.held.items() if v[4] == "ready"]
        self.behind = [(v[0], k) for k, v in self.held.items() if v[4] == "pending"]
        self.waits, self.in_line = dict(self.behind), len(self.ready)
        for heap in (self.ends, self.ready, self.behind):
            heapify(heap)

    def _store(self) -> None:
        for k in self.first.keys() - self.held.keys():
            self.jobs.removeKey((k,))
        for k, v in self.held.items():
            if self.first.get(k) != tuple(v):
                self.jobs.updateValue((k,), tuple(v))
        self.line.update((self.next,))
        self._set(min((v[6] for v in self.held.values() if v[4] in ("leased", "delayed")), default=None))

    def _ready(self, k: str) -> None:
        job = self.held[k]
        job[4], job[5], job[6], job[7], self.next = "ready", self.next, 0, "", self.next + 1
        heappush(self.ready, (job[5], k))
        self.in_line += 1

    def _until(self, k: str, status: str, until: int, token: str) -> None:
        job = self.held[k]
        job[4], job[6], job[7] = status, until, token
        heappush(self.ends, (until, k))

    def _moved(self, now: int) -> Iterator[tuple[str, str]]:
        """Leases that have ended and waits that are over go back in line; then sessions behind a full line fill it."""
        over = set()
        while self.ends and self.ends[0][0] <= now:
            until, k = heappop(self.ends)
            job = self.held.get(k)
            if job is not None and job[4] in ("leased", "delayed") and job[6] == until:
                over.add((job[4] != "leased", until, k))
        for was_delayed, _, k in sorted(over):
            self._ready(k)
            yield k, "due" if was_delayed else "expired"
        while self.behind and self.in_line < self.capacity:
            session, k = heappop(self.behind)
            if self.waits.get(session) == k:
                del self.waits[session]
                self._ready(k)
                yield k, "ready"

    def _done(self, r: Row, now: int) -> tuple[str | None, str]:
        held, job = self.held, self.held.get(r.job_id)
        if r.action == "enqueue":
            if job is not None:
                return r.job_id, "idempotent" if job[0] == r.session_id and job[1] >= r.version and job[2] >= r.through else "conflict"
            new = [r.session_id, r.version, r.through, 0, "", 0, 0, ""]
            if self.in_line < self.capacity:
                held[r.job_id] = new
                self._ready(r.job_id)
                return r.job_id, "ready"
            old = self.waits.get(r.session_id)
            if old is not None:
                if held[old][1] >= r.version and held[old][2] >= r.through:
                    return r.job_id, "coalesced"
                new[1], new[2] = max(held[old][1], r.version), max(held[old][2], r.through)
                del held[old]
            new[4], held[r.job_id], self.waits[r.session_id] = "pending", new, r.job_id
            heappush(self.behind, (r.session_id, r.job_id))
            return r.job_id, "pending"
        if r.action == "lease":
            if not self.in_line:
                return None, "empty"
            k = heappop(self.ready)[1]  # jobs leave the line by a lease only
            self.in_line -= 1
            self._until(k, "leased", now + self.lease, r.token)
            return k, "leased"
        if job is None or job[4] != "leased" or job[7] != r.token:
            return r.job_id, "lost"
        if r.action == "ack":
            del held[r.job_id]
            return r.job_id, "done"
        if r.action == "return":
            self._until(r.job_id, "delayed", now + self.wait, "")
            return r.job_id, "returned"
        job[3] += 1
        if job[3] >= self.attempts:
            job[4], job[6], job[7] = "dead", 0, ""
            return r.job_id, "dead"
        self._until(r.job_id, "delayed", now + self.wait * 2 ** (job[3] - 1), "")
        return r.job_id, "retry"

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        self._load()
        for r in sorted(rows, key=lambda r: r.line_no):
            now = _ms(r["at"])
            yield from (Row(queue=key[0], line_no=None, job_id=k, outcome=o) for k, o in self._moved(now))
            k, outcome = self._done(r, now)
            yield Row(queue=key[0], line_no=r.line_no, job_id=k, outcome=outcome)
        self._store()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self._load()
        yield from (Row(queue=key[0], line_no=None, job_id=k, outcome=o) for k, o in self._moved(timerValues.getCurrentWatermarkInMs()))
        self._store()


def job_queue(log: DataFrame, late: str = "0 seconds", capacity: int = 1_000, lease_s: float = 60, wait_s: float = 5, attempts: int = 5) -> DataFrame:
    """Outcomes of a stream of actions on queues (STR6): queue, line_no (null where time alone did it), job_id, outcome.

    log: queue, line_no, at, action (enqueue, lease, ack, fail, return), job_id, session_id, version, through, token. A queue's actions are
    one key's, so use as many queues as there is to be parallelism. Beyond ``capacity`` jobs in line one a session waits behind it and takes
    in later ones of its session (coalesced: it asks for no more than that one). A failed job waits ``wait_s``, twice as long each time, and is dead after
    ``attempts`` failures; a lease ends after ``lease_s``, by the next action or a timer, and its job goes back in line.
    """
    processor = _Queue(capacity, round(lease_s * 1000), round(wait_s * 1000), attempts)
    return log.withWatermark("at", late).groupBy("queue").transformWithState(processor, "queue string, line_no long, job_id string, outcome string", "Append", "EventTime")


# --- reservations in two steps


class _Reservations(_Timed):
    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.known = handle.getMapState("known", "event_id string", "sequence long, sha256 string, committed boolean, at long")
        self.last = handle.getValueState("last", "n long")

    def _forget(self, now: int) -> Iterator[tuple[str, int, str]]:
        """Events whose time is over; of those never committed the number stays free."""
        for e, (n, _, committed, at) in sorted(self.held.items(), key=lambda x: x[1][0]):
            if at + self.ttl <= now:
                del self.held[e]
                if not committed:
                    yield e, n, "expired"

    def _load(self) -> None:
        self.held = {k[0]: tuple(v) for k, v in self.known.iterator()}
        self.before = dict(self.held)

    def _store(self) -> None:
        for k in self.before.keys() - self.held.keys():
            self.known.removeKey((k,))
        for k, v in self.held.items():
            if self.before.get(k) != v:
                self.known.updateValue((k,), v)
        self._set(min((at + self.ttl for *_, at in self.held.values()), default=None))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        self._load()
        last, said = self.last.get()[0] if self.last.exists() else 0, lambda e, n, o: Row(session_id=key[0], event_id=e, sequence=n, outcome=o)
        for r in sorted(rows, key=lambda r: (r["at"], r.line_no)):
            now = _ms(r["at"])
            yield from (said(*x) for x in self._forget(now))
            there = self.held.get(r.event_id)
            if r.action == "reserve":
                if there is None:
                    last += 1
                    self.held[r.event_id] = last, r.sha256, False, now
                    yield said(r.event_id, last, "reserved")
                else:
                    yield said(r.event_id, there[0], "conflict" if there[1] != r.sha256 else "duplicate" if there[2] else "reserved")
            elif there is None:
                yield said(r.event_id, None, "missing")
            elif there[0] != r.sequence:
                yield said(r.event_id, there[0], "sequence_conflict")
            elif there[1] != r.sha256:
                yield said(r.event_id, there[0], "digest_conflict")
            else:
                if not there[2]:
                    self.held[r.event_id] = there[0], there[1], True, now
                yield said(r.event_id, there[0], "duplicate" if there[2] else "committed")
        self.last.update((last,))
        self._store()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self._load()
        yield from (Row(session_id=key[0], event_id=e, sequence=n, outcome=o) for e, n, o in self._forget(timerValues.getCurrentWatermarkInMs()))
        self._store()


def two_phase(reserves: DataFrame, commits: DataFrame, late: str = "0 seconds", ttl_s: float = 86_400) -> DataFrame:
    """Outcomes of reserving numbers and committing events to them (STR2): session_id, event_id, sequence, outcome.

    reserves: session_id, event_id, sha256, at and line_no (order among equal times); commits have sequence, too. An event is reserved once
    and committed once; repeats of a commit are duplicates, other content or another number a conflict, a commit of nothing reserved is missing. What is
    known of an event is forgotten ``ttl_s`` after it was reserved or committed; if it was only reserved, a row says expired. Numbers are never given twice.
    """
    columns = ["session_id", "event_id", "sha256", "at", "line_no", "sequence", "action"]
    both = reserves.withColumn("sequence", F.lit(None).cast("long")).withColumn("action", F.lit("reserve")).select(*columns).unionByName(commits.withColumn("action", F.lit("commit")).select(*columns))
    kind = reserves.schema["session_id"].dataType.simpleString()
    return both.withWatermark("at", late).groupBy("session_id").transformWithState(_Reservations(round(ttl_s * 1000)), f"session_id {kind}, event_id string, sequence long, outcome string", "Append", "EventTime")
