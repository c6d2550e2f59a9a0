"""Streaming forms of the journal and schedule operators, on Structured Streaming state.

State is kept by session or scope and is bounded by what is open there; a stream replayed with ``availableNow`` gives the
rows of the batch operators. Times come from the rows (event time), never from a clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEQUENCED = "session_id long, event_id string, sequence long, outcome string"
RELEASED = "session_id long, sequence long"
BATCHED = "scope_id long, event_id long, batch_no int, tokens long"


def _reserving(ttl_s: float | None):
    def reserve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The next number for an id that is new, the old number for a replay, a conflict for other content."""
        last, known = 0, {}
        if state.exists:
            last, *columns = state.get
            known = {i: (n, d, t) for i, n, d, t in zip(*columns)}
        for pdf in batches:
            rows = []
            for event_id, digest, at in zip(pdf.event_id, pdf.sha256, pdf["at"] if "at" in pdf else [0.0] * len(pdf)):
                if event_id not in known:
                    last += 1
                    known[event_id] = last, digest, float(at)
                    rows.append((key[0], event_id, last, "new"))
                else:
                    number, first, _ = known[event_id]
                    rows.append((key[0], event_id, number, "same" if first == digest else "conflict"))
            yield pd.DataFrame(rows, columns=["session_id", "event_id", "sequence", "outcome"])
        if ttl_s is not None and known:
            oldest = max(t for *_, t in known.values()) - ttl_s
            known = {i: v for i, v in known.items() if v[2] >= oldest}
        state.update((last, list(known), *(list(c) for c in zip(*known.values()))) if known else (last, [], [], [], []))

    return reserve


def reserve_sequences(events: DataFrame, ttl_s: float | None = None) -> DataFrame:
    """Sequence numbers by session for a stream of session_id, event_id and sha256, once for each id (STR1, STR2).

    With ``ttl_s`` a column at (seconds, as a double) tells when events were: ids older than that before a session's newest
    are forgotten, so its state stays as large as what comes within that time; numbers go on all the same.
    """
    return events.groupBy("session_id").applyInPandasWithState(_reserving(ttl_s), SEQUENCED, "last long, ids array<string>, numbers array<long>, digests array<string>, times array<double>", "append", GroupStateTimeout.NoTimeout)


def _release(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    done, waiting = (state.get[0], set(state.get[1])) if state.exists else (0, set())
    for pdf in batches:
        waiting.update(s for s in pdf.sequence.tolist() if s > done)
    out = []
    while done + 1 in waiting:
        done += 1
        waiting.discard(done)
        out.append((key[0], done))
    state.update((done, sorted(waiting)))
    yield pd.DataFrame(out, columns=["session_id", "sequence"]).astype("int64")


def release_in_order(events: DataFrame) -> DataFrame:
    """Sequences once all before them have come; what is behind a gap waits in the state (STR10, WIN4)."""
    return events.groupBy("session_id").applyInPandasWithState(_release, RELEASED, "done long, waiting array<long>", "append", GroupStateTimeout.NoTimeout)


def fill_batches(events: DataFrame, max_tokens: int, max_events: int) -> DataFrame:
    """Batches by scope, sent when the next event would go over a limit; the open one stays in the state (STR8, WIN13).

    Events of a micro-batch are taken in order of time and id; across micro-batches in order of arrival.
    """

    def fill(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        no, ids, tokens = (state.get[0], list(state.get[1]), list(state.get[2])) if state.exists else (0, [], [])
        out, used = [], sum(tokens)
        rows = pd.concat(list(batches)).sort_values(["completed_at", "event_id"])
        for event_id, n in zip(rows.event_id, rows.tokens):
            if ids and (used + n > max_tokens or len(ids) >= max_events):
                out += [(key[0], i, no, t) for i, t in zip(ids, tokens)]
                no, ids, tokens, used = no + 1, [], [], 0
            ids.append(int(event_id))
            tokens.append(int(n))
            used += int(n)
        state.update((no, ids, tokens))
        yield pd.DataFrame(out, columns=["scope_id", "event_id", "batch_no", "tokens"]).astype({"scope_id": "int64", "event_id": "int64", "batch_no": "int32", "tokens": "int64"})

    return events.groupBy("scope_id").applyInPandasWithState(fill, BATCHED, "no int, ids array<long>, tokens array<long>", "append", GroupStateTimeout.NoTimeout)


def windowed_activity(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and tokens by window and type, with a watermark (extra: the services themselves have no such windows)."""
    return events.withWatermark("completed_at", late).groupBy(F.window("completed_at", window), "event_type").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def compare_and_set(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Envelopes after a micro-batch: an update whose expected version is the current one goes in, others are stale (STR4).

    Of several updates of one session, the first by ``order`` counts.
    """
    first = updates.groupBy("session_id").agg(F.min_by(F.struct("expected", "payload"), "order").alias("u"))
    both = current.join(first, "session_id", "left")
    fits = F.coalesce(F.col("u.expected") == F.col("version"), F.lit(False))
    return both.select("session_id", F.when(fits, F.col("version") + 1).otherwise(F.col("version")).alias("version"), F.when(fits, F.col("u.payload")).otherwise(F.col("payload")).alias("payload"), F.when(F.col("u").isNull(), "kept").when(fits, "set").otherwise("stale").alias("outcome"))
