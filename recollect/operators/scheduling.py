"""Review scheduling over completed tasks: pending events, due scopes, batches, rates and queues."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from recollect.operators.dealing import in_order

IDLE_S, MAX_WAIT_S, MAX_TOKENS, MAX_EVENTS = 7_200, 86_400, 16_000, 20


def progress(log: DataFrame) -> DataFrame:
    """event_id of events whose last line in the log says processed (AGG5)."""
    last = log.groupBy("event_id").agg(F.max_by("processed", "line_no").alias("processed"))
    return last.where("processed").select("event_id")


def pending(events: DataFrame, done: DataFrame) -> DataFrame:
    """Events not processed yet (JN1, JN2)."""
    return events.join(done, "event_id", "left_anti")


def duplicate_events(events: DataFrame) -> DataFrame:
    """Ids that a ledger holds more than once (SRC7, SNK4)."""
    return events.groupBy("event_id").agg(F.count("*").alias("copies")).where("copies > 1")


def due_scopes(events: DataFrame, as_of: Column, idle_s: int = IDLE_S, max_wait_s: int = MAX_WAIT_S, max_tokens: int = MAX_TOKENS, max_events: int = MAX_EVENTS) -> DataFrame:
    """Scopes whose pending events are due, and why, in the order idle, tokens, events, max_wait (AGG4)."""
    sums = events.groupBy("scope_id").agg(F.min("completed_at").alias("_first"), F.max("completed_at").alias("_last"), F.sum("tokens").alias("tokens"), F.count("*").alias("events"))
    age = lambda c: F.unix_micros(as_of) - F.unix_micros(c)
    why = F.array_compact(F.array(F.when(age("_last") >= idle_s * 1_000_000, "idle"), F.when(F.col("tokens") >= max_tokens, "tokens"), F.when(F.col("events") >= max_events, "events"), F.when(age("_first") >= max_wait_s * 1_000_000, "max_wait")))
    return sums.select("scope_id", "tokens", "events", F.array_join(why, ",").alias("reasons")).where("reasons <> ''")


def batched(events: DataFrame, max_tokens: int = MAX_TOKENS, max_events: int = MAX_EVENTS) -> DataFrame:
    """batch_no of each event: batches are filled in order, and closed by the event that would go over a limit (WIN13).

    A scope's events come to one task in order, which keeps only the totals of the batch that is open; the first event of a
    batch is always taken. A null number of tokens makes the total null, which is over no limit.
    """
    scope, at = events.schema["scope_id"].dataType, events.schema["event_id"].dataType
    schema = StructType([StructField("scope_id", scope), StructField("event_id", at), StructField("batch_no", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, no, used, n = None, 0, 0, 0
        for batch in batches:
            numbers = []
            for scope_id, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = None if used is None or tokens is None else used + tokens
                if (scope_id,) != last:
                    last, no, used, n = (scope_id,), 0, tokens, 1
                elif (total is not None and total > max_tokens) or n >= max_events:
                    no, used, n = no + 1, tokens, 1
                else:
                    used, n = total, n + 1
                numbers.append(no)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(numbers, pa.int32())], names=["scope_id", "event_id", "batch_no"])

    dealt = in_order(events, ["scope_id"], "completed_at", "event_id", "tokens")
    return dealt.select("scope_id", "tokens", "event_id").mapInArrow(run, schema)


def reviewable(events: DataFrame) -> DataFrame:
    """Not interrupted, with a response (FLT5)."""
    return events.where(~F.col("interrupted") & (F.trim("final_response") != ""))


def latest_activity(events: DataFrame, *key: str) -> DataFrame:
    """Of each key the time of the last event (AGG23)."""
    return events.groupBy(*key).agg(F.max("completed_at").alias("latest"))


def task_gate(events: DataFrame, done: DataFrame) -> DataFrame:
    """Whether each scope's latest event is processed, so that a new task may start (GOV20)."""
    last = events.groupBy("scope_id").agg(F.max_by("event_id", F.struct("completed_at", "event_id")).alias("event_id"))
    return last.join(done.withColumn("_done", F.lit(True)), "event_id", "left").select("scope_id", "event_id", F.coalesce("_done", F.lit(False)).alias("open"))


def job_states(log: DataFrame, max_attempts: int, base_s: float = 1.0, most_s: float = 60.0) -> DataFrame:
    """Of each job its state after the log of enqueue, lease, ack and fail lines, with attempts and wait (STR6).

    Acked jobs stay acked; others are dead after ``max_attempts`` failures, waiting after a failure, leased or queued.
    """
    sums = log.groupBy("job_id").agg(F.count_if(F.col("action") == "fail").alias("attempts"), F.bool_or(F.col("action") == "ack").alias("_acked"), F.max_by("action", "line_no").alias("_last"))
    state = F.when(F.col("_acked"), "done").when(F.col("attempts") >= max_attempts, "dead").when(F.col("_last") == "fail", "waiting").when(F.col("_last") == "lease", "leased").otherwise("queued")
    wait = F.when(state == "waiting", F.least(F.lit(most_s), base_s * F.pow(F.lit(2.0), F.col("attempts") - 1))).otherwise(0.0)
    return sums.select("job_id", "attempts", state.alias("state"), wait.alias("wait_s"))


def transitions(log: DataFrame, allowed: DataFrame, start: str, *key: str) -> DataFrame:
    """Each status change of a log, and whether the relation of allowed changes has it (STR13, STR14)."""
    by = Window.partitionBy(*key).orderBy("line_no")
    steps = log.withColumn("from_status", F.lag("status", 1, start).over(by))
    return steps.join(allowed.select("from_status", F.col("to_status").alias("status"), F.lit(True).alias("_ok")), ["from_status", "status"], "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_ok")
