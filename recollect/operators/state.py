"""State of sessions, sources, curators and campaigns as tables: what a service keeps in memory, recomputed from its rows.

Each operator reads a log or a table of states and gives the next states, or what is wrong; none asks a clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from recollect.operators.dealing import in_order


def restored(projection: DataFrame, journal: DataFrame) -> DataFrame:
    """Rows of the journal for sessions whose projection is empty (STR3); others keep what they have."""
    return journal.join(projection.select("session_id").distinct(), "session_id", "left_anti")


def next_sequences(projection: DataFrame, journal: DataFrame) -> DataFrame:
    """The sequence from which each session counts on: one more than the last of projection and journal (STR3, AGG3)."""
    both = projection.select("session_id", "sequence").unionByName(journal.select("session_id", "sequence"))
    return both.groupBy("session_id").agg((F.max("sequence") + 1).alias("next_sequence"))


def applied_jobs(envelopes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Compression jobs with their outcome on the envelopes, each on what the jobs before it have made (STR7).

    envelopes: session_id, version, through; jobs: session_id, job_id, expected_version, from_sequence, through, in order of
    job_id. A job goes in (acked) where the version is the one it was made for, which makes the next version. A job for another version
    that begins right behind what is compressed is to be made again on the new base, others are stale. A session's
    jobs are a sorted stream that keeps its version and how far it is compressed.
    """
    met = jobs.join(envelopes.select("session_id", "version", F.col("through").alias("_through")), "session_id", "left")
    kind = lambda c: jobs.schema[c].dataType
    schema = StructType([StructField("session_id", kind("session_id")), StructField("job_id", kind("job_id")), StructField("outcome", StringType()), StructField("new_version", LongType()), StructField("new_through", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, version, through = None, None, None
        for batch in batches:
            out = []
            for key, expected, begins, ends, first, so_far in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
                if (key,) != session:
                    session, version, through = (key,), first, so_far
                if version is None:
                    out.append(("missing", None, None))
                elif expected == version:
                    version, through = version + 1, max(x for x in (ends, through) if x is not None)
                    out.append(("acked", version, through))
                else:
                    out.append(("rebase" if through is not None and begins == through + 1 else "stale", None, None))
            outcome, made, upto = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(outcome, pa.string()), pa.array(made, pa.int64()), pa.array(upto, pa.int64())], names=schema.names)

    stream = in_order(met.select("session_id", "job_id", "expected_version", "from_sequence", "through", "version", "_through"), ["session_id"], "job_id")
    return jobs.join(stream.mapInArrow(run, schema), ["session_id", "job_id"])


def after_cursor(records: DataFrame, cursors: DataFrame, limit: int) -> DataFrame:
    """Of each source the next ``limit`` records behind its cursor, in order of position, each with the cursor after it (STR9).

    Sources without a cursor begin at the first record; the cursor is advanced record by record, so any of them can be the last.
    """
    left = records.join(cursors, "source", "left").where(F.col("cursor").isNull() | (F.col("position") > F.col("cursor")))
    by = Window.partitionBy("source").orderBy("position")
    return left.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= limit).withColumn("cursor", F.col("position")).drop("_n")


def progress(sessions: DataFrame) -> DataFrame:
    """How far each mark of a session is behind its last sequence (STR11): what is compressed, and what its memory covers."""
    behind = lambda c: F.greatest(F.lit(0), F.col("latest_sequence") - F.coalesce(c, F.lit(0)))
    return sessions.withColumn("uncompressed", behind("compressed_through_sequence")).withColumn("uncovered", behind("covered_through_sequence"))


def curators_due(curators: DataFrame, as_of: Column) -> DataFrame:
    """Whether each curator is due (STR15): daily ones once a date of their time zone, from their hour on; others after their interval.

    curators: kind (daily or interval), zone, hour, last_checked (a date), last_attempt (a time), interval_s.
    """
    local = F.from_utc_timestamp(as_of, F.col("zone"))
    daily = (F.hour(local) >= F.col("hour")) & (F.coalesce(F.col("last_checked"), F.lit("")) != F.date_format(local, "yyyy-MM-dd"))
    waited = F.coalesce((F.unix_micros(as_of) - F.unix_micros("last_attempt")) >= F.col("interval_s") * 1_000_000, F.lit(True))
    return curators.withColumn("due", F.when(F.col("kind") == "daily", daily).otherwise(waited))


def campaign_errors(receipts: DataFrame, cycles: DataFrame, tasks: int = 12, gates: tuple[tuple[int, int], ...] = ((6, 1), (11, 2))) -> DataFrame:
    """The first thing wrong with each receipt that has something wrong (WIN21), in the order of a user's lines.

    receipts: user_id, line_no, task_no, thread_id, event_id, version; cycles: user_id, cycle, version. Tasks come in order
    and not beyond the last; threads and events are new; from a gate's task on its cycle must be active, and the version is
    that of the last cycle whose gate is passed (0 before). A later cycle's version must be newer.
    """
    mine = Window.partitionBy("user_id").orderBy("line_no")
    seen = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("line_no")) > 1
    wide = cycles.groupBy("user_id").agg(*(F.max(F.when(F.col("cycle") == c, F.col("version"))).alias(f"_v{c}") for _, c in gates))
    r = receipts.withColumn("_n", F.row_number().over(mine)).join(wide, "user_id", "left")
    wanted, closed, older, last = F.lit(0), F.lit(False), F.lit(False), None
    for first, c in gates:
        passed, version = F.col("task_no") >= first, F.col(f"_v{c}")
        wanted = F.when(passed, F.coalesce(version, F.lit(-1))).otherwise(wanted)
        closed = closed | (passed & version.isNull())
        older = older | (passed & (version <= last)) if last is not None else older
        last = version
    error = (
        F.when(seen("thread_id"), "thread again")
        .when(seen("event_id"), "event again")
        .when((F.col("task_no") != F.col("_n")) | ~F.col("task_no").between(1, tasks), "order")
        .when(closed, "cycle not active")
        .when(F.coalesce(older, F.lit(False)), "cycle not newer")
        .when(F.col("version") != wanted, "version")
    )
    return r.withColumn("error", error).where("error is not null").select("user_id", "line_no", "error")


def campaign_summary(receipts: DataFrame, cycles: DataFrame) -> DataFrame:
    """By user: tasks, distinct threads and events, and active cycles (AGG12)."""
    done = receipts.groupBy("user_id").agg(F.count("*").alias("tasks"), F.count_distinct("thread_id").alias("threads"), F.count_distinct("event_id").alias("events"))
    active = cycles.groupBy("user_id").agg(F.count_distinct("cycle").alias("cycles"))
    return done.join(active, "user_id", "left").withColumn("cycles", F.coalesce("cycles", F.lit(0)))


def history_errors(messages: DataFrame) -> DataFrame:
    """Messages of a public history that may not be shown to a model (GOV21): other roles than user and assistant, or blank."""
    role = ~F.coalesce("role", F.lit("")).isin("user", "assistant")
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    return messages.withColumn("error", F.when(role, "role").when(blank, "blank")).where("error is not null")


def to_wire(rows: DataFrame) -> DataFrame:
    """Rows as JSON texts, null fields included (PRJ5)."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("wire"))


def from_wire(wire: DataFrame, schema: StructType) -> DataFrame:
    """Rows from JSON texts; a text that does not fit the schema is an error (PRJ5)."""
    return wire.select(F.from_json("wire", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
