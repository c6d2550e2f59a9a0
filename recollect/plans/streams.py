"""Streams replayed over the test tables, and readers over them; rows are compared with the batch operators in tests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recollect.plans import tables as D
from recollect.sources import cursors as C
from recollect.sources import readers as R
from recollect.sources.folders import shared_folder
from recollect.streaming import sessions as S
from recollect.streaming import timers as T


def _folder(spark) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _replayed(spark, table, columns, run, mode="append"):
    """The stream's whole output for all rows of a table, in one replay."""
    # as a pattern, which may match a file as well as a folder of files
    stream = spark.readStream.schema(spark.read.parquet(table).schema).parquet(table[:-1] + f"[{table[-1]}]")
    folder = _folder(spark)
    query = T.started(run(columns(stream)).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet"), f"{folder}/out")
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_sequences(spark, sf_dir):
    columns = lambda t: t.select(F.col("conv_id").alias("session_id"), F.concat_ws("-", "conv_id", "turn").alias("event_id"), F.sha2("text", 256).alias("sha256"))
    return _replayed(spark, f"{sf_dir}/conversations.parquet", columns, S.reserve_sequences)


def stream_in_order(spark, sf_dir):
    columns = lambda t: t.select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("sequence")).where("(session_id * 7 + sequence) % 11 <> 0")
    return _replayed(spark, f"{sf_dir}/conversations.parquet", columns, S.release_in_order)


def stream_batches(spark, sf_dir):
    n = F.greatest(F.lit(1), F.floor((F.length("props") + F.floor("value") * 10 + 3) / 4)).cast("long")
    columns = lambda t: t.select(F.col("user_id").alias("scope_id"), "event_id", F.col("ts").cast("timestamp").alias("completed_at"), n.alias("tokens"))
    return _replayed(spark, f"{sf_dir}/events.parquet", columns, lambda e: S.fill_batches(e, 4_000, 12))


def stream_due_batches(spark, sf_dir):
    n = F.greatest(F.lit(1), F.floor((F.length("props") + F.floor("value") * 10 + 3) / 4)).cast("long")
    columns = lambda t: t.select(F.col("user_id").alias("scope_id"), "event_id", F.col("ts").cast("timestamp").alias("completed_at"), n.alias("tokens"))
    return _replayed(spark, f"{sf_dir}/events.parquet", columns, T.due_batches)


def stream_job_queue(spark, sf_dir):
    """Events as a log of queues: each type does something else to the jobs of its user."""
    action = F.element_at(F.array(*map(F.lit, ("enqueue", "lease", "enqueue", "ack", "fail", "return", "lease"))), (F.col("event_id") % 7 + 1).cast("int"))
    last = (F.col("event_id") - F.col("event_id") % 7 + 1).cast("string")  # the lease in the same run of seven
    job = F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 7) % 3)
    columns = lambda t: t.select(
        F.concat(F.lit("q"), F.col("user_id") % 32).alias("queue"), F.col("event_id").alias("line_no"), F.col("ts").cast("timestamp").alias("at"), action.alias("action"), job.alias("job_id"),
        F.col("user_id").cast("string").alias("session_id"), F.floor("value").cast("long").alias("version"), F.col("event_id").alias("through"), last.alias("token"),
    )
    return _replayed(spark, f"{sf_dir}/events.parquet", columns, lambda x: T.job_queue(x, capacity=8))


def stream_two_phase(spark, sf_dir):
    """Turns reserved one after the other and committed a second later: every fifth with other content, every seventh to another number, and one of nothing."""
    event = F.concat_ws("-", "conv_id", "turn").alias("event_id")
    at = lambda s: F.timestamp_seconds(F.col("turn") * 10 + s + 1_700_000_000).alias("at")
    sha, n = F.sha2("text", 256), F.col("turn") + 1

    def run(t):
        reserves = t.select(F.col("conv_id").alias("session_id"), event, sha.alias("sha256"), at(0), F.col("turn").cast("long").alias("line_no"))
        commits = t.select(
            F.col("conv_id").alias("session_id"), F.when(F.col("turn") % 11 == 10, F.lit("none")).otherwise(event).alias("event_id"), F.when(F.col("turn") % 5 == 4, F.lit("other")).otherwise(sha).alias("sha256"),
            at(1), F.col("turn").cast("long").alias("line_no"), (n + (F.col("turn") % 7 == 6).cast("int")).cast("long").alias("sequence"),
        )
        return T.two_phase(reserves, commits)

    return _replayed(spark, f"{sf_dir}/conversations.parquet", lambda t: t, run)


def cursor_sync(spark, sf_dir):
    """Turns as records in a folder: first the even ones, then, when these are taken, all; the ledger and the batch that took each."""
    folder = _folder(spark)
    t = D.table(spark, sf_dir, "conversations")
    turn = F.concat_ws("-", "conv_id", "turn")
    message = F.struct(F.when(F.col("role") == "tool", "robot").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))
    records = t.select(
        turn.alias("cursor"), turn.alias("event_id"), F.lit("u").alias("user_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("round_id"),
        F.lit("2024-01-01T00:00:00Z").alias("completed_at"), F.array(message).alias("messages"), F.sha2("text", 256).alias("final_response"), (F.col("turn") % 2 == 0).alias("even"),
    )
    for i, part in enumerate((records.where("even"), records)):
        C.as_lines(part.drop("even")).write.text(f"{folder}/in/{i}")
        query = C.sync(spark, f"{folder}/in", f"{folder}/ledger")
        query.awaitTermination()
    ledger = spark.read.parquet(f"{folder}/ledger/events")
    return ledger.select("event_id", "session_id", F.col("final_response").alias("sha"), F.col("batch").cast("long").alias("batch"))


def compare_and_set(spark, sf_dir):
    j = D.journal(spark, sf_dir)
    current = j.groupBy("session_id").agg(F.max("sequence").alias("version")).withColumn("payload", F.lit("old"))
    ahead = F.when(F.col("session_id") % 3 == 1, 0).otherwise(2)  # the first update of these sessions expects the current version
    return S.compare_and_set(current, j.where("session_id % 3 <> 0").select("session_id", (F.col("sequence") + ahead).alias("expected"), F.concat(F.lit("new"), "sequence").alias("payload"), (-F.col("sequence")).alias("order")))


def text_chunks(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    return R.chunks(docs, 800).select("source_id", "start", "end", F.sha2("chunk", 256).alias("sha"))


def memory_entries(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.replace("text", F.lit("\n"), F.lit("\n§\n")).alias("content"))
    return R.repository_entries(docs).select("source_id", F.col("pos").cast("long").alias("pos"), "memory_id")


SQL = {
    "compare_and_set": f"""WITH j AS ({D.JOURNAL}), c AS (SELECT session_id, max(sequence) AS v FROM j GROUP BY session_id)
        SELECT session_id, (v + (session_id % 3 = 1)::INT)::BIGINT AS version, CASE WHEN session_id % 3 = 1 THEN 'new' || v ELSE 'old' END AS payload,
        CASE session_id % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'set' ELSE 'stale' END AS outcome FROM c""",
    "memory_entries": r"""WITH e AS (SELECT doc_id AS source_id, trim(unnest(string_split(text, chr(10)))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
        SELECT source_id, pos, 'mem-' || sha256(content) AS memory_id FROM e WHERE content <> ''""",
    "stream_sequences": "SELECT conv_id AS session_id, conv_id || '-' || turn AS event_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence, 'new' AS outcome FROM conversations",
    "stream_two_phase": """SELECT conv_id AS session_id, conv_id || '-' || turn AS event_id, turn::BIGINT + 1 AS sequence, 'reserved' AS outcome FROM conversations
        UNION ALL SELECT conv_id, CASE WHEN turn % 11 = 10 THEN 'none' ELSE conv_id || '-' || turn END, CASE WHEN turn % 11 <> 10 THEN turn::BIGINT + 1 END,
        CASE WHEN turn % 11 = 10 THEN 'missing' WHEN turn % 7 = 6 THEN 'sequence_conflict' WHEN turn % 5 = 4 THEN 'digest_conflict' ELSE 'committed' END FROM conversations""",
    "cursor_sync": """SELECT conv_id || '-' || turn AS event_id, conv_id::VARCHAR AS session_id, sha256(text) AS sha, (turn % 2)::BIGINT AS batch FROM conversations
        WHERE role IN ('user', 'assistant', 'system') AND regexp_matches(text, '[^ \t\n\r]')""",
    "stream_in_order": f"SELECT session_id, sequence FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence) AS n FROM ({D.JOURNAL_WITH_GAPS})) WHERE sequence = n",
}

QUERIES = {f.__name__: f for f in (stream_sequences, stream_in_order, stream_batches, stream_due_batches, stream_job_queue, stream_two_phase, cursor_sync, compare_and_set, text_chunks, memory_entries)}
