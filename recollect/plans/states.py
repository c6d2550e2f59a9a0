"""Queries over states, messages of blocks and what else sessions keep, with their SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from recollect.operators import blocks as B
from recollect.operators import review as R
from recollect.operators import scheduling as S
from recollect.operators import state as U
from recollect.operators import transcript as X
from recollect.plans import tables as D
from recollect.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = datetime(2024, 1, 31, 22, 30, tzinfo=timezone.utc)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"SELECT session_id, sequence FROM ({D.JOURNAL}) WHERE session_id % 3 <> 0")
def restored_projections(spark, sf_dir):
    j = D.journal(spark, sf_dir).select("session_id", "sequence")
    return U.restored(j.where("session_id % 3 = 0 and sequence < 3"), j)


@query(f"SELECT session_id, max(CASE WHEN session_id % 3 = 0 THEN sequence + 5 ELSE sequence END) + 1 AS next_sequence FROM ({D.JOURNAL}) GROUP BY session_id")
def next_sequences(spark, sf_dir):
    j = D.journal(spark, sf_dir).select("session_id", "sequence")
    return U.next_sequences(j.where("session_id % 3 = 0").withColumn("sequence", F.col("sequence") + 5), j)


@query("""WITH j AS (SELECT event_id AS id, user_id AS s, event_id % 3 AS v, event_id % 20 AS f, event_id % 20 + 4 AS t FROM events), one AS (SELECT s, min(id) AS one FROM j WHERE v = 1 GROUP BY s),
    two AS (SELECT j.s, min(id) AS two FROM j JOIN one ON one.s = j.s WHERE v = 2 AND id > one GROUP BY j.s), u AS (SELECT j.*, one, two, greatest(10, one % 20 + 4) AS t1, greatest(10, one % 20 + 4, two % 20 + 4) AS t2 FROM j LEFT JOIN one USING (s) LEFT JOIN two USING (s)),
    o AS (SELECT *, s % 5 <> 0 AND coalesce(id = one, false) AS first, s % 5 <> 0 AND coalesce(id = two, false) AS second, CASE WHEN id > two THEN t2 WHEN id > one THEN t1 ELSE 10 END AS so_far FROM u)
    SELECT id AS job_id, CASE WHEN s % 5 = 0 THEN 'missing' WHEN first OR second THEN 'acked' WHEN f = so_far + 1 THEN 'rebase' ELSE 'stale' END AS outcome,
    CASE WHEN first THEN 2 WHEN second THEN 3 END::BIGINT AS new_version, CASE WHEN first THEN t1 WHEN second THEN t2 END::BIGINT AS new_through FROM o""")
def applied_jobs(spark, sf_dir):
    i = F.col("event_id")
    jobs = D.events(spark, sf_dir).select(i.alias("job_id"), F.col("scope_id").alias("session_id"), (i % 3).alias("expected_version"), (i % 20).alias("from_sequence"), (i % 20 + 4).alias("through"))
    envelopes = jobs.where("session_id % 5 <> 0").select("session_id").distinct().withColumn("version", F.lit(1).cast("long")).withColumn("through", F.lit(10).cast("long"))
    return U.applied_jobs(envelopes, jobs).select("job_id", "outcome", "new_version", "new_through")


@query("SELECT source, doc_id FROM documents WHERE doc_id > CASE WHEN source < 'src3' THEN 300 ELSE -1 END QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 7")
def cursor_reads(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("position"))
    cursors = d.where("source < 'src3'").select("source").distinct().withColumn("cursor", F.lit(300).cast("long"))
    return U.after_cursor(d, cursors, 7).select("source", F.col("cursor").alias("doc_id"))


@query(f"SELECT session_id, greatest(0, max(sequence) - coalesce(max(sequence) FILTER (sequence % 3 = 0), 0)) AS uncompressed, greatest(0, max(sequence) - coalesce(max(sequence) FILTER (sequence = 2), 0)) AS uncovered FROM ({D.JOURNAL}) GROUP BY session_id")
def session_progress(spark, sf_dir):
    n = F.col("sequence")
    s = D.journal(spark, sf_dir).groupBy("session_id").agg(F.max(n).alias("latest_sequence"), F.max(F.when(n % 3 == 0, n)).alias("compressed_through_sequence"), F.max(F.when(n == 2, n)).alias("covered_through_sequence"))
    return U.progress(s).select("session_id", "uncompressed", "uncovered")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 3600 * 40 <= 60000 ELSE CASE WHEN doc_id % 2 = 0 THEN 22 ELSE 7 END >= doc_id % 24 AND coalesce(CASE doc_id % 4 WHEN 1 THEN '2024-01-31' WHEN 2 THEN '2024-02-01' END, '') <> CASE WHEN doc_id % 2 = 0 THEN '2024-01-31' ELSE '2024-02-01' END END AS due FROM documents""")
def curators_due(spark, sf_dir):
    i = F.col("doc_id")
    last = F.timestamp_micros(F.lit(int(AS_OF.timestamp()) * 1_000_000) - 60_000 * 1_000_000)
    c = D.table(spark, sf_dir, "documents").select(i, F.when(i % 3 == 0, "interval").otherwise("daily").alias("kind"), F.when(i % 2 == 0, "UTC").otherwise("Asia/Tokyo").alias("zone"), (i % 24).alias("hour"), F.when(i % 4 == 1, "2024-01-31").when(i % 4 == 2, "2024-02-01").alias("last_checked"), last.alias("last_attempt"), (i % 3600 * 40).alias("interval_s"))
    return U.curators_due(c, F.lit(AS_OF).cast("timestamp")).select("doc_id", "due")


def _campaign(spark, sf_dir):
    from pyspark.sql import Window

    e = D.events(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("scope_id").orderBy("event_id"))
    r = e.select(F.col("scope_id").alias("user_id"), F.col("event_id").alias("line_no"), n.alias("task_no"), F.when(F.col("event_id") % 50 == 1, F.col("event_id") - 1).otherwise(F.col("event_id")).alias("thread_id"), "event_id").where("task_no <= 13")
    version = F.when(F.col("task_no") >= 11, 7).when(F.col("task_no") >= 6, F.when(F.col("line_no") % 40 == 3, 9).otherwise(3)).otherwise(0)
    cycles = r.select("user_id").distinct().select("user_id", F.explode(F.array(*(F.struct(F.lit(c).alias("cycle"), F.lit(v).alias("version")) for c, v in ((1, 3), (2, 7))))).alias("c")).select("user_id", "c.*").where("cycle = 1 or user_id % 4 <> 0")
    return r.withColumn("version", version), cycles


_CAMPAIGN = """SELECT user_id, event_id AS line_no, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS task_no, CASE WHEN event_id % 50 = 1 THEN event_id - 1 ELSE event_id END AS thread_id FROM events QUALIFY task_no <= 13"""


@query(f"""WITH r AS ({_CAMPAIGN}), s AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY line_no) > 1 AS again FROM r)
    SELECT user_id, line_no, CASE WHEN again THEN 'thread again' WHEN task_no > 12 THEN 'order' WHEN task_no >= 11 AND user_id % 4 = 0 THEN 'cycle not active' ELSE 'version' END AS error FROM s
    WHERE again OR task_no > 12 OR task_no >= 11 AND user_id % 4 = 0 OR task_no BETWEEN 6 AND 10 AND line_no % 40 = 3""")
def campaign_errors(spark, sf_dir):
    return U.campaign_errors(*_campaign(spark, sf_dir))


@query(f"SELECT user_id, count(*) AS tasks, count(DISTINCT thread_id) AS threads, count(DISTINCT line_no) AS events, CASE WHEN user_id % 4 = 0 THEN 1 ELSE 2 END::BIGINT AS cycles FROM ({_CAMPAIGN}) GROUP BY user_id")
def campaign_summary(spark, sf_dir):
    return U.campaign_summary(*_campaign(spark, sf_dir))


@query(f"SELECT session_id, sequence, CASE WHEN role = 'system' THEN 'role' ELSE 'blank' END AS error FROM ({D.JOURNAL}) WHERE role = 'system' OR sequence % 5 = 0")
def history_errors(spark, sf_dir):
    j = D.journal(spark, sf_dir).withColumn("content", F.when(F.col("sequence") % 5 == 0, " ").otherwise(F.col("content")))
    return U.history_errors(j).select("session_id", "sequence", "error")


@query("SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 2 = 0 THEN props END AS props FROM events")
def wire_round_trip(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("props"))
    return U.from_wire(U.to_wire(e), e.schema)


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0")
def matches_in_context(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("memory_id"))
    context = d.where("doc_id % 3 = 0").select("memory_id")
    return R.in_context(d.where("doc_id % 2 = 0"), context.unionAll(context)).select("doc_id")


@query("""SELECT 'evt-' || left(sha256(source || ':' || doc_id), 32) AS event_id, CASE WHEN doc_id % 2 = 0 THEN 'u' || doc_id ELSE 'u-' || left(sha256('u ' || doc_id), 24) END AS user_id FROM documents""")
def ledger_events(spark, sf_dir):
    i = F.col("doc_id")
    r = D.table(spark, sf_dir, "documents").select("source", i.alias("record_id"), F.concat(F.when(i % 2 == 0, "u").otherwise("u "), i).alias("user"), F.array("text").alias("transcript"), F.col("text").alias("final_response"), F.lit("2024-01-01T00:00:00Z").alias("completed_at"))
    return readers.as_events(r).select("event_id", "user_id")


@query("""SELECT doc_id AS event_id, CASE doc_id % 5 WHEN 0 THEN 'short' WHEN 1 THEN 'no user' WHEN 2 THEN 'no assistant' ELSE 'other answer' END AS error FROM documents WHERE doc_id % 5 < 4 UNION ALL SELECT doc_id, 'no assistant' FROM documents WHERE doc_id % 5 = 0""")
def manual_errors(spark, sf_dir):
    m = lambda role, content: F.struct(F.lit(role).alias("role"), F.lit(content).alias("content"))
    n = F.col("doc_id") % 5
    transcript = F.when(n == 0, F.array(m("user", "a"))).when(n == 1, F.array(m("assistant", "a"), m("assistant", "b"))).when(n == 2, F.array(m("user", "a"), m("user", "b"))).otherwise(F.array(m("user", "a"), m("assistant", "b")))
    d = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), transcript.alias("transcript"), F.when(n == 3, "c").otherwise("b").alias("final_response"))
    return readers.manual_errors(d)


# --- messages of blocks
def _messages(spark, sf_dir):
    """Rows of conversations as messages: assistants call a tool, users answer the call before, but for every fifth row."""
    block = lambda kind, i=None, use=None, text=None: F.struct(F.lit(kind).alias("type"), *((F.lit(None) if v is None else v).cast("string").alias(n) for n, v in (("id", i), ("tool_use_id", use), ("name", F.lit("Grep") if kind == "tool_use" else None), ("text", text), ("content", F.lit("result") if kind == "tool_result" else None))))
    n = F.col("sequence")
    told = block("text", text=F.col("content"))
    blocks = F.when(F.col("role") == "assistant", F.array(told, block("tool_use", i=n))).when((F.col("role") == "user") & (n % 5 == 0), F.array(block("tool_result", use=n + 100))).when(F.col("role") == "user", F.array(told, block("tool_result", use=n - 1))).otherwise(F.array(told))
    return D.journal(spark, sf_dir).select("session_id", n.alias("pos"), "role", F.lit(None).cast("string").alias("message_id"), F.lit(None).cast("string").alias("group_id"), F.timestamp_micros(F.lit(1_706_000_000_000_000) + n * 600_000_000 + F.col("session_id") * 100_000_000).alias("ts"), blocks.alias("blocks"))


_WITH_CALLS = f"SELECT *, lag(role) OVER (PARTITION BY session_id ORDER BY sequence) = 'assistant' AS answers, count(*) FILTER (role = 'assistant') OVER (PARTITION BY session_id ORDER BY sequence DESC) AS from_end FROM ({D.JOURNAL})"


@query(f"SELECT session_id, sequence AS pos, CASE WHEN role = 'assistant' OR role = 'user' AND answers THEN 2 ELSE 1 END::BIGINT AS blocks FROM ({_WITH_CALLS}) WHERE NOT (role = 'user' AND sequence % 5 = 0)")
def orphan_results(spark, sf_dir):
    return B.without_orphans(_messages(spark, sf_dir)).select("session_id", "pos", F.size("blocks").cast("long").alias("blocks"))


@query(f"""SELECT session_id, sequence AS pos FROM ({_WITH_CALLS}) WHERE role = 'user' AND sequence % 5 <> 0 AND answers AND from_end >= 1""")
def cleared_results(spark, sf_dir):
    got = B.cleared_results(_messages(spark, sf_dir), ("Grep",), 1)
    return got.where(F.exists("blocks", lambda b: b["content"] == B.CLEARED)).select("session_id", "pos")


@query(f"""SELECT session_id, ceil(sum(CASE WHEN role = 'user' AND sequence % 5 = 0 THEN 2 WHEN role = 'user' THEN floor(length(content) / 4 + 0.5) + 2 WHEN role = 'assistant' THEN floor(length(content) / 4 + 0.5) ELSE 0 END) * 4 / 3)::BIGINT AS tokens FROM ({D.JOURNAL}) GROUP BY session_id""")
def block_tokens(spark, sf_dir):
    return B.tokens(_messages(spark, sf_dir))


@query(f"SELECT session_id FROM ({D.JOURNAL}) WHERE role = 'assistant' GROUP BY session_id HAVING 1706003600 - (1706000000 + max(sequence) * 600 + session_id * 100) >= 1800")
def idle_sessions(spark, sf_dir):
    at = F.timestamp_micros(F.lit(1_706_003_600_000_000))
    return B.idle(_messages(spark, sf_dir), at, 30)


@query(f"""WITH r AS (SELECT session_id, sequence AS round_no, sum(length(content)) OVER (PARTITION BY session_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY session_id ORDER BY sequence) AS k, count(*) OVER (PARTITION BY session_id) AS n FROM ({D.JOURNAL}))
    SELECT session_id, round_no FROM r WHERE NOT (CASE WHEN session_id % 2 = 0 THEN coalesce(before, 0) < 500 ELSE k <= greatest(1, n // 5) END AND k < n)""")
def dropped_rounds(spark, sf_dir):
    r = D.journal(spark, sf_dir).select("session_id", F.col("sequence").alias("round_no"), F.length("content").alias("tokens"))
    return B.dropped_rounds(r, F.when(F.col("session_id") % 2 == 0, 500)).select("session_id", "round_no")


@query(f"""WITH r AS ({_WITH_CALLS}), m AS (SELECT session_id, greatest(1, max(sequence) // 2) AS cut FROM r GROUP BY session_id)
    SELECT session_id, least(cut, coalesce(min(sequence - 1) FILTER (sequence >= cut AND role = 'user' AND sequence % 5 <> 0 AND answers), cut))::BIGINT AS cut FROM r JOIN m USING (session_id) GROUP BY session_id, cut""")
def closed_cuts(spark, sf_dir):
    m = _messages(spark, sf_dir)
    cuts = m.groupBy("session_id").agg(F.greatest(F.lit(1), F.floor(F.max("pos") / 2)).alias("cut"))
    return B.closed_cuts(m, cuts).select("session_id", F.col("cut").cast("long").alias("cut"))


@query(f"SELECT session_id, sha256(sequence || chr(9) || to_json({{'sequence': sequence, 'role': role, 'content': content}})::VARCHAR) AS sha FROM ({D.JOURNAL})")
def numbered_lines(spark, sf_dir):
    lines = X.rendered(D.journal(spark, sf_dir))
    return lines.select("session_id", F.sha2(X.numbered(lines), 256).alias("sha"))


@query(f"SELECT DISTINCT session_id FROM ({D.JOURNAL}) WHERE content LIKE '%tion%'")
def files_with_matches(spark, sf_dir):
    lines = X.rendered(D.journal(spark, sf_dir))
    return X.files_with_matches(lines, X.matching(lines, "tion", ignore_case=False))


@query("SELECT event_id FROM events WHERE event_id % 3 = 0")
def activated_events(spark, sf_dir):
    """JN2: pending events without those that an active publication has used."""
    e = D.events(spark, sf_dir)
    return S.pending(e, e.where("event_id % 3 <> 0").select("event_id")).select("event_id")
