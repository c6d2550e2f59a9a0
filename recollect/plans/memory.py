"""Queries over memories and journals, with their SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import journal as J
from recollect.operators import retrieval as R
from recollect.plans import tables as D
from recollect.plans.reviews import TOKEN_RE, first_tokens_sql

AS_OF = datetime(2025, 3, 1, tzinfo=timezone.utc)
AS_OF_US = int(AS_OF.timestamp()) * 1_000_000
ASKED = R.Query("the account and of trash payment", "t1", "a", "u1", AS_OF, limit=10)
FINANCE = R.Query("the account and of trash payment", "t1", "a", "u1", AS_OF, domain="banking", limit=10)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TOKENS = lambda x: f"list_distinct(list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]'), lambda t: lower(t)))"
_DOMAIN_HITS = {d: " + ".join(f"contains(lower(content), {_q(k)})::INT" for k in words) for d, words in T.DOMAIN_KEYWORDS.items()}
_INFERRED = "CASE " + " ".join(f"WHEN {d}_n > 0 AND {d}_n = best THEN '{d}'" for d in T.DOMAIN_KEYWORDS) + " END"
_WITH_DOMAIN = f"SELECT *, {_INFERRED} AS inferred FROM (SELECT *, greatest({', '.join(f'{d}_n' for d in T.DOMAIN_KEYWORDS)}) AS best FROM (SELECT *, {', '.join(f'{n} AS {d}_n' for d, n in _DOMAIN_HITS.items())} FROM r))"
_WEIGHT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in R.KIND_WEIGHT.items()) + " END"


def _scored(source: str, query: R.Query) -> str:
    asked = _TOKENS(_q(query.text))
    age = f"greatest(0.0, ({AS_OF_US} - updated_us)::DOUBLE / 86400000000)"
    recency = f"greatest(0.0::DOUBLE, 0.05::DOUBLE * (1 - least({age}, 365.0::DOUBLE) / 365))"
    return f"""SELECT *, len(list_intersect({_TOKENS('content')}, {asked}))::DOUBLE / len({asked}) * 10 + {_WEIGHT} + confidence * 0.1::DOUBLE + 0.0::DOUBLE + {recency} AS score
        FROM ({source}) WHERE tenant_id = '{query.tenant_id}' AND agent_id = '{query.agent_id}' AND (user_id IS NULL OR user_id = '{query.user_id}')"""


_RANKED = f"WITH r AS ({D.RECORDS}), m AS (SELECT *, row_number() OVER (ORDER BY score DESC, memory_id) AS rank FROM ({_scored('SELECT * FROM r', ASKED)}) QUALIFY rank <= 10)"


def retrieval_ranked_topk(spark, sf_dir):
    return R.ranked(D.records(spark, sf_dir), ASKED).select("rank", "memory_id", "kind", F.round("score", 6).alias("score"))


def retrieval_domain_filter(spark, sf_dir):
    return R.of_domain(R.in_scope(D.records(spark, sf_dir), FINANCE), FINANCE).select("memory_id", T.inferred_domain(F.col("content")).alias("inferred"))


def retrieval_conflicts(spark, sf_dir):
    return R.conflict_winners(R.ranked(D.records(spark, sf_dir), ASKED)).select("rank", "memory_id", "conflict_key")


def retrieval_context(spark, sf_dir):
    return R.context(D.records(spark, sf_dir), ASKED)


def event_conflict_winners(spark, sf_dir):
    e = D.events(spark, sf_dir)
    keyed = e.select("event_id", F.concat_ws(":", "scope_id", "event_type").alias("conflict_key"), F.col("completed_at").alias("updated_at"), (F.col("event_id") % 10 / 10).alias("confidence"), F.col("value").alias("score"), F.col("event_id").alias("rank"))
    return R.conflict_winners(keyed).select("conflict_key", "event_id")


def token_estimates(spark, sf_dir):
    n = F.length("content")
    return D.journal(spark, sf_dir).select("session_id", "sequence", T.t1(n).alias("t1"), T.t2(F.col("content")).alias("t2"), T.t3(F.col("content")).alias("t3"), T.t4(n, F.lit(0)).alias("t4"))


def recent_turns(spark, sf_dir):
    return J.recent_turns(D.journal(spark, sf_dir), 2).select("session_id", "sequence", "role", F.col("turn_no").cast("long").alias("turn_no"))


def user_rounds(spark, sf_dir):
    return J.user_rounds(D.journal(spark, sf_dir)).select("session_id", "sequence", F.col("round_no").cast("long").alias("round_no"))


def assistant_rounds(spark, sf_dir):
    j = D.journal(spark, sf_dir)
    return J.assistant_rounds(j, F.floor(F.col("sequence") / 4).cast("string")).select("session_id", "sequence", F.col("round_no").cast("long").alias("round_no"))


def contiguous_prefix(spark, sf_dir):
    return J.contiguous_prefix(D.journal_with_gaps(spark, sf_dir)).select("session_id", "sequence")


def sequence_gaps(spark, sf_dir):
    return J.first_gaps(D.journal_with_gaps(spark, sf_dir))


def sequence_conflicts(spark, sf_dir):
    j = D.journal(spark, sf_dir)
    again = j.where("sequence % 3 = 0").withColumn("content", F.when(F.col("session_id") % 2 == 0, F.col("content")).otherwise(F.concat("content", F.lit("!"))))
    return J.sequence_conflicts(j.unionByName(again))


def append_outcomes(spark, sf_dir):
    j = D.journal(spark, sf_dir).withColumn("event_id", F.concat_ws("-", "session_id", "sequence")).withColumn("sha256", F.sha2("content", 256))
    again = j.withColumn("sha256", F.when(F.col("sequence") % 4 == 0, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("sha256")))
    return J.append_new(j.where("sequence <= 4"), again).select("event_id", "outcome")


def retention_split(spark, sf_dir):
    return J.retention_split(D.journal(spark, sf_dir), 600).select("session_id", "sequence", "retained")


def hot_list(spark, sf_dir):
    return J.hot_list(D.journal(spark, sf_dir), 4, 700).select("session_id", "sequence")


def session_coverage(spark, sf_dir):
    return J.coverage(D.journal(spark, sf_dir), F.col("sequence") % 4 == 0).select("session_id", F.col("latest_sequence").cast("long").alias("latest_sequence"), "last_safe_sequence")


def compression_policy(spark, sf_dir):
    return J.compression_policy(D.journal(spark, sf_dir), 800, 0.65, 8)


def extraction_due(spark, sf_dir):
    return J.extraction_due(D.journal(spark, sf_dir), F.col("session_id") % 2 == 0, F.lit(2), 400, 200).select("session_id", "tokens", "grown", "tool_calls", "initialised", "due")


def _generations(spark, sf_dir):
    """One for each row of a journal, made from its content's size."""
    j = D.journal(spark, sf_dir)
    expires = F.timestamp_micros(F.lit(1_740_700_800_000_000) + F.col("sequence") * 43_200_000_000)
    return j.select("session_id", F.col("sequence").alias("generation"), (F.col("sequence") * 10).alias("through_sequence"), expires.alias("expires_at"), F.length("content").cast("long").alias("tokens_before"), F.floor(F.length("content") / 3).cast("long").alias("tokens_after"))


_GENERATIONS = f"SELECT session_id, sequence AS generation, sequence * 10 AS through_sequence, 1740700800000000 + sequence * 43200000000 AS expires_us, length(content) AS tokens_before, length(content) // 3 AS tokens_after FROM ({D.JOURNAL})"


def visible_generations(spark, sf_dir):
    return J.visible_generations(_generations(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), F.lit(20), 3).select("session_id", "generation")


def compression_report(spark, sf_dir):
    return J.compression_report(_generations(spark, sf_dir)).select("session_id", "generations", "tokens_before", "tokens_after", F.round("saved", 6).alias("saved"), F.round("ratio", 6).alias("ratio"))


def boundary_tail(spark, sf_dir):
    return J.after_boundary(D.journal(spark, sf_dir), F.col("sequence") % 4 == 0).select("session_id", "sequence")


def marker_hashes(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    mark = F.concat(F.lit(" hash="), F.left(F.sha2(i, 256), F.lit(20)), F.lit(" <<ccr:"), i, F.lit("-a>> <<ccr:"), i, F.lit("-a>>"))
    docs = D.table(spark, sf_dir, "documents").withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("text", mark)).otherwise(F.col("text")))
    return docs.select("doc_id", F.array_join(T.marker_hashes(F.col("content")), ",").alias("hashes"))


_SEMANTIC = lambda x: f"list_distinct(list_transform({_TOKENS(x)}, lambda t: CASE WHEN length(t) > 3 AND t[-1] = 's' THEN left(t, length(t) - 1) ELSE t END))"
_T3 = lambda x: f"len(regexp_extract_all({x}, '{TOKEN_RE}'))"
#: The matches that win their conflicts, one row after another: those like a row kept before go, chunks that fit are taken.
_CONTEXT = rf"""{_RANKED.replace("WITH r", "WITH RECURSIVE r", 1)}, c AS (SELECT memory_id, rank, '[' || kind || ':' || memory_id || ']' || chr(10) || trim(content) || chr(10) AS chunk, {_SEMANTIC('content')} AS tokens FROM
        (SELECT *, row_number() OVER (PARTITION BY conflict_key ORDER BY updated_us DESC, confidence DESC, score DESC, rank) AS n FROM m) WHERE conflict_key IS NULL OR n = 1),
    o AS (SELECT *, row_number() OVER (ORDER BY rank) AS k FROM c),
    s AS (SELECT 0::BIGINT AS k, []::VARCHAR[][] AS kept, NULL::BIGINT AS own UNION ALL
        SELECT o.k, CASE WHEN like_one THEN kept ELSE list_append(kept, o.tokens) END, CASE WHEN like_one THEN NULL ELSE o.k END FROM
        (SELECT s.k, s.kept, len(list_filter(s.kept, lambda y: len(y) > 0 AND len(o.tokens) > 0 AND len(list_intersect(y, o.tokens)) / len(list_distinct(list_concat(y, o.tokens))) >= 0.8)) > 0 AS like_one FROM s JOIN o ON o.k = s.k + 1) x JOIN o ON o.k = x.k + 1),
    q AS (SELECT o.*, row_number() OVER (ORDER BY o.k) AS i FROM o JOIN s ON s.own = o.k),
    p AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS chunks, []::VARCHAR[] AS ids, {R.CONTEXT_TOKENS}::BIGINT AS budget, false AS done UNION ALL
        SELECT q.i, CASE WHEN p.done THEN chunks WHEN {_T3('q.chunk')} <= budget THEN list_append(chunks, q.chunk) WHEN len(chunks) > 0 THEN chunks ELSE [regexp_replace({first_tokens_sql('q.chunk', str(R.CONTEXT_TOKENS))}, '\s+$', '') || chr(10)] END,
        CASE WHEN p.done OR ({_T3('q.chunk')} > budget AND len(chunks) > 0) THEN ids ELSE list_append(ids, q.memory_id) END, CASE WHEN p.done OR {_T3('q.chunk')} > budget THEN budget ELSE budget - {_T3('q.chunk')} END,
        p.done OR ({_T3('q.chunk')} > budget AND len(chunks) = 0) FROM p JOIN q ON q.i = p.i + 1)"""
_W = "PARTITION BY session_id ORDER BY sequence"
SQL = {
    "retrieval_context": f"""{_CONTEXT} SELECT array_to_string(chunks, chr(10)) AS markdown, array_to_string(ids, ',') AS memory_ids, {_T3('array_to_string(chunks, chr(10))')}::BIGINT AS estimated_tokens FROM p ORDER BY i DESC LIMIT 1""",
    "retrieval_ranked_topk": f"{_RANKED} SELECT rank::INT AS rank, memory_id, kind, round(score, 6) AS score FROM m",
    "retrieval_domain_filter": f"""WITH r AS ({D.RECORDS}) SELECT memory_id, inferred FROM ({_WITH_DOMAIN}) WHERE tenant_id = 't1' AND agent_id = 'a' AND (user_id IS NULL OR user_id = 'u1')
        AND CASE WHEN inferred IS NOT NULL THEN inferred = 'finance' ELSE len(list_intersect({_TOKENS('content')}, {_TOKENS(_q(FINANCE.text))})) > 0 END""",
    "retrieval_conflicts": f"""{_RANKED} SELECT rank::INT AS rank, memory_id, conflict_key FROM (SELECT *, row_number() OVER (PARTITION BY conflict_key ORDER BY updated_us DESC, confidence DESC, score DESC, rank) AS n FROM m)
        WHERE conflict_key IS NULL OR n = 1""",
    "event_conflict_winners": f"""SELECT conflict_key, event_id FROM (SELECT event_id, scope_id || ':' || event_type AS conflict_key,
        row_number() OVER (PARTITION BY scope_id, event_type ORDER BY completed_at DESC, event_id % 10 DESC, value DESC, event_id) AS n FROM ({D.EVENTS})) WHERE n = 1""",
    "token_estimates": f"""SELECT session_id, sequence, greatest(1, ceil(length(content) / 4))::BIGINT AS t1, floor(length(content) / 4 + 0.5)::BIGINT AS t2,
        len(regexp_extract_all(content, '[A-Za-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]'))::BIGINT AS t3, greatest(1, (length(content) + 3) // 4)::BIGINT AS t4 FROM ({D.JOURNAL})""",
    "recent_turns": f"""WITH a AS (SELECT *, last_value(CASE WHEN role <> 'system' THEN role END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spoke FROM ({D.JOURNAL})),
        b AS (SELECT *, sum((role = 'user' AND coalesce(spoke, 'assistant') <> 'user')::INT) OVER ({_W}) AS turn_no FROM a), c AS (SELECT *, max(turn_no) OVER (PARTITION BY session_id) AS last FROM b)
        SELECT session_id, sequence, role, turn_no::BIGINT AS turn_no FROM c WHERE CASE WHEN turn_no = 0 THEN role = 'system' ELSE last - turn_no < 2 END""",
    "user_rounds": f"SELECT session_id, sequence, (count(*) FILTER (role = 'user') OVER ({_W}))::BIGINT AS round_no FROM ({D.JOURNAL})",
    "assistant_rounds": f"""WITH a AS (SELECT *, CASE WHEN role = 'assistant' THEN (sequence // 4)::VARCHAR END AS own FROM ({D.JOURNAL})),
        b AS (SELECT *, last_value(own IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER ({_W}) AS n FROM a)
        SELECT session_id, sequence, (sum((own IS NOT NULL AND coalesce(before, '') <> own AND n > 1)::INT) OVER ({_W}))::BIGINT AS round_no FROM b""",
    "contiguous_prefix": f"SELECT session_id, sequence FROM (SELECT *, row_number() OVER ({_W}) AS n FROM ({D.JOURNAL_WITH_GAPS})) WHERE sequence = n",
    "sequence_gaps": f"""WITH j AS ({D.JOURNAL_WITH_GAPS}), s AS (SELECT session_id, unnest(range(1, max(sequence) + 1)) AS sequence FROM j GROUP BY session_id)
        SELECT session_id, min(sequence)::BIGINT AS first_missing FROM s ANTI JOIN j USING (session_id, sequence) GROUP BY session_id""",
    "sequence_conflicts": f"""WITH j AS ({D.JOURNAL}) SELECT session_id, sequence, count(*) AS copies, count(DISTINCT (role, content)) > 1 AS conflict FROM
        (SELECT * FROM j UNION ALL SELECT session_id, sequence, role, CASE WHEN session_id % 2 = 0 THEN content ELSE content || '!' END FROM j WHERE sequence % 3 = 0) GROUP BY session_id, sequence""",
    "append_outcomes": f"SELECT session_id || '-' || sequence AS event_id, CASE WHEN sequence > 4 THEN 'new' WHEN sequence % 4 = 0 THEN 'conflict' ELSE 'same' END AS outcome FROM ({D.JOURNAL})",
    "retention_split": f"""SELECT session_id, sequence, coalesce(sum(length(content)) OVER (PARTITION BY session_id ORDER BY sequence DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 600 AS retained FROM ({D.JOURNAL})""",
    "hot_list": f"""SELECT session_id, sequence FROM (SELECT *, sum(CASE WHEN sequence <= 4 THEN strlen(content) ELSE 0 END) OVER (PARTITION BY session_id ORDER BY sequence DESC) AS size FROM ({D.JOURNAL})) WHERE sequence > 4 OR size <= 700""",
    "session_coverage": f"SELECT session_id, max(sequence)::BIGINT AS latest_sequence, coalesce(max(sequence) FILTER (role = 'assistant' AND sequence % 4 <> 0), 0)::BIGINT AS last_safe_sequence FROM ({D.JOURNAL}) GROUP BY session_id",
    "compression_policy": f"SELECT session_id, tokens, messages, tokens >= 800 * 0.65 OR messages >= 8 AS due FROM (SELECT session_id, greatest(1, ceil(sum(length(content)) / 4))::BIGINT AS tokens, count(*) AS messages FROM ({D.JOURNAL}) GROUP BY session_id)",
    "extraction_due": f"""WITH u AS (SELECT *, coalesce(max(sequence) FILTER (role = 'user') OVER (PARTITION BY session_id), 0) AS last_user FROM ({D.JOURNAL})),
        s AS (SELECT session_id, greatest(1, ceil(sum(length(content)) / 4))::BIGINT AS tokens, coalesce(CASE WHEN count(*) FILTER (sequence > 2) > 0 THEN greatest(1, ceil(sum(length(content)) FILTER (sequence > 2) / 4)) END, 0)::BIGINT AS grown,
        count(*) FILTER (sequence > 2 AND role = 'tool') AS tool_calls, bool_or(sequence > last_user AND role = 'tool') AS busy FROM u GROUP BY session_id)
        SELECT session_id, tokens, grown, tool_calls, session_id % 2 = 0 AS initialised, CASE WHEN session_id % 2 <> 0 THEN tokens >= 400 ELSE grown >= 200 AND (tool_calls >= 3 OR NOT busy) END AS due FROM s""",
    "visible_generations": f"SELECT session_id, generation FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY generation DESC) AS n FROM ({_GENERATIONS}) WHERE expires_us > {AS_OF_US} AND through_sequence > 20) WHERE n <= 3",
    "compression_report": f"""SELECT session_id, count(*) AS generations, sum(tokens_before)::BIGINT AS tokens_before, sum(tokens_after)::BIGINT AS tokens_after,
        round(CASE WHEN sum(tokens_before) > 0 THEN 1 - sum(tokens_after)::DOUBLE / sum(tokens_before)::DOUBLE ELSE 0 END, 6) AS saved, round(sum(tokens_before)::DOUBLE / greatest(sum(tokens_after), 1)::DOUBLE, 6) AS ratio FROM ({_GENERATIONS}) GROUP BY session_id""",
    "boundary_tail": f"SELECT session_id, sequence FROM (SELECT *, max(sequence) FILTER (sequence % 4 = 0) OVER (PARTITION BY session_id) AS b FROM ({D.JOURNAL})) WHERE sequence >= coalesce(b, 0)",
    "marker_hashes": """SELECT doc_id, array_to_string(list_distinct(h), ',') AS hashes FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [left(sha256(doc_id::VARCHAR), 20), doc_id || '-a'] ELSE [] END AS h FROM documents) WHERE len(h) < 2
        UNION ALL SELECT doc_id, left(sha256(doc_id::VARCHAR), 20) || ',' || doc_id || '-a' FROM documents WHERE doc_id % 3 = 0""",
}

QUERIES = {f.__name__: f for f in (
    retrieval_ranked_topk, retrieval_domain_filter, retrieval_conflicts, retrieval_context, event_conflict_winners, token_estimates, recent_turns, user_rounds, assistant_rounds, contiguous_prefix,
    sequence_gaps, sequence_conflicts, append_outcomes, retention_split, hot_list, session_coverage, compression_policy, extraction_due, visible_generations, compression_report, boundary_tail, marker_hashes,
)}
