"""Queries over transcripts, schedules, governance, graphs and audits, with their SQL."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.operators import audit as A
from recollect.operators import extraction as E
from recollect.operators import governance as G
from recollect.operators import graph as K
from recollect.operators import metrics as M
from recollect.operators import scheduling as S
from recollect.operators import tools
from recollect.operators import transcript as X
from recollect.plans import tables as D

NOW = datetime(2024, 1, 31, 12, tzinfo=timezone.utc)


def _now():
    return F.lit(NOW).cast("timestamp")


# --- transcripts
_LINES = f"SELECT session_id, sequence, to_json({{'sequence': sequence, 'role': role, 'content': content}})::VARCHAR AS text FROM ({D.JOURNAL})"
PATTERN = "user.*(tion|ing)[ .,]"


def _lines(spark, sf_dir):
    return X.rendered(D.journal(spark, sf_dir))


def transcript_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("session_id", "sequence", F.sha2("text", 256).alias("sha"))


def transcript_grep(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return lines.where(X.matching(lines, PATTERN)).select("session_id", "sequence")


def grep_context(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return X.with_context(lines, X.matching(lines, "ANDTH"), 1, 2).select("session_id", "sequence", "is_match")


def sql_grep(spark, sf_dir):
    """Two table functions in one statement: sessions with a match, and their lines around it."""
    tools.register(spark)
    by = "PARTITION BY session_id ORDER BY sequence"
    found = f"SELECT session_id FROM grep(TABLE({{lines}}) {by}, pattern => 'ANDTH')"
    return spark.sql(f"SELECT session_id, sequence, is_match FROM grep(TABLE({{lines}}) {by}, pattern => 'ANDTH', mode => 'content', before => 2, after => 1, head_limit => 0) WHERE session_id IN ({found})", lines=_lines(spark, sf_dir))


def sql_read(spark, sf_dir):
    tools.register(spark)
    rows = spark.sql("SELECT * FROM read_lines(TABLE({lines}) PARTITION BY session_id ORDER BY sequence, from_sequence => 2, max_lines => 5, chars => 2500)", lines=_lines(spark, sf_dir))
    return rows.select("session_id", "sequence", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "too_long")


def grep_counts(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return X.counts(lines, X.matching(lines, PATTERN))


def grep_multiline(spark, sf_dir):
    return X.multiline_matches(_lines(spark, sf_dir), r"tion\W+\S+\"\}\n\d+\t")


def transcript_page(spark, sf_dir):
    return X.page(_lines(spark, sf_dir), 1, 3).select("session_id", "sequence", "truncated")


def transcript_read(spark, sf_dir):
    return X.read(_lines(spark, sf_dir), 2, 5, 2_500).select("session_id", "sequence", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "too_long")


def grep_budget(spark, sf_dir):
    return X.within_budget(_lines(spark, sf_dir), 1_500).select("session_id", "sequence")


def resolved_markers(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    last = docs.agg(F.max("doc_id")).first()[0]
    both = F.filter(F.array(2 * i + 2, 2 * i + 1), lambda x: x <= last)  # of every fifth there is no marker
    contents = docs.select(i.cast("string").alias("hash"), F.col("text").alias("content"), F.when(i % 5 > 0, both.cast("array<string>")).alias("refs"))
    got = X.resolve_markers(docs.select(i.alias("start"), i.cast("string").alias("hash")), contents, 3)
    return got.select("start", F.sha2("content", 256).alias("sha"))


# --- schedules
def due_scopes(spark, sf_dir):
    return S.due_scopes(D.events(spark, sf_dir), _now(), max_tokens=200_000, max_events=70)


def review_batches(spark, sf_dir):
    return S.batched(D.events(spark, sf_dir), 4_000, 12)


_BATCHES = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY completed_at, event_id) AS k FROM ({D.EVENTS})),
    b AS (SELECT scope_id, k, event_id, 0 AS batch_no, tokens AS used, 1 AS n FROM e WHERE k = 1 UNION ALL
    SELECT e.scope_id, e.k, e.event_id, CASE WHEN b.used + e.tokens > 4000 OR b.n >= 12 THEN b.batch_no + 1 ELSE b.batch_no END,
    CASE WHEN b.used + e.tokens > 4000 OR b.n >= 12 THEN e.tokens ELSE b.used + e.tokens END, CASE WHEN b.used + e.tokens > 4000 OR b.n >= 12 THEN 1 ELSE b.n + 1 END
    FROM b JOIN e ON e.scope_id = b.scope_id AND e.k = b.k + 1) SELECT scope_id, event_id, batch_no FROM b"""


def _progress(spark, sf_dir):
    e = D.events(spark, sf_dir).where("event_id % 3 <> 0")
    first = e.select("event_id", F.lit(1).alias("line_no"), F.lit(True).alias("processed"))
    return S.progress(first.unionAll(e.where("event_id % 5 = 0").select("event_id", F.lit(2).alias("line_no"), F.lit(False).alias("processed"))))


def pending_events(spark, sf_dir):
    return S.pending(D.events(spark, sf_dir), _progress(spark, sf_dir)).select("event_id", "scope_id")


def task_gates(spark, sf_dir):
    return S.task_gate(D.events(spark, sf_dir), _progress(spark, sf_dir))


def duplicate_events(spark, sf_dir):
    e = D.events(spark, sf_dir).select("event_id")
    return S.duplicate_events(e.unionAll(e.where("event_id % 9 = 0")))


def latest_activity(spark, sf_dir):
    return S.latest_activity(D.events(spark, sf_dir), "event_type").select("event_type", F.unix_micros("latest").alias("latest_us"))


def job_states(spark, sf_dir):
    action = F.element_at(F.array(*(F.lit(a) for a in ("enqueue", "lease", "fail", "lease", "ack"))), (F.col("event_id") % 5 + 1).cast("int"))
    log = D.events(spark, sf_dir).select((F.col("event_id") % 997).alias("job_id"), F.col("event_id").alias("line_no"), action.alias("action"))
    return S.job_states(log.where("action <> 'ack' or job_id % 4 = 0"), 3)


_STATUSES = ("draft", "review", "active", "retired")
_ALLOWED = (("draft", "review"), ("review", "active"), ("review", "draft"), ("active", "retired"))


def publication_transitions(spark, sf_dir):
    status = F.element_at(F.array(*(F.lit(x) for x in _STATUSES)), (F.floor("value") % 4 + 1).cast("int"))
    log = D.events(spark, sf_dir).select("scope_id", F.col("event_id").alias("line_no"), status.alias("status"))
    return S.transitions(log, spark.createDataFrame(_ALLOWED, "from_status string, to_status string"), "draft", "scope_id").select("line_no", "from_status", "status", "allowed")


# --- governance
def _artifacts(spark, sf_dir):
    d, labels = D.table(spark, sf_dir, "documents"), D.table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("user_profile", "decision_card", "skill", "note"))), (i % 4 + 1).cast("int"))
    text = F.when(i % 17 == 0, F.concat("text", F.lit(" Please skip the manager approval."))).otherwise(F.col("text"))
    attributes = F.when(i % 3 != 0, F.create_map(*(F.lit(x) for k in ("scenario", "signals", "principle", "boundaries", "inputs", "steps", "output_template", "cautions") for x in (k, "x")))).otherwise(F.create_map(F.lit("scenario"), F.lit("x")))
    return d.join(labels, "doc_id", "left").select(i.alias("pos"), (i % 20).alias("batch"), F.when(i % 23 > 0, kind).alias("artifact_type"), text.alias("content"), F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.75).alias("confidence"), F.when(i % 29 == 0, "high").alias("declared_risk"), F.when(i % 13 == 0, F.array().cast("array<string>")).when(i % 19 > 0, F.array(i.cast("string"))).alias("source_event_ids"), attributes.alias("attributes"))


#: The patterns as SQL's engine takes them: it cannot look behind, and the test texts have nothing that this would rule out.
_RISKS = [re.sub(r"\(\?<![^)]*\)", "", p).replace("'", "''") for p in G.HIGH_RISK]
_DECIDED = f"""WITH a AS (SELECT doc_id AS pos, doc_id % 20 AS batch, CASE WHEN doc_id % 23 > 0 THEN ['user_profile', 'decision_card', 'skill', 'note'][doc_id % 4 + 1] ELSE 'none' END AS kind,
    CASE WHEN doc_id % 17 = 0 THEN text || ' Please skip the manager approval.' ELSE text END AS content, CASE WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.75 ELSE 0 END AS confidence FROM documents LEFT JOIN labels USING (doc_id)),
    d AS (SELECT pos, batch, CASE WHEN pos % 29 = 0 OR {' OR '.join(f"regexp_matches(content, '(?i){p}')" for p in _RISKS)} THEN 'require_review' WHEN pos % 13 = 0 OR pos % 19 = 0 THEN 'observe' WHEN kind IN ('note', 'none') THEN 'require_review'
    WHEN confidence < CASE WHEN kind = 'user_profile' THEN 0.7 ELSE 0.8 END THEN 'observe' WHEN kind IN ('decision_card', 'skill') AND pos % 3 = 0 THEN 'observe' ELSE 'auto_activate' END AS mode FROM a)"""


def artifact_decisions(spark, sf_dir):
    return G.decide(_artifacts(spark, sf_dir)).select("pos", "mode")


def batch_verdicts(spark, sf_dir):
    return G.batch_verdicts(G.decide(_artifacts(spark, sf_dir)), "batch")


def reinforced_confidence(spark, sf_dir):
    e = D.events(spark, sf_dir)
    got = G.reinforced(e.select("event_type", (F.col("event_id") % 50).alias("bucket"), (F.col("event_id") % 7 / 40).alias("confidence"), F.col("scope_id").alias("source_id")), "event_type", "bucket")
    return got.withColumn("confidence", F.round("confidence", 6))


def _entries(spark, sf_dir):
    lines = D.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return lines.select((F.col("doc_id") * 10_000_000 + F.col("line")).alias("pos"), "content", F.col("doc_id").alias("source_id"))


def consolidated_entries(spark, sf_dir):
    got = G.consolidated(_entries(spark, sf_dir)).where("entries > 1")
    return got.select(F.sha2("content", 256).alias("sha"), "pos", "entries", "sources")


def card_versions(spark, sf_dir):
    e = D.events(spark, sf_dir).select("event_id", "scope_id", "event_type", F.col("completed_at").alias("updated_at"))
    return G.versions(e, "scope_id", "event_type").select("event_id", F.col("version").cast("long").alias("version"), F.unix_micros("created_at").alias("created_us"))


def persona_domains(spark, sf_dir):
    e = D.events(spark, sf_dir)
    mine = e.select(F.col("event_type").alias("domain"), F.col("props").alias("content"), (F.col("event_id") % 11 / 10).alias("confidence"), F.col("event_id").alias("pos"))
    return G.persona(mine, 900).select("domain", "pos", "statements", "line")


def event_dispositions(spark, sf_dir):
    e = D.events(spark, sf_dir)
    return G.dispositions(e, e.where("value > 50").select("event_id")).groupBy("scope_id", "disposition").agg(F.count("*").alias("n"))


def evidence_gaps(spark, sf_dir):
    e = D.events(spark, sf_dir)
    required = e.select("scope_id").distinct().select("scope_id", F.explode(F.array(*(F.lit(x) for x in ("click", "view", "purchase", "audit")))).alias("event_type"))
    return G.evidence_gaps(required, e, "scope_id", "event_type")


def _audits(spark, sf_dir):
    o, i = D.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    flag = lambda n: (i % n == 0).cast("int")
    policy = F.element_at(F.array(*(F.lit(x) for x in ("always", "manual_on_review", "never"))), (i % 3 + 1).cast("int"))
    return o.select(i.alias("audit_id"), flag(7).alias("errors"), flag(11).alias("missing"), flag(13).alias("conflicts"), flag(5).alias("adverse"), F.when(i % 5 == 0, "reject").alias("conclusion"), policy.alias("approval_policy"))


_AUDITS = "SELECT o_orderkey AS audit_id, o_orderkey % 7 = 0 AS errors, o_orderkey % 11 = 0 AS missing, o_orderkey % 13 = 0 AS conflicts, o_orderkey % 5 = 0 AS adverse, ['always', 'manual_on_review', 'never'][o_orderkey % 3 + 1] AS policy FROM orders"


def evaluation_status(spark, sf_dir):
    return G.evaluation_status(_audits(spark, sf_dir)).select("audit_id", "status", "needs_approval")


def fail_closed_decision(spark, sf_dir):
    return G.fail_closed(_audits(spark, sf_dir)).select("audit_id", "decision", "reason")


def evaluation_rates(spark, sf_dir):
    l = D.table(spark, sf_dir, "labels").select((F.col("doc_id") % 6).alias("run"), F.col("quality").alias("good"), F.lit(1).alias("total"))
    return G.rates(l, "run", thresholds=(("good", "total", 0.5),))


# --- graphs
def _edges(spark, sf_dir):
    """Customers to their orders, and orders to their parts' suppliers, with times of validity."""
    o, l = D.table(spark, sf_dir, "orders"), D.table(spark, sf_dir, "lineitem")
    t = F.col("o_orderdate").cast("timestamp")
    end = F.when(F.col("o_orderkey") % 4 == 0, F.timestamp_micros(F.unix_micros(t) + F.col("o_orderkey") % 90 * 86_400_000_000))
    first = o.select(F.col("o_orderkey").alias("edge_pos"), F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target"), F.when(F.col("o_orderkey") % 2 == 0, "CAUSED").otherwise("PLACED").alias("type"), t.alias("created_at"), end.alias("invalidated_at"))
    n = F.lit(1_000_000_000) + F.col("l_orderkey") * 10 + F.col("l_linenumber")
    second = l.select(n.alias("edge_pos"), F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), F.lit("INFLUENCED").alias("type"), F.col("l_shipdate").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("invalidated_at"))
    return first.unionByName(second)


_EDGES = """SELECT o_orderkey AS edge_pos, 'c' || o_custkey AS source, 'o' || o_orderkey AS target, CASE WHEN o_orderkey % 2 = 0 THEN 'CAUSED' ELSE 'PLACED' END AS type, o_orderdate AS created_at,
    CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + to_days((o_orderkey % 90)::INT) END AS invalidated_at FROM orders UNION ALL
    SELECT 1000000000 + l_orderkey * 10 + l_linenumber, 'o' || l_orderkey, 's' || l_suppkey, 'INFLUENCED', l_shipdate, NULL FROM lineitem"""


def _nodes(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    none, start = F.lit(None).cast("timestamp"), F.timestamp_micros(F.lit(0))
    orders = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("order").alias("type"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(F.col("o_orderkey") % 6 == 0, F.timestamp_micros(F.lit(852_076_800_000_000))).alias("invalidated_at"))
    customers = D.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("customer").alias("type"), start.alias("created_at"), none.alias("invalidated_at"))
    suppliers = D.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("supplier").alias("type"), start.alias("created_at"), none.alias("invalidated_at"))
    return orders.unionAll(customers).unionAll(suppliers)


_NODES = """SELECT 'o' || o_orderkey AS id, o_orderdate AS created_at, CASE WHEN o_orderkey % 6 = 0 THEN TIMESTAMP '1997-01-01' END AS invalidated_at FROM orders
    UNION ALL SELECT 'c' || c_custkey, TIMESTAMP '1970-01-01', NULL FROM customer UNION ALL SELECT 's' || s_suppkey, TIMESTAMP '1970-01-01', NULL FROM supplier"""
_VALID = "created_at <= TIMESTAMP '1998-06-01' AND (invalidated_at IS NULL OR invalidated_at > TIMESTAMP '1998-06-01')"


def graph_as_of(spark, sf_dir):
    return K.state_at(_nodes(spark, sf_dir), _edges(spark, sf_dir), F.lit(datetime(1998, 6, 1, tzinfo=timezone.utc)).cast("timestamp"))[1].select("edge_pos")


def trace_subgraph(spark, sf_dir):
    ids = _nodes(spark, sf_dir).where("type <> 'order' or sha2(id, 256) < '6'").select("id")
    return K.subgraph(_edges(spark, sf_dir), ids).groupBy("type").agg(F.count("*").alias("n"))


def dangling_edges(spark, sf_dir):
    return K.dangling(_edges(spark, sf_dir), _nodes(spark, sf_dir).where("id not in ('s1', 's2', 'c7')"))


def khop_neighbours(spark, sf_dir):
    starts = D.table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return K.neighbours(_edges(spark, sf_dir), starts, 2).select("start", "id", "hop", "type", "direction")


def causal_chain(spark, sf_dir):
    starts = D.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return K.upstream(_edges(spark, sf_dir), starts, 5)


def fact_nodes(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    return K.facts_as_nodes(o.select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object"), F.col("o_orderkey").alias("pos")))


def fact_conflicts(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    return A.fact_conflicts(o.select(F.col("o_custkey").cast("string").alias("subject"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object"), F.lit("str").alias("value_type"), F.col("o_orderkey").alias("source_id")))


def entity_resolution(spark, sf_dir):
    c = D.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"), F.col("c_custkey").alias("pos"), F.regexp_replace("c_name", "[0-9]{2}$", "").alias("name"), F.col("c_mktsegment").alias("entity_type"), (F.col("c_custkey") % 9 / 10).alias("confidence"))
    return K.resolved_by_name(c).select("entity_id", "resolved_id", "confidence")


def alias_resolution(spark, sf_dir):
    """Customers in order, each with two aliases that later ones may have as names."""
    i = F.col("c_custkey")
    name = lambda n: F.concat(F.lit("Customer "), n % 400)
    c = D.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), i).alias("entity_id"), i.alias("pos"), name(i * 7).alias("name"), F.array(name(i * 7 + 1)).alias("aliases"), F.col("c_mktsegment").alias("entity_type"), (i % 9 / 10).alias("confidence"))
    return K.resolved_by_alias(c).select("entity_id", "resolved_id", "confidence")


# --- audits
_RULES = [("r1", 10, "reject", "total", "gt", "300000"), ("r1", 10, "reject", "status", "eq", "O"), ("r2", 5, "review", "priority", "in", "1-URGENT|2-HIGH"), ("r3", 5, "note", "priority", "contains", "LOW"), ("r3", 5, "note", "total", "lte", "100000.0")]


def rule_evaluation(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    facts = o.select(F.col("o_orderkey").alias("subject"), F.explode(F.create_map(F.lit("total"), F.col("o_totalprice").cast("string"), F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))).alias("field", "value"))
    rules = spark.createDataFrame(_RULES, "rule_id string, priority int, conclusion string, field string, op string, wanted string")
    return A.matching_rules(rules, facts)


def ontology_errors(spark, sf_dir):
    e = D.events(spark, sf_dir)
    field = F.when(F.col("event_id") % 10 == 0, "x").otherwise("k")
    nodes = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), field.alias("field"), F.when(F.col("event_id") % 14 == 0, "many").otherwise(F.get_json_object("props", "$.k")).alias("value"))
    rules = spark.createDataFrame([("click", "k", True, "number", None), ("view", "k", False, None, ["1", "2", "3", "many"])], "type string, field string, required boolean, value_type string, allowed array<string>")
    return A.ontology_errors(nodes, rules)


def chain_verify(spark, sf_dir):
    e = D.events(spark, sf_dir).select(F.col("scope_id").alias("chain_id"), F.row_number().over(_by_scope()).alias("sequence_id"), "event_id", "event_type", "props")
    chain = A.chained(e, "event_id", "event_type", "props")
    tampered = chain.where("event_id % 101 <> 0").withColumn("props", F.when(F.col("event_id") % 97 == 0, "{}").otherwise(F.col("props")))
    # a row that is numbered and linked anew behind one that was taken out
    before = F.lag("checksum").over(Window.partitionBy("chain_id").orderBy("sequence_id"))
    relinked = tampered.withColumn("previous_checksum", F.when(F.col("event_id") % 101 == 1, F.coalesce(before, F.lit(""))).otherwise(F.col("previous_checksum")))
    return A.chain_errors(relinked, "event_id", "event_type", "props")


def _by_scope():
    return Window.partitionBy("scope_id").orderBy("event_id")


def snapshot_fingerprint(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents")
    return A.fingerprint(d.select("source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.col("text").alias("content")), "source")


def manifest_differences(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("sha256"))
    return A.manifest_differences(d.where("name % 7 <> 0"), d.where("name % 5 <> 0").withColumn("sha256", F.when(F.col("name") % 11 == 0, "x").otherwise(F.col("sha256"))))


def compliance_report(spark, sf_dir):
    e = D.events(spark, sf_dir)
    return A.compliance(e.select(F.col("scope_id").alias("source"), F.when(F.col("value") > 99, "VIOLATES").when(F.col("value") > 50, "APPROVED_BY").otherwise("USES").alias("type")))


def turtle_lines(spark, sf_dir):
    parents = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("c1"))).otherwise(F.array().cast("array<string>"))
    own = D.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"), parents.alias("derived_from"), F.sha2("c_name", 256).alias("checksum"), (F.col("c_custkey") % 10 == 0).alias("invalidated"))
    return A.turtle(_edges(spark, sf_dir), _nodes(spark, sf_dir), own)


def ordered_evidence(spark, sf_dir):
    l, p = D.table(spark, sf_dir, "lineitem"), D.table(spark, sf_dir, "part").where("p_partkey % 5 <> 0")
    decisions = l.groupBy(F.col("l_orderkey").alias("decision_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("evidence_ids"))
    return A.in_order_of(decisions, p.select(F.col("p_partkey").alias("evidence_id"), F.col("p_brand").alias("title")))


def json_statements(spark, sf_dir):
    """Orders as JSON records, several in a chunk and one alone, and their lines as text: what they state. An id of zero counts as none."""
    l, o = D.table(spark, sf_dir, "lineitem"), D.table(spark, sf_dir, "orders")
    one = F.to_json(F.struct(F.col("o_orderkey").alias("application_id"), F.col("o_orderstatus").alias("name"), F.struct("o_custkey", F.lit(None).cast("string").alias("none")).alias("customer"), F.array("o_orderpriority").alias("flags")))
    pair = F.concat(F.lit("["), one, F.lit(", 5, "), one, F.lit("]"))
    orders = o.select(F.lit("orders").alias("source_id"), F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderkey") % 2 == 0, one).otherwise(pair).alias("content"))
    line = F.concat_ws("|", F.lit("triple"), "l_orderkey", F.lit(" line "), "l_linenumber")
    lines = l.select(F.lit("lines").alias("source_id"), F.col("l_orderkey").alias("chunk_id"), line.alias("content"))
    return E.stated(orders.unionByName(lines)).select("source_id", "chunk_id", F.col("pos").cast("long").alias("pos"), "kind", F.coalesce("id", "subject").alias("entity"), "predicate", F.coalesce("object", "value").alias("told"))


def card_fields(spark, sf_dir):
    """Documents as cards with a head of a number, a text, a list and an object."""
    d = D.table(spark, sf_dir, "documents")
    head = F.concat(F.lit("---\nid: "), "doc_id", F.lit("\ndomain: "), F.concat_ws("-", F.lit("d"), "doc_id"), F.lit("\nsources:\n  - e1\n  - "), "doc_id", F.lit('\nmore: {"a": ['), "doc_id", F.lit("]}\n---\n"))
    cards = d.select(F.col("doc_id").alias("source_id"), F.concat(head, "text").alias("content"))
    return E.front_matter(cards).select("source_id", "key", F.to_json("value").alias("value"))


def extracted_records(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    line = F.concat_ws("\n", F.concat_ws("|", F.lit("ENTITY"), "o_orderkey", F.lit(" order "), F.lit("o")), F.concat_ws("|", F.lit("relation"), "o_custkey", F.lit("placed"), "o_orderkey"), F.lit("noise"))
    return A.lines_of_records(o.select(F.col("o_orderkey").alias("source_id"), line.alias("text")))


# --- metrics
def _samples(spark, sf_dir):
    return D.events(spark, sf_dir).select(F.col("event_type").alias("operation"), F.round("value", 2).alias("latency_ms"), (F.col("event_id") % 2_000 == 0).alias("failed"))


_SAMPLES = "SELECT event_type AS operation, round(value, 2) AS latency_ms, event_id % 2000 = 0 AS failed FROM events"
_STATS = f"""SELECT operation, count(latency_ms) AS n, count(*) FILTER (failed) AS errors, min(latency_ms) AS least, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95,
    quantile_disc(latency_ms, 0.99) AS p99, max(latency_ms) AS most, avg(latency_ms) AS mean FROM ({_SAMPLES}) GROUP BY operation"""


def latency_stats(spark, sf_dir):
    return M.latencies(_samples(spark, sf_dir), "operation").withColumn("mean", F.round("mean", 6))


def slo_verdicts(spark, sf_dir):
    return M.verdicts(M.latencies(_samples(spark, sf_dir), "operation"), {"p95": 150.0, "p99": 300.0}).select("operation", "ok")


def latency_histogram(spark, sf_dir):
    return M.histogram(_samples(spark, sf_dir), "operation", [10.0, 50.0, 100.0])


def role_counts(spark, sf_dir):
    return M.pivoted(D.journal(spark, sf_dir), "session_id", "role", ["system", "user", "assistant"])


_W = "PARTITION BY session_id ORDER BY sequence"
SQL = {
    "transcript_lines": f"SELECT session_id, sequence, sha256(text) AS sha FROM ({_LINES})",
    "transcript_grep": f"SELECT session_id, sequence FROM ({_LINES}) WHERE regexp_matches(text, '(?i){PATTERN}')",
    "grep_context": f"""WITH m AS (SELECT *, regexp_matches(text, '(?i)ANDTH') AS is_match FROM ({_LINES})) SELECT session_id, sequence, is_match FROM
        (SELECT *, bool_or(is_match) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM m) WHERE near""",
    "sql_grep": f"""WITH m AS (SELECT *, regexp_matches(text, '(?i)ANDTH') AS is_match FROM ({_LINES})) SELECT session_id, sequence, is_match FROM
        (SELECT *, bool_or(is_match) OVER ({_W} ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM m) WHERE near""",
    "grep_counts": f"SELECT session_id, count(*) AS matches FROM ({_LINES}) WHERE regexp_matches(text, '(?i){PATTERN}') GROUP BY session_id",
    "transcript_page": f"SELECT session_id, sequence, last > 4 AS truncated FROM (SELECT *, row_number() OVER ({_W}) AS n, count(*) OVER (PARTITION BY session_id) AS last FROM ({_LINES})) WHERE n BETWEEN 2 AND 4",
    "transcript_read": f"""WITH f AS (SELECT *, sum(length(text)) OVER (PARTITION BY session_id) AS chars FROM (SELECT *, row_number() OVER ({_W}) AS n FROM ({_LINES}) WHERE sequence >= 2) WHERE n <= 5)
        SELECT session_id, sequence, sha256(CASE WHEN chars <= 2500 THEN text ELSE '' END) AS sha, chars > 2500 AS too_long FROM f""",
    "sql_read": f"""WITH f AS (SELECT *, sum(length(text)) OVER (PARTITION BY session_id) AS chars FROM (SELECT *, row_number() OVER ({_W}) AS n FROM ({_LINES}) WHERE sequence >= 2) WHERE n <= 5)
        SELECT session_id, sequence, sha256(CASE WHEN chars <= 2500 THEN text ELSE '' END) AS sha, chars > 2500 AS too_long FROM f""",
    "grep_budget": f"SELECT session_id, sequence FROM (SELECT *, sum(length(text) + 1) OVER ({_W}) AS used FROM ({_LINES})) WHERE used <= 1500",
    "resolved_markers": """WITH RECURSIVE w AS (SELECT doc_id AS start, doc_id AS id, '' AS way, 0 AS depth FROM documents UNION ALL
        SELECT start, 2 * id + 3 - k, way || k, depth + 1 FROM w JOIN documents ON doc_id = 2 * w.id + 1, (SELECT unnest([1, 2]) AS k) WHERE depth < 3 AND id % 5 > 0 AND 2 * id + 3 - k <= (SELECT max(doc_id) FROM documents)),
        leaf AS (SELECT * FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.start = a.start AND b.depth = a.depth + 1 AND left(b.way, a.depth) = a.way))
        SELECT start, sha256(string_agg(text, chr(10) || '---' || chr(10) ORDER BY way)) AS sha FROM leaf JOIN documents ON doc_id = leaf.id GROUP BY start""",
    "due_scopes": f"""WITH s AS (SELECT scope_id, sum(tokens)::BIGINT AS tokens, count(*) AS events, epoch_us(min(completed_at)) AS f, epoch_us(max(completed_at)) AS l FROM ({D.EVENTS}) GROUP BY scope_id),
        r AS (SELECT scope_id, tokens, events, array_to_string(list_filter([CASE WHEN {int(NOW.timestamp()) * 10**6} - l >= 7200000000 THEN 'idle' END, CASE WHEN tokens >= 200000 THEN 'tokens' END, CASE WHEN events >= 70 THEN 'events' END,
        CASE WHEN {int(NOW.timestamp()) * 10**6} - f >= 86400000000 THEN 'max_wait' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s) SELECT * FROM r WHERE reasons <> ''""",
    "review_batches": _BATCHES,
    "pending_events": f"SELECT event_id, scope_id FROM ({D.EVENTS}) WHERE event_id % 3 = 0 OR event_id % 5 = 0",
    "task_gates": f"SELECT scope_id, event_id, event_id % 3 <> 0 AND event_id % 5 <> 0 AS open FROM ({D.EVENTS}) QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY completed_at DESC, event_id DESC) = 1",
    "duplicate_events": "SELECT event_id, 2::BIGINT AS copies FROM events WHERE event_id % 9 = 0",
    "latest_activity": "SELECT event_type, epoch_us(max(ts)) AS latest_us FROM events GROUP BY event_type",
    "job_states": """WITH l AS (SELECT event_id % 997 AS job_id, event_id AS line_no, ['enqueue', 'lease', 'fail', 'lease', 'ack'][event_id % 5 + 1] AS action FROM events),
        s AS (SELECT job_id, count(*) FILTER (action = 'fail') AS attempts, bool_or(action = 'ack') AS acked, arg_max(action, line_no) AS last FROM l WHERE action <> 'ack' OR job_id % 4 = 0 GROUP BY job_id),
        t AS (SELECT job_id, attempts, CASE WHEN acked THEN 'done' WHEN attempts >= 3 THEN 'dead' WHEN last = 'fail' THEN 'waiting' WHEN last = 'lease' THEN 'leased' ELSE 'queued' END AS state FROM s)
        SELECT job_id, attempts, state, CASE WHEN state = 'waiting' THEN least(60.0::DOUBLE, pow(2.0::DOUBLE, attempts - 1)) ELSE 0.0::DOUBLE END AS wait_s FROM t""",
    "publication_transitions": f"""WITH l AS (SELECT user_id, event_id AS line_no, {list(_STATUSES)}[floor(value)::BIGINT % 4 + 1] AS status FROM events), s AS (SELECT *, lag(status, 1, 'draft') OVER (PARTITION BY user_id ORDER BY line_no) AS from_status FROM l)
        SELECT line_no, from_status, status, (from_status, status) IN {_ALLOWED} AS allowed FROM s""",
    "artifact_decisions": f"{_DECIDED} SELECT pos, mode FROM d",
    "batch_verdicts": f"{_DECIDED} SELECT batch, mode, pos FROM d QUALIFY row_number() OVER (PARTITION BY batch ORDER BY list_position(['require_review', 'observe', 'auto_activate'], mode), pos) = 1",
    "reinforced_confidence": "SELECT event_type, event_id % 50 AS bucket, round(least(1.0, 1 - product(1 - event_id % 7 / 40)), 6) AS confidence, count(DISTINCT user_id) AS sources, count(*) AS mentions FROM events GROUP BY 1, 2",
    "consolidated_entries": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
        e AS (SELECT doc_id * 10000000 + line AS pos, content, doc_id, lower(trim(regexp_replace(content, '\s+', ' ', 'g'))) AS key FROM l)
        SELECT sha256(arg_min(content, pos)) AS sha, min(pos) AS pos, count(*) AS entries, count(DISTINCT doc_id) AS sources FROM e GROUP BY key HAVING count(*) > 1""",
    "card_versions": "SELECT event_id, row_number() OVER w AS version, epoch_us(first_value(ts) OVER w) AS created_us FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)",
    "persona_domains": """WITH s AS (SELECT event_type AS domain, trim(props) AS statement, min(event_id) AS pos FROM events WHERE event_id % 11 >= 7 GROUP BY 1, 2),
        d AS (SELECT domain, min(pos) AS pos, count(*) AS statements, string_agg(statement, '; ' ORDER BY pos) AS whole FROM s GROUP BY domain),
        m AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY pos) - 1 AS k, 900 - (16 + count(*) OVER () - 1 + sum(length(domain) + 5) OVER ()) AS free FROM d),
        a AS (SELECT *, (free // n + (k < free % n)::INT)::BIGINT AS most, sum(length(whole)) OVER () <= free AS fits FROM m)
        SELECT domain, pos, statements, '- [' || domain || '] ' || CASE WHEN fits OR length(whole) <= most THEN whole ELSE rtrim(left(whole, most - 1)) || '…' END AS line FROM a""",
    "event_dispositions": "SELECT user_id AS scope_id, CASE WHEN value > 50 THEN 'used' ELSE 'no_durable_signal' END AS disposition, count(*) AS n FROM events GROUP BY 1, 2",
    "evidence_gaps": "SELECT scope_id, event_type FROM (SELECT DISTINCT user_id AS scope_id FROM events), (SELECT unnest(['click', 'view', 'purchase', 'audit']) AS event_type) EXCEPT SELECT user_id, event_type FROM events",
    "evaluation_status": f"""SELECT audit_id, CASE WHEN bad THEN 'MANUAL_REVIEW' ELSE 'EVALUATED' END AS status, CASE policy WHEN 'always' THEN true WHEN 'manual_on_review' THEN bad ELSE false END AS needs_approval
        FROM (SELECT *, errors OR missing OR conflicts OR adverse AS bad FROM ({_AUDITS}))""",
    "fail_closed_decision": f"SELECT audit_id, CASE WHEN errors OR missing OR conflicts THEN 'manual_review' WHEN adverse THEN 'reject' ELSE 'approved' END AS decision, CASE WHEN errors THEN 'ontology' WHEN missing THEN 'missing facts' WHEN conflicts THEN 'conflict' WHEN adverse THEN 'rule' ELSE 'no rule' END AS reason FROM ({_AUDITS})",
    "evaluation_rates": "SELECT doc_id % 6 AS run, sum(quality)::DOUBLE / count(*) AS good_rate, sum(quality)::DOUBLE / count(*) >= 0.5 AS good_ok FROM labels GROUP BY 1",
    "graph_as_of": f"WITH n AS (SELECT id FROM ({_NODES}) WHERE {_VALID}) SELECT edge_pos FROM ({_EDGES}) WHERE {_VALID} AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)",
    "trace_subgraph": f"""WITH n AS (SELECT id FROM ({_NODES}) WHERE left(id, 1) <> 'o' OR sha256(id) < '6') SELECT type, count(*) AS n FROM ({_EDGES}) WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) GROUP BY type""",
    "dangling_edges": f"SELECT DISTINCT edge_pos FROM ({_EDGES}) WHERE source IN ('s1', 's2', 'c7') OR target IN ('s1', 's2', 'c7') OR source NOT IN (SELECT id FROM ({_NODES})) OR target NOT IN (SELECT id FROM ({_NODES}))",
    "khop_neighbours": f"""WITH e AS (SELECT * FROM ({_EDGES}) WHERE invalidated_at IS NULL), b AS (SELECT source AS here, target AS id, type, 'out' AS direction, edge_pos FROM e UNION ALL SELECT target, source, type, 'in', edge_pos FROM e),
        s AS (SELECT 'c' || c_custkey AS start FROM customer WHERE c_custkey % 100 = 0),
        h1 AS (SELECT start, b.id, 1 AS hop, b.type, direction, edge_pos AS found FROM s JOIN b ON b.here = start QUALIFY row_number() OVER (PARTITION BY start, b.id ORDER BY edge_pos, direction DESC) = 1),
        h2 AS (SELECT start, b.id, 2 AS hop, b.type, b.direction, 0 AS found FROM h1 JOIN b ON b.here = h1.id QUALIFY row_number() OVER (PARTITION BY start, b.id ORDER BY h1.found, b.edge_pos, b.direction DESC) = 1)
        SELECT start, id, hop, type, direction FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 WHERE id <> start AND (start, id) NOT IN (SELECT (start, id) FROM h1))""",
    "causal_chain": f"""WITH RECURSIVE c AS (SELECT DISTINCT source, target FROM ({_EDGES}) WHERE type IN ('CAUSED', 'INFLUENCED', 'PRECEDENT_FOR')),
        u AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS id, 0 AS step FROM supplier UNION ALL SELECT start, source, step + 1 FROM u JOIN c ON c.target = u.id WHERE step < 5)
        SELECT start, id, min(step) AS step FROM u WHERE step > 0 GROUP BY start, id""",
    "fact_nodes": """SELECT subject, predicate, string_agg(object, ',' ORDER BY pos) AS "values" FROM (SELECT o_custkey AS subject, o_orderpriority AS predicate, o_orderstatus AS object, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "fact_conflicts": """SELECT o_custkey::VARCHAR AS subject, o_orderpriority AS predicate, count(DISTINCT o_orderstatus) AS "values", count(DISTINCT o_orderkey) AS sources,
        CASE WHEN count(DISTINCT o_orderstatus) > 2 THEN 'high' ELSE 'medium' END AS severity, left(sha256(o_custkey || '|' || o_orderpriority), 16) AS conflict_id FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(DISTINCT o_orderstatus) > 1""",
    "entity_resolution": """WITH c AS (SELECT 'c' || c_custkey AS entity_id, c_custkey AS pos, lower(regexp_replace(regexp_replace(c_name, '[0-9]{2}$', ''), '[^A-Za-z0-9_]+', '', 'g')) AS k, c_mktsegment AS t, c_custkey % 9 / 10 AS confidence FROM customer)
        SELECT entity_id, arg_min(entity_id, pos) OVER w AS resolved_id, max(confidence) OVER w AS confidence FROM c WINDOW w AS (PARTITION BY t, k)""",
    "rule_evaluation": """WITH m AS (SELECT o_orderkey AS subject, 'r1' AS rule_id, 'reject' AS conclusion, 10 AS p FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O' UNION ALL
        SELECT o_orderkey, 'r2', 'review', 5 FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') UNION ALL SELECT o_orderkey, 'r3', 'note', 5 FROM orders WHERE contains(o_orderpriority, 'LOW') AND o_totalprice <= 100000)
        SELECT subject, rule_id, conclusion, (row_number() OVER (PARTITION BY subject ORDER BY p DESC, rule_id))::INT AS place FROM m""",
    "ontology_errors": """WITH n AS (SELECT event_id AS id, event_type AS type, event_id % 10 = 0 AS other, CASE WHEN event_id % 14 = 0 THEN 'many' ELSE json_extract_string(props, '$.k') END AS v FROM events)
        SELECT id, 'k' AS field, CASE WHEN type = 'click' THEN CASE WHEN other OR v IS NULL THEN 'missing' ELSE 'type' END ELSE 'value' END AS error FROM n
        WHERE type = 'click' AND (other OR v IS NULL OR try_cast(v AS DOUBLE) IS NULL) OR type = 'view' AND NOT other AND v NOT IN ('1', '2', '3', 'many')""",
    "chain_verify": """WITH RECURSIVE e AS (SELECT user_id AS chain_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence_id, event_id, event_type, props FROM events),
        c AS (SELECT chain_id, sequence_id, event_id, event_type, props, '' AS previous, sha256(concat_ws('|', sequence_id, event_id, event_type, props, '')) AS checksum FROM e WHERE sequence_id = 1 UNION ALL
        SELECT e.chain_id, e.sequence_id, e.event_id, e.event_type, e.props, c.checksum, sha256(concat_ws('|', e.sequence_id, e.event_id, e.event_type, e.props, c.checksum)) FROM c JOIN e ON e.chain_id = c.chain_id AND e.sequence_id = c.sequence_id + 1),
        t AS (SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN '{}' ELSE props END AS props) FROM c WHERE event_id % 101 <> 0),
        k AS (SELECT *, row_number() OVER w AS n, coalesce(lag(checksum) OVER w, '') AS before FROM t WINDOW w AS (PARTITION BY chain_id ORDER BY sequence_id)),
        r AS (SELECT * REPLACE (CASE WHEN event_id % 101 = 1 THEN before ELSE previous END AS previous) FROM k)
        SELECT chain_id, sequence_id::INT AS sequence_id, 'sequence' AS error FROM r WHERE sequence_id <> n UNION ALL SELECT chain_id, sequence_id::INT, 'link' FROM r WHERE previous <> before
        UNION ALL SELECT chain_id, sequence_id::INT, 'checksum' FROM r WHERE checksum <> sha256(concat_ws('|', sequence_id, event_id, event_type, props, previous))""",
    "snapshot_fingerprint": "SELECT source, sha256(string_agg(lpad(doc_id::VARCHAR, 9, '0') || chr(0) || text || chr(0), '' ORDER BY doc_id)) AS fingerprint, count(*) AS files FROM documents GROUP BY source",
    "manifest_differences": "SELECT doc_id AS name, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'unlisted' ELSE 'changed' END AS reason FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 5 = 0 OR doc_id % 11 = 0) OR doc_id % 7 = 0 AND doc_id % 5 <> 0",
    "compliance_report": "SELECT user_id AS decision_id, count(*) FILTER (value > 99) AS violations, count(*) FILTER (value > 50 AND value <= 99) AS approvals, count(*) FILTER (value > 99) = 0 AND count(*) FILTER (value > 50 AND value <= 99) > 0 AS compliant FROM events GROUP BY user_id",
    "turtle_lines": f"""SELECT '<urn:node:' || left(sha256(source), 24) || '> <urn:rel:relatedTo> <urn:node:' || left(sha256(target), 24) || '> .' AS line FROM ({_EDGES}) UNION ALL
        SELECT '<urn:node:' || left(sha256(id), 24) || '> a <urn:type:' || CASE left(id, 1) WHEN 'o' THEN 'order' WHEN 'c' THEN 'customer' ELSE 'supplier' END || '> .' FROM ({_NODES}) UNION ALL
        SELECT '<urn:node:' || left(sha256('c' || c_custkey), 24) || '> prov:wasDerivedFrom <urn:node:' || left(sha256('c1'), 24) || '> .' FROM customer WHERE c_custkey % 2 = 0 UNION ALL
        SELECT '<urn:node:' || left(sha256('c' || c_custkey), 24) || '> <urn:rel:checksum> "' || sha256(c_name) || '" .' FROM customer UNION ALL
        SELECT '<urn:node:' || left(sha256('c' || c_custkey), 24) || '> <urn:rel:invalidated> true .' FROM customer WHERE c_custkey % 10 = 0""",
    "ordered_evidence": "SELECT l_orderkey AS decision_id, string_agg(p_brand, ',' ORDER BY l_linenumber, l_partkey) AS evidence FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 5 <> 0 GROUP BY l_orderkey",
    "json_statements": """WITH r AS (SELECT *, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [0] ELSE [0, 2] END)::BIGINT AS pos FROM orders WHERE o_orderkey <> 0)
        SELECT 'orders' AS source_id, o_orderkey AS chunk_id, pos, 'entity' AS kind, o_orderkey::VARCHAR AS entity, 'LoanApplication' AS predicate, o_orderstatus AS told FROM r
        UNION ALL SELECT 'orders', o_orderkey, pos, 'triple', o_orderkey::VARCHAR, 'customer', '{"o_custkey":' || o_custkey || '}' FROM r UNION ALL SELECT 'orders', o_orderkey, pos, 'triple', o_orderkey::VARCHAR, 'flags', '["' || o_orderpriority || '"]' FROM r
        UNION ALL SELECT 'lines', l_orderkey, 0, 'triple', l_orderkey::VARCHAR, 'line', l_linenumber::VARCHAR FROM lineitem""",
    "card_fields": """SELECT doc_id AS source_id, 'id' AS key, doc_id::VARCHAR AS value FROM documents UNION ALL SELECT doc_id, 'domain', '"d-' || doc_id || '"' FROM documents
        UNION ALL SELECT doc_id, 'sources', '["e1","' || doc_id || '"]' FROM documents UNION ALL SELECT doc_id, 'more', '{"a":[' || doc_id || ']}' FROM documents""",
    "extracted_records": "SELECT o_orderkey AS source_id, 0 AS pos, 'ENTITY' AS kind, o_orderkey::VARCHAR AS first, 'order' AS second, 'o' AS third FROM orders UNION ALL SELECT o_orderkey, 1, 'RELATION', o_custkey::VARCHAR, 'placed', o_orderkey::VARCHAR FROM orders",
    "latency_stats": f"SELECT * REPLACE (round(mean, 6) AS mean) FROM ({_STATS})",
    "slo_verdicts": f"SELECT operation, n > 0 AND errors = 0 AND p95 <= 150 AND p99 <= 300 AS ok FROM ({_STATS})",
    "latency_histogram": f"SELECT operation, count(*) FILTER (latency_ms <= 10) AS le_0, count(*) FILTER (latency_ms <= 50) AS le_1, count(*) FILTER (latency_ms <= 100) AS le_2, count(*) AS n FROM ({_SAMPLES}) GROUP BY operation",
    "role_counts": "SELECT conv_id AS session_id, count(*) FILTER (role = 'system') AS system, count(*) FILTER (role = 'user') AS user, count(*) FILTER (role = 'assistant') AS assistant FROM conversations GROUP BY conv_id",
}

QUERIES = {f.__name__: f for f in (
    transcript_lines, transcript_grep, grep_context, sql_grep, sql_read, grep_counts, grep_multiline, transcript_page, transcript_read, grep_budget, resolved_markers, due_scopes, review_batches, pending_events, task_gates, duplicate_events, latest_activity,
    job_states, publication_transitions, artifact_decisions, batch_verdicts, reinforced_confidence, consolidated_entries, card_versions, persona_domains, event_dispositions, evidence_gaps, evaluation_status, fail_closed_decision,
    evaluation_rates, graph_as_of, trace_subgraph, dangling_edges, khop_neighbours, causal_chain, fact_nodes, fact_conflicts, entity_resolution, alias_resolution, rule_evaluation, ontology_errors, chain_verify, snapshot_fingerprint,
    manifest_differences, compliance_report, turtle_lines, ordered_evidence, extracted_records, json_statements, card_fields, latency_stats, slo_verdicts, latency_histogram, role_counts,
)}
