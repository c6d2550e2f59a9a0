"""Provenance and audit graphs: lineage, tombstones, and the nodes and edges that decisions, facts and evidence make.

Entries have chain_id, sequence_id, entry_id, entity_id, entity_type, payload, derived_from (entity or entry ids), agent_id and
invalidated. ``audit.chained`` and ``audit.chain_errors`` make and verify the chain of checksums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.sources.folders import shared_folder


def latest(entries: DataFrame) -> DataFrame:
    """The current entry of each entity of a chain."""
    by = Window.partitionBy("chain_id", "entity_id").orderBy(F.desc("sequence_id"))
    return entries.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def _paths(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """entry_id, head and steps: entries on a path without forks, and how far down it they are from its first one, the head.

    An entry goes on the path of its child where it is that child's only parent, has no other child and is no start. Pointers to
    heads are doubled: a path of n entries takes log2(n) rounds of one join. Rings that nothing outside leads to are left out.
    """
    shared_folder(parents.sparkSession)
    one = parents.groupBy("chain_id", "child").agg(F.count("*").alias("n"), F.first("entry_id").alias("entry_id")).where("n = 1").drop("n")
    only = parents.groupBy("chain_id", "entry_id").agg(F.count("*").alias("n"), F.first("child").alias("child")).where("n = 1").drop("n")
    links = one.join(only, ["chain_id", "child", "entry_id"]).where("child <> entry_id").join(starts, ["chain_id", "entry_id"], "left_anti")
    rows = links.select("chain_id", "entry_id", F.col("child").alias("head"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open")).checkpoint()
    for _ in range(rows.count().bit_length() + 1):
        further = rows.select("chain_id", F.col("entry_id").alias("head"), F.col("head").alias("_head"), F.col("steps").alias("_steps"))
        rows = rows.join(further, ["chain_id", "head"], "left").select("chain_id", "entry_id", F.coalesce("_head", "head").alias("head"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_head").isNotNull().alias("open")).checkpoint()
        if rows.where("open").isEmpty():
            break
    return rows.where("not open").drop("open")


def lineage(entries: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """Of each start (chain_id, start) the entries it derives from, itself first, in the order of a search in depth (GR8, GR9).

    A reference is an entry's id, else the latest entry of an entity; others lead nowhere. An entry is placed by the least
    of the ways to it, which is where such a search meets it first: a way is the list of places in ``derived_from`` taken at forks.
    Paths without forks are one step, whatever their length, so rounds and the length of ways grow with the forks on a way only.
    With ``depth``, an ancestry that goes on beyond so many entries is an error.
    """
    shared_folder(entries.sparkSession)
    by_entity = latest(entries).select("chain_id", F.col("entity_id").alias("ref"), "entry_id", F.lit(1).alias("rank"))
    names = entries.select("chain_id", F.col("entry_id").alias("ref"), "entry_id", F.lit(0).alias("rank")).unionByName(by_entity).groupBy("chain_id", "ref").agg(F.min_by("entry_id", "rank").alias("entry_id"))
    refs = entries.select("chain_id", F.col("entry_id").alias("child"), F.posexplode("derived_from").alias("nth", "ref")).join(names, ["chain_id", "ref"])
    parents = refs.groupBy("chain_id", "child", "entry_id").agg(F.min("nth").alias("nth")).checkpoint()
    least = lambda rows: rows.groupBy("chain_id", "start", "entry_id").agg(F.min(F.struct("way", "steps")).alias("w")).select("chain_id", "start", "entry_id", "w.way", "w.steps")
    seen = starts.select("chain_id", "start", F.col("start").alias("ref")).join(names, ["chain_id", "ref"]).select("chain_id", "start", "entry_id", F.array().cast("array<int>").alias("way"), F.lit(0).cast("long").alias("steps"))
    seen = least(seen).checkpoint()
    paths = _paths(parents, seen.select("chain_id", "entry_id").distinct())
    above = paths.select("chain_id", F.col("entry_id").alias("child"), "head", "steps")
    forks = parents.join(paths.select("chain_id", "entry_id"), ["chain_id", "entry_id"], "left_anti").join(above, ["chain_id", "child"], "left")
    forks = forks.select("chain_id", F.coalesce("head", "child").alias("head"), "nth", "entry_id", (F.coalesce("steps", F.lit(0)) + 1).alias("more")).checkpoint()
    front = seen
    while not front.isEmpty():
        reached = front.withColumnRenamed("entry_id", "head").join(forks, ["chain_id", "head"])
        best = least(reached.select("chain_id", "start", "entry_id", F.concat("way", F.array("nth")).alias("way"), (F.col("steps") + F.col("more")).alias("steps")))
        known = seen.select("chain_id", "start", "entry_id", F.col("way").alias("_way"))
        front = best.join(known, ["chain_id", "start", "entry_id"], "left").where(F.col("_way").isNull() | (F.col("way") < F.col("_way"))).drop("_way").checkpoint()
        seen = least(seen.unionByName(front)).checkpoint()
    at = F.lit(0).cast("long").alias("at")
    on = paths.select("chain_id", "head", F.col("entry_id").alias("own"), F.col("steps").alias("at"))
    inner = seen.withColumnRenamed("entry_id", "head").join(on, ["chain_id", "head"]).select("chain_id", "start", F.col("own").alias("entry_id"), "way", "steps", "at")
    found = seen.select("chain_id", "start", "entry_id", "way", "steps", at).unionByName(inner)
    if depth is not None and not found.where(F.col("steps") + F.col("at") >= depth).isEmpty():
        raise RuntimeError(f"the ancestry goes on beyond {depth} steps")
    place = F.row_number().over(Window.partitionBy("chain_id", "start").orderBy("way", "at"))
    return found.withColumn("place", place).select("chain_id", "start", "entry_id", "place")


def tombstones(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """New entries that invalidate entities (chain_id, entity_id, agent_id, reason), derived from their current entries (GR10).

    They are numbered on from the chain's last, in order of entity; an entity that is not there is an error row (no entry_id).
    """
    now = latest(entries).select("chain_id", "entity_id", "entity_type", "payload", F.array("entry_id").alias("derived_from"))
    last = entries.groupBy("chain_id").agg(F.max("sequence_id").alias("_last"))
    out = requests.join(now, ["chain_id", "entity_id"], "left").join(last, "chain_id", "left")
    found = F.col("entity_type").isNotNull()
    nth = F.sum(found.cast("int")).over(Window.partitionBy("chain_id").orderBy("entity_id"))
    number = F.when(found, F.col("_last") + nth)
    entry_id = F.when(found, F.concat(F.lit("prov:"), F.left(F.sha2(F.concat_ws(":", F.col("chain_id").cast("string"), number.cast("string"), "entity_id"), 256), F.lit(32))))
    return out.withColumn("sequence_id", number).withColumn("entry_id", entry_id).withColumn("invalidated", found).drop("_last")


def _edges(rows: DataFrame, source: Column | str, target: Column | str, kind: str) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(col(source).cast("string").alias("source"), col(target).cast("string").alias("target"), F.lit(kind).alias("type"))


def decision_graph(decisions: DataFrame, approvals: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Edges that recording makes (GR11): evidence used, policies applied, approvals and exceptions of known decisions.

    decisions: decision_id, evidence_ids, rule_refs (policy_id and version); the others: their id and decision_id.
    """
    known = decisions.select("decision_id")
    used = _edges(decisions.select("decision_id", F.explode("evidence_ids").alias("t")), "decision_id", "t", "USED_EVIDENCE")
    applied = _edges(decisions.select("decision_id", F.explode("rule_refs").alias("r")), "decision_id", F.concat_ws(":", "r.policy_id", "r.version"), "APPLIED_POLICY")
    approved = _edges(approvals.join(known, "decision_id", "left_semi"), "decision_id", "approval_id", "HAS_APPROVAL")
    excepted = _edges(exceptions.join(known, "decision_id", "left_semi"), "decision_id", "exception_id", "HAS_POLICY_EXCEPTION")
    return used.unionByName(applied).unionByName(approved).unionByName(excepted)


def unknown_references(decisions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Evidence and policies of decisions that are no nodes, which may not be recorded (GR11)."""
    refs = decisions.select("decision_id", F.explode(F.concat("evidence_ids", F.transform("rule_refs", lambda r: F.concat_ws(":", r["policy_id"], r["version"])))).alias("id"))
    return refs.join(nodes.select("id"), "id", "left_anti")


def fact_id(*parts: str) -> Column:
    """The id of a fact from its subject, predicate, object, source and chunk."""
    return F.concat(F.lit("fact:"), F.left(F.sha2(F.to_json(F.array(*(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))), 256), F.lit(20)))


def fact_graph(triplets: DataFrame, nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Edges from known subjects to their facts, and from events to their participants (GR12).

    triplets: subject, predicate, object, source_id, chunk_id; events: event_id and participants.
    """
    facts = triplets.withColumn("_fact", fact_id("subject", "predicate", "object", "source_id", "chunk_id"))
    has = _edges(facts.join(nodes.select(F.col("id").alias("subject")), "subject", "left_semi"), "subject", "_fact", "HAS_FACT")
    return has.unionByName(_edges(events.select("event_id", F.explode("participants").alias("p")), "event_id", "p", "HAS_PARTICIPANT"))


def fact_index(triplets: DataFrame) -> DataFrame:
    """Of each subject and predicate the ids of its facts, in order of pos (GR12)."""
    item = F.struct("pos", fact_id("subject", "predicate", "object", "source_id", "chunk_id").alias("fact"))
    return triplets.groupBy("subject", "predicate").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["fact"]).alias("facts"))


def audit_graph(audits: DataFrame) -> DataFrame:
    """Edges of audits (GR14): the profile they were made by, the evidence they were given, and the decision.

    audits: audit_id, agent_id, profile_version, evidence_ids and decision_id (null before a decision).
    """
    by = _edges(audits, "audit_id", F.concat_ws(":", F.lit("profile"), "agent_id", "profile_version"), "EVALUATED_WITH")
    given = _edges(audits.select("audit_id", F.explode("evidence_ids").alias("e")), "audit_id", "e", "HAS_EVIDENCE")
    return by.unionByName(given).unionByName(_edges(audits.where("decision_id is not null"), "audit_id", "decision_id", "HAS_DECISION"))


def critical_conflicts(conflicts: DataFrame, subjects: DataFrame, fields: DataFrame) -> DataFrame:
    """Conflicts of selected subjects over fields that some rule asks for (JN12)."""
    return conflicts.join(subjects.select("subject"), "subject", "left_semi").join(fields.select(F.col("field").alias("predicate")).distinct(), "predicate", "left_semi")


def policy_sources(rules: DataFrame, documents: DataFrame, gram: int = 8) -> DataFrame:
    """rule_id and source_id of documents whose id holds the name of the rule's source, up to a # (JN17).

    The key is the name's first ``gram`` characters, the whole name where it is shorter: ids are cut into pieces of the lengths
    that such keys have, and what meets is compared in full. An empty name (a reference that begins with #) is part of every id.
    """
    name = F.split("source_ref", "#")[0]
    named = rules.where("source_ref <> ''").select("rule_id", name.alias("_name"), F.left(name, F.lit(gram)).alias("_key"))
    lengths = sorted(r[0] for r in named.select(F.length("_key")).distinct().collect())  # from 0 to ``gram``
    ids = documents.select("source_id")
    none = F.array().cast("array<string>")

    def pieces(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length("source_id") - n + 1), lambda i: F.substring(F.col("source_id"), i, F.lit(n)))
        return F.when(F.length("source_id") >= n, each).otherwise(none)

    cut = F.array_distinct(F.concat(none, *map(pieces, lengths)))
    met = ids.select("source_id", F.explode(cut).alias("_key")).join(named, "_key")
    return met.where(F.contains("source_id", "_name")).select("rule_id", "source_id")


def first_of_type(nodes: DataFrame, kind: str, *scope: str) -> DataFrame:
    """Of each scope the node of a type that came first (SRT10)."""
    return nodes.where(F.col("type") == kind).groupBy(*scope).agg(F.min_by("id", "pos").alias("id"))


def type_errors(inputs: DataFrame, types: DataFrame) -> DataFrame:
    """Inputs (audit_id, field, value_type; null for no value) whose type is not exactly the one wanted (FLT11)."""
    return inputs.where("value_type is not null").join(types.select("field", "wanted"), "field").where(F.col("value_type") != F.col("wanted")).select("audit_id", F.concat_ws(" ", "field", F.lit("must be"), "wanted").alias("error"))


def amount_rule(inputs: DataFrame) -> DataFrame:
    """matched or mismatch of declared and booked amounts, null where one is missing (GOV16)."""
    both = F.col("declared_amount").isNotNull() & F.col("ledger_amount").isNotNull()
    return inputs.withColumn("conclusion", F.when(both, F.when(F.col("declared_amount") == F.col("ledger_amount"), "matched").otherwise("mismatch")))


def sorted_json(rows: DataFrame, *columns: str) -> Column:
    """A row as JSON with its fields in order of their names (SNK6)."""
    return F.to_json(F.struct(*sorted(columns or rows.columns)))


def html_rows(nodes: DataFrame) -> Column:
    """A row of an HTML table, with what means markup escaped, quotes of both kinds included (SNK8)."""

    def escaped(c: str) -> Column:
        text = F.col(c).cast("string")
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            text = F.replace(text, F.lit(sign), F.lit(name))
        return text

    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), escaped(c), F.lit("</td>")) for c in nodes.columns), F.lit("</tr>"))
