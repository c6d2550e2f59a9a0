"""Governance of memories: risk, verdicts, consolidation, evidence and the audit decision."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from recollect.functions import text as T
from recollect.operators.dealing import in_order
from recollect.operators.graph import components

# What makes a text one of high risk, whatever its case.
HIGH_RISK = (
    r"\b(?:my|user(?:'s)?)\s+(?:password|verification code|full card number|identity number)\b",
    r"\b(?:my|user(?:'s)?)\s+(?:passport|identity|social security|tax)(?:\s+(?:number|id))?\s*(?:is|:|=)",
    r"(?:我的|用户的)(?:密码|验证码|完整卡号|身份证号)",
    r"(?:我的|用户的)(?:护照号|身份证号|社保号|税号)\s*(?:是|为|：|:)",
    r"(?<!never )(?<!not )(?<!don't )\b(?:skip|bypass)\b.{0,24}\b(?:approval|confirmation|verification)\b",
    r"\b(?:do not|does not|don't|doesn't) need\b.{0,20}\b(?:approval|confirmation|verification)\b",
    r"\b(?:allow|permit).{0,24}\b(?:payment|transfer)s?\b.{0,24}\bwithout (?:approval|confirmation|verification)\b",
    r"(?:转账|付款).{0,16}(?:不用|无需|跳过).{0,12}(?:确认|审批|验证)",
    r"(?:绕过|跳过).{0,16}(?:验证|审批|权限|安全)",
)
# The least confidence of each kind, and the attributes that each must have.
LEAST = {"user_profile": 0.7, "decision_card": 0.8, "skill": 0.8}
NEEDS = {"decision_card": ("scenario", "signals", "principle", "boundaries"), "skill": ("scenario", "inputs", "steps", "output_template", "cautions")}
MODES = ("require_review", "observe", "auto_activate")


def high_risk(text: Column) -> Column:
    """Any of the patterns (FLT6)."""
    return F.rlike(text, F.lit("(?i)" + "|".join(f"(?:{p})" for p in HIGH_RISK)))


def decide(artifacts: DataFrame) -> DataFrame:
    """mode of each artifact: review for risk, else observed for missing evidence, confidence or attributes (GOV1).

    Artifacts have artifact_type, content, confidence, declared_risk, source_event_ids and attributes (a map). What is
    null counts against an artifact: no confidence is 0, no sources are none, no type is an unknown one, no attribute is
    missing. An attribute of blanks alone is there.
    """
    kind = F.coalesce("artifact_type", F.lit(""))
    least = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in LEAST.items()), F.lit(0.0))
    lacks = F.coalesce(*(F.when(kind == k, F.exists(F.array(*(F.lit(x) for x in v)), lambda x: F.coalesce(F.try_element_at("attributes", x), F.lit("")) == "")) for k, v in NEEDS.items()), F.lit(False))
    mode = (
        F.when((F.coalesce("declared_risk", F.lit("")) == "high") | high_risk(F.coalesce("content", F.lit(""))), "require_review")
        .when(F.coalesce(F.size("source_event_ids"), F.lit(0)) <= 0, "observe")
        .when(~kind.isin(*LEAST), "require_review")
        .when(F.coalesce("confidence", F.lit(0.0)) < least, "observe")
        .when(lacks, "observe")
        .otherwise("auto_activate")
    )
    return artifacts.withColumn("mode", mode)


def batch_verdicts(decided: DataFrame, *batch: str) -> DataFrame:
    """The most restrictive mode of each batch, and the first artifact that has it (AGG7)."""
    order = F.coalesce(*(F.when(F.col("mode") == m, F.lit(i)) for i, m in enumerate(MODES)))
    return decided.groupBy(*batch).agg(F.min_by("mode", F.struct(order, "pos")).alias("mode"), F.min_by("pos", F.struct(order, "pos")).alias("pos"))


def reinforced(candidates: DataFrame, *key: str) -> DataFrame:
    """Candidates of one content with their joint confidence (noisy or, 1 at most) and number of sources (AGG6, JN3)."""
    joint = 1 - F.product(1 - F.col("confidence"))
    return candidates.groupBy(*key).agg(F.least(F.lit(1.0), joint).alias("confidence"), F.count_distinct("source_id").alias("sources"), F.count("*").alias("mentions"))


def consolidated(entries: DataFrame, content: str = "content") -> DataFrame:
    """Entries of one normalised text as one: the first's text, and the numbers folded and of sources (AGG8, AGG9).

    Entries have a pos of their own each. Digests are grouped, not texts; the first entries' texts are fetched by pos.
    """
    key = F.unhex(F.sha2(T.normalized(F.col(content)), 256))
    first = entries.groupBy(key.alias("key"), "source_id").agg(F.min("pos").alias("pos"), F.count("*").alias("entries"))
    sums = first.groupBy("key").agg(F.min("pos").alias("pos"), F.sum("entries").alias("entries"), F.count("source_id").alias("sources"))
    return sums.join(entries.select("pos", F.col(content).alias("content")), "pos").select("content", "pos", "entries", "sources")


def versions(cards: DataFrame, *key: str) -> DataFrame:
    """Version numbers, the first row's time, and the sources so far, in order (WIN20, SNK13)."""
    by = Window.partitionBy(*key).orderBy("updated_at", "event_id")
    return cards.withColumn("version", F.row_number().over(by)).withColumn("created_at", F.first("updated_at").over(by.rowsBetween(Window.unboundedPreceding, 0)))


def persona(entries: DataFrame, limit: int, least: float = 0.7, *scope: str) -> DataFrame:
    """By domain, in order of first entries: its distinct statements that are sure enough, in one line of bounded length (AGG10).

    Where a scope's lines are longer than ``limit`` together, all domains get an equal allowance of characters for their
    statements, the first ones one more till the rest is used; what is cut ends in an ellipsis. A limit that does not
    leave a character for each domain is an error.
    """
    statement = F.trim(F.regexp_replace("content", r"\s+", " "))
    sure = entries.where((F.col("confidence") >= least) & (statement != "")).groupBy(*scope, "domain", statement.alias("statement")).agg(F.min("pos").alias("pos"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "statement")))
    lines = sure.groupBy(*scope, "domain").agg(F.min("pos").alias("pos"), F.count("*").alias("statements"), F.array_join(F.transform(ordered, lambda x: x["statement"]), "; ").alias("all"))
    of_scope = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(0))  # a row for each domain
    prefix = F.concat(F.lit("- ["), "domain", F.lit("] "))
    n, place = F.count("*").over(of_scope), F.row_number().over(of_scope.orderBy("pos")) - 1
    fixed = F.lit(len("# User Persona\n\n")) + n - 1 + F.sum(F.length(prefix)).over(of_scope)
    measured = lines.withColumn("_n", n).withColumn("_place", place).withColumn("_left", F.lit(limit) - fixed).withColumn("_whole", fixed + F.sum(F.length("all")).over(of_scope))
    allowed = F.floor(F.col("_left") / F.col("_n")) + (F.col("_place") < F.col("_left") % F.col("_n")).cast("int")
    short = F.when(F.col("_left") < F.col("_n"), F.raise_error(F.lit("the limit leaves no character for some domain")))
    excerpt = F.when(F.length("all") <= allowed, F.col("all")).when(allowed <= 1, F.left("all", allowed.cast("int"))).otherwise(F.concat(F.rtrim(F.left("all", (allowed - 1).cast("int"))), F.lit("…")))
    line = F.concat(prefix, F.when(F.col("_whole") <= limit, F.col("all")).otherwise(F.coalesce(short.cast("string"), excerpt)))
    return measured.select(*scope, "domain", "pos", "statements", line.alias("line"))


def dispositions(events: DataFrame, uses: DataFrame) -> DataFrame:
    """Exactly one disposition of each event: used where any action cites it (GOV9)."""
    cited = uses.select("event_id").distinct().withColumn("_used", F.lit(True))
    return events.join(cited, "event_id", "left").withColumn("disposition", F.when(F.col("_used"), "used").otherwise("no_durable_signal")).drop("_used")


def evidence_gaps(required: DataFrame, observed: DataFrame, *key: str) -> DataFrame:
    """Required values that were not observed (JN10, SET6)."""
    return required.join(observed, list(key), "left_anti")


def evaluation_status(audits: DataFrame) -> DataFrame:
    """Manual review for any error, missing field, conflict or adverse conclusion (GOV11), and whether approval is needed (GOV12)."""
    bad = (F.col("errors") > 0) | (F.col("missing") > 0) | (F.col("conflicts") > 0) | (F.col("adverse") > 0)
    status = F.when(bad, "MANUAL_REVIEW").otherwise("EVALUATED")
    needs = F.when(F.col("approval_policy") == "always", True).when(F.col("approval_policy") == "manual_on_review", bad).otherwise(False)
    return audits.withColumn("status", status).withColumn("needs_approval", needs)


def recorded_decision(audits: DataFrame) -> DataFrame:
    """outcome and status of evaluated audits with a proposed outcome: a manual review overrules it (GOV12, STR14).

    manual_on_review asks for approval where the outcome is a manual review, be it proposed or forced.
    """
    outcome = F.when(F.col("status") == "MANUAL_REVIEW", "manual_review").otherwise(F.col("proposed"))
    needs = (F.col("approval_policy") == "always") | ((F.col("approval_policy") == "manual_on_review") & (outcome == "manual_review"))
    return audits.withColumn("outcome", outcome).withColumn("status", F.when(needs, "PENDING_APPROVAL").otherwise("EVALUATED"))


def submitted(requests: DataFrame, decisions: DataFrame, allowed: DataFrame) -> DataFrame:
    """Approvals and exceptions in order (pos) with their outcome, and the final status of decisions that are approved (GOV13, FLT15, STR14).

    requests: pos, approval_id, decision_id, approver, role, action (approve, reject, or exception). A request that is not
    authorised is refused. One whose id was accepted before is a replay if its content is the same, else a conflict of ids;
    approvals and exceptions have ids of their own. Others need a decision that is known and pending: an approval settles it,
    an exception is recorded and leaves it pending. What is refused uses up neither its id nor its decision. Requests that
    are connected by ids and decisions are folded in order as a sorted stream, which keeps what was accepted there.
    """
    may = allowed.select("approver", "role").distinct().withColumn("_may", F.lit(True))
    known = decisions.select("decision_id", F.col("status").alias("_status"))
    each = requests.join(may, ["approver", "role"], "left").join(known, "decision_id", "left").withColumn("_kind", F.col("action") == "exception").withColumn("_may", F.coalesce("_may", F.lit(False)))
    node = lambda kind, c: F.concat(kind, F.lit(":"), F.col(c).cast("string"))
    of_id, of_decision = node(F.when(F.col("_kind"), "e").otherwise("a"), "approval_id"), node(F.lit("d"), "decision_id")
    roots = components(each.where("_may").select(of_id.alias("a"), of_decision.alias("b")))
    dealt = each.withColumn("node", of_id).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    content = F.to_json(F.struct("decision_id", "approver", "role", "action"), {"ignoreNullFields": "false"})
    columns = "root", "pos", "_kind", F.col("approval_id").cast("string").alias("id"), F.col("decision_id").cast("string").alias("decision"), content.alias("content"), "_may", "_status"
    pos = requests.schema["pos"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, accepted, settled = None, {}, set()
        for batch in batches:
            out = []
            for root, _, exception, name, decision, said, may_, status in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if root != component:
                    component, accepted, settled = root, {}, set()
                if not may_:
                    out.append("not authorized")
                elif (exception, name) in accepted:
                    out.append("replay" if accepted[exception, name] == said else "id conflict")
                elif status is None:
                    out.append("unknown decision")
                elif status != "PENDING_APPROVAL" or decision in settled:
                    out.append("not pending")
                else:
                    out.append("accepted")
                    accepted[exception, name] = said
                    if not exception:
                        settled.add(decision)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.string())], names=["pos", "outcome"])

    stream = in_order(dealt.select(*columns), ["root"], "pos")
    outcome = stream.mapInArrow(run, StructType([StructField("pos", pos), StructField("outcome", StringType())]))
    settles = (F.col("outcome") == "accepted") & (F.col("action") != "exception")
    return requests.join(outcome, "pos").withColumn("final_status", F.when(settles, F.when(F.col("action") == "approve", "APPROVED").otherwise("REJECTED")))


def gate_reasons(runs: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """reasons: the names of the checks that do not hold, in order; none where a run passes its gate (AGG11)."""
    return runs.withColumn("reasons", F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()))))


def fail_closed(audits: DataFrame) -> DataFrame:
    """The decision and why, by the first that applies: ontology errors, missing facts and critical conflicts go to manual
    review, then a conclusion, else approval (GOV14)."""
    bad = F.when(F.col("errors") > 0, "ontology").when(F.col("missing") > 0, "missing facts").when(F.col("conflicts") > 0, "conflict")
    outcome = F.when(bad.isNotNull(), "manual_review").otherwise(F.coalesce("conclusion", F.lit("approved")))
    return audits.withColumn("decision", outcome).withColumn("reason", F.coalesce(bad, F.when(F.col("conclusion").isNotNull(), "rule").otherwise("no rule")))


def rates(runs: DataFrame, *key: str, thresholds: tuple[tuple[str, str, float], ...] = ()) -> DataFrame:
    """Sums of successes over totals, 0 where there is no total, and whether each reaches its threshold (AGG11)."""
    out = runs.groupBy(*key).agg(*(F.coalesce(F.try_divide(F.sum(s), F.sum(t)), F.lit(0.0)).alias(f"{s}_rate") for s, t, _ in thresholds))
    for s, _, least in thresholds:
        out = out.withColumn(f"{s}_ok", F.col(f"{s}_rate") >= least)
    return out
