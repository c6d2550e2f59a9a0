"""Reviews: from a model's actions and candidates to what is stored, with the checks between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import text as T

KNOWLEDGE = ("user_preference", "decision_rule", "workflow_skill")
# What a decision card says where its candidate does not.
SIGNALS = "Relevant situation matches the extracted rule."
OUTCOME = "Apply the extracted rule consistently."
BOUNDARIES = "Use only in contexts supported by the cited events."


def artifact_of(actions: DataFrame) -> DataFrame:
    """Content and confidence of actions (GOV2): kind, and payload as an array of name, text, texts (a list) and number.

    A profile's content is that of its field content; others join all texts that are not blank, in order. Without a number
    the confidence is 0.
    """
    field = lambda n: F.get(F.filter("payload", lambda p: p["name"] == n), 0)
    texts = F.filter(F.flatten(F.transform("payload", lambda p: F.when(p["text"].isNotNull(), F.array(p["text"])).otherwise(F.coalesce(p["texts"], F.array().cast("array<string>"))))), lambda x: F.trim(x) != "")
    content = F.when(F.col("kind") == "user_profile", F.trim(F.coalesce(field("content")["text"], F.lit("")))).otherwise(F.array_join(F.transform(texts, lambda x: F.trim(x)), "\n"))
    return actions.withColumn("content", content).withColumn("confidence", F.coalesce(field("confidence")["number"], F.lit(0.0)))


def candidate_errors(candidates: DataFrame) -> DataFrame:
    """error of each candidate, null where it is valid (GOV3): its type, content, confidence (a text, which must be a number), and sources within the batch.

    candidates: type, content, confidence, source_event_ids and batch_event_ids.
    """
    number = F.col("confidence").try_cast("double")
    sources = F.filter(F.coalesce("source_event_ids", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    outside = F.size(F.array_except(F.transform(sources, lambda x: F.trim(x)), F.coalesce("batch_event_ids", F.array().cast("array<string>")))) > 0
    error = (
        F.when(~F.coalesce("type", F.lit("")).isin(*KNOWLEDGE), "type")
        .when(F.trim(F.coalesce("content", F.lit(""))) == "", "content")
        .when(number.isNull() | F.isnan(number), "confidence required")
        .when((number < 0) | (number > 1), "confidence range")
        .when((F.size(sources) == 0) | outside, "sources")
    )
    return candidates.withColumn("error", error)


def routed(candidates: DataFrame) -> DataFrame:
    """Actions of candidates (GOV6): skills are put off, preferences go to the profile, rules become cards, with defaults.

    candidates: type, knowledge_id, content, confidence and attributes (a map).
    """
    a = lambda *names: F.coalesce(*(F.try_element_at("attributes", F.lit(n)) for n in names))
    raw = F.regexp_replace(F.regexp_replace(F.replace(F.lower(F.trim(F.coalesce("knowledge_id", F.lit("")))), F.lit("_"), F.lit("-")), "[^a-z0-9-]+", "-"), "^-+|-+$", "")
    own = F.concat(F.replace("type", F.lit("_"), F.lit("-")), F.lit("-"), F.left(F.sha2("content", 256), F.lit(12)))
    card = F.struct(
        F.when(raw != "", F.left(raw, F.lit(64))).otherwise(own).alias("id"),
        F.coalesce(a("name", "title"), "content").alias("title"),
        F.coalesce(a("trigger", "scenario"), "content").alias("scenario"),
        F.coalesce(a("signals"), F.lit(SIGNALS)).alias("signals"),
        F.col("content").alias("principle"),
        F.coalesce(a("outcome"), F.lit(OUTCOME)).alias("outcome"),
        F.coalesce(a("constraints", "boundaries"), F.lit(BOUNDARIES)).alias("boundaries"),
        F.col("confidence").alias("confidence"),
    )
    rule = F.col("type") == "decision_rule"
    kept = candidates.where(F.col("type").isin("decision_rule", "user_preference"))
    return kept.withColumn("kind", F.when(rule, "decision_card").otherwise("user_profile")).withColumn("tool", F.when(rule, "decision_card_manage").otherwise("memory_manage")).withColumn("card", F.when(rule, card))


def action_errors(actions: DataFrame, events: DataFrame) -> DataFrame:
    """The first error of each action that has one (GOV8): evidence outside the batch, or a tool not allowed for an event.

    actions: batch_id, action_id, tool_name, evidence_event_ids; events: batch_id, event_id, allowed_tools.
    """
    cited = actions.select("batch_id", "action_id", "tool_name", F.posexplode("evidence_event_ids").alias("pos", "event_id"))
    met = cited.join(events, ["batch_id", "event_id"], "left")
    error = F.when(F.col("allowed_tools").isNull(), "evidence outside the batch").when(~F.array_contains("allowed_tools", F.col("tool_name")), "tool not allowed")
    return met.withColumn("error", error).where("error is not null").groupBy("batch_id", "action_id").agg(F.min_by("error", "pos").alias("error"))


def content_key(kind: Column, content: Column) -> Column:
    """What makes two artifacts one candidate: kind and content, whatever the case and blanks around it."""
    return F.sha2(F.concat_ws("\n", kind, F.lower(F.trim(content))), 256)


def reinforced_by_stored(artifacts: DataFrame, stored: DataFrame) -> DataFrame:
    """Artifacts with what is stored of their key: joint confidence, sources of both in order, the declared risk of either (JN3, AGG6, SET3).

    Both have key, confidence, source_event_ids and declared_risk; stored keys are unique.
    """
    old = stored.select("key", *(F.col(c).alias(f"_{c}") for c in ("confidence", "source_event_ids", "declared_risk")))
    joint = F.least(F.lit(1.0), 1 - (1 - F.col("_confidence")) * (1 - F.col("confidence")))
    met = artifacts.join(old, "key", "left").withColumn("_known", F.col("_confidence").isNotNull())
    out = met.withColumn("confidence", F.when(F.col("_known"), joint).otherwise(F.col("confidence")))
    out = out.withColumn("source_event_ids", F.when(F.col("_known"), F.array_distinct(F.concat("_source_event_ids", "source_event_ids"))).otherwise(F.col("source_event_ids")))
    return out.withColumn("declared_risk", F.coalesce("declared_risk", "_declared_risk")).drop("_known", "_confidence", "_source_event_ids", "_declared_risk")


def with_more_evidence(reinforced: DataFrame, current: DataFrame) -> DataFrame:
    """Reinforced artifacts whose sources are others than those of the current artifact of their key (JN4)."""
    now = current.select("key", F.col("source_event_ids").alias("_now"))
    return reinforced.join(now, "key").where(F.col("source_event_ids") != F.col("_now")).drop("_now")


def recorded(stored: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The store after artifacts (with pos) are recorded: of each key the last one, else what was stored (GOV10)."""
    last = artifacts.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("pos")))).where("_n = 1").drop("_n", "pos")
    return stored.join(last.select("key"), "key", "left_anti").unionByName(last)


def removed(stored: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The store without the artifacts' keys (GOV10)."""
    return stored.join(artifacts.select("key"), "key", "left_anti")


def evidence_changes(before: DataFrame, after: DataFrame, *scope: str) -> DataFrame:
    """Evidence that a curation lost or made up: it must keep the set as it was, so any row is an error (SET4)."""
    a, b = before.select(*scope, "evidence_id").distinct(), after.select(*scope, "evidence_id").distinct()
    lost = a.join(b, [*scope, "evidence_id"], "left_anti").withColumn("error", F.lit("lost"))
    return lost.unionByName(b.join(a, [*scope, "evidence_id"], "left_anti").withColumn("error", F.lit("made up")))


def archive_errors(requests: DataFrame) -> DataFrame:
    """Archives (archive_ids, ids) that name ids that are not there, or all of them (SET5)."""
    unknown = F.size(F.array_except("archive_ids", "ids")) > 0
    every = F.size(F.array_except("ids", "archive_ids")) == 0
    return requests.withColumn("error", F.when(unknown, "unknown").when(every, "all")).where("error is not null")


def in_context(matches: DataFrame, context_ids: DataFrame) -> DataFrame:
    """Matches whose id went into the context (JN14)."""
    return matches.join(context_ids.select("memory_id").distinct(), "memory_id", "left_semi")


def cached_reviews(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (request) with the cached result of the same canonical input, where its digest still fits and it was a success (GOV19, FN24)."""
    keyed = requests.withColumn("key", F.sha2("request", 256))
    good = cache.where((F.col("status") == "success") & (F.sha2("result", 256) == F.col("result_sha256"))).select("key", "result")
    return keyed.join(good, "key", "left").withColumn("hit", F.col("result").isNotNull())


def bootstrap_needs(scopes: DataFrame) -> DataFrame:
    """Whether an empty profile, or empty rules and cards, ask for a first candidate, where the tool is allowed (GOV22)."""
    allowed = lambda tool: F.array_contains("allowed_tools", tool)
    profile = (F.trim(F.coalesce("profile", F.lit(""))) == "") & allowed("memory_manage")
    rules = (F.col("rules") + F.col("cards") == 0) & allowed("decision_card_manage")
    return scopes.withColumn("needs_profile", F.col("legacy") & profile).withColumn("needs_card", F.col("legacy") & rules)


def action_counts(actions: DataFrame, key: str) -> DataFrame:
    """Candidates, actions and types of each review (AGG22)."""
    return actions.groupBy(key).agg(F.count("*").alias("actions"), F.count_if(F.col("kind") == "user_profile").alias("profiles"), F.count_if(F.col("kind") == "decision_card").alias("cards"), F.count_distinct("kind").alias("kinds"))


def replayed(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Events with their recorded review; an event with several recordings is an error row (SRC17)."""
    once = documents.groupBy("event_id").agg(F.count("*").alias("_n"), F.min("review").alias("review"))
    out = events.join(once, "event_id", "left")
    error = F.when(F.col("_n") > 1, "recorded twice").when(F.col("_n").isNull(), "not recorded")
    return out.withColumn("review", F.when(error.isNull(), F.col("review"))).withColumn("error", error).drop("_n")


def keyword_review(events: DataFrame, rules: dict[str, str]) -> DataFrame:
    """A review without a model: of each event the first rule (pattern: kind) that its response meets (the deterministic backend of §2.13)."""
    kind = F.coalesce(*(F.when(F.col("final_response").rlike(f"(?i){p}"), F.lit(k)) for p, k in rules.items()))
    return events.withColumn("kind", kind).where("kind is not null")


def truncated_writeback(memories: DataFrame, most: int) -> DataFrame:
    """Memory texts cut to a length, without blanks around (the deterministic write-back of §2.13)."""
    return memories.withColumn("content", F.rtrim(F.left(F.trim("content"), F.lit(most))))


def merged_text(old: Column, new: Column) -> Column:
    """The longer of two texts where it holds the other, else both, a line each; case and blanks do not count (FN34)."""
    a, b = T.normalized(old), T.normalized(new)
    return F.when(F.contains(b, a), F.trim(new)).when(F.contains(a, b), F.trim(old)).otherwise(F.concat(T.rstripped(old), F.lit("\n"), F.trim(new)))
