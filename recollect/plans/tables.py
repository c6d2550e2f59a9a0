"""How the test tables stand for the data model, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memory records; what documents lack follows from their ids."""
    i = F.col("doc_id")
    kinds = F.element_at(F.array(*(F.lit(k) for k in ("decision_rule", "decision_card", "user_persona", "skill_candidate"))), (i % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        i.cast("string").alias("memory_id"),
        kinds.alias("kind"),
        F.col("text").alias("content"),
        F.concat(F.lit("t"), (i % 2).cast("string")).alias("tenant_id"),
        F.lit("a").alias("agent_id"),
        F.when(i % 5 != 0, F.concat(F.lit("u"), (i % 3).cast("string"))).alias("user_id"),
        ((i % 11) / 10).alias("confidence"),
        F.lit(None).cast("string").alias("domain"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + (i % 400) * 86_400_000_000).alias("updated_at"),
        F.when(i % 6 == 0, F.concat(F.lit("key"), (i % 7).cast("string"))).alias("conflict_key"),
    )


RECORDS = """SELECT doc_id::VARCHAR AS memory_id, ['decision_rule', 'decision_card', 'user_persona', 'skill_candidate'][doc_id % 4 + 1] AS kind, text AS content,
    't' || (doc_id % 2) AS tenant_id, 'a' AS agent_id, CASE WHEN doc_id % 5 <> 0 THEN 'u' || (doc_id % 3) END AS user_id, (doc_id % 11)::DOUBLE / 10 AS confidence,
    1704067200000000 + (doc_id % 400) * 86400000000 AS updated_us, CASE WHEN doc_id % 6 = 0 THEN 'key' || (doc_id % 7) END AS conflict_key FROM documents"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as journals."""
    t = table(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("sequence"), "role", F.col("text").alias("content"))


JOURNAL = "SELECT conv_id AS session_id, turn + 1 AS sequence, role, text AS content FROM conversations"


def journal_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(spark, sf_dir).where((F.col("session_id") * 7 + F.col("sequence")) % 11 != 0)


JOURNAL_WITH_GAPS = f"SELECT * FROM ({JOURNAL}) WHERE (session_id * 7 + sequence) % 11 <> 0"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as completed tasks: the user is the scope, and the tokens follow from value and props."""
    t = table(spark, sf_dir, "events")
    n = F.greatest(F.lit(1), F.floor((F.length("props") + F.floor("value") * 10 + 3) / 4)).cast("long")
    return t.select("event_id", F.col("user_id").alias("scope_id"), F.col("ts").cast("timestamp").alias("completed_at"), "event_type", "value", "props", n.alias("tokens"))


EVENTS = "SELECT event_id, user_id AS scope_id, ts AS completed_at, event_type, value, props, greatest(1, floor((length(props) + floor(value) * 10 + 3) / 4))::BIGINT AS tokens FROM events"
