"""Operators over a session's journal: turns, rounds, gaps, retention and compaction policies.

Rows have session_id, sequence (from 1), role and content; every window is partitioned by session, whose size is that of one
conversation. No operator collects a session into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from recollect.functions import text as T

def in_session() -> WindowSpec:
    return Window.partitionBy("session_id")


def in_order() -> WindowSpec:
    return in_session().orderBy("sequence")


def before() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def newer_first() -> WindowSpec:
    return in_session().orderBy(F.desc("sequence"))


def recent_turns(events: DataFrame, n: int) -> DataFrame:
    """The last n complete turns and the system rows in front of the first (WIN1).

    A user row opens a turn unless the open turn has no reply yet; system rows in between do not close it.
    """
    spoke = F.when(F.col("role") != "system", F.col("role"))
    opens = (F.col("role") == "user") & (F.coalesce(F.last(spoke, ignorenulls=True).over(before()), F.lit("assistant")) != "user")
    turns = events.withColumn("_opens", opens.cast("int")).withColumn("turn_no", F.sum("_opens").over(so_far()))
    last = turns.withColumn("_last", F.max("turn_no").over(in_session()))
    keep = F.when(F.col("turn_no") == 0, F.col("role") == "system").otherwise(F.col("_last") - F.col("turn_no") < n)
    return last.where(keep).drop("_opens", "_last")


def user_rounds(events: DataFrame) -> DataFrame:
    """round_no: each user row starts a round (WIN2)."""
    return events.withColumn("round_no", F.count_if(F.col("role") == "user").over(so_far()))


def assistant_rounds(events: DataFrame, message_id: Column) -> DataFrame:
    """round_no: an assistant row whose message is not the last assistant's starts a round, but at the start (WIN3)."""
    own = F.when(F.col("role") == "assistant", F.coalesce(message_id, F.concat(F.lit("#"), F.col("sequence").cast("string"))))
    named = events.withColumn("_own", own)
    starts = F.col("_own").isNotNull() & (F.coalesce(F.last("_own", ignorenulls=True).over(before()), F.lit("")) != F.col("_own")) & (F.row_number().over(in_order()) > 1)
    return named.withColumn("_starts", starts.cast("int")).withColumn("round_no", F.sum("_starts").over(so_far())).drop("_own", "_starts")


def contiguous_prefix(events: DataFrame, after: int = 0) -> DataFrame:
    """Rows after a sequence up to the first gap (WIN4)."""
    return events.where(F.col("sequence") > after).withColumn("_n", F.row_number().over(in_order())).where(F.col("sequence") - F.col("_n") == after).drop("_n")


def first_gaps(events: DataFrame) -> DataFrame:
    """Of each session through its last sequence, the first that is missing, if any (WIN5)."""
    behind = events.select("session_id", "sequence", F.lag("sequence", 1, 0).over(in_order()).alias("_before"))
    return behind.where(F.col("sequence") > F.col("_before") + 1).groupBy("session_id").agg((F.min("_before") + 1).cast("long").alias("first_missing"))


def sequence_conflicts(events: DataFrame) -> DataFrame:
    """Sequences with their number of copies, and whether these differ (WIN6, JN18)."""
    same = F.sha2(F.concat_ws("\n", "role", "content"), 256)
    return events.groupBy("session_id", "sequence").agg(F.count("*").alias("copies"), (F.count_distinct(same) > 1).alias("conflict"))


def first_of_identical(events: DataFrame, *identity: str) -> DataFrame:
    """The first row of each identity in a session (WIN7)."""
    by = Window.partitionBy("session_id", *identity).orderBy("sequence")
    return events.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def retention_split(events: DataFrame, budget: int) -> DataFrame:
    """retained: strictly newer rows have at most ``budget`` characters; without a budget none is (WIN8)."""
    newer = F.coalesce(F.sum(F.length("content").cast("long")).over(newer_first().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return events.withColumn("retained", (newer <= budget) & F.lit(budget > 0))


def hot_list(events: DataFrame, through: int, budget: int) -> DataFrame:
    """Rows after ``through``, and of the others the newest whose bytes together fit the budget (WIN9)."""
    old = F.col("sequence") <= through
    size = F.sum(F.when(old, F.octet_length("content").cast("long")).otherwise(0)).over(newer_first().rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("_size", size).where(~old | (F.col("_size") <= budget)).drop("_size")


def coverage(events: DataFrame, has_tool_calls: Column) -> DataFrame:
    """Latest sequence and last assistant row without tool calls of each session (AGG3, WIN19)."""
    safe = (F.col("role") == "assistant") & ~F.coalesce(has_tool_calls, F.lit(False))
    return events.groupBy("session_id").agg(F.max("sequence").alias("latest_sequence"), F.coalesce(F.max(F.when(safe, F.col("sequence"))), F.lit(0)).cast("long").alias("last_safe_sequence"))


def tool_calls(events: DataFrame, covered: Column) -> DataFrame:
    """Tool calls after the covered sequence, from the metadata's texts; what is no whole number counts for none (AGG26)."""
    n = F.coalesce(F.try_element_at("metadata", F.lit("tool_call_count")).try_cast("long"), F.lit(0))
    return events.groupBy("session_id").agg(F.sum(F.when(F.col("sequence") > covered, n).otherwise(0)).alias("tool_calls"))


def compression_policy(events: DataFrame, window: int, ratio: float = 0.65, max_messages: int = 100, max_seconds: int | None = None, age_seconds: Column | None = None) -> DataFrame:
    """Whether a session is due: tokens, rows or age reach their limits (FLT7, T1)."""
    if not 0.60 <= ratio <= 0.70:
        raise ValueError("ratio must be between 0.60 and 0.70")
    sums = events.groupBy("session_id").agg(T.t1(F.sum(F.length("content"))).alias("tokens"), F.count("*").alias("messages"), (F.max(age_seconds) if age_seconds is not None else F.lit(0)).alias("_age"))
    due = (F.col("tokens") >= window * ratio) | (F.col("messages") >= max_messages)
    due = due | (F.col("_age") >= max_seconds) if max_seconds is not None else due
    return sums.withColumn("due", due).drop("_age")


def extraction_due(events: DataFrame, initialised: Column, covered: Column, first: int = 10_000, growth: int = 5_000, calls: int = 3) -> DataFrame:
    """Whether session memory is due: the first time by size; later by growth, with enough tool rows or a last turn without (FLT8, AGG26)."""
    after = F.col("sequence") > covered
    last_turn = F.col("sequence") > F.coalesce(F.max(F.when(F.col("role") == "user", F.col("sequence"))).over(in_session()), F.lit(0))
    marked = events.withColumn("_after", after).withColumn("_last_tool", last_turn & (F.col("role") == "tool")).withColumn("_init", initialised)
    sums = marked.groupBy("session_id").agg(T.t1(F.sum(F.length("content"))).alias("tokens"), F.when(F.count_if("_after") > 0, T.t1(F.sum(F.when(F.col("_after"), F.length("content"))))).otherwise(0).alias("grown"), F.count_if(F.col("_after") & (F.col("role") == "tool")).alias("tool_calls"), F.bool_or("_last_tool").alias("_busy"), F.first("_init").alias("initialised"))
    due = F.when(~F.col("initialised"), F.col("tokens") >= first).otherwise((F.col("grown") >= growth) & ((F.col("tool_calls") >= calls) | ~F.col("_busy")))
    return sums.withColumn("due", due).drop("_busy")


def visible_generations(generations: DataFrame, as_of: Column, covered: Column, last: int) -> DataFrame:
    """The last few generations that have not expired (equality is expired) and reach beyond the boundary (FLT3, SRT5)."""
    seen = generations.where((F.col("expires_at") > as_of) & (F.col("through_sequence") > covered))
    by = Window.partitionBy("session_id").orderBy(F.desc("generation"))
    return seen.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= last).drop("_n")


def compression_report(generations: DataFrame) -> DataFrame:
    """Tokens before and after by session, and the share saved (AGG16, AGG27)."""
    sums = generations.groupBy("session_id").agg(F.count("*").alias("generations"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"))
    return sums.withColumn("saved", F.when(F.col("tokens_before") > 0, 1 - F.col("tokens_after") / F.col("tokens_before")).otherwise(0.0)).withColumn("ratio", F.col("tokens_before") / F.greatest("tokens_after", F.lit(1)))


def after_boundary(messages: DataFrame, is_boundary: Column) -> DataFrame:
    """Rows from the last boundary on, all where there is none (FLT4)."""
    marked = messages.withColumn("_at", F.max(F.when(is_boundary, F.col("sequence"))).over(in_session()))
    return marked.where(F.col("sequence") >= F.coalesce("_at", F.lit(0))).drop("_at")


def append_new(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """Arriving events with their outcome: new, same (a replay) or conflict (same id, other content) (SNK2, STR1)."""
    known = existing.select("session_id", "event_id", F.col("sha256").alias("_known"))
    joined = arriving.join(known, ["session_id", "event_id"], "left")
    return joined.withColumn("outcome", F.when(F.col("_known").isNull(), "new").when(F.col("_known") == F.col("sha256"), "same").otherwise("conflict")).drop("_known")
