"""Operators over messages of blocks: tool calls and results, clearing of old results, cuts that keep calls and results together.

Messages have session_id, pos, role, message_id, group_id, ts and blocks (an array of type, id, tool_use_id, name, text and
content), told apart by session and pos. What a session's blocks have in common is found by joins on its ids; messages that
nothing touches stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEDIA_TOKENS = 2_000
CLEARED = "[old tool result cleared]"


def _with_found(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages with ``_found``: the calls that their own results answer and that ids (session_id, id) hold."""
    asked = messages.select("session_id", "pos", F.explode(_ids("tool_result", "tool_use_id")).alias("id"))
    found = asked.join(ids, ["session_id", "id"], "left_semi").groupBy("session_id", "pos").agg(F.collect_set("id").alias("_found"))
    return messages.join(found, ["session_id", "pos"], "left").withColumn("_found", F.coalesce("_found", F.array().cast("array<string>"))).select(*messages.columns, "_found")


def _ids(kind: str, field: str) -> Column:
    return F.transform(F.filter(F.coalesce("blocks", F.array().cast("array<struct<type:string,id:string,tool_use_id:string,name:string,text:string,content:string>>")), lambda b: b["type"] == kind), lambda b: b[field])


def tokens(messages: DataFrame) -> DataFrame:
    """Estimate by session: blocks of user and assistant rows, a third on top, rounded up (T2 over messages)."""
    size = lambda b: F.when(b["type"].isin("image", "document"), MEDIA_TOKENS).otherwise(F.floor(F.length(F.coalesce(b["text"], b["content"], F.lit(""))) / 4 + 0.5))
    each = F.when(F.col("role").isin("user", "assistant") & F.col("blocks").isNotNull(), F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + size(b).cast("long"))).otherwise(0)
    return messages.groupBy("session_id").agg(F.ceil(F.sum(each) * 4 / 3).cast("long").alias("tokens"))


def without_orphans(messages: DataFrame) -> DataFrame:
    """Results without their call go, and messages that held nothing else (JN7)."""
    calls = messages.select("session_id", F.explode(_ids("tool_use", "id")).alias("id"))
    kept = F.filter("blocks", lambda b: (b["type"] != "tool_result") | F.array_contains(F.col("_found"), b["tool_use_id"]))
    return _with_found(messages, calls).withColumn("_kept", kept).where("blocks is null or size(blocks) = 0 or size(_kept) > 0").withColumn("blocks", F.col("_kept")).drop("_found", "_kept")


def cleared_results(messages: DataFrame, tools: tuple[str, ...], keep: int) -> DataFrame:
    """Contents of results of the named tools are cleared, but for the last ``keep`` calls, at least one (JN8, SRT9)."""
    calls = messages.select("session_id", "pos", F.posexplode(F.filter("blocks", lambda b: (b["type"] == "tool_use") & b["name"].isin(*tools))).alias("nth", "call"))
    from_end = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("pos"), F.desc("nth")))
    old = calls.select("session_id", F.col("call.id").alias("id"), from_end.alias("n")).where(F.col("n") > max(1, keep))
    blocks = F.transform("blocks", lambda b: F.when((b["type"] == "tool_result") & F.array_contains(F.col("_found"), b["tool_use_id"]), b.withField("content", F.lit(CLEARED))).otherwise(b))
    return _with_found(messages, old).withColumn("blocks", blocks).drop("_found")


def closed_cuts(messages: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cuts (session_id, cut) moved left till calls of kept results, parts of kept messages and kept groups are kept, too (WIN11)."""
    placed = messages.join(cuts, "session_id")
    for _ in range(2):  # calls first, then the messages and groups that these are parts of
        kept = F.col("pos") >= F.col("cut")
        results = placed.where(kept).select("session_id", F.explode(_ids("tool_result", "tool_use_id")).alias("id")).distinct()
        calls = placed.select("session_id", "pos", F.explode(_ids("tool_use", "id")).alias("id"))
        parts = placed.where(kept).select("session_id", F.explode(F.array_compact(F.array(F.when(F.col("role") == "assistant", F.concat(F.lit("m"), "message_id")), F.concat(F.lit("g"), "group_id")))).alias("id")).distinct()
        named = placed.select("session_id", "pos", F.explode(F.array_compact(F.array(F.when(F.col("role") == "assistant", F.concat(F.lit("m"), "message_id")), F.concat(F.lit("g"), "group_id")))).alias("id"))
        left = calls.join(results, ["session_id", "id"]).select("session_id", "pos").unionAll(named.join(parts, ["session_id", "id"]).select("session_id", "pos"))
        moved = placed.select("session_id", "cut").distinct().join(left.groupBy("session_id").agg(F.min("pos").alias("_p")), "session_id", "left").select("session_id", F.least("cut", "_p").alias("cut"))
        placed = messages.join(moved, "session_id")
    return moved


def dropped_rounds(rounds: DataFrame, gap: Column) -> DataFrame:
    """Rounds (session_id, round_no, tokens) left after the oldest are dropped to free ``gap`` tokens; without a gap a fifth
    of them, at least one, never all (WIN12)."""
    by = Window.partitionBy("session_id").orderBy("round_no")
    n = F.count("*").over(Window.partitionBy("session_id"))
    before = F.coalesce(F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goes = F.when(gap.isNotNull(), before < gap).otherwise(F.row_number().over(by) <= F.greatest(F.lit(1), F.floor(n / 5)))
    return rounds.withColumn("_goes", goes & (F.row_number().over(by) < n)).where("not _goes").drop("_goes")


def idle(messages: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """Sessions whose last assistant row is as old as the threshold, or older (FLT10)."""
    last = messages.where("role = 'assistant'").groupBy("session_id").agg(F.max_by("ts", "pos").alias("ts"))
    return last.where(F.unix_micros(as_of) - F.unix_micros("ts") >= minutes * 60_000_000).select("session_id")


def mutated(actions: DataFrame) -> DataFrame:
    """Entries of each scope after its actions in order (GOV7): add (a text once), replace (id and text must match), remove.

    actions: scope_id, pos, action, memory_id, text, new_text. A fold by scope: whether an action applies depends on those before.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        entries: dict[str, str] = {}
        for a in pdf.sort_values("pos").itertuples():
            if a.action == "add" and a.text not in entries.values():
                entries[a.memory_id] = a.text
            elif a.action == "replace" and entries.get(a.memory_id) == a.text:
                entries[a.memory_id] = a.new_text
            elif a.action == "remove" and entries.get(a.memory_id) == a.text:
                del entries[a.memory_id]
        return pd.DataFrame([(pdf.scope_id.iloc[0], i, t) for i, t in entries.items()], columns=["scope_id", "memory_id", "text"])

    return actions.groupBy("scope_id").applyInPandas(fold, "scope_id long, memory_id string, text string")


def compressed(messages: DataFrame, compressor: Callable, schema: str) -> DataFrame:
    """A hook for compressors and models outside: a function over pandas batches, run by ``mapInPandas``."""
    return messages.mapInPandas(compressor, schema)
