"""The active context of a session: what a model is shown of its memory, and when and where it is compacted.

Messages have session_id, role and content; ranges of sequences tell what a message stands for. Windows are by session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import text as T

# Fixed value: what stands in the place of what was compacted.
BOUNDARY = "[compact boundary]"
# Tokens that a summary may take, and those kept free for automatic and for manual compaction.
SUMMARY_TOKENS, AUTO_BUFFER, MANUAL_BUFFER, MOST_FAILURES = 20_000, 13_000, 3_000, 3
# Tokens and texts that are enough to keep, and tokens that are too many.
MIN_TOKENS, MIN_TEXTS, MAX_TOKENS = 10_000, 5, 40_000


def annotated(messages: DataFrame, from_: Column, through: Column, group: Column) -> DataFrame:
    """Messages with the range of sequences they stand for and the group they belong to (PRJ2); a wrong range is an error."""
    good = (from_ >= 0) & (through >= from_) & (group != "")
    checked = F.when(F.coalesce(good, F.lit(False)), from_).otherwise(F.raise_error(F.lit("a range or group is wrong")))
    return messages.withColumn("stm_sequence_from", checked.cast("long")).withColumn("stm_sequence_through", through.cast("long")).withColumn("stm_group_id", group)


def for_provider(messages: DataFrame) -> DataFrame:
    """Messages without the columns that are only for memory itself (PRJ1)."""
    return messages.drop(*(c for c in messages.columns if c.startswith("stm_")))


def joined_parts(parts: Column) -> Column:
    """The texts of a message's input_text parts, a line each (FN30)."""
    texts = F.filter(parts, lambda p: (p["type"] == "input_text") & p["text"].isNotNull())
    return F.array_join(F.transform(texts, lambda p: p["text"]), "\n")


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """Of each session the checkpoint of the highest version, the newest of equals (AGG2)."""
    by = Window.partitionBy("session_id").orderBy(F.desc("envelope_version"), F.desc("created_at"))
    return checkpoints.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def active_context(boundaries: DataFrame, generations: DataFrame, kept: DataFrame, originals: DataFrame, as_of: Column, last: int) -> DataFrame:
    """What a session shows: its boundary and summary, visible generations, messages kept, and originals beyond the boundary (SET2).

    boundaries: session_id, boundary_id, covered, summary; generations: session_id, generation, from_sequence,
    through_sequence, expires_at, pos, role, content; kept: session_id, pos, role, content, stm_…; originals: session_id,
    sequence, role, content. Sessions without a boundary have covered 0. Of equal messages the first stays (WIN7).
    """
    covered = boundaries.select("session_id", "covered")
    of_boundary = lambda df: annotated(df, F.lit(0), F.col("covered"), F.concat(F.lit("revision:"), "boundary_id"))
    place = lambda part, a, b: (F.lit(part).alias("_part"), F.col(a).cast("long").alias("_a") if isinstance(a, str) else F.lit(a).cast("long").alias("_a"), F.col(b).cast("long").alias("_b") if isinstance(b, str) else F.lit(b).cast("long").alias("_b"))
    columns = ("session_id", "role", "content", "stm_sequence_from", "stm_sequence_through", "stm_group_id")
    head = of_boundary(boundaries.withColumn("role", F.lit("system")).withColumn("content", F.lit(BOUNDARY))).select(*columns, *place(0, 0, 0))
    summary = of_boundary(boundaries.withColumn("role", F.lit("user")).withColumn("content", F.col("summary"))).select(*columns, *place(1, 0, 0))
    reach = generations.join(covered, "session_id", "left").where((F.col("expires_at") > as_of) & (F.col("through_sequence") > F.coalesce("covered", F.lit(0))))
    newest = reach.withColumn("_n", F.dense_rank().over(Window.partitionBy("session_id").orderBy(F.desc("generation")))).where(F.col("_n") <= last)
    compressed = annotated(newest, F.col("from_sequence"), F.col("through_sequence"), F.concat(F.lit("generation:"), F.col("generation").cast("string"))).select(*columns, *place(2, "generation", "pos"))
    tail = kept.select(*columns, *place(3, "pos", 0))
    beyond = originals.join(covered, "session_id", "left").where(F.col("sequence") > F.coalesce("covered", F.lit(0)))
    fresh = annotated(beyond, F.col("sequence"), F.col("sequence"), F.concat(F.lit("event:"), F.col("sequence").cast("string"))).select(*columns, *place(4, "sequence", 0))
    every = head.unionByName(summary).unionByName(compressed).unionByName(tail).unionByName(fresh)
    order = ("_part", "_a", "_b")
    first = F.row_number().over(Window.partitionBy(*columns).orderBy(*order))
    once = every.withColumn("_first", first).where("_first = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).drop("_first", *order)


def coverage_place(messages: DataFrame, covered: DataFrame) -> DataFrame:
    """Of each session the first place whose message ends exactly at the covered sequence, if there is one (JN15)."""
    found = messages.join(covered, "session_id").where(F.col("through") == F.col("covered"))
    return found.groupBy("session_id").agg(F.min("pos").alias("pos"))


def kept_from(messages: DataFrame, coverage: DataFrame, recent_turns: int, min_tokens: int = MIN_TOKENS, min_texts: int = MIN_TEXTS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """session_id and the place from which messages are kept at a compaction (WIN10; ``blocks.closed_cuts`` closes it, WIN11).

    messages: session_id, pos (from 0), role, tokens, has_text, is_boundary; coverage: session_id, last (place of the last
    message summarised, -1 for none). From behind it the cut moves back until there are enough tokens and texts, or too
    many tokens, never before the last boundary; then over the last user turns; then on to later user messages while
    what is kept has too many tokens.
    """
    session = Window.partitionBy("session_id")
    newer = session.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    user = F.col("role") == "user"
    m = messages.join(coverage, "session_id").withColumn("_n", F.count("*").over(session))
    m = m.withColumn("_tokens", F.sum("tokens").over(newer)).withColumn("_texts", F.count_if("has_text").over(newer)).withColumn("_turns", F.count_if(user).over(newer))
    m = m.withColumn("_floor", F.coalesce(F.max(F.when(F.col("is_boundary"), F.col("pos"))).over(session) + 1, F.lit(0)))
    m = m.withColumn("_start", F.when(F.col("last") >= 0, F.col("last") + 1).otherwise(F.col("_n")))
    stops = (F.col("pos") <= F.col("_floor")) | (F.col("_tokens") >= max_tokens) | ((F.col("_tokens") >= min_tokens) & (F.col("_texts") >= min_texts))
    walked = F.max(F.when((F.col("pos") <= F.col("_start")) & stops, F.col("pos"))).over(session)
    m = m.withColumn("_walked", F.when((F.col("_start") >= F.col("_n")) & (F.col("_floor") >= F.col("_n")), F.col("_n")).otherwise(F.coalesce(walked, "_start")))
    turn = F.coalesce(F.max(F.when(user & (F.col("_turns") == recent_turns) & (F.col("pos") >= F.col("_floor")), F.col("pos"))).over(session), "_floor")
    m = m.withColumn("_cut", F.least("_walked", turn))
    later = user & (F.col("pos") > F.col("_cut"))
    fits = F.min(F.when(((F.col("pos") == F.col("_cut")) | later) & (F.col("_tokens") <= max_tokens), F.col("pos")))
    return m.groupBy("session_id").agg(F.coalesce(F.when(F.max("_cut") >= F.max("_n"), F.max("_cut")), fits, F.max(F.when(later, F.col("pos"))), F.max("_cut")).cast("long").alias("cut"))


def compaction_threshold(window: Column, most_output: Column, manual: Column) -> Column:
    """Tokens from which a context is compacted (FN33)."""
    return window - F.least(most_output, F.lit(SUMMARY_TOKENS)) - F.when(manual, MANUAL_BUFFER).otherwise(AUTO_BUFFER)


def compaction_gate(sessions: DataFrame) -> DataFrame:
    """due: not asked by compaction itself, not failed too often unless by hand, and enough tokens (FLT9).

    sessions: query_source, failures, manual, tokens, window and most_output.
    """
    own = F.coalesce("query_source", F.lit("")).isin("session_memory", "compact")
    broken = ~F.col("manual") & (F.coalesce("failures", F.lit(0)) >= MOST_FAILURES)
    threshold = compaction_threshold(F.col("window"), F.col("most_output"), F.col("manual"))
    return sessions.withColumn("threshold", threshold.cast("long")).withColumn("due", ~own & ~broken & (F.col("tokens") >= threshold))


def without_oldest(generations: DataFrame) -> DataFrame:
    """Generations of each session but the oldest; a session's only one stays (SRT11)."""
    session = Window.partitionBy("session_id")
    return generations.withColumn("_n", F.row_number().over(session.orderBy("generation"))).withColumn("_all", F.count("*").over(session)).where("_n > 1 or _all = 1").drop("_n", "_all")


def refresh_states(generations: DataFrame, as_of: Column, refresh_s: int = 3_600) -> DataFrame:
    """Of each session whether a generation has expired, and whether one has or will within the refresh time (STR12)."""
    left = F.unix_micros("expires_at") - F.unix_micros(as_of)
    return generations.groupBy("session_id").agg(F.bool_or(left <= 0).alias("expired"), F.bool_or(left <= refresh_s * 1_000_000).alias("rebuild"))


def selected_documents(documents: DataFrame, query: str, budget: int) -> DataFrame:
    """Of each request the documents that fit its budget of tokens, by overlap with the query, later ones first among equals (WIN16).

    documents: request_id, pos, document; a request's are few. Documents that do not fit are left out, but for the best one, which is cut
    and is then all there is.
    """
    asked = T.token_set(F.lit(query))
    overlap = F.when(F.size(asked) > 0, F.size(F.array_intersect(T.token_set(F.col("document")), asked)) / F.size(asked)).otherwise(0.0)
    item = F.struct((-overlap).alias("overlap"), (-F.col("pos")).alias("later"), F.col("pos").alias("pos"), F.col("document").alias("document"), T.t3(F.col("document")).alias("n"))
    ranked = documents.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    start = F.struct(F.array().cast("array<struct<pos:bigint,document:string>>").alias("taken"), F.lit(budget).cast("long").alias("left"))

    def step(s: Column, x: Column) -> Column:
        whole = F.struct(x["pos"].cast("long").alias("pos"), x["document"].alias("document"))
        part = F.struct(x["pos"].cast("long").alias("pos"), F.concat(T.rstripped(T.first_tokens(x["document"], budget)), F.lit("\n")).alias("document"))
        takes = lambda d, left: F.struct(F.concat(s["taken"], F.array(d)).alias("taken"), left.cast("long").alias("left"))
        return F.when(s["left"] < 1, s).when(x["n"] <= s["left"], takes(whole, s["left"] - x["n"])).when(F.size(s["taken"]) > 0, s).otherwise(takes(part, F.lit(0)))

    taken = ranked.select("request_id", F.aggregate("all", start, step)["taken"].alias("taken"))
    return taken.select("request_id", F.posexplode("taken").alias("place", "d")).select("request_id", "place", "d.pos", "d.document")


def new_checkpoints(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """Arriving checkpoints that are not there yet, each id once; one of another scope than it says is an error row (SNK3, FN24).

    checkpoints: user_id, session_id, scope_user_id, scope_session_id and payload; the id is a digest of scope and payload.
    """
    digest = F.concat(F.lit("ckpt-"), F.sha2(F.to_json(F.struct("user_id", "session_id", "payload")), 256))
    named = arriving.withColumn("checkpoint_id", digest)
    named = named.withColumn("error", F.when((F.col("user_id") != F.col("scope_user_id")) | (F.col("session_id") != F.col("scope_session_id")), "scope"))
    return named.join(existing.select("checkpoint_id"), "checkpoint_id", "left_anti").dropDuplicates(["checkpoint_id", "error"])
