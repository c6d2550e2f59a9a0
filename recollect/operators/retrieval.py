"""Retrieval of durable memories: scope and domain filters, lexical ranking, conflicts, near-duplicates and packing.

Records have memory_id, kind, content, tenant_id, agent_id, user_id (null: shared), confidence, domain, updated_at and
conflict_key. Every operator takes a DataFrame and gives one; times are compared with an explicit ``as_of``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import text as T

# What a kind of memory adds to a score.
KIND_WEIGHT = {"decision_rule": 0.30, "decision_card": 0.25, "user_persona": 0.20, "skill_candidate": 0.10}
DEFAULT_LIMIT, MAX_LIMIT, CONTEXT_TOKENS, SAME = 5, 10, 1_200, 0.8


@dataclass(frozen=True)
class Query:
    text: str
    tenant_id: str
    agent_id: str
    user_id: str
    as_of: datetime
    domain: str | None = None
    kinds: tuple[str, ...] = ()
    limit: int = DEFAULT_LIMIT


def in_scope(records: DataFrame, query: Query) -> DataFrame:
    """Rows of the tenant and agent that are the user's or shared, of the kinds asked for (FLT1)."""
    kept = records.where((F.col("tenant_id") == query.tenant_id) & (F.col("agent_id") == query.agent_id) & (F.col("user_id").isNull() | (F.col("user_id") == query.user_id)))
    return kept.where(F.col("kind").isin(*query.kinds)) if query.kinds else kept


def of_domain(records: DataFrame, query: Query) -> DataFrame:
    """Rows whose content's inferred domain is the one asked for; where none can be inferred, a token in common will do (FLT2)."""
    if query.domain is None:
        return records
    inferred = T.inferred_domain(F.col("content"))
    shared = F.arrays_overlap(T.token_set(F.col("content")), T.token_set(F.lit(query.text)))
    return records.where(F.when(inferred.isNotNull(), inferred == T.domain(F.lit(query.domain))).otherwise(shared))


def score(query: Query) -> Column:
    """Ten times the share of the query's tokens, and what kind, confidence, domain and recency add (SRT1)."""
    asked = T.token_set(F.lit(query.text))
    relevance = F.when(F.size(asked) > 0, F.size(F.array_intersect(T.token_set(F.col("content")), asked)) / F.size(asked)).otherwise(0.0)
    weight = F.coalesce(*(F.when(F.col("kind") == k, F.lit(w)) for k, w in KIND_WEIGHT.items()), F.lit(0.0))
    bonus = F.lit(0.0) if query.domain is None else F.when(T.domain(F.col("domain")) == T.domain(F.lit(query.domain)), 0.15).otherwise(0.0)
    return relevance * 10 + weight + F.col("confidence") * 0.1 + bonus + T.recency(F.col("updated_at"), F.lit(query.as_of).cast("timestamp"))


def ranked(records: DataFrame, query: Query) -> DataFrame:
    """The best rows in order of score, then id, numbered from 1; filters run before any scoring (SRT2)."""
    limit = max(1, min(query.limit, MAX_LIMIT))
    best = of_domain(in_scope(records, query), query).withColumn("score", score(query)).orderBy(F.desc("score"), "memory_id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "memory_id")))  # over at most MAX_LIMIT rows


def conflict_winners(matches: DataFrame, *partition: str) -> DataFrame:
    """Rows without a conflict key, and of each key the latest, surest, best-scored and first-ranked (WIN18)."""
    by = Window.partitionBy(*partition, "conflict_key").orderBy(F.desc(F.coalesce(F.unix_micros("updated_at"), F.lit(0))), F.desc("confidence"), F.desc("score"), "rank")
    keyed = F.trim(F.coalesce("conflict_key", F.lit(""))) != ""
    return matches.withColumn("_first", F.row_number().over(by)).where(~keyed | (F.col("_first") == 1)).drop("_first")


def without_similar(matches: DataFrame, similar: float = SAME) -> DataFrame:
    """In order of rank, rows whose token sets are not too like any kept before (WIN17). Matches are few: at most MAX_LIMIT."""
    one = matches.groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", T.semantic_set(F.col("content")).alias("tokens")))).alias("all"))
    empty = F.array().cast("array<struct<rank:int,tokens:array<string>>>")
    kept = F.aggregate("all", empty, lambda k, x: F.when(F.exists(k, lambda y: T.jaccard(y["tokens"], x["tokens"]) >= similar), k).otherwise(F.concat(k, F.array(x))))
    return matches.join(F.broadcast(one.select(F.explode(F.transform(kept, lambda x: x["rank"])).alias("rank"))), "rank", "left_semi")


def packed(matches: DataFrame, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """Chunks in order of rank that fit the budget of tokens: misfits are skipped, but the first, which is cut short (WIN15).

    One row: the context, its memory ids and its tokens.
    """
    chunk = F.concat(F.lit("["), "kind", F.lit(":"), "memory_id", F.lit("]\n"), F.trim("content"), F.lit("\n"))
    all_ = F.array_sort(F.collect_list(F.struct("rank", chunk.alias("chunk"), "memory_id", T.t3(chunk).alias("n"))))
    start = F.struct(F.array().cast("array<string>").alias("chunks"), F.array().cast("array<string>").alias("ids"), F.lit(budget).cast("long").alias("left"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        takes = lambda c, left, done: F.struct(F.concat(s["chunks"], F.array(c)).alias("chunks"), F.concat(s["ids"], F.array(x["memory_id"])).alias("ids"), left.alias("left"), done.alias("done"))
        cut = F.concat(T.rstripped(T.first_tokens(x["chunk"], budget)), F.lit("\n"))
        return F.when(s["done"], s).when(x["n"] <= s["left"], takes(x["chunk"], s["left"] - x["n"], F.lit(False))).when(F.size(s["chunks"]) > 0, s).otherwise(takes(cut, F.lit(0).cast("long"), F.lit(True)))

    made = matches.groupBy().agg(F.aggregate(all_, start, step).alias("s"))
    markdown = F.array_join("s.chunks", "\n")
    return made.select(markdown.alias("markdown"), F.array_join("s.ids", ",").alias("memory_ids"), T.t3(markdown).alias("estimated_tokens"))


def context(records: DataFrame, query: Query, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """The whole of retrieval: rank, settle conflicts, drop near-duplicates, pack."""
    return packed(without_similar(conflict_winners(ranked(records, query))), budget)
