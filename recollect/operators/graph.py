"""Property graphs: nodes and edges with times of validity, as of a time, neighbourhoods, causal chains, lineage.

nodes: id, type, created_at, invalidated_at; edges: edge_pos, source, target, type, created_at, invalidated_at. Searches go
level by level: a join of the front with the edges, and an anti join with what has been reached. Every level is cut in the
checkpoint folder, so neither lineage nor plans grow with the number of levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from recollect.functions import arrow
from recollect.operators.dealing import in_order
from recollect.sources.folders import shared_folder

CAUSAL = ("CAUSED", "INFLUENCED", "PRECEDENT_FOR")


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _valid(as_of: Column) -> Column:
    return (F.col("created_at") <= as_of) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > as_of))


def state_at(nodes: DataFrame, edges: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes valid at a time, and the edges valid then both of whose ends are (GR5, JN13)."""
    there = nodes.where(_valid(as_of))
    ids = there.select("id")
    kept = edges.where(_valid(as_of)).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return there, kept


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between the ids (JN6)."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node (GR2)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").select("edge_pos").union(edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select("edge_pos")).distinct()


def upserted(rows: DataFrame) -> DataFrame:
    """Nodes from rows in order (id, pos, type, properties): the last value of each property by name, and whether the type
    was changed, which is an error (GR1)."""
    types = rows.groupBy("id").agg(F.min_by("type", "pos").alias("type"), (F.count_distinct("type") > 1).alias("type_conflict"))
    last = rows.select("id", "pos", F.explode("properties").alias("name", "value")).groupBy("id", "name").agg(F.max_by("value", "pos").alias("value"))
    merged = last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("properties"))
    return types.join(merged, "id", "left")


def current(rows: DataFrame) -> DataFrame:
    """Nodes or edges that are not invalidated (GR6)."""
    return rows.where("invalidated_at is null")


def neighbours(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """start, id and hop of what is within ``hops`` steps in either direction, over edges that are not invalidated (GR3).

    Validity of nodes is not asked for. Of several ways to a node in its first hop, that through the node which was found
    first counts, then the first edge by position: ways are compared by the edges on them, in order.
    """
    live = edges.where("invalidated_at is null")
    both = live.select(F.col("source").alias("here"), F.col("target").alias("id"), "type", F.lit("out").alias("direction"), "edge_pos").unionAll(live.select(F.col("target").alias("here"), F.col("source").alias("id"), "type", F.lit("in").alias("direction"), "edge_pos"))
    seen = _cut(starts.select(F.col("id").alias("start"), "id").distinct().withColumn("hop", F.lit(0)).withColumn("type", F.lit(None).cast("string")).withColumn("direction", F.lit(None).cast("string")).withColumn("way", F.array().cast("array<bigint>")))
    front = seen
    both = both.withColumn("step", F.col("edge_pos").cast("long") * 2 + (F.col("direction") == "in").cast("int")).drop("edge_pos")
    for hop in range(1, hops + 1):
        reached = front.select("start", F.col("id").alias("here"), "way").join(both, "here").withColumn("way", F.concat("way", F.array("step")))
        first = reached.groupBy("start", "id").agg(F.min(F.struct("way", "type", "direction")).alias("e"))
        front = _cut(first.join(seen.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", F.lit(hop).alias("hop"), "e.type", "e.direction", "e.way"))
        seen = seen.unionByName(front)
    return seen.where("hop > 0").drop("way")


def upstream(edges: DataFrame, starts: DataFrame, steps: int = 5, types: tuple[str, ...] = CAUSAL) -> DataFrame:
    """start, id and step of what leads to the starts over causal edges, invalidated ones included (GR4)."""
    # dealt once, by what each step asks for: no step reads the edges, or shuffles them, again
    causal = _cut(edges.where(F.col("type").isin(*types)).select("source", "target").repartition("target").distinct())
    seen = _cut(starts.select(F.col("id").alias("start"), "id").distinct().withColumn("step", F.lit(0)))
    front = seen
    for step in range(1, steps + 1):
        reached = front.select("start", F.col("id").alias("target")).join(causal, "target").select("start", F.col("source").alias("id")).distinct()
        front = _cut(reached.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("step", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("step > 0")


def facts_as_nodes(facts: DataFrame) -> DataFrame:
    """One node for each subject and predicate, with its distinct values in order of first appearance (GR7, AGG20)."""
    first = facts.groupBy("subject", "predicate", "object").agg(F.min("pos").alias("pos"))
    by = F.array_sort(F.collect_list(F.struct("pos", "object")))
    return first.groupBy("subject", "predicate").agg(F.array_join(F.transform(by, lambda x: x["object"]), ",").alias("values"))


def canonical_name(name: Column) -> Column:
    """Compatibility forms as plain ones, case folded, only letters, digits and underscores."""
    return F.regexp_replace(arrow.folded(arrow.compatible(name)), r"[^\p{L}\p{N}_]+", "")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root, the least node of its component, for every node of the edges a - b.

    Each round turns the neighbours of every node to the least of them, first the greater ones, then all; rounds grow with the
    logarithm of the longest path. No node's neighbours are gathered: the least is an aggregate, and the rest is a join.
    """
    shared_folder(edges.sparkSession)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        turned = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = turned.groupBy("a").agg(F.min("b").alias("m"))
        edges = turned.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct().checkpoint()
    raise RuntimeError("the components did not settle")


def resolved_by_alias(entities: DataFrame) -> DataFrame:
    """Entities with the id of the one they resolve to, by the first of their name and aliases that an earlier one has (GR13).

    Rows count in order of ``pos``. Names and aliases always lead to the entity that had them last, so what two rows share
    does not make a third the same as both: the result depends on the order. Only rows that are connected by names of one type
    can meet; each such component is folded in order as a sorted stream, which keeps its names, not its rows.
    """
    named = entities.withColumn("_type", arrow.folded(F.col("entity_type")))
    names = F.array_distinct(F.concat(F.array(canonical_name(F.col("name"))), F.array_sort("_aliases")))
    alias = entities.select("entity_id", "pos", F.explode("aliases").alias("alias")).select("entity_id", "pos", canonical_name(F.col("alias")).alias("alias"))
    of = alias.groupBy("entity_id", "pos").agg(F.collect_set("alias").alias("_aliases"))
    held = named.join(of, ["entity_id", "pos"], "left").withColumn("_aliases", F.coalesce("_aliases", F.array().cast("array<string>"))).select("entity_id", "pos", "_type", names.alias("names")).checkpoint()
    key = F.sha2(F.to_json(F.struct("_type", "name")), 256)
    each = held.select("entity_id", "pos", "_type", F.explode("names").alias("name")).select("entity_id", "pos", key.alias("name"))
    first = F.min("name").over(Window.partitionBy("entity_id", "pos"))
    edges = each.select(F.col("name").alias("a"), first.alias("b"))
    roots = components(edges)
    own = held.select("*", F.sha2(F.to_json(F.struct("_type", F.element_at("names", 1).alias("name"))), 256).alias("node"))
    dealt = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    entity, at = entities.schema["entity_id"].dataType, entities.schema["pos"].dataType
    schema = StructType([StructField("entity_id", entity), StructField("pos", at), StructField("resolved_id", entity)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, leads, first_of = None, {}, {}
        for batch in batches:
            out = []
            for root, kind, entity_id, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if root != component:
                    component, leads, first_of = root, {}, {}
                key = next((leads[kind, n] for n in found if (kind, n) in leads), (kind, found[0]))
                out.append(first_of.setdefault(key, entity_id))
                leads.update(((kind, n), key) for n in found)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(4), pa.array(out, batch.schema.field(2).type)], names=["entity_id", "pos", "resolved_id"])

    stream = in_order(dealt.select("root", "_type", "entity_id", "names", "pos"), ["root"], "pos", "entity_id")
    resolved = stream.mapInArrow(run, schema)
    most = resolved.join(entities.select("entity_id", "pos", "confidence"), ["entity_id", "pos"]).groupBy("resolved_id").agg(F.max("confidence").alias("_most"))
    return entities.join(resolved, ["entity_id", "pos"]).join(most, "resolved_id").withColumn("confidence", F.col("_most")).drop("_most")


def resolved_by_name(entities: DataFrame) -> DataFrame:
    """entity_id (once, at pos) with the id of the first entity of its type and canonical name, and the group's greatest confidence (GR13 by exact name)."""
    named = entities.withColumn("_type", arrow.folded(F.col("entity_type"))).withColumn("_name", canonical_name(F.col("name")))
    groups = named.groupBy("_type", "_name").agg(F.min_by("entity_id", "pos").alias("resolved_id"), F.max("confidence").alias("_most"))
    return named.join(groups, ["_type", "_name"]).withColumn("confidence", F.col("_most")).drop("_type", "_name", "_most")


def merged_entities(resolved: DataFrame) -> DataFrame:
    """Of each group of resolved entities: all other names and aliases, sources, and the first value of each property (AGG19)."""
    of = resolved.groupBy("resolved_id").agg(F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat("aliases", F.when(F.col("entity_id") != F.col("resolved_id"), F.array("name")).otherwise(F.array().cast("array<string>"))))))).alias("aliases"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_ids")))).alias("source_ids"))
    first = resolved.select("resolved_id", "pos", F.explode("properties").alias("property", "value")).groupBy("resolved_id", "property").agg(F.min_by("value", "pos").alias("value"))
    properties = first.groupBy("resolved_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "value")))).alias("properties"))
    return of.join(properties, "resolved_id", "left")


def _renamed(rows: DataFrame, names: DataFrame, column: str, applies: Column | None = None) -> DataFrame:
    """Rows with what the column's entity resolves to in its place, where ``applies``."""
    key = F.col(column) if applies is None else F.when(applies, F.col(column))
    m = names.select(F.col("entity_id").alias("_from"), F.col("resolved_id").alias("_to"))
    return rows.withColumn("_key", key).join(m, F.col("_key") == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_key", "_from", "_to")


def rewritten_triplets(triplets: DataFrame, names: DataFrame) -> DataFrame:
    """Triplets whose subjects, and objects that are strings (value_type str), are replaced by what they resolve to (JN9)."""
    return _renamed(_renamed(triplets, names, "subject"), names, "object", F.col("value_type") == "str")


def rewritten_participants(events: DataFrame, names: DataFrame) -> DataFrame:
    """Events (event_id, participants) with each participant replaced by what it resolves to, in their order, repeats kept (JN9)."""
    each = events.select("event_id", F.posexplode("participants").alias("nth", "id"))
    item = F.struct("nth", "id")
    lists = _renamed(each, names, "id").groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["id"]).alias("_now"))
    return events.join(lists, "event_id", "left").withColumn("participants", F.coalesce("_now", "participants")).drop("_now")


def rewritten(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with both ends replaced by what they resolve to (JN9)."""
    m = names.select("entity_id", "resolved_id")
    out = relations
    for end in ("subject_id", "object_id"):
        out = out.join(m.select(F.col("entity_id").alias(end), F.col("resolved_id").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return out
