"""Audit operators: facts and their conflicts, rules, ontology constraints, hash chains, fingerprints and exports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from recollect.operators.dealing import in_order


def fact_conflicts(facts: DataFrame) -> DataFrame:
    """Subject and predicate with several values, typed apart (AGG1): high severity for over two, else medium."""
    typed = F.concat_ws(":", "value_type", "object")
    sums = facts.groupBy("subject", "predicate").agg(F.count_distinct(typed).alias("values"), F.count_distinct("source_id").alias("sources")).where("values > 1")
    key = F.left(F.sha2(F.concat_ws("|", "subject", "predicate"), 256), F.lit(16))
    return sums.withColumn("severity", F.when(F.col("values") > 2, "high").otherwise("medium")).withColumn("conflict_id", key)


def _holds(op: Column, value: Column, wanted: Column) -> Column:
    """Whether a fact's value meets a condition; numbers are compared as numbers, a comparison that makes no sense is false."""
    a, b = value.try_cast("double"), wanted.try_cast("double")
    compared = (
        F.when(op == "eq", F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(value == wanted))
        .when(op == "ne", F.when(a.isNotNull() & b.isNotNull(), a != b).otherwise(value != wanted))
        .when(op == "gt", a > b)
        .when(op == "gte", a >= b)
        .when(op == "lt", a < b)
        .when(op == "lte", a <= b)
        .when(op == "contains", F.contains(value, wanted))
        .when(op == "in", F.array_contains(F.split(wanted, r"\|"), value))
    )
    return F.coalesce(compared, F.lit(False))


def _by_subject(met: DataFrame) -> DataFrame:
    """Rows dealt once by subject, for all that follows, to as many tasks as shuffles have: put together by size they would be few and large."""
    return met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "subject")


def matching_rules(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """subject and rule where all of a rule's conditions hold, in order of priority (GOV15, JN11, SRT4).

    rules: rule_id, priority, conclusion and conditions (field, op, wanted) as rows; facts: subject, field, value. A condition
    without a fact does not hold. Rules are broadcast: there are few fields, so facts dealt by field would come to few tasks.
    """
    total = rules.groupBy("rule_id").agg(F.count("*").alias("n"), F.first("priority").alias("priority"), F.first("conclusion").alias("conclusion"))
    met = facts.join(F.broadcast(rules.select("rule_id", "field", "op", "wanted")), "field").where(_holds(F.col("op"), F.col("value"), F.col("wanted")))
    conditions = F.size(F.collect_set(F.struct("field", "op", "wanted")))  # as many as the rule has, at most
    counted = _by_subject(met.select("subject", "rule_id", "field", "op", "wanted")).groupBy("subject", "rule_id").agg(conditions.alias("met"))
    matched = counted.join(F.broadcast(total), "rule_id").where("met = n")
    by = Window.partitionBy("subject").orderBy(F.desc("priority"), "rule_id")
    return matched.select("subject", "rule_id", "conclusion", F.row_number().over(by).alias("place"))


#: How explanations write the operators of conditions.
_SIGNS = {"eq": "==", "ne": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "in": "in", "contains": "contains"}


def explained_rules(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """The rules that ``matching_rules`` finds, each with the steps that led to it, a sentence for each condition in order (GOV15).

    rules as there, with version, source_ref and nth, the place of a condition in its rule; facts have one value for a field.
    Numbers are written bare, other values in single quotes. An operator that does not exist is an error, rather than a
    condition that never holds. What is gathered for a subject and a rule is bounded by the rule's conditions.
    """
    quoted = lambda c: F.when(c.try_cast("double").isNotNull(), c).otherwise(F.concat(F.lit("'"), c, F.lit("'")))
    known = F.when(F.col("op").isin(*_SIGNS), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unsupported operator: "), F.coalesce("op", F.lit("none")))))
    signs = F.create_map(*(F.lit(x) for pair in _SIGNS.items() for x in pair))
    conditions = rules.select("rule_id", "nth", "field", known.alias("op"), "wanted")
    met = facts.join(F.broadcast(conditions), "field").where(_holds(F.col("op"), F.col("value"), F.col("wanted")))
    step = F.concat_ws(" ", "field", F.element_at(signs, F.col("op")), quoted(F.col("wanted")), F.lit("matched actual value"), quoted(F.col("value")))
    steps = F.array_sort(F.collect_list(F.struct("nth", "step")))
    of = _by_subject(met.select("subject", "rule_id", "nth", step.alias("step"))).groupBy("subject", "rule_id").agg(steps.alias("steps"))
    heads = rules.groupBy("rule_id").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("priority", "conclusion", "version", "source_ref")))
    matched = of.join(F.broadcast(heads), "rule_id").where(F.size("steps") == F.col("n"))
    place = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("priority"), "rule_id"))
    return matched.select("subject", "rule_id", "version", "conclusion", "source_ref", F.transform("steps", lambda s: s["step"]).alias("steps"), place.alias("place"))


def ontology_errors(nodes: DataFrame, constraints: DataFrame) -> DataFrame:
    """id, field and error of nodes that break constraints (FLT12): required, of a type, or of allowed values.

    nodes: id, type, field, value (one row for each property; a null value is a missing one).
    constraints: type, field, required, value_type, allowed.
    """
    ids = nodes.select("id", "type").distinct()
    wanted = ids.join(constraints, "type")
    found = wanted.join(nodes.select("id", "field", "value"), ["id", "field"], "left")
    number = F.col("value").try_cast("double").isNotNull() | F.lower("value").isin("true", "false")
    error = (
        F.when(F.col("value").isNull(), F.when(F.col("required"), "missing"))
        .when((F.col("value_type") == "number") & ~number, "type")
        .when(F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.col("value")), "value")
    )
    return found.select("id", "field", error.alias("error")).where("error is not null")


def canonical(*columns: str) -> Column:
    """One string for a row's columns, the same in any engine."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def _record(payload: tuple[str, ...], previous: Column) -> Column:
    """What a row's checksum is of: its number, its payload and the checksum of the row before."""
    return F.concat_ws("|", F.col("sequence_id").cast("string"), canonical(*payload), previous)


def chained(rows: DataFrame, *payload: str) -> DataFrame:
    """Rows (chain_id, sequence_id from 1) with checksums, each over the row and the checksum of the row before it (GR10).

    A chain is made one row after another: its rows come to one task as a sorted stream, which keeps one checksum.
    """
    schema = StructType([*rows.schema.fields, StructField("previous_checksum", StringType()), StructField("checksum", StringType())])
    record = _record(payload, F.lit(""))  # with an empty link: the checksum goes behind it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, ""
        for batch in batches:
            links, sums = [], []
            for chain, text in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                digest = digest if (chain,) == last else ""
                last = (chain,)
                links.append(digest)
                digest = hashlib.sha256((text + digest).encode()).hexdigest()
                sums.append(digest)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(links, pa.string()), pa.array(sums, pa.string())], names=[f.name for f in schema])

    dealt = in_order(rows, ["chain_id"], "sequence_id")
    return dealt.withColumn("_chain", F.col("chain_id").cast("string")).withColumn("_record", record).mapInArrow(run, schema)


def chain_errors(chain: DataFrame, *payload: str) -> DataFrame:
    """Rows whose number, link or checksum is wrong, a row for each error (WIN14).

    Links are compared with the row before, checksums with those of the rows as they are, previous checksum included; so
    all rows are checked at once, and a row that is taken out, changed or linked anew is seen.
    """
    by = Window.partitionBy("chain_id").orderBy("sequence_id")
    checked = chain.withColumn("_n", F.row_number().over(by)).withColumn("_before", F.coalesce(F.lag("checksum").over(by), F.lit("")))
    own = F.sha2(_record(payload, F.coalesce("previous_checksum", F.lit(""))), 256)
    errors = F.array_compact(F.array(F.when(F.col("sequence_id") != F.col("_n"), "sequence"), F.when(F.coalesce("previous_checksum", F.lit("")) != F.col("_before"), "link"), F.when(F.coalesce("checksum", F.lit("")) != own, "checksum")))
    return checked.select("chain_id", "sequence_id", F.explode(errors).alias("error"))


def fingerprint(files: DataFrame, key: str) -> DataFrame:
    """One digest of each set of files: names and contents in order of name, each closed by a zero byte (AGG24).

    A set's files come to one task as a sorted stream, which goes through one running digest: nothing is collected.
    """
    schema = StructType([files.schema[key], StructField("fingerprint", StringType()), StructField("files", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, n = None, None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([last, pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], names=[f.name for f in schema])

        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(0).slice(i, 1)
                if last is None or not own.equals(last):
                    if digest is not None:
                        yield done()
                    last, digest, n = own, hashlib.sha256(), 0
                for column in (1, 2):
                    digest.update(batch.column(column)[i].as_py().encode() + b"\0")
                n += 1
        if digest is not None:
            yield done()

    return in_order(files.select(key, "name", F.coalesce("content", F.lit("")).alias("content")), [key], "name").mapInArrow(run, schema)


def snapshot_id(files: DataFrame) -> Column:
    """Digest of the JSON of paths with content digests and whether each existed, in order of path (AGG25); one row a path of a bounded set."""
    entry = F.concat(F.to_json(F.struct("path")).substr(F.lit(9), F.length(F.to_json(F.struct("path"))) - 9), F.lit(':{"existed":'), F.col("existed").cast("string"), F.lit(',"sha256":"'), F.coalesce("sha256", F.lit("")), F.lit('"}'))
    return F.sha2(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", entry.alias("e")))), lambda x: x["e"]), ","), F.lit("}")), 256)


def manifest_differences(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """name and reason of artifacts that are missing, not listed or changed (JN16)."""
    both = manifest.select("name", F.col("sha256").alias("_listed")).join(found.select("name", F.col("sha256").alias("_found")), "name", "full_outer")
    reason = F.when(F.col("_found").isNull(), "missing").when(F.col("_listed").isNull(), "unlisted").when(F.col("_listed") != F.col("_found"), "changed")
    return both.select("name", reason.alias("reason")).where("reason is not null")


def compliance(edges: DataFrame) -> DataFrame:
    """By decision: no violation and at least one approval make it compliant (AGG21)."""
    sums = edges.groupBy(F.col("source").alias("decision_id")).agg(F.count_if(F.col("type") == "VIOLATES").alias("violations"), F.count_if(F.col("type") == "APPROVED_BY").alias("approvals"))
    return sums.withColumn("compliant", (F.col("violations") == 0) & (F.col("approvals") > 0))


def _iri(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit("<urn:node:"), F.left(F.sha2(value.cast("string"), 256), F.lit(24)), F.lit(">"))


def turtle(edges: DataFrame, nodes: DataFrame | None = None, provenance: DataFrame | None = None) -> DataFrame:
    """Lines of a Turtle export, nodes named by digests (SNK7): a statement for each edge; with nodes (id, type) their types;
    with provenance (entity_id, derived_from, checksum, invalidated) derivations, checksums and what is invalidated."""
    line = lambda *parts: F.concat_ws(" ", *parts, F.lit(".")).alias("line")
    out = edges.select(line(_iri("source"), F.lit("<urn:rel:relatedTo>"), _iri("target")))
    if nodes is not None:
        out = out.unionAll(nodes.select(line(_iri("id"), F.lit("a"), F.concat(F.lit("<urn:type:"), F.regexp_replace("type", "[^A-Za-z0-9]+", "_"), F.lit(">")))))
    if provenance is not None:
        own = _iri("entity_id")
        out = out.unionAll(provenance.select("entity_id", F.explode("derived_from").alias("parent")).select(line(own, F.lit("prov:wasDerivedFrom"), _iri("parent"))))
        out = out.unionAll(provenance.select(line(own, F.lit("<urn:rel:checksum>"), F.concat(F.lit('"'), "checksum", F.lit('"')))))
        out = out.unionAll(provenance.where("invalidated").select(line(own, F.lit("<urn:rel:invalidated>"), F.lit("true"))))
    return out


def in_order_of(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each decision's evidence in the order of its ids; ids without evidence are left out (JN5)."""
    at = decisions.select("decision_id", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    found = at.join(evidence, "evidence_id")
    return found.groupBy("decision_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]), ",").alias("evidence"))


def lines_of_records(texts: DataFrame) -> DataFrame:
    """Records in lines such as ENTITY|id|name|type, by kind with their fields (FN13)."""
    line = texts.select("source_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    part = F.split(F.trim("line"), r"\|")
    kind = F.upper(F.trim(part[0]))
    return line.where(kind.isin("ENTITY", "RELATION", "EVENT", "TRIPLE") & (F.size(part) >= 3)).select("source_id", "pos", kind.alias("kind"), F.trim(part[1]).alias("first"), F.trim(part[2]).alias("second"), F.trim(F.coalesce(F.get(part, 3), F.lit(""))).alias("third"))
