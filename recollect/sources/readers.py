"""Readers of journals, ledgers, files and memory repositories into DataFrames with fixed schemas, and writers of partitions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

JOURNAL = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "timestamp", "role", "content", "event_id", "content_type", "sha256", "original_url", "local_path")] + [T.StructField("sequence", T.LongType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
LEDGER = "event_id string, task_id string, scope struct<tenant_id:string,agent_id:string,user_id:string>, completed_at string, interrupted boolean, tool_iterations int, transcript array<struct<role:string,content:string>>, final_response string, source_refs array<map<string,string>>"
KINDS = ("message", "file", "compaction_checkpoint")
MOST_BYTES = 10 * 1024 * 1024


def journal_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of journal files with the file, place and parsed record, and what is wrong with them (SRC1).

    A last line that is cut off (no line end, no JSON) is skipped; any other bad or blank line is an error row. Files, which must not be
    compressed, are read in byte ranges: a line's place is its place in its range after the lines of the ranges before, and a file whose
    lines with their ends are one byte longer than it has a last line without end. Only counts by range are shuffled.
    """
    at = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start", "file_size")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*at, F.col("value").alias("line"), F.monotonically_increasing_id().alias("_id"))
    ranges = lines.groupBy("file_path", "file_block_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"), F.sum(F.octet_length("line") + 1).alias("_bytes"), F.max("file_size").alias("_size"))
    of_file = Window.partitionBy("file_path")
    before = F.coalesce(F.sum("_rows").over(of_file.orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_end = F.sum("_bytes").over(of_file) > F.col("_size")
    ranges = ranges.select("file_path", "file_block_start", "_first", before.alias("_before"), F.when(open_end, F.sum("_rows").over(of_file) - 1).alias("_torn"))
    placed = lines.join(ranges, ["file_path", "file_block_start"]).select(F.col("file_path").alias("file"), (F.col("_id") - F.col("_first") + F.col("_before")).alias("pos"), "line", "_torn")
    parsed = placed.withColumn("record", F.from_json("line", JOURNAL, {"mode": "PERMISSIVE"}))
    bad = F.col("record").isNull() | F.col("record.type").isNull()
    kept = parsed.where(~(F.coalesce(F.col("pos") == F.col("_torn"), F.lit(False)) & bad))
    error = F.when(F.trim("line") == "", "blank").when(bad, "bad").when(~F.col("record.type").isin(*KINDS), "unknown type")
    return kept.select("file", "pos", "record", error.alias("error"))


def sequence_range(events: DataFrame, from_: int, through: int) -> DataFrame:
    """Rows of a range of sequences; the comparison is pushed into the scan (SRC3, SRC4)."""
    return events.where(F.col("sequence").between(from_, through))


def event(events: DataFrame, event_id: str) -> DataFrame:
    """One event by its id (SRC5)."""
    return events.where(F.col("event_id") == event_id).limit(1)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Completed tasks with a time stamp; rows without a time zone are errors (SRC7, FN36)."""
    raw = spark.read.schema(LEDGER).json(path)
    zoned = F.col("completed_at").rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return raw.withColumn("error", F.when(~zoned, "no time zone")).withColumn("completed_at", F.when(zoned, F.try_to_timestamp("completed_at")))


def manual_errors(tasks: DataFrame) -> DataFrame:
    """What keeps a manual import out: too few messages, no user or assistant, another last answer (SRC8)."""
    roles = F.transform("transcript", lambda m: m["role"])
    answers = F.filter("transcript", lambda m: m["role"] == "assistant")
    errors = F.array_compact(F.array(F.when(F.size("transcript") < 2, "short"), F.when(~F.array_contains(roles, "user"), "no user"), F.when(~F.array_contains(roles, "assistant"), "no assistant"), F.when(F.get(answers, F.size(answers) - 1)["content"] != F.col("final_response"), "other answer")))
    return tasks.select("event_id", F.explode(errors).alias("error"))


def content_type(path: Column) -> Column:
    """By suffix: json, html or csv, else plain (SRC12)."""
    low = F.lower(path)
    return F.when(low.endswith(".json"), "application/json").when(low.rlike(r"\.html?$"), "text/html").when(low.endswith(".csv"), "text/csv").otherwise("text/plain")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Text files of a folder up to a size, with content type and digest (SRC12)."""
    found = spark.read.format("binaryFile").load(path).where(F.col("length") <= MOST_BYTES)
    return found.select(F.col("path").alias("source_id"), content_type(F.col("path")).alias("content_type"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("collected_at"))


def repository_entries(files_: DataFrame) -> DataFrame:
    """Entries of memory files, which lines with a section sign divide, with ids from their content (SRC11, FN15)."""
    each = files_.select("source_id", F.posexplode(F.split("content", "\n§\n")).alias("pos", "content")).withColumn("content", F.trim("content")).where("content <> ''")
    return each.withColumn("memory_id", F.concat(F.lit("mem-"), F.sha2("content", 256)))


def front_matter(card: Column) -> Column:
    """key: value lines between two lines of dashes, as a map (FN17 for single values)."""
    head = F.regexp_extract(card, r"(?s)\A---\n(.*?)\n---", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_]+:"))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.split(x, ":", 2)[0].alias("key"), F.trim(F.split(x, ":", 2)[1]).alias("value"))))


def expired_files(lines: DataFrame, as_of: Column, days: int) -> DataFrame:
    """file and verdict: delete where its newest valid time is too old, keep, or failed where it has none (SNK12)."""
    newest = lines.groupBy("file").agg(F.max(F.try_to_timestamp("record.timestamp")).alias("newest"))
    old = F.unix_micros("newest") < F.unix_micros(as_of) - days * 86_400_000_000
    return newest.withColumn("verdict", F.when(F.col("newest").isNull(), "failed").when(old, "delete").otherwise("keep"))


def append_days(events: DataFrame, path: str, buckets: int = 16) -> None:
    """Rows as JSON lines in a folder for each UTC day and bucket of sessions (SNK1)."""
    day = F.to_date(F.timestamp_micros(F.unix_micros("created_at")))
    bucketed = events.withColumn("event_date", day).withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
    bucketed.write.mode("append").partitionBy("event_date", "bucket").json(path)


def day(spark: SparkSession, path: str, date: str) -> DataFrame:
    """Rows of one day; only its folder is read (SRC6)."""
    return spark.read.json(path).where(F.col("event_date") == F.to_date(F.lit(date)))


def unique_seeds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Seed records of JSON lines with their copies: a dataset and record id must be there once (SRC10)."""
    raw = spark.read.schema(schema).json(path)
    return raw.withColumn("copies", F.count("*").over(Window.partitionBy("source_dataset", "source_record_id")))


def fan_in(spark: SparkSession, sources: list[tuple[str, str]], readers: dict[str, Callable[[SparkSession, str], DataFrame]]) -> DataFrame:
    """Documents of all sources (type, path), with the type; an unknown type is an error (SRC16, SET1)."""
    out = None
    for kind, path in sources:
        if kind not in readers:
            raise ValueError(f"unknown type of source: {kind}")
        rows = readers[kind](spark, path).select("source_id", "content_type", "content").withColumn("source_type", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


def as_events(records: DataFrame, safe: str = "^[A-Za-z0-9_.-]{1,64}$") -> DataFrame:
    """Conversation records as ledger events; user ids that are not safe in names are replaced by a digest (PRJ4, FLT13)."""
    user = F.when(F.col("user").rlike(safe), F.col("user")).otherwise(F.concat(F.lit("u-"), F.left(F.sha2("user", 256), F.lit(24))))
    return records.select(F.concat(F.lit("evt-"), F.left(F.sha2(F.concat_ws(":", "source", "record_id"), 256), F.lit(32))).alias("event_id"), user.alias("user_id"), "transcript", "final_response", "completed_at")


def query_as_document(rows: DataFrame, source_id: str) -> DataFrame:
    """A query's whole result as one JSON document with its number of rows; for results of bounded size (SRC15)."""
    # one document by nature: a result that does not fit one row belongs into a table
    return rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("rows"), F.count("*").alias("row_count")).select(F.lit(source_id).alias("source_id"), F.concat(F.lit('{"row_count":'), "row_count", F.lit(',"rows":'), "rows", F.lit("}")).alias("content"))


def read_only(query: str) -> str:
    """The query, which must only read (SRC15)."""
    if not re.match(r"\s*(select|with|pragma)\b", query, re.I):
        raise ValueError("only select, with and pragma")
    return query


def chunks(texts: DataFrame, most: int) -> DataFrame:
    """Lines packed into chunks of at most ``most`` characters, with their places; an overlong line stays whole (FN12).

    A text of one line is split at blanks instead, a word that is too long stays whole. Chunks of nothing are left out.
    """
    key = texts.schema["source_id"]
    schema = StructType([key, T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("chunk", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for start, end in _places(text or "", most):
                    if end > start:
                        at.append(i)
                        rows.append((start, end, text[start:end]))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c) for c in zip(*rows))], names=[f.name for f in schema])

    return texts.select("source_id", "text").mapInArrow(run, schema)


def _places(text: str, most: int) -> Iterator[tuple[int, int]]:
    """Where chunks begin and end, in one go over the text's lines or words."""
    parts = re.compile(r"[^\n]*\n?") if "\n" in text else re.compile(r"\S+|\Z")
    start = end = None
    for m in parts.finditer(text):
        a, b = m.start(), m.end() - m[0].endswith("\n")
        if m.start() == m.end():
            continue
        if start is not None and b - start > most:
            yield start, end
            start = None
        start, end = a if start is None else start, b
    if start is not None:
        yield start, end
