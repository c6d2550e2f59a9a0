"""Importance resampling towards a target: hashed word n-grams weigh texts, Gumbel noise draws without replacement.

Words are runs of letters and digits with A-Z in lower case; features are all runs of one to three words, joined by a
space, repeats counted, each in the bucket that its CRC-32 modulo ``BUCKETS`` names.

Identical texts are collapsed first, by grouping the full text: features and weights are computed once for each text, and
its features enter the counts of the source times its copies. Tasks add up bucket counts in arrays of fixed size before anything
is shuffled; the gains are a table of ``BUCKETS`` numbers, whatever the input. Weights go back to the rows by the text's
SHA-256, and only then does each row get its own noise. Ranks come from one sort of narrow rows into ranges; a row's place is its place
in its range after the rows of the ranges before, so no task sees all rows.

Defined cases: null and empty texts have no features, weight zero and no rank; repeated doc_ids are rows of their own (with equal texts
they tie, in any order); a null doc_id counts as an empty one in the noise and is last among ties; other columns, whatever their names, are
ignored; an empty table of either kind gives counts of zero.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import arrow_rows, cut, emit, lower_ascii, written

BUCKETS, LONGEST, SEED = 10_000, 3, 42
LEAST_WORDS = 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text: str | None) -> tuple[int, np.ndarray]:
    """The number of words of the text, and the bucket of each of its features."""
    words = [w.encode() for w in _WORD.findall(lower_ascii(text))] if text else []
    crc = zlib.crc32
    runs = [crc(w) for w in words]
    found = list(runs)
    for n in range(1, LONGEST):  # the CRC of a run goes on from that of the run without its last word
        runs = [crc(b" " + w, c) for w, c in zip(words[n:], runs)]
        found += runs
    return len(words), np.array(found, np.uint32) % BUCKETS


def features(texts: DataFrame) -> DataFrame:
    """key, copies, n_words, n_features, and the buckets as two-byte numbers, of each text (key, copies, text)."""
    schema = pa.schema([("key", pa.binary()), ("copies", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, n, *buckets(t)) for k, n, t in arrow_rows(batches, ["key", "copies", "text"]))
        return emit(((k, n, w, len(b), np.sort(b).astype(np.uint16).tobytes()) for k, n, w, b in rows), schema, 256)

    return texts.mapInArrow(run, "key binary, copies long, n_words long, n_features long, buckets binary")


def counts(found: DataFrame) -> np.ndarray:
    """How many features each bucket has in all texts, copies counted."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for copies, held in arrow_rows(batches, ["copies", "buckets"]):
            total += copies * np.bincount(np.frombuffer(held, np.uint16), minlength=BUCKETS)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], schema=schema)

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in found.select("copies", "buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths."""
    s_all, t_all = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (s_all + BUCKETS) / ((int(s) + 1) * (t_all + BUCKETS)))) for s, t in zip(source, target)], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, n_features, n_words and weight of each text."""
    schema = pa.schema([("key", pa.binary()), ("n_features", pa.int64()), ("n_words", pa.int64()), ("weight", pa.int64())])
    columns = ["key", "n_features", "n_words", "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emit(((k, n, w, int(gain[np.frombuffer(b, np.uint16)].sum())) for k, n, w, b in arrow_rows(batches, columns)), schema)

    return found.select(*columns).mapInArrow(run, "key binary, n_features long, n_words long, weight long")


def _distinct(docs: DataFrame) -> DataFrame:
    """key, copies and text of each distinct text that is not empty."""
    texts = docs.select("text").where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    return texts.select(_key().alias("key"), "copies", "text")


def _key():
    return F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))


def ranked(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``rows`` with rank: 1, 2, ... for the highest scores among those with enough words, as many as the share asks for, else null."""
    taken = F.col("n_words") >= LEAST_WORDS
    first = cut(rows.withColumn("taken", taken).orderBy(F.col("taken").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    # what is read back keeps the ranges as its partitions, and their order
    placed = first.withColumn("range", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    sizes = placed.groupBy("range").agg(F.count("*").alias("rows"), F.count_if("taken").alias("n")).orderBy("range").collect()  # one row a range
    drawn = sum(s.n for s in sizes) * share[0] // share[1]
    before, starts = 0, []
    for s in sizes:
        starts.append((s["range"], before))
        before += s.rows
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "range int, before long"))
    place = F.col("place") + F.col("before")
    return placed.join(start, "range").withColumn("rank", F.when(F.col("taken") & (place <= drawn), place)).drop("range", "place", "before", "taken")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100)) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; ``share`` of those with enough words are drawn."""
    found = written(features(_distinct(docs)))
    wanted = features(target.select(F.lit(b"").alias("key"), F.lit(1).cast("long").alias("copies"), "text"))
    weights = weighed(found, gains(counts(found), counts(wanted)))
    named = docs.select(F.col("doc_id").cast("long"), _key().alias("key")).join(weights, "key", "left")
    zero = {"n_features": 0, "n_words": 0, "weight": 0}
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = named.fillna(zero).select("doc_id", "n_features", "n_words", "weight", (F.col("weight") + noise).cast("long").alias("score"))
    return ranked(scored, share).select("doc_id", "n_features", "weight", "score", "rank")
