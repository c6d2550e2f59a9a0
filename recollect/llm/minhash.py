"""Links between near copies: SimHash fingerprints compared bit-sliced in blocks, and an exact comparison of shingles decides.

Shingles are five words in sequence (all words, where there are fewer), as XXH64 values. Texts with equal sets of shingles
are one node. Blocks are made by least hashes: ``BANDS`` bands of ``ROWS`` minima each; of pairs with a Jaccard similarity
of 0.8 a share of 1 - (1 - 0.8 ** 5) ** 20 = 0.9996 meets in some block, of more similar ones more.

In a first round every member of a block is compared with the member that shares blocks with most others, as the text that
all were copied from does; nodes linked so are one component. In a second round members of different components are
compared: all of them in blocks of up to ``SMALL``, in larger ones those whose fingerprints are ``RADIUS`` bits apart at most
(the fingerprints of 64 bits of two sets with a similarity of 0.8 are 10 apart, with a deviation of 3, so a share of 0.9998
is within it). There the largest component need not ask, and members are dealt into parts of ``PART``, so no task holds a
whole block of any size and near copies of one text are not compared with each other again. Pairs whose sets have a
similarity of at least ``LEAST`` are links; no candidate is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import arrow_rows, cut, emit, row_number, words_ascii_space
from recollect.llm.fingerprints import of_hashes, sliced, within

SHINGLE, LEAST, BANDS, ROWS, SMALL, SEED = 5, 0.8, 20, 5, 32, 42
RADIUS, PART, ASKED = 20, 8_192, 128
_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
#: Shingles that are hashed anew in one go.
STEP = 1 << 12


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    words = words_ascii_space(text)
    if not words:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, len(words)
    if n <= SHINGLE:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.unique(np.fromiter([digest(b"%b %b %b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], words[3:], words[4:])], np.uint64, n - SHINGLE + 1))


def blocks(h: np.ndarray) -> list[int]:
    """The block of each band, as signed longs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(h), STEP):
        np.minimum(least, (h[i : i + STEP] * _TIMES + _PLUS).min(axis=1), out=least)
    values = (xxhash.xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(least.reshape(BANDS, ROWS)))
    return [v - (v >> 63 << 64) for v in values]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets; that of two empty ones is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def sketches(docs: DataFrame) -> DataFrame:
    """row, doc_id, a digest of the set of shingles, its fingerprint and its blocks, for each row of ``docs``."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("set_is", pa.binary()), ("fp", pa.int64()), ("blocks", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emit(((r, i, xxhash.xxh128_digest(h.tobytes()), f - (f >> 63 << 64), blocks(h)) for r, i, t in arrow_rows(batches, ["row", "doc_id", "text"]) for h in (shingles(t),) for f in (of_hashes(h),)), schema)

    return docs.select(row_number().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(run, "row long, doc_id long, set_is binary, fp long, blocks array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """node and its set of shingles, from row and text."""
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emit(((r, shingles(t).tobytes()) for r, t in arrow_rows(batches, ["row", "text"])), schema, 256)

    return rows.mapInArrow(run, "node long, set binary")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = arrow_rows(batches, ["a", "b", "set_a", "set_b"])
        return emit(((a, b) for a, b, x, y in rows if similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= LEAST), schema)

    of_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return of_b.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").mapInArrow(run, "a long, b long")


def near_lanes(lanes: np.ndarray, asked: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places of fingerprints asked and of lanes that are at most ``radius`` bits apart."""
    planes = sliced(lanes)
    words = planes.shape[1]
    near = within(planes, np.tile(np.arange(words), len(asked)), np.repeat(asked, words), radius).reshape(len(asked), words)
    at, word, lane = np.nonzero((near[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
    place = word * 64 + lane
    real = place < len(lanes)
    return at[real], place[real]


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes of different components with near fingerprints: of each part of a block the lanes, then those that ask."""
    key, lanes, asked = None, [], []

    def answers() -> Iterator[pa.RecordBatch]:
        if lanes and asked:
            node, root, fp = (np.array(c, np.int64) for c in zip(*lanes))
            for i in range(0, len(asked), ASKED):
                n, r, f = (np.array(c, np.int64) for c in zip(*asked[i : i + ASKED]))
                q, p = near_lanes(fp.view(np.uint64), f.view(np.uint64))
                other = r[q] != root[p]
                a, b = n[q[other]], node[p[other]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        asked.clear()

    for block, part, asks, node, root, fp in arrow_rows(batches, ["block", "part", "asks", "node", "root", "fp"]):
        if (block, part) != key:
            yield from answers()
            key = block, part
            lanes.clear()
        (asked if asks else lanes).append((node, root, fp))
        if len(asked) >= PART:
            yield from answers()
    yield from answers()


def _of_large(members: DataFrame) -> DataFrame:
    """Pairs of large blocks (node, block, members, root, fp) that are worth an exact comparison."""
    most = members.groupBy("block", "root").agg(F.count("*").alias("n")).groupBy("block").agg(F.max_by("root", "n").alias("most"))
    parts = F.ceil(F.col("members") / PART).cast("int")
    columns = ("block", "part", "asks", "node", "root", "fp")
    lanes = members.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("asks", F.lit(False)).select(*columns)
    asks = members.join(most, "block").where("root <> most").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("asks", F.lit(True)).select(*columns)
    stream = lanes.unionByName(asks).repartition("block", "part").sortWithinPartitions("block", "part", "asks")
    return stream.mapInArrow(_near_pairs, "a long, b long").distinct()


def rooted(docs: DataFrame, connected: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """row, doc_id and root (equal for rows of one component) of every row of ``docs``."""
    rows = cut(sketches(docs))
    nodes = cut(rows.groupBy("set_is").agg(F.min("row").alias("node")))
    dealt = rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "fp", F.explode("blocks").alias("block"))
    sizes = dealt.groupBy("block").agg(F.count("*").alias("members")).where("members > 1")
    shared = cut(dealt.join(sizes, "block").select("node", "fp", "block", "members"))
    texts = docs.select(row_number().alias("row"), "text").join(shared.select(F.col("node").alias("row")).distinct(), "row", "left_semi")
    sets = cut(_sets(texts))

    pair = F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")
    met = shared.groupBy("node").agg(F.sum("members").alias("met"))
    hubs = shared.join(met, "node").groupBy("block").agg(F.min(F.struct((-F.col("met")).alias("by"), F.col("node").alias("hub"))).alias("h")).select("block", "h.hub")
    links = cut(_similar(shared.join(hubs, "block").where("node <> hub").select(*pair).distinct(), sets))
    found = connected(links)

    members = cut(shared.join(found, "node", "left").select("node", "fp", "block", "members", F.coalesce("root", "node").alias("root")))
    small = members.where(F.col("members") <= SMALL)
    others = small.select("block", F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    apart = small.join(others, "block").where("root <> hub_root").select(*pair).distinct()
    more = cut(_similar(apart.unionAll(_of_large(members.where(F.col("members") > SMALL))), sets))
    if not more.isEmpty():
        found = connected(links.unionAll(more))
    named = nodes.join(found, "node", "left").select("set_is", F.coalesce("root", "node").alias("root"))
    return rows.select("row", "doc_id", "set_is").join(named, "set_is").select("row", "doc_id", "root")
