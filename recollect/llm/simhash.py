"""SimHash near-duplicates: fingerprints of word shingles, compared bit-sliced, joined to components.

Fingerprints: a shingle is three words in sequence (all words, where there are fewer); bit b is 1 where over half of the
shingles' XXH64 values have it.

Links: two fingerprints within ``RADIUS`` = 3 bits differ in at most three of six bands of bits, so three bands at least
are equal: each of the 20 choices of three bands is a table of blocks, and every link meets in one block of some table.
A block stands vertically: bit plane b holds bit b of up to 64 fingerprints in one machine word. One pass over the planes
updates 64 distances at a time in two carry-save counter planes and an overflow plane, and a word is abandoned once all
its lanes have overflowed. A block yields a star for each of its components (never all pairs), and stars are joined over
all blocks by alternating large-star and small-star steps, each cut in the checkpoint folder.

Equal fingerprints are folded into one row before anything is compared, so thousands of copies cost one comparison. Members
of a block have 31 bits or more in common and differ in the others. Blocks of over ``LARGE`` members are split: their other bits make
four parts, of which a link's fingerprints, 3 bits apart, have one in common, so members meet by block and part and no link
is lost. Blocks of over 64 members are searched breadth first, each member once against the members not yet reached, so a
group of near copies empties its block in a few steps.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; rows are kept one to one, repeated
doc_ids included; null doc_ids get the component of their fingerprint, whose id comes from the other rows (null if none
has one); other columns, whatever their names, are ignored by ``components`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import minhash
from recollect.llm.common import arrow_rows, cut, emit, row_number, unused_name, words_ascii_space, written
from recollect.llm.fingerprints import ALL as _ALL
from recollect.llm.fingerprints import LANES as _LANES
from recollect.llm.fingerprints import RADIUS, of_hashes, sliced, within

SHINGLE, SEED = 3, 42
#: Six bands of bits: the first bit and the width of each.
BANDS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
_TABLES = list(combinations(range(6), 3))
#: Blocks of more members than this are dealt anew by the bits that their members need not have in common.
LARGE = 8_192
#: Pairs of a query and a word of lanes that are compared in one go.
STEP = 1 << 15


def fingerprint(text: str | None) -> int:
    words = words_ascii_space(text)
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, len(words)
    if n <= SHINGLE:
        return digest(b" ".join(words), SEED)
    return of_hashes(np.fromiter([digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])], np.uint64, n - 2))


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """The row's number, its doc_id and the fingerprint as a signed long, for each row of ``docs``."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emit(((r, i, f - (f >> 63 << 64)) for r, i, t in arrow_rows(batches, ["row", "doc_id", "text"]) for f in (fingerprint(t),)), schema)

    return docs.select(row_number().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(run, "row long, doc_id long, fp long")


# --- bit-sliced comparison


def stars_of_small(fps: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars of blocks of at most 64 members; ``fps`` are ordered by ``block``.

    Blocks are put side by side: a word holds one block, and all queries of many blocks are compared at once.
    """
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    size = np.diff(np.r_[start, len(fps)])
    word = np.repeat(np.arange(len(start)), size)
    lane = np.arange(len(fps)) - start[word]
    laid = np.zeros((len(start), 64), np.uint64)
    laid[word, lane] = fps
    planes = sliced(laid.ravel())
    real = np.where(size == 64, _ALL, (np.uint64(1) << (size % 64).astype(np.uint64)) - np.uint64(1))
    near = np.concatenate([within(planes, word[i : i + STEP], fps[i : i + STEP]) for i in range(0, len(fps), STEP)]) & real[word]
    linked = np.flatnonzero(near != _LANES[lane])
    if not len(linked):
        return
    near = near[linked]
    at = np.full((len(start), 64), -1)
    at[word[linked], lane[linked]] = np.arange(len(linked))
    while True:  # each mask takes in the masks of its lanes, till none grows
        grown = near.copy()
        for k in range(64):
            has = np.flatnonzero(near & _LANES[k])
            other = at[word[linked[has]], k]
            grown[has[other >= 0]] |= near[other[other >= 0]]
        if (grown == near).all():
            break
        near = grown
    lowest = np.bitwise_count((near & (~near + np.uint64(1))) - np.uint64(1)).astype(np.int64)
    root = start[word[linked]] + lowest
    leaf = root != linked
    yield fps[linked[leaf]], fps[root[leaf]]


def stars_of_large(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars of one block of any size: breadth-first, each member compared once with the members not yet reached."""
    planes, n = sliced(fps), len(fps)
    unseen = np.full(planes.shape[1], _ALL)
    if n % 64:
        unseen[-1] = (np.uint64(1) << np.uint64(n % 64)) - np.uint64(1)
    for first in range(n):
        if not unseen[first // 64] & _LANES[first % 64]:
            continue
        unseen[first // 64] &= ~_LANES[first % 64]
        queue = np.array([first])
        while len(queue):
            head, queue = queue[:256], queue[256:]
            open_words = np.flatnonzero(unseen)
            if not len(open_words):
                return
            per = max(1, STEP // len(open_words))
            for i in range(0, len(head), per):
                q = head[i : i + per]
                near = within(planes, np.tile(open_words, len(q)), np.repeat(fps[q], len(open_words)))
                found = np.bitwise_or.reduce(near.reshape(len(q), -1), axis=0) & unseen[open_words]
                hit = np.flatnonzero(found)
                if len(hit):
                    lanes = (found[hit][:, None] & _LANES) != 0
                    row, lane = np.nonzero(lanes)
                    new = open_words[hit][row] * 64 + lane
                    unseen[open_words[hit]] &= ~found[hit]
                    queue = np.r_[queue, new]
                    yield fps[new], np.full(len(new), fps[first])


def _keys(fps: DataFrame) -> DataFrame:
    """A row for each fingerprint and table: table t has the three bands ``_TABLES[t]``, which together are the block's key."""
    band = [F.shiftrightunsigned("fp", lo).bitwiseAND((1 << n) - 1) for lo, n in BANDS]
    keys = [F.lit(t).cast("long") * (1 << 33) + band[a] * (1 << 22) + band[b] * (1 << 11) + band[c] for t, (a, b, c) in enumerate(_TABLES)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("block"))


def _split(members: DataFrame) -> DataFrame:
    """Members of large blocks (fp, block) by block and each of four parts of the bits outside the table's bands."""
    table, fp = F.shiftright("block", 33), F.col("fp")
    parts = []
    for t, bands in enumerate(_TABLES):
        bits = [lo + i for b, (lo, n) in enumerate(BANDS) if b not in bands for i in range(n)]
        masks = [sum(1 << x for x in bits[k::4]) for k in range(4)]
        parts.append(F.when(table == t, F.array(*(F.xxhash64("block", F.lit(k), fp.bitwiseAND(F.lit(m - (m >> 63 << 64)))) for k, m in enumerate(masks)))))
    return members.select("fp", F.explode(F.coalesce(*parts)).alias("block"))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ordered by block, the stars of each block; a block may go over the ends of batches."""

    def out(pairs):
        for a, b in pairs:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def blocks(fps: np.ndarray, block: np.ndarray):
        start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        size = np.diff(np.r_[start, len(fps)])
        size_of = np.repeat(size, size)
        small = (size_of > 1) & (size_of <= 64)
        if small.any():
            yield from out(stars_of_small(fps[small], block[small]))
        for s, n in zip(start[size > 64], size[size > 64]):
            yield from out(stars_of_large(fps[s : s + n]))

    fps, block = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows, enough = 0, 1 << 17
    for batch in batches:
        held.append((np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1))))
        rows += batch.num_rows
        if rows < enough:
            continue
        fps, block = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        whole = np.searchsorted(block, block[-1])  # the last block may go on
        if whole:
            yield from blocks(fps[:whole], block[:whole])
        held, rows = [(fps[whole:], block[whole:])], len(fps) - whole
        enough = max(1 << 17, 2 * rows)  # a block that goes on and on is put together a few times, not at every batch
    if held:
        fps, block = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        if len(fps):
            yield from blocks(fps, block)


def stars(fps: DataFrame, large: int = LARGE) -> DataFrame:
    """Links a - b between distinct fingerprints (column fp) that have the same components as all links have."""
    dealt = _keys(fps)
    sizes = dealt.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > large).select("block")
    if not sizes.isEmpty():
        sizes = cut(sizes)
        dealt = dealt.join(sizes, "block", "left_anti").select("fp", "block").unionAll(_split(dealt.join(sizes, "block", "left_semi")).select("fp", "block"))
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_stars, "a long, b long")


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the component's smallest node) of every node of the edges a - b.

    Alternating large-star and small-star: each turns every node's neighbours towards the smallest of them; the number of
    rounds grows with the logarithm of the longest path. Written to the checkpoint folder after each round.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct())
    before = None
    for _ in range(rounds):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 31)).alias("h")).first()
        if state == before or not state.n:
            break
        before = state
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.where("a <> b").distinct())
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(docs: DataFrame) -> DataFrame:
    """row, doc_id, fp (signed long), root (equal for rows of one component) and component_id of every row."""
    prints = cut(with_fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected(stars(distinct.select("fp")))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("row", "doc_id", "fp", "root", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, of each component only one: that of the smallest doc_id (null last), the first of its rows.

    Links are those of ``minhash``: a similarity of 0.8 over five words is far more than 3 bits of a fingerprint apart.

    Rows are told apart by their numbers, so ``docs`` must give its rows in the same order twice, as a table does.
    """
    number = unused_name(docs, "row")
    kept = minhash.rooted(docs, connected).groupBy("root").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias(number)).select(number)
    return docs.withColumn(number, row_number()).join(kept, number, "left_semi").drop(number)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, of each component only one: that of the smallest doc_id (null last), the first of its rows.

    Links are those of ``components``, and besides those of ``minhash``, as a similarity of 0.8 over five words can be far more than 3 bits
    of a fingerprint apart. The components of both are joined.

    Rows are told apart by their numbers, so ``docs`` must give its rows in the same order twice, as a table does.
    """
    number = unused_name(docs, "row")
    near = components(docs).select("row", F.col("root").alias("print"))
    both = cut(minhash.rooted(docs, connected).join(near, "row"))
    hubs = both.groupBy("print").agg(F.min("root").alias("hub"))
    joined = connected(both.select("print", "root").distinct().join(hubs, "print").select(F.col("root").alias("a"), F.col("hub").alias("b")))
    rooted = both.join(joined.select(F.col("node").alias("root"), F.col("root").alias("_all")), "root", "left").withColumn("root", F.coalesce("_all", "root"))
    kept = rooted.groupBy("root").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias(number)).select(number)
    return docs.withColumn(number, row_number()).join(kept, number, "left_semi").drop(number)
