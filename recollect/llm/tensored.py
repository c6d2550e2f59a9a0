"""Near-duplicates by MinHash with tensored banding; every link is confirmed on the full sets of shingles.

A document's set: its distinct runs of four words (the whole sequence, where there are fewer; nothing without words), as
XXH64 values. Links: sets with a Jaccard similarity of 0.8 or more, compared in whole numbers.

Tensored banding: two collections of ``BANDS`` bands, each of ``ROWS`` minima, are computed for each set. A table's key
joins one band of the first collection with one of the second, so BANDS * BANDS = 196 tables with keys of six minima need
2 * BANDS * ROWS = 84 minima instead of 1,176. Pairs of similarity 0.8 meet in some table with a probability of
(1 - (1 - 0.8 ** 3) ** 14) ** 2 = 0.9999; of 0.85, 0.999997. A key can be shared only where both its bands are, so bands
that one set alone has are dropped before any are joined to keys: most documents make no key at all.

Verification: equal sets are one node, so copies cost one row. In a first round each member of a block (of one key) is
compared with the block's hub, the member that shares blocks with most others. Then members of different components are
compared: directly in blocks of up to ``SMALL``; in larger ones those that share one of their rarest shingles. A pair is
that similar only if among the fifth (and one more) of either set that fewest sets hold, there is one in common, so this
loses no pair and parts documents that have only common passages in common. Rare shingles that ``SMALL`` members hold give
pairs; those that more hold make clusters, whose members meet in cells of bounded size, without a row for each pair. No
candidate is left out.

Defined cases: null and empty texts, and those of white space only, have an empty set, linked with nothing; their component
is their own doc_id. Rows are kept one to one, repeated doc_ids included. Null doc_ids get the component of their set, named by
its other rows (null if none has an id). Other columns, whatever their names, are ignored. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import arrow_rows, emit, row_number, words_ascii_space, written
from recollect.llm.simhash import connected

SHINGLE, SEED, PERCENT = 4, 42, 80
BANDS, ROWS, SMALL = 14, 3, 16
#: Shingles in a part of a cluster.
PART = 1 << 19
_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(0, 1 << 63, (2 * BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, (2 * BANDS * ROWS, 1), dtype=np.uint64)
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
    return np.unique(np.fromiter([digest(b"%b %b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], words[3:])], np.uint64, n - SHINGLE + 1))


def bands(h: np.ndarray) -> list[int]:
    """The bands of both collections, the first's first, as signed longs that differ from band to band."""
    if not len(h):
        return []
    least = np.full(2 * BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(h), STEP):
        np.minimum(least, (h[i : i + STEP] * _TIMES + _PLUS).min(axis=1), out=least)
    values = (xxhash.xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(least.reshape(2 * BANDS, ROWS)))
    return [v - (v >> 63 << 64) for v in values]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets share at least ``PERCENT`` of their union."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, a digest of the set (null: empty) and its bands, for each row of ``docs``."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_is", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r, i, shingles(t)) for r, i, t in arrow_rows(batches, ["row", "doc_id", "text"]))
        return emit(((r, i, len(h), xxhash.xxh128_digest(h.tobytes()) if len(h) else None, bands(h)) for r, i, h in rows), schema)

    return docs.select(row_number().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(run, "row long, doc_id long, n_shingles long, set_is binary, bands array<long>")


def keys(nodes: DataFrame) -> DataFrame:
    """node and block for each key that a node (node, bands) may share: a band of either collection, both of which others have too."""
    halves = nodes.select("node", F.posexplode("bands").alias("place", "band")).select("node", (F.col("place") >= BANDS).alias("second"), "band")
    shared = halves.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    of_node = halves.join(shared, "band").groupBy("node").agg(*(F.collect_list(F.when(F.col("second") == s, F.col("band"))).alias(name) for s, name in ((False, "a"), (True, "b"))))
    joined = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    return of_node.select("node", F.explode(joined).alias("block"))


def _sets(rows: DataFrame) -> DataFrame:
    """node and its set, from row and text."""
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emit(((r, shingles(t).tobytes()) for r, t in arrow_rows(batches, ["row", "text"])), schema, 256)

    return rows.mapInArrow(run, "node long, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are linked."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = arrow_rows(batches, ["a", "b", "set_a", "set_b"])
        return emit(((a, b) for a, b, x, y in rows if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))), schema)

    of_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return of_b.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").mapInArrow(run, "a long, b long")


def _exploded(sets: DataFrame) -> DataFrame:
    """node, root, the size of its set and each of its shingles."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("size", pa.int32()), ("shingle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, root, held in arrow_rows(batches, ["node", "root", "set"]):
            h = np.frombuffer(held, np.int64)
            for i in range(0, len(h), 1 << 16):
                part = h[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), x, t)) for x, t in ((node, np.int64), (root, np.int64), (len(h), np.int32))] + [pa.array(part)], schema=schema)

    return sets.mapInArrow(run, "node long, root long, size int, shingle long")


def _rare(members: DataFrame, sets: DataFrame) -> DataFrame:
    """node, root, size and shingle: of each member (node, root) the shingles that fewest members hold, as many as one must be common in of a link; those within one component are left out."""
    each = written(_exploded(sets.join(members, "node").select("node", "root", "set")))
    held = each.groupBy("shingle").agg(F.count("*").alias("held"), F.min("root").alias("low"), F.max("root").alias("high"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("held", "shingle"))
    # 100 * both >= PERCENT * union asks for both >= PERCENT / 100 of either set, so one of its first size - that + 1 is in common
    first = F.col("size") - F.ceil(F.col("size") * PERCENT / 100).cast("int") + 1
    return each.join(held, "shingle").withColumn("rank", rank).where(F.col("rank") <= first).where("low < high").select("node", "root", "size", "shingle")


def _rare_pairs(rare: DataFrame, few: DataFrame) -> DataFrame:
    """Pairs of different components and like sizes that have a shingle of ``few`` in common, which ``SMALL`` members hold at most."""
    one = rare.join(few, "shingle")
    other = one.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("node", "root", "size")))
    pairs = one.join(other, "shingle").where("node < node_b AND root <> root_b").where(100 * F.least("size", "size_b") >= PERCENT * F.greatest("size", "size_b"))
    return pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between nodes of different components, of each cell first the lanes (node, root, set), then those that ask."""
    key, lanes, held = None, [], None

    def of(node: int, root: int, shingle: np.ndarray) -> Iterator[tuple[int, int]]:
        nodes, roots, sizes, tokens, lane = held
        low, high = np.searchsorted(tokens, shingle), np.searchsorted(tokens, shingle, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())  # all places from low to high, one shingle after the other
        both = np.bincount(lane[at], minlength=len(nodes))
        for x in nodes[(roots != root) & (100 * both >= PERCENT * (sizes + len(shingle) - both))]:
            yield min(node, int(x)), max(node, int(x))

    def links() -> Iterator[tuple[int, int]]:
        nonlocal key, held
        for cluster, part, ask_part, asks, node, root, shingle in arrow_rows(batches, ["cluster", "part", "ask_part", "asks", "node", "root", "set"]):
            if (cluster, part, ask_part) != key:
                key, held = (cluster, part, ask_part), None
                lanes.clear()
            if not asks:
                lanes.append((node, root, np.frombuffer(shingle, np.uint64)))
            elif lanes:
                if held is None:
                    sizes, tokens = np.array([len(x[2]) for x in lanes]), np.concatenate([x[2] for x in lanes])
                    order = np.argsort(tokens, kind="stable")
                    held = np.array([x[0] for x in lanes]), np.array([x[1] for x in lanes]), sizes, tokens[order], np.repeat(np.arange(len(lanes)), sizes)[order]
                yield from of(node, root, np.frombuffer(shingle, np.uint64))

    return emit(links(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _clustered_links(rare: DataFrame, few: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a, b between members of different components that have a shingle in common which many hold.

    Members that meet by such shingles are a cluster. Its members are dealt into parts of ``PART`` shingles or so; each part meets those who
    ask, all but the largest component's, part by part, in cells of bounded size that count all their overlaps at once.
    """
    many = written(rare.join(few, "shingle", "left_anti"))
    least = many.groupBy("shingle").agg(F.min("node").alias("a"))
    found = connected(many.join(least, "shingle").select("a", F.col("node").alias("b"))).withColumnRenamed("root", "cluster")
    member = many.groupBy("node").agg(F.first("root").alias("root"), F.first("size").alias("size"))
    member = written(member.join(found, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")))
    of_root = member.groupBy("cluster", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    clusters = of_root.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.ceil(F.sum("size") / PART).cast("int").alias("parts"))
    dealt = member.join(clusters, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("all", F.sequence(F.lit(0), F.col("parts") - 1))
    lanes = dealt.select("node", "root", "cluster", F.col("own").alias("part"), F.explode("all").alias("ask_part"), F.lit(False).alias("asks"))
    asks = dealt.where("root <> most").select("node", "root", "cluster", F.explode("all").alias("part"), F.col("own").alias("ask_part"), F.lit(True).alias("asks"))
    cell = "cluster", "part", "ask_part"
    stream = lanes.unionAll(asks).join(sets, "node").repartition(*cell).sortWithinPartitions(*cell, "asks")
    return stream.mapInArrow(_cells, "a long, b long").distinct()


def rooted(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles and root (equal for rows of one component; null for empty sets) of every row of ``docs``."""
    rows = written(sketches(docs))
    nodes = written(rows.where("set_is IS NOT NULL").groupBy("set_is").agg(F.min("row").alias("node")))
    dealt = keys(rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "bands"))
    dealt = written(dealt)
    sizes = dealt.groupBy("block").agg(F.count("*").alias("members")).where("members > 1")
    shared = written(dealt.join(sizes, "block").select("block", "node", "members").sortWithinPartitions("block"))
    met = written(shared.groupBy("node").agg(F.sum("members").alias("met")))
    hubs = shared.join(met, "node").groupBy("block").agg(F.min(F.struct((-F.col("met")).alias("by"), F.col("node").alias("hub"))).alias("h")).select("block", "h.hub")
    texts = docs.select(row_number().alias("row"), "text").join(met.select(F.col("node").alias("row")), "row", "left_semi")
    sets = written(_sets(texts))

    pair = F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")
    links = written(_confirmed(shared.join(hubs, "block").where("node <> hub").select(*pair).distinct(), sets))
    found = connected(links)

    members = shared.join(found, "node", "left").select("node", "block", "members", F.coalesce("root", "node").alias("root"))
    mixed = members.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("block")
    members = written(members.join(mixed, "block", "left_semi"))
    small = members.where(F.col("members") <= SMALL)
    others = small.select("block", F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    apart = small.join(others, "block").where("root < hub_root").select(*pair).distinct()
    large = members.where(F.col("members") > SMALL).select("node", "root").distinct()
    rare = written(_rare(large, sets))
    few = written(rare.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") <= SMALL).select("shingle"))
    more = written(_confirmed(apart.unionAll(_rare_pairs(rare, few)).distinct(), sets).unionAll(_clustered_links(rare, few, sets)))
    if not more.isEmpty():
        found = connected(links.unionAll(more))
    named = nodes.join(found, "node", "left").select("set_is", F.coalesce("root", "node").alias("root"))
    return rows.select("row", "doc_id", "n_shingles", "set_is").join(named, "set_is", "left").select("row", "doc_id", "n_shingles", "root")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the component's smallest doc_id) and kept (whether that is the row's own) of every row."""
    rows = written(rooted(docs))
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("first_id"))
    named = rows.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("first_id")))
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
