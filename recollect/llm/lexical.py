"""Ranked lexical search: compressed postings in shards, read document at a time.

Terms are runs of letters and digits with A-Z in lower case. Building: each task walks its documents and closes a shard after
``DOCS`` of them or ``POSTINGS`` postings. A shard is one row: its documents' ids in order and their lengths, its
terms, and for each term its postings, sorted by doc_id: gaps of places and term frequencies as variable-length
bytes. Nothing is shuffled but the counts of terms; the shards are a table in the shared folder.

Searching: queries come in blocks of ``BLOCK``, of which all shards see one at a time. For each query and shard a heap
merges the cursors of its terms document by document. A bounded heap, keyed score then doc_id, holds the query's best so far, over all
shards that a task reads. Terms whose best scores in the shard together do not reach the worst of a full heap open no document:
only the other terms are merged, and theirs are looked up for documents that can still get in. So results are
exact. What tasks have found is merged in two steps, each of at most ``k`` rows a query and task.

Scores are whole numbers (see ``weight`` and ``impacts``). A term that nearly every document holds may have weight zero; a
document without score above zero is not returned.

Defined cases: null texts and those without terms are no documents (they count nowhere); queries without terms give no row; repeated
doc_ids are documents of their own and ties between them are alike; a null doc_id comes last among ties; repeated items are
queries of their own; other columns, whatever their names, are ignored; an empty table of either kind gives no row.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import arrow_rows, cut, emit, kept_in_worker, lower_ascii, new_key, row_number, written

DOCS, POSTINGS, BLOCK = 2_048, 1 << 20, 2_048
#: Queries' terms up to this number restrict the index to them; with more, it has all terms.
TERMS = 1 << 20
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A doc_id that stands for null: after all others.
NONE = (1 << 63) - 1


def terms(text: str | None) -> list[str]:
    return _TERM.findall(lower_ascii(text)) if text else []


# --- bytes


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, seven bits a byte, low bits first; the last byte of each has its high bit clear."""
    v = np.asarray(numbers, np.uint64)
    if not len(v):
        return b""
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1) << np.uint64(7 * k)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max())):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[start[has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def unpacked(held: bytes) -> np.ndarray:
    b = np.frombuffer(held, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(b < 128)
    if len(last) == len(b):
        return b.astype(np.uint64)
    start = np.r_[0, last[:-1] + 1]
    shift = np.arange(len(b)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * shift).astype(np.uint64), start)


# --- building


def _shard(docs: list[tuple[int, Counter]]) -> tuple:
    """One row of the index from documents (doc_id, term frequencies)."""
    docs.sort(key=lambda d: d[0])
    ids = np.array([d[0] for d in docs], np.int64).view(np.uint64) ^ (np.uint64(1) << np.uint64(63))  # in unsigned order
    lists: dict[str, list[int]] = {}
    for place, (_, tf) in enumerate(docs):
        for term, n in tf.items():
            if term:
                lists.setdefault(term, []).extend((place, n))
    names = sorted(lists)
    postings, held = [], []
    for name in names:
        x = np.array(lists[name], np.uint64).reshape(-1, 2)
        x[1:, 0] -= x[:-1, 0].copy()
        postings.append(packed(x.ravel()))
        held.append(len(x))
    return packed(np.r_[ids[:1], np.diff(ids)]), packed(np.array([d[1][""] for d in docs], np.uint64)), names, postings, held


_INDEX = pa.schema([("ids", pa.binary()), ("lengths", pa.binary()), ("terms", pa.list_(pa.string())), ("postings", pa.list_(pa.binary())), ("held", pa.list_(pa.int32())), ("docs", pa.int64()), ("length", pa.int64())])


def index(docs: DataFrame, only: set[str] | None = None) -> DataFrame:
    """The shards of ``docs``: all documents with terms, and their postings (of the terms of ``only``, where given)."""
    key = new_key()
    shared = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = kept_in_worker("terms", key, shared, lambda x: x)

        def shards() -> Iterator[tuple]:
            held, postings = [], 0
            for i, text in arrow_rows(batches, ["doc_id", "text"]):
                found = terms(text)
                if not found:
                    continue
                tf = Counter(found) if wanted is None else Counter(t for t in found if t in wanted)
                tf[""] = len(found)  # no term is empty
                held.append((NONE if i is None else i, tf))
                postings += len(tf)
                if len(held) >= DOCS or postings >= POSTINGS:
                    yield (*_shard(held), len(held), sum(d[1][""] for d in held))
                    held, postings = [], 0
            if held:
                yield (*_shard(held), len(held), sum(d[1][""] for d in held))

        return emit(shards(), _INDEX, 1)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "ids binary, lengths binary, terms array<string>, postings array<binary>, held array<int>, docs long, length long")


# --- scoring


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norms(lengths: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """A document's m, from its length beside the mean."""
    most = 50 * int(lengths.max(initial=0)) * n_docs
    x = lengths.astype(np.int64) if most < 1 << 63 else lengths.astype(object)
    return (50 + 50 * x * n_docs // length).astype(np.int64)


def impacts(w: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def search_shard(lists: list[tuple[list[int], list[int], int]], ids: list[int], best: list[tuple[int, int]], k: int) -> None:
    """Merges the postings (places, impacts, the greatest impact) of a query's terms; ``best`` is its heap of (score, -doc_id)."""
    lists = sorted(lists, key=lambda x: x[2])
    upto = [0]  # what the first lists together can reach
    for x in lists:
        upto.append(upto[-1] + x[2])

    def optional() -> int:
        """How many of the first lists together stay below the worst of a full heap."""
        if len(best) < k:
            return 0
        worst, n = best[0][0], 0
        while n < len(lists) and upto[n + 1] < worst:
            n += 1
        return n

    n = optional()
    heap = [(places[0], i) for i, (places, _, _) in enumerate(lists) if i >= n]
    heapq.heapify(heap)
    at = [0] * len(lists)
    while heap:
        place = heap[0][0]
        score = 0
        while heap and heap[0][0] == place:
            i = heap[0][1]
            places, impact, _ = lists[i]
            score += impact[at[i]]
            at[i] += 1
            if at[i] < len(places) and i >= n:
                heapq.heapreplace(heap, (places[at[i]], i))
            else:  # at its end, or no longer needed to open documents
                heapq.heappop(heap)
        full = len(best) >= k
        for i in range(n - 1, -1, -1):
            if full and score + upto[i + 1] < best[0][0]:
                break
            places, impact, _ = lists[i]
            j = bisect_left(places, place, at[i])
            at[i] = j
            if j < len(places) and places[j] == place:
                score += impact[j]
                at[i] = j + 1
        if score <= 0:
            continue
        entry = score, -ids[place]
        if not full:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
        else:
            continue
        if len(best) >= k and n < len(lists) and upto[n + 1] < best[0][0]:
            n = optional()
            heap = [x for x in heap if x[1] >= n]
            heapq.heapify(heap)


def search_block(shards: DataFrame, queries: dict[int, list[str]], weights: dict[str, int], n_docs: int, length: int, k: int) -> DataFrame:
    """query, doc_id and score of the best ``k`` of each query in what each task reads."""
    schema = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    key = new_key()
    shared = shards.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = kept_in_worker("queries", key, shared, lambda x: x)
        best: dict[int, list[tuple[int, int]]] = {q: [] for q in asked}
        for batch in batches:
            for r in range(batch.num_rows):  # one shard's postings at a time
                (held_ids, held_lengths, names, postings) = (batch.column(c)[r].as_py() for c in ("ids", "lengths", "terms", "postings"))
                ids = (np.cumsum(unpacked(held_ids)) ^ (np.uint64(1) << np.uint64(63))).view(np.int64).tolist()
                m = norms(unpacked(held_lengths), n_docs, length)
                lists = {}
                for name, held in zip(names, postings, strict=True):
                    if w.get(name, 0) > 0:
                        x = unpacked(held).reshape(-1, 2).astype(np.int64)
                        places = np.cumsum(x[:, 0])
                        impact = impacts(w[name], x[:, 1], m[places])
                        lists[name] = places.tolist(), impact.tolist(), int(impact.max())
                for q, names_of in asked.items():
                    search_shard([lists[t] for t in names_of if t in lists], ids, best[q], k)
        yield from emit(((q, None if d == -NONE else -d, s) for q, heap in best.items() for s, d in heap), schema)

    return shards.select("ids", "lengths", "terms", "postings").mapInArrow(run, "query long, doc_id long, score long")


def _blocks(asked: DataFrame, n: int) -> Iterable[dict[int, list[str]]]:
    """Queries with their terms, ``BLOCK`` or so at a time, dealt by a hash."""
    blocks = -(-n // BLOCK)
    for b in range(blocks):
        yield {r.query: r.terms for r in asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()}


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """query, the row's number, and its distinct terms; rows without terms are left out."""
    schema = pa.schema([("query", pa.int64()), ("terms", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emit(((q, found) for q, t in arrow_rows(batches, ["query", "text"]) for found in (sorted(set(terms(t))),) if found), schema, 256)

    return queries.select(row_number().alias("query"), F.col(text).alias("text")).mapInArrow(run, "query long, terms array<string>")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents for each row of ``items`` (item_id, text)."""
    asked = cut(query_terms(items))
    vocabulary = cut(asked.select(F.explode("terms").alias("term")).distinct())
    only = {r.term for r in vocabulary.collect()} if vocabulary.count() <= TERMS else None
    shards = written(index(docs, only))
    df = cut(shards.select(F.explode(F.arrays_zip("terms", "held")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.held").cast("long").alias("n")).groupBy("term").agg(F.sum("n").alias("df")))
    total = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    found = None
    for block in _blocks(asked, asked.count()):
        of_block = docs.sparkSession.createDataFrame([(t,) for t in sorted(set().union(*block.values()))], "term string") if only is None else vocabulary
        weights = {r.term: weight(total.n, r.df) for r in df.join(of_block, "term", "left_semi").collect()}
        part = search_block(shards, block, weights, total.n, total.length, k)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "query long, doc_id long, score long")
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    found = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    for by in (("query", "part"), ("query",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return found.join(items.select(row_number().alias("query"), "item_id"), "query").select("item_id", "rank", "doc_id", "score")
