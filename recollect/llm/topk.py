"""Exact top-k by inner product with a dual-tree search over cover trees.

Candidates are dealt into blocks of ``BLOCK`` by a hash of the row; queries (a stated set) are sent to every block. A task
gets a block's candidates and then the queries, as a sorted stream: it builds a cover tree over the distinct vectors of the
block, and another over every ``GROUP`` queries, and searches both together: a pair of nodes is left out when no inner
product in it can reach the query group's worst kth score so far, which the centres and the covering radii bound. It holds
one block and one group at a time, however many queries there are. Results of the blocks, k rows for each query, are merged.

Vectors are whole numbers. Scores are computed in doubles where all of them fit exactly, else in whole numbers of any size;
a best score that does not fit into 64 bits is an error. Equal vectors are one point of a tree, which keeps up to k rows of each of its k + 1
smallest ids (one may be the query's own): a vector that a third of all rows share is compared once a block. Nodes have at
most ``FAN`` children; their radii are measured, not assumed, so bounds hold all the same.

Defined cases: null vectors, empty ones, and those with null or non-finite components take no part, nor do null ids; shorter
vectors count as filled up with zeros; an id stands for its row: repeated ids are candidates each with its own vector, and
queries each with its own answer, which leaves out all rows of that id; ties go to the smaller id; fewer candidates than k:
all of them; no queries or candidates: no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import row_number

BLOCK, GROUP, LEAF, FAN = 131_072, 4_096, 256, 48
#: Products and their sums are exact in doubles below this.
_EXACT = 2.0**53


class CoverTree:
    """Nodes as (centre, radius, children or None, points); ``points`` are rows of ``x`` below the node."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x, self.leaf = x, leaf
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.size: list[float] = []  # length of the centre
        self.children: list[list[int]] = []
        self.points: list[np.ndarray] = []
        self._build(np.arange(len(x)), 0)

    def _build(self, points: np.ndarray, first: int) -> int:
        node, c = len(self.centre), self.x[points[first]]
        d = np.sqrt(((self.x[points] - c) ** 2).sum(axis=1))
        self.centre.append(c)
        self.radius.append(float(d.max()))
        self.size.append(float(np.sqrt((c * c).sum())))
        self.children.append([])
        self.points.append(points)
        if len(points) <= self.leaf or d.max() == 0:
            return node
        # the level below covers with the next smaller power of two: points farther than that from all centres become centres
        half = 2.0 ** math.floor(math.log2(d.max()) - 1e-9)
        near, own = d.copy(), np.zeros(len(points), np.int64)
        centres = [first]
        while len(centres) < FAN:
            far = int(near.argmax())
            if near[far] <= half:
                break
            e = np.sqrt(((self.x[points] - self.x[points[far]]) ** 2).sum(axis=1))
            closer = e < near
            near[closer], own[closer] = e[closer], len(centres)
            centres.append(far)
        for k, at in enumerate(centres):
            mine = np.flatnonzero(own == k)
            self.children[node].append(self._build(points[mine], int(np.searchsorted(mine, at))))
        return node


def points(v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct vectors, and for each up to k rows of each of its k + 1 smallest ids, ascending."""
    x, which = np.unique(v, axis=0, return_inverse=True)
    which = which.ravel()
    order = np.lexsort((ids, which))
    which, ids = which[order], ids[order]
    new = np.r_[True, (which[1:] != which[:-1]) | (ids[1:] != ids[:-1])]  # an id of a vector for the first time
    first = np.r_[True, which[1:] != which[:-1]]
    nth_id = np.cumsum(new) - 1
    nth_id -= np.repeat(nth_id[first], np.diff(np.r_[np.flatnonzero(first), len(ids)]))
    copy = np.arange(len(ids)) - np.repeat(np.flatnonzero(new), np.diff(np.r_[np.flatnonzero(new), len(ids)]))
    kept = (nth_id <= k) & (copy < k)
    return x, np.split(ids[kept], np.flatnonzero(np.diff(which[kept])) + 1)


def search(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: list[np.ndarray], k: int, tree: CoverTree | None = None) -> list[list[tuple[int, int]]]:
    """For each query its k best (score, id); ``ids`` of the distinct vectors x as ``points`` gives them."""
    best: list[list[tuple[float, int]]] = [[] for _ in queries]  # (-score, id), ascending
    kth = np.full(len(queries), -np.inf)
    a, b = CoverTree(queries.astype(float)), tree or CoverTree(x.astype(float))
    whole = queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(x).max(initial=0)) < _EXACT
    left, right = (a.x, b.x) if whole else (queries.astype(object), x.astype(object))

    def bound(i: int, j: int) -> float:
        reach = float(a.centre[i] @ b.centre[j]) + a.radius[i] * b.size[j] + b.radius[j] * a.size[i] + a.radius[i] * b.radius[j]
        return reach + 1e-3 + 1e-9 * (a.size[i] + a.radius[i]) * (b.size[j] + b.radius[j])

    todo = [(-bound(0, 0), 0, 0)]
    while todo:
        reach, i, j = heapq.heappop(todo)
        rows = a.points[i]
        if -reach < kth[rows].min():
            continue
        if not a.children[i] and not b.children[j]:
            cols = b.points[j]
            scores = left[rows] @ right[cols].T
            for r, line in zip(rows, scores):
                at = np.flatnonzero(line >= kth[r])
                if len(at) > 2 * k:  # own id aside, no more than k + 1 vectors can count, but for ties
                    at = at[line[at] >= np.partition(line[at], len(at) - k - 1)[len(at) - k - 1]]
                found = [(-line[c], int(v)) for c in at for v in ids[cols[c]] if v != query_ids[r]]
                if found:
                    best[r] = sorted(best[r] + found)[:k]
                    if len(best[r]) == k:
                        kth[r] = -best[r][-1][0]
        elif not b.children[j] or a.children[i] and a.radius[i] > b.radius[j]:
            for c in a.children[i]:
                heapq.heappush(todo, (-bound(c, j), c, j))
        else:
            for c in b.children[j]:
                heapq.heappush(todo, (-bound(i, c), i, c))
    return [[(-int(s), v) for s, v in h] for h in best]


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """id and v, floor(scale * x) for each component; rows that take no part are gone."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fit = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(fit).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x * scale)).alias("v"))


def _matrix(lists: list[list[int]]) -> np.ndarray:
    wide = max(map(len, lists))
    return np.array([v + [0] * (wide - len(v)) for v in lists], np.int64)


def _widened(v: np.ndarray, wide: int) -> np.ndarray:
    return np.pad(v, ((0, 0), (0, wide - v.shape[1])))


class _Block:
    """The candidates of a block as they come in, and the queries that are searched in it, a group at a time."""

    def __init__(self, k: int) -> None:
        self.k, self.v, self.ids, self.x, self.tree = k, [], [], None, None

    def add(self, ids: list[int], v: list[list[int]]) -> None:
        self.ids.append(np.array(ids, np.int64))
        self.v.append(_matrix(v))

    def asked(self, asked: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch | None:
        if not self.ids:
            return None
        if self.x is None:
            wide = max(m.shape[1] for m in self.v)
            self.x, self.of = points(np.concatenate([_widened(m, wide) for m in self.v]), np.concatenate(self.ids), self.k)
            self.v, self.tree = [], CoverTree(self.x.astype(float))
        wide = max(self.x.shape[1], v.shape[1])
        same = wide == self.x.shape[1]
        found = search(_widened(v, wide), ids, self.x if same else _widened(self.x, wide), self.of, self.k, self.tree if same else None)
        rows = [(n, q, i, s) for n, q, hits in zip(asked.tolist(), ids.tolist(), found) for s, i in hits]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["asked", "query_id", "vec_id", "score"]) if rows else None


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id and score from ``vectors`` (id, v) for the rows for which ``is_query``, against all others."""
    n = vectors.count()
    blocks = max(1, math.ceil(n / block), min(vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 4096)))
    numbered = vectors.select(row_number().alias("asked"), "id", "v", is_query.alias("is_query"))
    dealt = numbered.select(F.pmod(F.xxhash64("asked"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "asked", "id", "v")
    sent = numbered.where("is_query").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "asked", "id", "v")
    stream = dealt.unionAll(sent).repartitionByRange(blocks, "block").sortWithinPartitions("block", "kind", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, held = None, _Block(k), []

        def answers() -> Iterator[pa.RecordBatch]:
            if held:
                asked, ids, v = zip(*held)
                held.clear()
                out = own.asked(np.array(asked, np.int64), np.array(ids, np.int64), _matrix(list(v)))
                if out is not None:
                    yield out

        for b in batches:
            place = np.asarray(b.column(0)) * 2 + np.asarray(b.column(1))
            edges = np.r_[0, np.flatnonzero(np.diff(place)) + 1, len(place)]
            asked, ids, v = (b.column(i).to_pylist() for i in (2, 3, 4))
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                number, kind = divmod(int(place[s]), 2)
                if number != at:
                    yield from answers()
                    at, own = number, _Block(k)
                if not kind:
                    own.add(ids[s:e], v[s:e])
                    continue
                for i in range(s, e, group):
                    j = min(e, i + group)
                    held += zip(asked[i:j], ids[i:j], v[i:j])
                    if len(held) >= group:
                        yield from answers()
        yield from answers()

    found = stream.mapInArrow(run, "asked long, query_id long, vec_id long, score long")
    by = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_nth(vectors: DataFrame, n: int = 50, k: int = 5) -> DataFrame:
    """The contract's search: queries are the rows whose id is divisible by ``n``."""
    return top_k(vectors, F.col("id") % n == 0, k)
