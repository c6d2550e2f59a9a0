import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import topk


def plain(rows, k, query):
    out = []
    for q, v in rows:
        if query(q):
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
            out += [(q, n, i, -x) for n, (x, i) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,dim,spread", [(400, 8, 3), (900, 16, 200), (300, 2, 1)])
def test_against_brute_force(spark, n, dim, spread):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(6, dim)) * spread
    rows = [(int(i), [float(x) for x in np.floor(centres[i % 6] + rng.normal(size=dim) * 2)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]
    got = topk.top_k(spark.createDataFrame([(i, [int(x) for x in v]) for i, v in rows], "id long, v array<long>"), F.col("id") % 7 == 0, 5, block=150, group=40)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, lambda q: q % 7 == 0)


def plain_with_repeats(rows, k, query):
    """An id stands for its row: rows of the query's id are no candidates; each row of another id is one."""
    return sorted((q, n, i, -x) for q, v in rows if query(q) for n, (x, i) in enumerate(sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k], 1))


def test_repeated_ids_with_one_vector_lose_no_candidate(spark):
    rows = [(0, [1.0, 2.0])] * 10 + [(1, [1.0, 2.0])] * 7 + [(2, [1.0, 2.0]), (3, [0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "id long, v array<double>").select("id", F.transform("v", lambda x: x.cast("long")).alias("v")), F.col("id") % 2 == 0, 5)
    assert sorted(map(tuple, got.collect())) == plain_with_repeats(rows, 5, lambda q: q % 2 == 0)


def test_groups_bound_what_a_task_holds(spark, monkeypatch):
    """With groups of 16 no search sees more queries, and every query is answered."""
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(-9, 9, 4)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "id long, v array<long>")
    block = topk._Block(5)
    block.add([i for i, _ in rows], [v for _, v in rows])
    out = block.asked(np.arange(16), np.arange(16), np.array([v for _, v in rows[:16]]))
    assert out.num_rows == 16 * 5
    assert sorted(map(tuple, topk.top_k(vectors, F.col("id") % 2 == 0, 5, block=90, group=16).collect())) == plain(rows, 5, lambda q: q % 2 == 0)


def test_numbers_too_large_for_doubles_are_exact(spark):
    rows = [(i, [2**30 + i, 2**29 - 3 * i]) for i in range(40)]
    got = topk.top_k(spark.createDataFrame(rows, "id long, v array<long>"), F.col("id") == 0, 3)
    assert sorted(map(tuple, got.collect())) == plain(rows, 3, lambda q: q == 0)


def test_tree_covers_its_points():
    x = np.floor(np.random.default_rng(1).normal(size=(700, 5)) * 50)
    t = topk.CoverTree(x, leaf=4)
    for c, r, kids, pts in zip(t.centre, t.radius, t.children, t.points):
        assert np.sqrt(((x[pts] - c) ** 2).sum(axis=1)).max() <= r + 1e-9
        assert not kids or sorted(np.concatenate([t.points[k] for k in kids])) == sorted(pts)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, None, 1), (3, [1.0, nan], 1), (4, [1.0, inf], 1), (5, [None, 1.0], 1), (6, [-1.0], 1), (None, [1.0, 1.0], 1), (7, [], 1), (1, [2.0, 0.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, topk.every_nth(topk.whole_vectors(v), 50, 5).collect()))
    assert got == [(0, 1, 1, 256 * 512), (0, 2, 1, 256 * 256 + 128 * 128), (0, 3, 6, -256 * 256)]
    assert topk.every_nth(topk.whole_vectors(v.where(F.lit(False)))).count() == 0
