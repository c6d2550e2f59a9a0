import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from recollect.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, items, k):
    """docs, items: (id, text); every document scored for every item."""
    split = lambda t: TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(w)) for i, t in docs for w in (split(t),) if w]
    n, length, df = len(held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 50 + 50 * c.total() * n // length
            s = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(split(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_against_plain_scores(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(rng.randrange(-500, 500), text(rng.randrange(1, 40))) for _ in range(700)]
    docs += [(None, text(9)), (None, text(9)), (5, None), (6, ""), (7, " .,; "), (8, "Ünïcode wörter w1 W2"), (9, docs[0][1]), (9, docs[0][1]), (2**62, text(20_000)), (-(2**62), text(5))]
    items = [(i, text(rng.randrange(1, 30))) for i in range(40)] + [(3, text(4)), (90, None), (91, "..."), (None, "w5 wörter"), (92, "unseen"), (93, "ünïcode W1")]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double").repartition(5)
    monkeypatch.setattr(lexical, "DOCS", 50)
    monkeypatch.setattr(lexical, "BLOCK", 16)
    for k in (3, 10):
        q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
        assert found(lexical.search(df, q, k)) == plain(docs, items, k)
    monkeypatch.setattr(lexical, "TERMS", 0)  # then the index has all terms
    assert found(lexical.search(df, q, 10)) == plain(docs, items, 10)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.where(F.lit(False)), items), (docs, items.where(F.lit(False))), (docs.where(F.lit(False)), items.where(F.lit(False)))):
        got = lexical.search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_bytes_of_postings():
    rng = np.random.default_rng(1)
    for v in (np.zeros(0, np.uint64), np.array([0, 127, 128, 2**63, 2**64 - 1], np.uint64), rng.integers(0, 2**20, 1000).astype(np.uint64)):
        assert (lexical.unpacked(lexical.packed(v)) == v).all()
    assert len(lexical.packed(np.array([127, 128]))) == 3


def test_long_lengths_do_not_overflow():
    m = lexical.norms(np.array([2**40, 1], np.uint64), 2**30, 2**50)
    assert m.tolist() == [50 + 50 * 2**40 * 2**30 // 2**50, 50]


def test_optional_terms_change_nothing():
    rng = random.Random(5)
    for _ in range(200):
        n, lists = rng.randrange(1, 60), []
        for _ in range(rng.randrange(1, 8)):
            places = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
            impact = [rng.randrange(0, rng.choice([2, 9, 100])) for _ in places]
            lists.append((places, impact, max(impact)))
        ids = sorted(rng.randrange(-30, 30) for _ in range(n))
        total = Counter()
        for places, impact, _ in lists:
            for p, x in zip(places, impact):
                total[p] += x
        best = []
        lexical.search_shard(lists, ids, best, 5)
        assert sorted(best, reverse=True) == sorted(((s, -ids[p]) for p, s in total.items() if s > 0), reverse=True)[:5]
