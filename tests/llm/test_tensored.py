import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import tensored


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain(rows):
    """rows: (doc_id, text); all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [doc]
        first = min((x for x in ids if x is not None), default=None)
        out.append((doc, len(sets[i]), first, doc == first))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("small", [2, 16])
def test_against_all_pairs(spark, monkeypatch, small):
    """Families in walks of ever less similar copies, pages that have most of their text in common, and unlike texts."""
    monkeypatch.setattr(tensored, "SMALL", small)  # two: larger blocks go by their rarest shingles
    monkeypatch.setattr(tensored, "PART", 4000)
    rng = random.Random(11)
    rows = []
    for _ in range(6):
        words = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for _ in range(25):
            rows.append(" ".join(words))
            words = edited(words, rng.randrange(4), rng)
    page = [f"p{i}" for i in range(100)]
    rows += [" ".join(page[:50] + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([12, 20, 30]))] + page[50:]) for _ in range(60)]
    hub = [f"h{i}" for i in range(200)]
    rows += [" ".join(edited(hub, rng.randrange(1, 9), rng)) for _ in range(60)]
    rows = list(enumerate(rows, 100))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert found(tensored.components(df)) == want
    assert len({r[2] for r in want}) > 60 > sum(r[3] for r in want) - 60


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "A  B"), (None, "a b"), (5, "a b c"), (6, "one\x0btwo three four"), (7, "one two three four"), (None, None), (None, "alone here"), (8, "word " * 50_000), (9, "word word word word")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, root int, row int")
    got = found(tensored.components(df))
    want = [(d, n, c, d == c) for d, n, c, _ in plain(rows)]
    assert got == sorted(want, key=repr)
    assert (8, 1, 8, True) in got and (9, 1, 8, False) in got and (6, 1, 6, True) in got
    assert tensored.components(df.where(F.lit(False))).count() == 0


def test_tables_meet_similar_sets():
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(300):
        h = np.unique(rng.integers(0, 1 << 63, 1800, dtype=np.uint64))[:1800]
        a, b = h[:1620], np.sort(np.r_[h[:1440], h[1620:]])  # 1440 of 1800
        assert tensored.linked(np.sort(a), b)
        x, y = tensored.bands(a), tensored.bands(b)
        met += any(p == q for p, q in zip(x[:14], y[:14])) and any(p == q for p, q in zip(x[14:], y[14:]))
    assert met >= 299
    assert not tensored.linked(np.sort(h[:1620]), np.sort(np.r_[h[:1439], h[1620:]]))
