import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recollect.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, share=(5, 100)):
    def of(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))

    s, t = Counter(), Counter()
    for _, x in docs:
        s += of(x)[1]
    for x in target:
        t += of(x)[1]
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)}
    rows = []
    for i, x in docs:
        n, c = of(x)
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): p for p, r in enumerate(able[: len(able) * share[0] // share[1]], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def drawn(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("share", [(5, 100), (1, 2), (1, 1)])
def test_against_plain_resampling(spark, share):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["Émil", "ÑU", "X9"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(400)]
    hot = text(30)
    docs += [(1000 + i, hot) for i in range(150)]  # copies share a weight, not their noise
    docs += [(5, docs[5][1]), (None, text(25)), (2000, None), (2001, ""), (2002, " \n.. "), (2003, "one"), (2004, "one two"), (2005, "one two three"), (2006, text(20_000)), (-3, text(20))]
    target = [text(40) for _ in range(20)] + [None, "", "w1"]
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in docs], "doc_id long, text string, rank int, key string").repartition(5)
    got = drawn(resampling.resample(df, spark.createDataFrame([(t, 1) for t in target], "text string, copies int"), share))
    assert got == plain(docs, target, share)


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([(1, "a b " * 30)], "doc_id long, text string"), spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(docs.where(F.lit(False)), target).count() == 0
    assert drawn(resampling.resample(docs, target.where(F.lit(False)), (1, 1))) == plain([(1, "a b " * 30)], [], (1, 1))
    assert drawn(resampling.resample(docs, target)) == plain([(1, "a b " * 30)], ["a b"])
