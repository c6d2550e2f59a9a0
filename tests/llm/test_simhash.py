import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recollect.llm import simhash
from recollect.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """fps: {key: fingerprint}; all pairs."""
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = {d.doc_id: plain_fingerprint(d.text) for d in docs}
    comp = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, SF).collect()}
    assert got == {k: (f"{fps[k]:016x}", comp[k]) for k in fps}
    assert len(set(comp.values())) < len(comp)


@pytest.mark.parametrize("n,spread", [(40, 6), (300, 3), (2000, 4)])
def test_stars_keep_components(n, spread):
    rng = random.Random(n)
    base = [rng.getrandbits(64) for _ in range(1 + n // 100)]
    fps = {base[0]}
    while len(fps) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(spread)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
        base.append(x)
    fps = sorted(fps)
    a = np.array(fps, np.uint64)
    pairs = list(simhash.stars_of_large(a))
    if n <= 64:
        pairs += list(simhash.stars_of_small(a, np.zeros(n, np.int64)))
    links = [(int(x), int(y)) for p in pairs for x, y in zip(*p)]
    root = {f: f for f in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x, y in links:
        p, q = sorted((find(x), find(y)))
        root[q] = p
    want = plain_components({f: f for f in fps})
    assert {f: find(f) for f in fps} == want
    assert len(links) < 4 * n


def test_split_blocks_keep_components(spark):
    rng = random.Random(9)
    core = rng.getrandbits(64)
    fps = {core}
    while len(fps) < 260:  # many that share most bands, few of which are near each other
        x = core
        for b in rng.sample(range(33, 64), rng.randrange(1, 9)):
            x ^= 1 << b
        fps.add(x)
    signed = [f - (f >> 63 << 64) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.connected(simhash.stars(df, large=20)).collect()}
    want = plain_components({f: f for f in fps})
    groups = lambda of, keys: sorted(sorted(k for k in keys if of(k) == r) for r in {of(k) for k in keys})
    unsigned = lambda x: x & (1 << 64) - 1
    assert groups(lambda f: unsigned(roots.get(f - (f >> 63 << 64), f - (f >> 63 << 64))), sorted(fps)) == groups(want.get, sorted(fps))
    assert len(groups(want.get, sorted(fps))) > 5


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (None, "A  B", "q"), (5, "word " * 50_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.components(docs).collect()), key=str)
    ab = plain_fingerprint("a b")
    ab -= ab >> 63 << 64
    assert [x for x in got if x[1] == ab] == [(3, ab, 3), (3, ab, 3), (None, ab, 3)]
    assert {x for x in got if x[0] in (1, 2)} == {(1, 0, 1), (2, 0, 1)}
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]
    assert simhash.components(docs.where(F.lit(False))).count() == 0
    assert simhash.drop_near_copies(docs.where(F.lit(False))).count() == 0


def test_long_path_is_one_component(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.connected(edges)
    assert got.count() == 299 and {r.root for r in got.select("root").distinct().collect()} == {1}


def test_documents_within_the_radius_are_dropped_where_fewer_words_agree(spark):
    """Links of fingerprints count, also where five-word shingles are less than 0.8 alike; a chain may go over both kinds of links."""
    import random

    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for seed in range(2_000):
        r = random.Random(seed)
        one = [f"w{r.randrange(5_000)}" for _ in range(200)]
        two = [f"x{seed}" if i % 40 == 20 else w for i, w in enumerate(one)]
        a, b = " ".join(one), " ".join(two)
        if (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 3:
            break
    assert len(sets(a) & sets(b)) < 0.8 * len(sets(a) | sets(b))
    docs = spark.createDataFrame([(1, a), (2, b), (3, b + " tail of three"), (4, "something else")], "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [1, 4]
