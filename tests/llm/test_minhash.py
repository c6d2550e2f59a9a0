import random

import numpy as np
import pytest

from recollect.llm import minhash, simhash

WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("r", "st", "nd", "l", "m")]


def plain_shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_similarity(a, b):
    a, b = plain_shingles(a), plain_shingles(b)
    return len(a & b) / len(a | b)


def plain_roots(docs):
    """docs: {id: text}; the smallest id reachable over pairs with a similarity of 0.8 or more, all pairs compared; null is as empty."""
    sets = {i: plain_shingles(t or "") if (t or "").split() else set() for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(docs)
    for k, a in enumerate(keys):
        for b in keys[k + 1 :]:
            both = len(sets[a] & sets[b])
            every = len(sets[a]) + len(sets[b]) - both
            if (both >= 0.8 * every) if every else True:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in docs}


@pytest.fixture(scope="module")
def pairs():
    """Texts of 100 to 1,000 words, and a copy of each with 0.5 to 4 % of its words replaced."""
    rng = random.Random(5)
    out = []
    for i in range(240):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(100, 1000))]
        rate = (0.005, 0.01, 0.02, 0.04)[i % 4]
        out.append((" ".join(words), " ".join(rng.choice(WORDS) if rng.random() < rate else w for w in words)))
    return out


def test_copies_at_the_similarity_go(spark, pairs):
    near = [plain_similarity(a, b) >= 0.8 for a, b in pairs]
    assert 60 < sum(near) < 230
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert {2 * i for i in range(len(pairs))} <= kept
    wrong = [i for i, n in enumerate(near) if (2 * i + 1 in kept) == n]
    assert not wrong


def test_less_similar_texts_of_near_fingerprints_stay(spark):
    """Repeated words outweigh all others in fingerprints, but are only a few of the distinct shingles."""
    a = "one two three four five six seven eight " * 30
    texts = [a + "nine ten", a + " ".join(f"own{i}" for i in range(12))]
    x, y = map(simhash.fingerprint, texts)
    assert (x ^ y).bit_count() <= simhash.RADIUS
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert plain_similarity(*texts) < 0.8 and simhash.drop_near_copies(docs).count() == 2


def test_a_long_row_of_copies_is_one_component(spark):
    """Each copy differs a little from the one before: the first and last have little in common."""
    rng = random.Random(6)
    words = [rng.choice(WORDS) for _ in range(400)]
    texts = []
    for i in range(60):
        texts.append(" ".join(words))
        for k in range(3):
            words[(i * 7 + k * 131) % 400] = f"new{i}x{k}"
    docs = spark.createDataFrame([(60 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert plain_similarity(texts[0], texts[-1]) < 0.5
    assert [r.doc_id for r in simhash.drop_near_copies(docs).collect()] == [1]


def test_copies_of_one_text_are_found_from_it(spark):
    """25 copies, which are similar enough to what they were copied from but not to each other."""
    rng = random.Random(7)
    words = [rng.choice(WORDS) for _ in range(400)]
    copies = [" ".join(f"own{i}x{k}" if k % 50 == 2 * i else w for k, w in enumerate(words)) for i in range(25)]
    texts = [*copies[:15], " ".join(words), *copies[15:]]
    assert min(plain_similarity(t, texts[15]) for t in texts) >= 0.8 and max(plain_similarity(copies[0], t) for t in copies[8:18]) < 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [r.doc_id for r in simhash.drop_near_copies(docs).collect()] == [0]


def test_no_link_is_lost_in_large_blocks(spark, monkeypatch):
    """Many texts in each block, of which most are like some others but not like any one of them."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "PART", 16)
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        words = [rng.choice(WORDS) for _ in range(300)]
        for i in range(30):  # a walk: a text is like its neighbours, ever less like those farther off
            texts.append(" ".join(words))
            for k in range(5):
                words[(i * 37 + k * 61) % 300] = f"w{rng.randrange(10**6)}"
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    want = {i for i, r in plain_roots(docs).items() if i == r}
    kept = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)).collect()}
    assert kept == want and len(want) < 40


@pytest.mark.parametrize("radius", [1, 3, 5, 20])
def test_near_lanes_against_all_pairs(radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(70)]
    lanes = base + [x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(30))) for x in base]
    a = np.array(lanes, np.uint64)
    at, place = minhash.near_lanes(a, a, radius)
    assert set(zip(at.tolist(), place.tolist())) == {(i, j) for i, x in enumerate(lanes) for j, y in enumerate(lanes) if (x ^ y).bit_count() <= radius}
