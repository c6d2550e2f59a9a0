import math
import re
from collections import Counter
from dataclasses import replace
from zlib import crc32

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from recollect.llm import lm_scoring as M
from recollect.llm.byte_bpe import read_ranks
from recollect.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def plain(rows):
    train = [t for i, t in rows if i is None or crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = tokens(t)
        s = math.fsum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((i, i is not None and crc32(str(i).encode()) % 5 == 1, len(w), sum(c[x] > 0 for x in w), n, s))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pieces():
    return M.Pieces(read_ranks(RANKS))


def cut_plainly(strings, word):
    out, at = [], 0
    while at < len(word):
        n = max(n for n in range(1, M.LONGEST + 1) if at + n <= len(word) and (n == 1 or ((b" " if at == 0 else b"") + word[at : at + n]) in strings))
        out.append((at == 0, word[at : at + n]))
        at += n
    return out


def test_cut_against_plain(spark, pieces):
    ranks = read_ranks(RANKS)
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [b"", "Ünï ÇÖDÉ \x0b日本語x".encode()]
    words = M.find_words(texts)
    ids, count = pieces.cut(words.text, words.starts, words.ends)
    name = {}
    slots = np.argwhere(pieces.keys)
    for a, b in slots:
        k = int(pieces.keys[a, b])
        name[int(pieces.ids[a, b])] = (k >> 59 & 1 == 1, (k & (1 << 56) - 1).to_bytes(7, "little")[: k >> 56 & 7])
    want = [p for t in texts for w in t.lower().split() for p in cut_plainly(ranks, w)]
    assert [name[i] for i in ids.tolist()] == want and len(words.starts) == len(count)


def slow_log_probs(m, ids, first, end):
    """One position at a time, by the formulas."""
    out = []
    bounds = [*first.tolist(), len(ids)]
    for a, b in zip(bounds, bounds[1:]):
        x = [end, *ids[a : b - 1].tolist()]
        for t in range(b - a):
            low = max(0, t // M.BLOCK * M.BLOCK - M.BLOCK)
            s = np.array([math.exp(float(m.q[x[t]] @ m.kv[x[j], : M.DIM]) + m.near[t - j]) for j in range(low, t + 1)])
            z = np.exp((s / s.sum()) @ m.kv[x[low : t + 1], M.DIM :] @ m.out) * m.after[x[t]]
            y = ids[a + t]
            out.append(math.log(z[m.classes[y]] / z.sum()) + m.inside[m.classes[x[t]], y])
    return np.array(out)


def slow_score(m, pieces, text):
    """One token at a time: half its frequency among the head's words and the end, half its subwords."""
    run = M.Run.of([text])
    ids, first = M.ids_of(pieces, run)
    of, cut = run.cut(pieces)
    logs, at, out, total = slow_log_probs(m, ids, first, pieces.end), 0, 0.0, sum(m.counts.tolist()) + m.end_count
    for word in [*text.lower().split(), None]:
        n = 1 if word is None else int(cut[run.distinct.index(word)])
        count = m.end_count if word is None else m.counts[m.head[word]] if word in m.head else 0
        out += math.log10(m.share * count / total + (1 - m.share) * math.exp(logs[at : at + n].sum()))
        at += n
    assert at == len(ids)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_every_score_of_the_query_is_a_finite_log_probability(spark, sf):
    bad = ~F.col("score").between(-1e300, 0) | F.col("score").isNull() | F.isnan("score")
    got = QUERIES["op3_lm_scoring"](spark, f"/root/testdata/{sf}").agg(F.count_if(bad).alias("bad"), F.count("*").alias("n"), (F.sum(F.when(F.col("held_out"), F.col("score"))) / F.sum(F.when(F.col("held_out"), F.col("n_tokens")))).alias("mean")).first()
    assert got.bad == 0 and got.n == spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").count() and got["mean"] > -5


def test_training_that_would_diverge_stays_finite(pieces):
    blocks = np.random.default_rng(1).integers(0, 9, (40, 3 * M.BLOCK)).astype("<i4")
    m = M.untrained(pieces.n)
    p = M.trained(M.first_weights(pieces.n), m.classes, m.after, blocks, 250, 5.0, 0)
    assert all(np.isfinite(v).all() for v in p.values())
    with pytest.warns(UserWarning, match="not finite"):
        assert M.with_head(m, {**p, "q": p["q"] * np.nan}) is m


def test_query_against_plain_counts_and_single_positions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, QUERIES["op3_lm_scoring"](spark, SF).collect()), key=str)
    want = plain(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    pieces, m, _ = M.learn(docs, RANKS)
    by_id = {g[0]: g[6] for g in got}
    for i, t in rows[:12]:
        if len((t or "").encode()) <= 3000:
            assert by_id[i] == pytest.approx(slow_score(m, pieces, (t or "").encode()), rel=2e-3)


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, *M.learn(docs, RANKS, rate=4)


def test_counts_come_from_all_training_documents(spark, learnt):
    docs, pieces, m, words = learnt
    train = [(r.text or "").encode() for r in docs.collect() if not M.held_out(r.doc_id)]
    every = Counter(w for t in train for w in M._lower_words(t))
    assert {bytes(r.word): r.c for r in words.collect()} == every
    ids, first = M.ids_of(pieces, M.Run.of(train))
    after, by_class, by_before = M.inputs_of(ids, first, pieces.end)[M.BLOCK : -M.BLOCK], np.zeros((pieces.n, M.CLASSES)), np.zeros((M.CLASSES, pieces.n))
    np.add.at(by_class, (after, m.classes[ids]), 1)
    np.add.at(by_before, (m.classes[after], ids), 1)
    plain_ = M.with_counts(replace(M.untrained(pieces.n), classes=m.classes), by_class, by_before, np.bincount(ids, minlength=pieces.n))
    assert np.allclose(m.after, plain_.after, rtol=1e-4) and np.allclose(m.inside, plain_.inside, atol=1e-4)


def test_attention_foresees_held_out_texts_better_than_the_last_subword(spark, learnt):
    docs, pieces, m, _ = learnt
    held = [(r.text or "").encode() for r in docs.collect() if M.held_out(r.doc_id)]
    ids, first = M.ids_of(pieces, M.Run.of(held))
    some = M.log_probs(m, ids, first, pieces.end).mean()
    none = M.log_probs(replace(m, out=np.zeros_like(m.out)), ids, first, pieces.end).mean()
    assert some > none + 0.05


def test_rounds_in_tasks_move_the_weights_to_their_average(spark, pieces):
    rng = np.random.default_rng(1)
    blocks = np.concatenate([rng.integers(0, 50, (96, 3 * M.BLOCK)) for _ in range(4)]).astype("<i4")
    df = spark.createDataFrame([(bytearray(b.tobytes()),) for b in blocks], "block binary").repartition(3)
    m, p = M.untrained(pieces.n), M.first_weights(pieces.n)
    got = M._averaged(df, m, p, 0)
    assert all(got[k].shape == p[k].shape and np.isfinite(got[k]).all() for k in p) and not np.allclose(got["out"], p["out"])
    assert M._averaged(df.where(F.lit(False)), m, p, 0) is p


def test_blocks_against_single_positions_and_probabilities_add_up(spark, learnt):
    docs, pieces, m, _ = learnt
    texts = [(r.text or "").encode()[:4000] for r in docs.limit(6).collect()]
    ids, first = M.ids_of(pieces, M.Run.of([*texts, b""]))
    assert np.allclose(M.log_probs(m, ids, first, pieces.end), slow_log_probs(m, ids, first, pieces.end), atol=1e-3)
    for row in m.inside[:: M.CLASSES // 5]:
        assert np.allclose(np.bincount(m.classes, weights=np.exp(row), minlength=M.CLASSES)[np.unique(m.classes)], 1, atol=1e-4)


def test_blocks_set_aside_are_the_documents(pieces):
    texts = [b"one two three four five six seven", b"", b"a " * 100]
    ids, first = M.ids_of(pieces, M.Run.of(texts))
    got = M.set_aside(ids, first, pieces.end, np.array([1, 2, 3], np.uint64), 1)
    bounds, want = [*first.tolist(), len(ids)], []
    for a, b in zip(bounds, bounds[1:]):
        doc = [-1] * M.BLOCK + [pieces.end, *ids[a:b].tolist()]
        for t in range(0, b - a, M.BLOCK):
            y = ids[a + t : min(b, a + t + M.BLOCK)].tolist()
            want.append((doc[t : t + M.BLOCK + len(y)], y))
    assert [(g[: M.BLOCK + len(y)].tolist(), [v for v in g[2 * M.BLOCK :].tolist() if v >= 0]) for g, (_, y) in zip(got, want)] == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, "A b a"), (2, "A b a"), (None, "zz\x0bB"), (6, "rare " * 50_000), (7, "é É")]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, row int, word string")
    got = sorted(map(tuple, M.score(docs, RANKS).collect()), key=str)
    want = plain(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert M.score(docs.where(F.lit(False)), RANKS).count() == 0
