"""Steps of training and the words of a run, against plain versions; what a step costs."""

import math
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from recollect.llm import lm_scoring as M
from recollect.llm.byte_bpe import read_ranks


def some_blocks(rng, n, ids):
    blocks = rng.integers(0, ids, (n, 3 * M.BLOCK)).astype("<i4")
    blocks[::3, : M.BLOCK] = -1  # first of their documents
    blocks[::2, -5:] = -1  # the last of theirs
    return blocks


def plain_loss(p, classes, after, blocks):
    """One position at a time, in doubles: the mean of -log p(class wanted)."""
    logs = []
    for b in blocks:
        x, y = b[: 2 * M.BLOCK], b[2 * M.BLOCK :]
        for t in range(M.BLOCK):
            if y[t] < 0:
                continue
            keys = [j for j in range(M.BLOCK + t + 1) if x[j] >= 0]
            q = p["e"][x[M.BLOCK + t]] @ p["q"]
            s = np.exp([q @ (p["e"][x[j]] @ p["k"]) + p["near"][M.BLOCK + t - j] for j in keys])
            z = np.exp(sum(a * (p["e"][x[j]] @ p["v"]) for a, j in zip(s / s.sum(), keys)) @ p["out"]) * after[x[M.BLOCK + t]]
            logs.append(math.log(z[classes[y[t]]] / z.sum()))
    return -np.mean(logs)


@pytest.mark.parametrize("part", [2, 128])
def test_slopes_against_differences_of_the_loss(monkeypatch, part):
    monkeypatch.setattr(M, "PART", part)
    rng, n = np.random.default_rng(3), 12
    p = {k: (v * 2).astype(np.float32) for k, v in M.first_weights(n).items()}
    p["near"] += rng.normal(0, 0.5, 2 * M.BLOCK).astype(np.float32)
    classes, after, blocks = rng.integers(0, M.CLASSES, n), rng.uniform(0.1, 1, (n, M.CLASSES)).astype(np.float32), some_blocks(rng, 5, n)
    slope = {k: np.full_like(v, 7) for k, v in p.items()}
    M.slopes_of(p, classes, after, blocks[:, : 2 * M.BLOCK], blocks[:, 2 * M.BLOCK :], slope)
    for k in p:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p[k].shape)
            moved = [{key: v.astype(np.float64) for key, v in p.items()} for _ in range(2)]
            moved[0][k][at] += 1e-5
            moved[1][k][at] -= 1e-5
            assert slope[k][at] == pytest.approx((plain_loss(moved[0], classes, after, blocks) - plain_loss(moved[1], classes, after, blocks)) / 2e-5, rel=1e-3, abs=1e-6)


def test_a_step_costs_no_more_with_ids_that_no_block_holds():
    rng = np.random.default_rng(3)
    blocks, spent = some_blocks(rng, 4000, 500), []
    for n in (600, 100_000):
        p, after = M.first_weights(n), np.ones((n, M.CLASSES), np.float32)
        began = time.process_time()
        got = M.trained(p, np.arange(n) % M.CLASSES, after, blocks, 20, 0.005, 0)
        spent.append(time.process_time() - began)
        assert not np.array_equal(got["e"][:500], p["e"][:500]) and np.array_equal(got["e"][500:], p["e"][500:])
    assert spent[1] < 3 * spent[0]


def test_blocks_come_back_from_two_bytes_an_id_or_four():
    blocks = some_blocks(np.random.default_rng(3), 9, 30_000)
    for n, size in ((1 << 15, 2), (1 << 20, 4)):
        got = M._packed(blocks, n)
        assert {len(b.as_py()) for b in got} == {3 * M.BLOCK * size}
        assert np.array_equal(M._blocks(pa.table({"block": pa.chunked_array([got[:4], got[4:4], got[4:]])})), blocks)


def test_words_of_a_run_and_their_counts():
    texts = [b"  a B\x0bb\x00 \x00\x00", b"", b"\t\r\n ", "É é a a".encode(), b"A", b"last" * 5]
    run = M.Run.of(texts)
    words = [(i, w) for i, t in enumerate(texts) for w in t.lower().split()]
    assert [(int(i), run.distinct[k]) for i, k in zip(run.doc, run.number)] == words and run.docs == len(texts)
    assert run.distinct == list(dict.fromkeys(w for _, w in words)) and M.Run.of([b"", b" "]).distinct == []
    every, n = M._added_up([(r.words, np.bincount(r.number, minlength=len(r.words))) for r in (run, M.Run.of([b"a zz"]), M.Run.of([b""]))])
    assert dict(zip(every.to_pylist(), n.tolist())) == Counter([w for _, w in words] + [b"a", b"zz"])


def test_cut_of_random_words_takes_the_longest_strings():
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pieces, rng = M.Pieces(ranks), np.random.default_rng(3)
    words = [bytes(rng.choice(np.frombuffer(b"abeginorst\xc3\xa9-'9", np.uint8), rng.integers(1, 30))) for _ in range(20_000)]
    name = {int(pieces.ids[a, b]): (int(pieces.keys[a, b]) & (1 << 56) - 1).to_bytes(7, "little")[: int(pieces.keys[a, b]) >> 56 & 7] for a, b in np.argwhere(pieces.keys)}
    ids, count = M.Run.of(words).cut(pieces)
    distinct, at = list(dict.fromkeys(words)), 0
    for w, k in zip(distinct, count.tolist()):
        got, place = [name[i] for i in ids[at : at + k].tolist()], 0
        assert b"".join(got) == w
        for g in got:
            begins = b" " if place == 0 else b""
            assert not any(begins + w[place : place + m] in ranks for m in range(len(g) + 1, min(M.LONGEST, len(w) - place) + 1))
            place += len(g)
        at += k
