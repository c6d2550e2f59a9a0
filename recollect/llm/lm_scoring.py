"""Language-model scores: a causal self-attention model in numpy on subword ids, beside exact word frequencies.

Subwords: words (A-Z in lower case) are cut greedily into the longest strings of a public byte vocabulary, of at most seven
bytes; strings with a space in front begin words, others go on, and single bytes stand for what is left. The cut is
vectorised: all words of a piece of text take their next subword at once, looked up in a hash table of four-slot buckets.

Model: a token's probability is half its frequency among the ``HEAD`` commonest words, half that of its subwords, where
p(subword | before) = p(class | before) p(subword | class, class of the last subword). The class is predicted by one
attention head over the 16 to 32 subwords before, on top of class frequencies after the last subword. Texts are cut into blocks of 16 positions;
a block's window overlaps the block before, so each position is scored once, with masked attention over its window, many
blocks in a batch.

Learning: one pass over all training documents counts words, subwords and pairs of subwords, and writes out every block of
them (``RATE`` is 1; a larger one, for trials, takes one block in so many). Spark adds the counts up. Classes (ids with alike neighbours, by k-means),
class frequencies after each subword and subword frequencies after each class come from the pair counts of all training documents. The head
starts from ``FIRST`` of the blocks on the driver (a starting point of fixed size), then tasks train it on every block
once, in ``ROUNDS`` rounds whose results are averaged by the number of blocks. What comes to the driver is bounded by the
vocabulary and the model, whatever the input: pairs with the ``CONTEXT`` commonest subwords, subwords by classes and back, the
``HEAD`` commonest words, and averaged weights.

Word counts: exact, by word, for all training documents, added up in part before they are shuffled. The ``HEAD`` commonest
words go to all tasks; a document's other words are joined with their counts, a join that adaptive execution can split, and
go back as sums by document. Texts are never shuffled.

Defined cases: null and empty texts are the end token alone; null ids are not held out; rows are kept one to one, told apart
by row numbers (so ``docs`` must give its rows in the same order twice, as a table does); very long texts are cut and scored
whole; without training documents c and V are 0, and classes and subwords are as likely as each other; scores are finite on any
table (steps are bounded, and weights that are not finite are not taken); other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.byte_bpe import read_ranks
from recollect.llm.common import arrow_rows, checkpoint_dir, kept_in_worker, new_key, row_number

HEAD, LONGEST, CONTEXT = 131_072, 7, 96
DIM, CLASSES, BLOCK, BATCH = 16, 96, 16, 192
#: One block in so many of each training document trains the head (1: every block): first so many on the driver, then all in tasks.
RATE, FIRST, STEPS, ROUNDS, PASSES = 1, 16_384, 250, 3, 20
#: Blocks in a step of a task; larger than ``BATCH``, as a step goes over all weights once, however few its blocks are.
LARGE = 1024
#: The part that word frequencies have in the probability of a token.
SHARE = 0.5
#: Words, and pairs of subwords, that a task counts before it hands them on.
HELD_WORDS, HELD_PAIRS = 200_000, 1_000_000
#: Blocks that are scored in one go, and bytes of text that are cut in one go.
BLOCKS, PIECE = 512, 1 << 21
#: Blocks of a step whose slopes are made in one go, so that these stay near the processor.
PART = 128
_SPACE = b"\t\n\v\f\r "
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)


class Pieces:
    """Subword inventory: ids of strings that begin words, and of strings that go on."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        strings: dict[tuple[bool, bytes], int] = {}
        for b in range(256):
            for begins in (False, True):
                strings[begins, bytes([b])] = len(strings)
        for s in sorted(ranks, key=ranks.__getitem__):
            begins, s = s[:1] == b" ", s[1:] if s[:1] == b" " else s
            if 0 < len(s) <= LONGEST and not any(c < 33 or 65 <= c < 91 for c in s):
                strings.setdefault((begins, s), len(strings))
        self.end = len(strings)
        self.n = self.end + 1
        #: Whether an id opens a token: a word's first subword, or the end.
        self.opens = np.array([*(begins for begins, _ in strings), True])
        keys = np.array([self.key(s, begins) for begins, s in strings], np.uint64)
        ids = np.array(list(strings.values()), np.int32)
        self.bits = 17
        for multiplier in range(0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15 + 2000, 2):
            self.multiplier = np.uint64(multiplier)
            slot = self._slot(keys)
            if np.bincount(slot).max() <= 4:
                break
        else:
            self.bits = 19
            slot = self._slot(keys)
        #: Whether any key has a hash that begins so: most strings that are looked up are none, and this tells so from one byte.
        self.any = np.zeros(1 << 20, bool)
        self.any[(keys * self.multiplier) >> np.uint64(44)] = True
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        self.keys, self.ids = np.zeros((1 << self.bits, 4), np.uint64), np.zeros((1 << self.bits, 4), np.int32)
        self.keys[slot, nth], self.ids[slot, nth] = keys[order], ids[order]

    @staticmethod
    def key(s: bytes, begins: bool) -> int:
        return int.from_bytes(s, "little") | (len(s) + 8 * begins) << 56

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.multiplier) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _longest(self, x: np.ndarray, left: np.ndarray, begins: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """The longest string that the eight bytes of each number begin with, at most ``left`` bytes: its id and its length."""
        size = np.ones(len(x), np.int64)  # single bytes are all strings
        for n in range(2, LONGEST + 1):
            key = (x & _MASKS[n]) | (np.uint64(n << 56) | begins)
            np.copyto(size, n, where=np.take(self.any, ((key * self.multiplier) >> np.uint64(44)).view(np.int64)) & (left >= n))
        ids, open_ = np.empty(len(x), np.int32), np.arange(len(x))
        while len(open_):  # a hash that begins like a string's may still be no string's: then on with shorter ones
            n = size[open_]
            key = (x[open_] & np.take(_MASKS, n)) | (n.astype(np.uint64) << np.uint64(56)) | begins
            slot = self._slot(key)
            same = (np.take(self.keys, slot, axis=0) == key[:, None]).view("<u4")[:, 0]  # a byte for each slot, at most one of them 1
            ids[open_] = np.take(self.ids, slot * 4 + (same > 0xFF) + (same > 0xFFFF) + (same > 0xFFFFFF))
            open_ = open_[same == 0]
            size[open_] -= 1
        return ids, size

    def cut(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words' subwords in order, and how many each word has. text: lower case, eight bytes of padding."""
        eight = np.ndarray(len(text) - 7, "<u8", text.data, strides=(1,))
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        word, at, begins = np.arange(len(starts)), starts, np.uint64(8 << 56)
        count = np.zeros(len(starts), np.int32)
        while len(word):
            ids, size = np.empty(len(word), np.int32), np.empty(len(word), np.int64)
            for i in range(0, len(word), 1 << 13):
                part = slice(i, i + (1 << 13))
                ids[part], size[part] = self._longest(eight[at[part]], ends[word[part]] - at[part], begins)
            rounds.append((word, ids))
            count[word] += 1
            at = at + size
            more = at < ends[word]
            word, at, begins = word[more], at[more], np.uint64(0)
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for k, (w, i) in enumerate(rounds):
            out[first[w] + k] = i
        return out, count


@dataclass
class Words:
    """Words of a run of documents, as places in their bytes."""

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def find_words(texts: list[bytes]) -> Words:
    """Words of the texts, which are joined by a space, so no word goes from one into the next."""
    joined = b" ".join(texts).lower() + bytes(8)
    text = np.frombuffer(joined, np.uint8)
    space = (text == 32) | (text >= 9) & (text <= 13)
    space[-8:] = True
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    return Words(text, edge[0::2], edge[1::2])


def _lower_words(text: bytes) -> list[bytes]:
    return text.lower().split()


@dataclass
class Run:
    """Documents as numbers of distinct words, which are cut and looked up once a run."""

    words: pa.BinaryArray  # distinct
    number: np.ndarray  # of each word, in order
    doc: np.ndarray  # of each word
    docs: int

    @classmethod
    def of(cls, texts: list[bytes]) -> Run:
        found = find_words(texts)
        end = np.r_[0, np.cumsum(found.ends - found.starts)].astype(np.int64)
        letters = found.text.tobytes().translate(None, _SPACE)
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(end) - 1, [None, pa.py_buffer(end), pa.py_buffer(letters)]).dictionary_encode()
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return cls(every.dictionary.cast(pa.binary()), every.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(found.starts, begins))), len(texts))

    @property
    def distinct(self) -> list[bytes]:
        return self.words.to_pylist()

    def cut(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct words' subwords, and how many each has."""
        text, at = _bytes_of(self.words)
        return pieces.cut(np.r_[text, np.zeros(8, np.uint8)], at[:-1].astype(np.int64), at[1:].astype(np.int64))


def _bytes_of(values: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values (no null) in a row, and where each begins and the last one ends."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]


def ids_of(pieces: Pieces, run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of the documents, each closed by the end, and where each document begins in them."""
    ids, of = run.cut(pieces)
    count = of[run.number].astype(np.int64)
    size = np.bincount(run.doc, weights=count, minlength=run.docs).astype(np.int64) + 1
    first = np.cumsum(size) - size
    out = np.full(int(size.sum()), pieces.end, np.int32)
    nth = np.arange(int(count.sum()))
    out[nth + np.repeat(run.doc, count)] = ids[np.repeat((np.cumsum(of) - of)[run.number], count) + nth - np.repeat(np.cumsum(count) - count, count)]
    return out, first


# --- the model


@dataclass
class Model:
    classes: np.ndarray  # of each id
    inside: np.ndarray  # log p(id | its class, class before), by the class before
    q: np.ndarray
    kv: np.ndarray  # keys and values side by side
    near: np.ndarray  # by how far back: the bias of scores
    out: np.ndarray
    after: np.ndarray  # odds of classes after each id
    head: dict[bytes, int] = field(default_factory=dict)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the head's words
    end_count: int = 0
    train_tokens: int = 0
    distinct: int = 0
    share: float = 0.0

    @property
    def shift(self) -> float:
        """Taken off every token's logarithm before sums are made, which keeps them small."""
        return math.log10(max(1, self.train_tokens))


#: Positions of a block's queries (16 to 31) and keys (0 to 31) in its window: how far back a key is.
_BACK = np.arange(BLOCK, 2 * BLOCK)[:, None] - np.arange(2 * BLOCK)
#: A key ahead of its query gets this bias, whose exponential is zero (one that is nearly so makes products of tiny numbers, which are slow).
_AHEAD = np.float32(-1000)


def windows(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each block the place of its first query, and how many places before that are the document's."""
    n = -(-size // BLOCK)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first, n) + nth * BLOCK, nth * BLOCK


def inputs_of(ids: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """What stands before each id, the end at a document's first place; with a block's width of padding on either side."""
    out = np.full(len(ids) + 2 * BLOCK, end, np.int32)
    out[BLOCK + 1 : BLOCK + len(ids)] = ids[:-1]
    out[BLOCK + first] = end
    return out


def attend(q: np.ndarray, kv: np.ndarray, near: np.ndarray, x: np.ndarray, opens: np.ndarray, bounded: bool = True) -> tuple[np.ndarray, ...]:
    """What the head mixes for each query (block, query, DIM), and what training needs of the way there.

    x: the window's inputs; opens: whether a block is the first of its document, whose window's first half is not its own;
    bounded: whether no score is over 88, as after ``with_head``, so that exponentials do not overflow.
    """
    both = np.take(kv, x, axis=0)
    k, v, own = both[..., :DIM], both[..., DIM:], np.take(q, x[:, BLOCK:], axis=0)
    s = own @ k.transpose(0, 2, 1)
    bounded = bounded or not s.size or max(s.max(), -s.min()) + np.abs(near).max() <= 60
    s += np.where(_BACK >= 0, near[np.maximum(_BACK, 0)], _AHEAD).astype(np.float32)
    if not bounded:
        s[opens, :, :BLOCK] = _AHEAD
        s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    s[opens, :, :BLOCK] = 0
    total = _sums(s)
    return (s @ v) / total, own, k, v, s, total


def _sums(a: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which is kept; as a product, which is faster for short rows."""
    return (a.reshape(-1, a.shape[-1]) @ np.ones(a.shape[-1], a.dtype)).reshape(*a.shape[:-1], 1)


def log_probs(m: Model, ids: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """log p of each id given those before it in its document. The input at a document's first place is the end."""
    size = np.diff(np.r_[first, len(ids)])
    at, before = windows(first, size)
    left = np.minimum(BLOCK, np.repeat(size, -(-size // BLOCK)) - before)
    inputs, classes = inputs_of(ids, first, end), np.take(m.classes, ids)
    seen = np.lib.stride_tricks.sliding_window_view(inputs, 2 * BLOCK)
    wanted = np.lib.stride_tricks.sliding_window_view(np.concatenate([classes, np.zeros(BLOCK, classes.dtype)]), BLOCK)
    out, n = np.empty(len(ids), np.float32), 0
    for i in range(0, len(at), BLOCKS):
        a = at[i : i + BLOCKS]
        x = seen[a]
        mixed = attend(m.q, m.kv, m.near, x, before[i : i + BLOCKS] == 0)[0]
        z = mixed.reshape(-1, DIM) @ m.out
        np.exp(z, out=z)
        after, at_ = np.take(m.after, x[:, BLOCK:].ravel(), axis=0), np.arange(len(z)) * CLASSES + wanted[a].ravel()
        own = np.log(np.take(z, at_) * np.take(after, at_) / np.einsum("ij,ij->i", z, after))
        own = own[(np.arange(BLOCK) < left[i : i + BLOCKS, None]).ravel()]
        out[n : n + len(own)] = own  # blocks come in the order of their places
        n += len(own)
    return out + np.take(m.inside, np.take(m.classes, inputs[BLOCK:-BLOCK]).astype(np.int64) * m.inside.shape[1] + ids)


def token_logs(m: Model, pieces: Pieces, run: Run, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log p of each token of the documents (words, then one end), and where each document begins in them.

    A token's probability is one part (``m.share``) its frequency among the head's words and the end, the rest that of its
    subwords. place: of each of the run's distinct words its place in the head, -1 for none.
    """
    ids, first = ids_of(pieces, run)
    at = np.flatnonzero(pieces.opens[ids])
    own = np.add.reduceat(log_probs(m, ids, first, pieces.end).astype(np.float64), at)
    begin = np.searchsorted(at, first)
    if m.share:
        end = ids[at] == pieces.end
        of = np.full(len(at), len(m.counts))
        of[~end] = place[run.number]
        count = np.r_[m.counts, m.end_count].astype(np.float64)
        with np.errstate(divide="ignore"):
            logs = np.log(np.r_[m.share * count / count.sum(), 0])  # the last is for words that are not in the head
        own = np.logaddexp(logs[of], own + math.log(1 - m.share))
    return own, begin


def untrained(n: int) -> Model:
    zero = lambda *s: np.zeros(s, np.float32)
    return Model(np.arange(n) % CLASSES, np.full((CLASSES, n), -math.log(n / CLASSES), np.float32), zero(n, DIM), zero(n, 2 * DIM), zero(2 * BLOCK), zero(DIM, CLASSES), zero(n, CLASSES) + 1)


def classes_of(x: np.ndarray, count: np.ndarray, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Ids with alike neighbours share a class: k-means over the frequencies ``x`` of the commonest ids before and after."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([x, 0.5 * (x.sum(axis=1, keepdims=True) == 0) * np.maximum(count, 1)[:, None]], axis=1)
    x = np.sqrt(x / np.maximum(count, 1)[:, None]).astype(np.float32)
    seen = np.flatnonzero(count > 0)
    frequent = seen[np.argsort(-count[seen], kind="stable")][:4096]
    centres = x[rng.choice(frequent, CLASSES, replace=len(frequent) < CLASSES, p=count[frequent] / count[frequent].sum())]
    for _ in range(rounds):
        own = ((centres**2).sum(axis=1) - 2 * x[frequent] @ centres.T).argmin(axis=1)
        for c in range(CLASSES):
            mine = frequent[own == c]
            if len(mine):
                centres[c] = np.average(x[mine], axis=0, weights=np.sqrt(count[mine]))
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def with_counts(m: Model, by_class: np.ndarray, by_before: np.ndarray, counts: np.ndarray) -> Model:
    """Odds of classes after each id (by_class, smoothed by those after its class), and p(id | class, class before) (by_before,
    smoothed by p(id | class)), from counts of all training documents."""
    prior = (by_class.sum(axis=0) + 1) / (by_class.sum() + CLASSES)
    pooled = np.zeros((CLASSES, CLASSES))
    np.add.at(pooled, m.classes, by_class)
    pooled = (pooled + 20 * prior) / (pooled.sum(axis=1, keepdims=True) + 20)
    m.after = ((by_class + 10 * pooled[m.classes]) / (by_class.sum(axis=1, keepdims=True) + 10)).astype(np.float32)
    smooth = counts + 0.5
    own = smooth / np.bincount(m.classes, weights=smooth, minlength=CLASSES)[m.classes]
    m.inside = np.empty((CLASSES, len(counts)), np.float32)
    for c in range(CLASSES):  # the class before
        row = by_before[c].astype(np.float64)
        m.inside[c] = np.log((row + 20 * own) / (np.bincount(m.classes, weights=row, minlength=CLASSES)[m.classes] + 20))
    return m


Weights = dict[str, np.ndarray]


def first_weights(n: int, seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.5, (n, DIM)), "q": rng.normal(0, 0.3, (DIM, DIM)), "k": rng.normal(0, 0.3, (DIM, DIM)), "v": rng.normal(0, 0.3, (DIM, DIM)), "near": np.zeros(2 * BLOCK), "out": rng.normal(0, 0.02, (DIM, CLASSES))}
    return {k: v.astype(np.float32) for k, v in p.items()}


def flat(p: Weights) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(values: np.ndarray, like: Weights) -> Weights:
    """Weights of the shapes of ``like`` from all their numbers; numbers of four bytes are shared, not copied."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32, copy=False)
        at += like[k].size
    return out


def slopes_of(p: Weights, classes: np.ndarray, after: np.ndarray, x: np.ndarray, y: np.ndarray, slope: Weights) -> None:
    """Puts the gradient of the blocks' loss (inputs, ids wanted) into ``slope``, ``PART`` blocks at a time.

    Slopes are added up for queries, keys and values of each id first, and go back to what these are made of once, in the end.
    """
    q, kv = p["e"] @ p["q"], p["e"] @ np.concatenate([p["k"], p["v"]], axis=1)
    by_id = [np.zeros_like(p["e"]) for _ in range(3)]
    place = np.arange(p["e"].size // 2).reshape(-1, DIM // 2)  # of each pair of numbers
    share = np.float32(1 / max(1, int((y >= 0).sum())))
    slope["out"][:], slope["near"][:], lag = 0, 0, np.zeros(_BACK.shape, np.float32)
    for i in range(0, len(x), PART):
        x_, y_ = np.maximum(x[i : i + PART], 0), y[i : i + PART]
        mixed, own, k, v, s, total = attend(q, kv, p["near"], x_, x[i : i + PART, 0] < 0, bounded=False)
        s /= total
        mixed = mixed.reshape(-1, DIM)
        dz = mixed @ p["out"]
        if not max(dz.max(), -dz.min()) <= 60:
            dz -= dz.max(axis=1, keepdims=True)
        np.exp(dz, out=dz)
        dz *= np.take(after, x_[:, BLOCK:].ravel(), axis=0)
        all_ = _sums(dz)
        dz.reshape(-1)[np.arange(len(dz)) * CLASSES + classes[np.maximum(y_, 0).ravel()]] -= all_[:, 0]
        weight = np.where(y_.reshape(-1, 1) >= 0, share, np.float32(0)) / all_  # of a row of dz
        weighed = mixed * weight
        for j in range(0, len(dz), 512):  # a product over many rows is slower than its parts
            slope["out"] += weighed[j : j + 512].T @ dz[j : j + 512]
        dmixed = (dz @ p["out"].T) * weight
        along = _sums(dmixed * mixed).reshape(*y_.shape, 1)  # the sum over keys of a key's weight times its slope
        dmixed = dmixed.reshape(*y_.shape, DIM)
        ds = dmixed @ v.transpose(0, 2, 1)
        ds -= along
        ds *= s
        at = np.take(place, x_, axis=0)
        for to, where, d in zip(by_id, (at[:, BLOCK:], at, at), (ds @ k, ds.transpose(0, 2, 1) @ own, s.transpose(0, 2, 1) @ dmixed), strict=True):
            np.add.at(to.view(np.complex64).reshape(-1), where.ravel(), d.view(np.complex64).ravel())  # two numbers at once: much faster than rows
        lag += ds.sum(axis=0)
    np.add.at(slope["near"], np.maximum(_BACK, 0), lag)
    slope["e"][:] = 0
    for key, d in zip("qkv", by_id, strict=True):
        slope[key][:] = p["e"].T @ d
        slope["e"] += d @ p[key].T


def trained(p: Weights, classes: np.ndarray, after: np.ndarray, blocks: np.ndarray, steps: int, rate: float, seed: int, batch: int = BATCH) -> Weights:
    """Weights after ``steps`` steps of Adam over the blocks (inputs of a window and the ids wanted, -1 for none).

    No step's gradient is longer than 1, and no block is seen more than ``PASSES`` times or so. Ids that no block holds have no
    slope and do not move, so steps go over the others only.
    """
    steps = min(steps, PASSES * -(-len(blocks) // batch))
    rng = np.random.default_rng(seed)
    inputs, first = blocks[:, : 2 * BLOCK], p
    held = np.zeros(len(after), bool)
    held[np.maximum(inputs, 0).ravel()] = True
    place = np.r_[np.cumsum(held) - 1, -1]  # the last is for -1
    inputs, after = place[inputs], after[held]
    p = {**p, "e": p["e"][held]}
    values = flat(p)
    slopes, mean, square = (np.zeros_like(values) for _ in range(3))
    p, slope = unflat(values, p), unflat(slopes, p)
    order = rng.permutation(len(blocks))
    for step in range(1, steps + 1):
        pick = order[np.arange((step - 1) * batch, min(step * batch, (step - 1) * batch + len(blocks))) % len(blocks)]
        slopes_of(p, classes, after, inputs[pick], blocks[pick, 2 * BLOCK : 3 * BLOCK], slope)
        slopes /= np.float32(max(1.0, math.sqrt(float(slopes @ slopes))))
        pace = rate * min(1.0, step / 30) * (1 - step / (steps + 1)) ** 0.5
        mean += np.float32(0.1) * (slopes - mean)
        square += np.float32(0.01) * (slopes * slopes - square)
        values -= np.float32(pace / (1 - 0.9**step)) * mean / (np.sqrt(square / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    e = first["e"].copy()
    e[held] = p["e"]
    return {**p, "e": e}


def with_head(m: Model, p: Weights) -> Model:
    """The model with the head's tables. Queries and keys are at most 9 long, so no score's exponential overflows.

    Weights that are not finite are not taken: the model then goes by the last subword alone, and a warning says so.
    """
    if not all(np.isfinite(v).all() for v in p.values()):
        warnings.warn("the attention head's weights are not finite; scores go by the last subword alone", stacklevel=2)
        return m
    short = lambda a: a * np.minimum(1, 9 / np.maximum(np.sqrt((a * a).sum(axis=1, keepdims=True)), 1e-9))
    m.q, m.near, m.out = (a.astype(np.float32) for a in (short(p["e"] @ p["q"]), np.clip(p["near"], -5, 5), p["out"]))
    m.kv = np.concatenate([short(p["e"] @ p["k"]), p["e"] @ p["v"]], axis=1).astype(np.float32)
    return m


# --- on Spark


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and crc32(str(doc_id).encode()) % 5 == 1


def _pieces_of_text(rows: list[tuple], size: int = PIECE) -> Iterator[list[tuple]]:
    """Rows (the text last) in runs of about ``size`` bytes."""
    held, n = [], 0
    for row in rows:
        held.append((*row[:-1], (row[-1] or "").encode()))
        n += len(held[-1][-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


#: What a task has counted and set aside: pairs of subwords a, b, words, and blocks, each with null in what it is not.
_COUNTED = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("word", pa.binary()), ("block", pa.binary())])


def _counted(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name) if f.name in columns else pa.nulls(n, f.type) for f in _COUNTED], schema=_COUNTED)


def set_aside(ids: np.ndarray, first: np.ndarray, end: int, signs: np.ndarray, rate: int) -> np.ndarray:
    """One block in ``rate`` of each document: the inputs of its window (-1 in front of the document) and the ids wanted (-1 behind it)."""
    size = np.diff(np.r_[first, len(ids)])
    at, before = windows(first, size)
    nth = -(-size // BLOCK)
    doc = np.repeat(np.arange(len(first)), nth)
    mine = ((signs[doc] + (before // BLOCK).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(rate) == 0
    at, before, left = at[mine], before[mine], np.minimum(BLOCK, size[doc[mine]] - before[mine])
    x = np.lib.stride_tricks.sliding_window_view(inputs_of(ids, first, end), 2 * BLOCK)[at]
    x[:, :BLOCK][before == 0] = -1
    y = np.lib.stride_tricks.sliding_window_view(np.concatenate([ids, np.zeros(BLOCK, ids.dtype)]), BLOCK)[at]
    return np.concatenate([x, np.where(np.arange(BLOCK) < left[:, None], y, -1)], axis=1).astype("<i4")


def _count(training: DataFrame, pieces: Pieces, rate: int) -> DataFrame:
    """Counts and blocks of the training texts (column text), as ``_COUNTED``; counts of a task are to be added up."""
    shared, key = training.sparkSession.sparkContext.broadcast(pieces), new_key()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = kept_in_worker("lm-pieces", key, shared, lambda x: x)
        words: list[tuple[pa.BinaryArray, np.ndarray]] = []
        keys, times, held, held_words = [], [], 0, 0

        def pairs() -> Iterator[pa.RecordBatch]:
            every, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(times)).astype(np.int64)
            for i in range(0, len(every), 1 << 16):
                a, b = np.divmod(every[i : i + (1 << 16)], subwords.n)
                yield _counted(a=pa.array(a, pa.int32()), b=pa.array(b, pa.int32()), n=pa.array(n[i : i + (1 << 16)]))

        def counted_words() -> Iterator[pa.RecordBatch]:
            every, n = words.pop()
            for i in range(0, len(every), 1 << 15):
                yield _counted(word=every[i : i + (1 << 15)], n=pa.array(n[i : i + (1 << 15)]))

        for rows in _pieces_of_text(arrow_rows(batches, ["text"])):
            texts = [t for (t,) in rows]
            found = Run.of(texts)
            ids, first = ids_of(subwords, found)
            k, n = np.unique(inputs_of(ids, first, subwords.end)[BLOCK:-BLOCK].astype(np.int64) * subwords.n + ids, return_counts=True)
            keys.append(k)
            times.append(n)
            held += len(k)
            if held > HELD_PAIRS:
                yield from pairs()
                keys, times, held = [], [], 0
            words.append((found.words, np.bincount(found.number, minlength=len(found.words))))
            held_words += len(found.words)
            if held_words > 2 * HELD_WORDS:
                words = [_added_up(words)]
                held_words = len(words[0][0])
                if held_words > HELD_WORDS:
                    yield from counted_words()
                    held_words = 0
            signs = np.array([crc32(t) << 32 | len(t) for t in texts], np.uint64)
            blocks = set_aside(ids, first, subwords.end, signs, rate)
            if len(blocks):
                yield _counted(block=_packed(blocks, subwords.n))
        if held:
            yield from pairs()
        if held_words:
            words = [_added_up(words)]
            yield from counted_words()

    return training.mapInArrow(count, "a int, b int, n long, word binary, block binary")


def _added_up(counts: list[tuple[pa.BinaryArray, np.ndarray]]) -> tuple[pa.BinaryArray, np.ndarray]:
    """Words with their counts, each word once."""
    every = pa.chunked_array([w for w, _ in counts]).combine_chunks().dictionary_encode()
    return every.dictionary, np.bincount(every.indices.to_numpy(), weights=np.concatenate([n for _, n in counts])).astype(np.int64)


def _packed(blocks: np.ndarray, n: int) -> pa.BinaryArray:
    """Blocks of ``n`` ids as binary values, with two bytes an id where these are enough for all ids."""
    values = np.ascontiguousarray(blocks, "<i2" if n <= 1 << 15 else "<i4")
    at = np.arange(len(values) + 1, dtype=np.int32) * (values.itemsize * values.shape[1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(at), pa.py_buffer(values)])


def _blocks(table: pa.Table) -> np.ndarray:
    rows = [_bytes_of(c.cast(pa.binary()))[0].reshape(len(c), -1) for c in table["block"].chunks if len(c)]
    values = np.concatenate(rows)
    return values.view(f"<i{values.shape[1] // (3 * BLOCK)}")


def _averaged(blocks: DataFrame, m: Model, p: Weights, part: int) -> Weights:
    """The weights after tasks have trained them on their blocks, averaged by the number of blocks."""
    shared, slices = blocks.sparkSession.sparkContext.broadcast((p, m.classes, m.after)), 16

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0
        for held in _runs(batches, 1 << 16):
            p_, classes, after = shared.value
            mine = _blocks(held)
            got = flat(trained(dict(p_), classes, after, mine, -(-len(mine) // LARGE), 0.005, part, LARGE)) * len(mine)
            if not np.isfinite(got).all():  # then these blocks leave the weights as they were
                got = flat(p_) * len(mine)
            total, weight = got if total is None else total + got, weight + len(mine)
        if weight:
            for i, x in enumerate(np.array_split(total.astype("<f8"), slices)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([weight], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["slice", "n", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n: Counter = Counter()
        for i, k, x in arrow_rows(batches, ["slice", "n", "sums"]):
            x = np.frombuffer(x, "<f8")
            sums[i], n[i] = x if i not in sums else sums[i] + x, n[i] + k
        for i, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([n[i]], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["slice", "n", "sums"])

    schema = "slice int, n long, sums binary"
    got = sorted(map(tuple, blocks.mapInArrow(train, schema).repartition(slices, "slice").mapInArrow(add, schema).collect()))
    return unflat(np.concatenate([np.frombuffer(bytes(x), "<f8") / n for _, n, x in got]), p) if got else p


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches in runs of about ``size`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def learn(docs: DataFrame, ranks_path: str, rate: int = RATE) -> tuple[Pieces, Model, DataFrame]:
    """The subwords, the model, and the table of word counts (word, c), all from all training documents."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/lm-{uuid.uuid4().hex}"
    learns = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True))
    pieces = Pieces(read_ranks(ranks_path))
    _count(docs.where(learns).select("text"), pieces, rate).write.parquet(f"{folder}/counted")
    counted = spark.read.parquet(f"{folder}/counted")
    counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")).write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    counted.where("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n")).write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")

    n = pieces.n
    model, counts = untrained(n), np.zeros(n, np.int64)
    by_id = pairs.groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts[np.asarray(by_id["b"])] = np.asarray(by_id["n"])
    if not counts.sum():
        return pieces, model, words
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    model.end_count = int(counts[pieces.end])
    model.train_tokens, model.distinct = (total.n or 0) + model.end_count, total.v + 1
    head = words.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    model.head = {w: i for i, w in enumerate(head["word"].to_pylist())}
    model.counts = np.asarray(head["c"])
    model.share = SHARE

    top = np.argsort(-counts, kind="stable")[:CONTEXT]
    column = np.full(n, -1)
    column[top] = np.arange(len(top))
    common = spark.createDataFrame([(int(i),) for i in top], "id int")
    near = [pairs.join(F.broadcast(common), F.col(c) == F.col("id"), "left_semi").toArrow() for c in ("a", "b")]
    x = np.zeros((n, 2 * CONTEXT), np.float32)
    for shift, table, own, other in ((0, near[0], "b", "a"), (CONTEXT, near[1], "a", "b")):
        np.add.at(x, (np.asarray(table[own]), column[np.asarray(table[other])] + shift), np.asarray(table["n"]))
    model.classes = classes_of(x, counts)
    named = spark.createDataFrame([(i, int(c)) for i, c in enumerate(model.classes)], "b int, class int")
    classed = pairs.join(F.broadcast(named), "b").groupBy("a", "class").agg(F.sum("n").alias("n")).toArrow()
    by_class = np.zeros((n, CLASSES))
    by_class[np.asarray(classed["a"]), np.asarray(classed["class"])] = np.asarray(classed["n"])
    before = pairs.join(F.broadcast(named.withColumnRenamed("b", "a")), "a").groupBy("class", "b").agg(F.sum("n").alias("n")).toArrow()
    by_before = np.zeros((CLASSES, n), np.float32)
    by_before[np.asarray(before["class"]), np.asarray(before["b"])] = np.asarray(before["n"])
    model = with_counts(model, by_class, by_before, counts)

    blocks = counted.where("block is not null").select("block")
    # the first blocks by their hash: most are told from the rest by a bound, under which four times as many are to be expected
    bound = -(1 << 63) + min(1 << 63, (1 << 64) * 4 * FIRST * BLOCK // int(counts.sum()))
    some = blocks.where(F.xxhash64("block") < bound).orderBy(F.xxhash64("block"), "block").limit(FIRST).toArrow()
    if some.num_rows < FIRST:
        some = blocks.orderBy(F.xxhash64("block"), "block").limit(FIRST).toArrow()
    if not some.num_rows:
        return pieces, model, words
    p = trained(first_weights(n), model.classes, model.after, _blocks(some), STEPS, 0.02, 0)
    for r in range(ROUNDS):
        p = _averaged(blocks.where(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == r), model, p, r)
    return pieces, with_head(model, p), words


_DOC = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "known": pa.int64(), "logs": pa.float64(), "score": pa.float64()}
_ROWS = pa.schema([("row", pa.int64()), ("word", pa.binary()), ("n", pa.int32()), *_DOC.items()])


def _first_pass(docs: DataFrame, pieces: Pieces, model: Model) -> DataFrame:
    """For each document a row with what the head and the model say, and a row for each of its other words.

    The word of a document's own row is a space and its number, which no word is, so these rows are spread like the others.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast((pieces, model)), new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, m, logs, known, head = kept_in_worker("lm", key, shared, lambda x: (*x, np.log10(np.r_[x[1].counts, 0] + 0.5) - x[1].shift, np.r_[x[1].counts, 0] > 0, pa.array(x[1].head, pa.binary())))
        end_log, end_known = math.log10(m.end_count + 0.5) - m.shift, int(m.end_count > 0)
        for rows in _pieces_of_text(arrow_rows(batches, ["row", "doc_id", "text"])):
            found, n = Run.of([t for *_, t in rows]), len(rows)
            row = np.array([r for r, *_ in rows], np.int64)
            place = pc.fill_null(pc.index_in(found.words, value_set=head), -1).to_numpy().astype(np.int64)
            own, begin = token_logs(m, subwords, found, place)
            scores = np.add.reduceat(own, begin) / math.log(10)
            at = place[found.number]
            inside = at >= 0
            base = np.bincount(found.doc[inside], weights=logs[at[inside]], minlength=n) + end_log
            seen = np.bincount(found.doc[inside], weights=known[at[inside]], minlength=n).astype(np.int64) + end_known
            size = np.bincount(found.doc, minlength=n) + 1
            pairs, times = np.unique(found.doc[~inside] * len(found.words) + found.number[~inside], return_counts=True)
            if len(pairs):
                of, word = np.divmod(pairs, len(found.words))
                k = len(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(row[of]), found.words.take(pa.array(word)), pa.array(times, pa.int32()), *(pa.nulls(k, t) for t in _DOC.values())], schema=_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array([b" %d" % r for r in row.tolist()], pa.binary()), pa.array(np.zeros(n), pa.int32()), pa.array([i for _, i, _ in rows], pa.int64()), pa.array(size), pa.array(seen), pa.array(base), pa.array(scores)], schema=_ROWS)

    numbered = docs.select(row_number().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(run, "row long, word binary, n int, doc_id long, n_tokens long, known long, logs double, score double")


def score(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    pieces, model, words = learn(docs, ranks_path)
    rows = _first_pass(docs, pieces, model).join(words, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rows.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.sum(F.when(c > 0, F.col("n")).otherwise(0)) + F.max("known")).cast("long").alias("n_known"),
        (F.sum(F.col("n") * (F.log10(c + 0.5) - model.shift)) + F.max("logs")).alias("logs"),
        F.max("score").alias("score"),
    )
    total = math.log10(model.train_tokens + 0.5 * (model.distinct + 1)) - model.shift
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return sums.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * total).alias("base_score"), "score")
