"""Byte-level BPE encoding and decoding with two-tier look-up.

Tier one: a minimal perfect hash over all vocabulary strings resolves a pre-token that is a vocabulary entry
(which by construction of a rank vocabulary is what the merges would arrive at; ``Vocabulary`` keeps only entries for
which that was verified). Tier two: every other pre-token is merged with a heap of pair ranks over a doubly linked
list of byte symbols.

Defined cases: a null or empty text has no tokens (n_tokens 0, both digests those of the empty string); rows are kept one
to one, so repeated ids and null ids pass through; an empty table gives no rows; very long texts are encoded whole; other
columns are ignored by ``encode`` and never clash with its own; a pattern other than the public one is an error.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from xxhash import xxh64_intdigest

from recollect.llm.common import Recent, arrow_rows, emit, kept_in_worker, new_key

#: Unicode's white space.
_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space that follows white space.
_AFTER_WHITE = re.compile(f"[{_WHITE}] ")
#: Characters beyond those that ``plain`` knows; texts without them are split by the standard library's engine, which is faster.
_ODD = re.compile(r"[^\t-\r\x20-\x7e\xa0¡¿À-ÖØ-öø-ÿ]")

#: Entries of a generation of a memo: three memos with two generations each take 80 MB or so.
KNOWN = 100_000


class PerfectHash:
    """Minimal perfect hash by displacement: a bucket's seed sends each of its keys to a slot of its own."""

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        self.buckets = n // 3 + 1
        by: dict[int, list[int]] = {}
        for i, k in enumerate(keys):
            by.setdefault(xxh64_intdigest(k) % self.buckets, []).append(i)
        self.seeds, self.key_at = [0] * self.buckets, [-1] * n
        free = iter(range(n))
        for b, members in sorted(by.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:  # the last buckets take what slots are left; a negative seed names the slot
                at, seed = [next(i for i in free if self.key_at[i] < 0)], 0
                self.seeds[b] = -at[0] - 1
            else:
                for seed in range(1, 1 << 22):
                    at = [xxh64_intdigest(keys[i], seed) % n for i in members]
                    if len({*at}) == len(at) and all(self.key_at[a] < 0 for a in at):
                        break
                else:
                    raise ValueError("no seed tells these keys apart")
                self.seeds[b] = seed
            for a, i in zip(at, members, strict=True):
                self.key_at[a] = i

    def slot(self, key: bytes) -> int:
        """Where ``key`` would be; whoever asks compares the key that lies there."""
        seed = self.seeds[xxh64_intdigest(key) % self.buckets]
        return -seed - 1 if seed < 0 else xxh64_intdigest(key, seed) % self.n


class Vocabulary:
    """Ranks of byte strings, the tables for merging, and the perfect hash of tier one.

    Built once on the driver (its size is that of the vocabulary, whatever the corpus) and broadcast.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.split = spaced(pattern)
        self.split_plain = plain(pattern)
        self.first = [ranks[bytes([b])] for b in range(256)]
        #: joins[a][b]: the rank that symbols a and b merge into
        self.joins: list[dict[int, int]] = [{} for _ in range(max(ranks.values()) + 1)]
        for whole, rank in ranks.items():
            for k in range(1, len(whole)):
                a, b = ranks.get(whole[:k]), ranks.get(whole[k:])
                if a is not None and b is not None:
                    self.joins[a][b] = rank
        keys = [k for k in ranks if self.merged(k) == [ranks[k]]]
        self.hash = PerfectHash(keys)
        self.slots = [(keys[i], ranks[keys[i]]) for i in self.hash.key_at]
        self.bytes_of = {str(r): b for b, r in ranks.items()}

    def whole(self, token: bytes) -> int | None:
        """Tier one: the rank of a pre-token that is a vocabulary entry."""
        key, rank = self.slots[self.hash.slot(token)]
        return rank if key == token else None

    def merged(self, token: bytes) -> list[int]:
        """Tier two: merge the lowest-ranked pair, leftmost first, until none is left; a heap over linked symbols."""
        joins, n = self.joins, len(token)
        ids = [self.first[b] for b in token]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        shift = n.bit_length()
        low = (1 << shift) - 1
        heap = []
        for i in range(n - 1):
            rank = joins[ids[i]].get(ids[i + 1])
            if rank is not None:
                heap.append(rank << shift | i)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i, rank = x & low, x >> shift
            a, j = ids[i], after[i]
            if a < 0 or j >= n or joins[a].get(ids[j]) != rank:  # one of the two has merged since
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                r = joins[rank].get(ids[k])
                if r is not None:
                    push(heap, r << shift | i)
            h = before[i]
            if h >= 0:
                r = joins[ids[h]].get(rank)
                if r is not None:
                    push(heap, r << shift | h)
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens: the pattern's matches, one after another."""
        return (self.split if _ODD.search(text) else self.split_plain).findall(text)


def known(pattern: str) -> None:
    if pattern != public_tokenizers.PATTERN:
        raise ValueError("another pattern: its white space and letters would have to be spelled out, too")


def spaced(pattern: str) -> regex.Pattern:
    """The pattern with white space spelled out: engines differ on U+001C to U+001F. Only the one pattern whose parts are known here."""
    known(pattern)
    return regex.compile(pattern.replace(r"[^\s\p{L}", rf"[^{_WHITE}\p{{L}}").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]"))


def plain(pattern: str) -> re.Pattern:
    """The pattern for texts without odd characters, in the standard library's engine."""
    known(pattern)
    letters, white = "A-Za-zÀ-ÖØ-öø-ÿ", r"\t-\r\x20\xa0"
    return re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{white}{letters}0-9]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", "[0-9]").replace(r"\s", f"[{white}]").replace(r"\S", f"[^{white}]"))


class Encoder:
    """A vocabulary with the memos of one Python worker, each of at most twice ``KNOWN`` entries."""

    def __init__(self, voc: Vocabulary) -> None:
        self.voc = voc
        self.piece = Recent(self._piece, KNOWN)
        self.chunk = Recent(self._chunk, KNOWN)
        self.bytes = Recent(self._bytes, KNOWN)

    def _piece(self, piece: str) -> str:
        token = piece.encode()
        rank = self.voc.whole(token)
        return str(rank) if rank is not None else " ".join(map(str, self.voc.merged(token)))

    def _chunk(self, chunk: str) -> str:
        return " ".join(map(self.piece.__getitem__, self.voc.pieces(chunk)))

    def _bytes(self, ids: str) -> bytes:
        return b"".join(map(self.voc.bytes_of.__getitem__, ids.split(" ")))

    def ids(self, text: str) -> list[str]:
        """The text's ids in decimal, in groups joined by spaces.

        No match of the pattern runs on over a space that follows anything but white space, so such a text is cut there.
        """
        if not text:
            return []
        if _AFTER_WHITE.search(text):
            return list(map(self.piece.__getitem__, self.voc.pieces(text)))
        head, *tail = text.split(" ")
        return ([self.chunk[head]] if head else []) + [self.chunk[" " + x] for x in tail]

    def decode(self, groups: list[str]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, groups))


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(read_ranks(path), pattern)


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the array ``ids`` of every text, for training."""
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary(ranks_path, pattern)), new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept_in_worker("byte_bpe", key, shared, Encoder)
        return emit(((i, [int(x) for g in enc.ids(t or "") for x in g.split()]) for i, t in arrow_rows(batches, ["doc_id", "text"])), TOKENS, 512)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Token count of every text, with digests of its ids and of the bytes that these decode to."""
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary(ranks_path, pattern)), new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept_in_worker("byte_bpe", key, shared, Encoder)

        def rows():
            for doc_id, text in arrow_rows(batches, ["doc_id", "text"]):
                groups = enc.ids(text or "")
                ids = " ".join(groups)
                yield doc_id, ids.count(" ") + 1 if ids else 0, sha256(ids.encode()).hexdigest(), sha256(enc.decode(groups)).hexdigest()

        return emit(rows(), ENCODED)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
