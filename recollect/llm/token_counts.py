"""Token counts by a subword model with merges by score, with a whole-token shortcut.

Offline, on the driver, every vocabulary string is merged from its characters; those that arrive at one token are proven
whole. A pre-token found among them counts as one without any merging; only the rest is merged.

Pre-tokens: the text with each space written as the space mark and one mark in front is cut before every mark that
follows another character. No vocabulary string has a mark behind another character (``Pieces`` checks that), so no merge
can reach over such a cut.

Defined cases: a null or empty text has no bytes and no tokens; rows are kept one to one, repeated and null ids included; an
empty table gives no rows; very long texts are counted whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from recollect.llm.common import Recent, arrow_rows, emit, kept_in_worker, new_key

MARK = "▁"
_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


class Pieces:
    """Normal pieces with their scores, and the strings proven to be one token each.

    ``score`` orders merges: higher first, then leftmost. A character that no piece holds falls back to its bytes.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        order = sorted({*scores.values()}, reverse=True)
        place = {v: i for i, v in enumerate(order)}
        #: piece: how early it is merged
        self.rank = {p: place[v] for p, v in scores.items()}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in scores):
            raise ValueError("a piece has a space mark behind another character")
        self.whole = frozenset(p for p in scores if self.merge(p) == [p])

    def merge(self, text: str) -> list[str]:
        """The symbols of one pre-token after all merges; a heap of adjacent pairs over linked symbols."""
        rank, n = self.rank.get, len(text)
        parts, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        shift = n.bit_length()
        low = (1 << shift) - 1
        heap = [r << shift | i for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            i = x & low
            j = after[i]
            a = parts[i]
            if not a or j >= n or rank(joined := a + parts[j]) != x >> shift:
                continue
            parts[i], parts[j] = joined, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(joined + parts[k])) is not None:
                    heapq.heappush(heap, r << shift | i)
            h = before[i]
            if h >= 0 and (r := rank(parts[h] + joined)) is not None:
                heapq.heappush(heap, r << shift | h)
        return [p for p in parts if p]

    def count(self, pre_token: str) -> int:
        if pre_token in self.whole:
            return 1
        return sum(1 if p in self.rank else len(p.encode()) for p in self.merge(pre_token))


class Counter:
    """The pieces with the memo of one Python worker."""

    def __init__(self, pieces: Pieces) -> None:
        self.line_ends_alone = not any("\n" in p for p in pieces.rank)
        self.rest = Recent(pieces.count, 400_000)
        self.word = Recent(self._word, 400_000)

    def _word(self, word: str) -> int:
        """What stands between two spaces. Nothing merges with a line end, as no piece holds one: the parts count alone."""
        if "\n" in word and self.line_ends_alone:
            first, *lines = word.split("\n")
            return self.rest[MARK + first] + sum(1 + (self.rest[x] if x else 0) for x in lines)
        return self.rest[MARK + word]

    def marked(self, text: str) -> int:
        return sum(map(self.rest.__getitem__, _RUNS.findall(text)))

    def text(self, text: str) -> int:
        """A text with runs of spaces, or with marks of its own, is cut by the pattern; others at their spaces."""
        if not text:
            return 0
        if "  " in text or text[-1] == " " or text[0] == " " or MARK in text:
            return self.marked(MARK + text.replace(" ", MARK))
        return sum(map(self.word.__getitem__, text.split(" ")))


@lru_cache(maxsize=2)
def read_pieces(path: str) -> Pieces:
    """The normal pieces of a .model file that merges by score, keeps its text as it is and falls back to bytes."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("another kind of model")
    return Pieces({p.piece: p.score for p in model.pieces if p.type == 1})


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more tokens than ``limit``."""
    shared, key = docs.sparkSession.sparkContext.broadcast(read_pieces(model_path)), new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_in_worker("token_counts", key, shared, Counter)

        def rows():
            for doc_id, text in arrow_rows(batches, ["doc_id", "text"]):
                n = counter.text(text or "")
                yield doc_id, len((text or "").encode()), n, n > limit

        return emit(rows(), COUNTED)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
