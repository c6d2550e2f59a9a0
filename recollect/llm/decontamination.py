"""Benchmark decontamination with a generalised suffix automaton of the test items.

All items' words are laid into one automaton over word numbers. A document's words are streamed through it; the state
and its matching length tell, at every word, how long a passage of the items ends there. A length of at least ``window``
means that the last ``window`` words are a window of an item; items shorter than that are one window each, found by the
states that spell a whole item. States know the items in which their last ``window`` words occur, so no text is compared.

Items are broadcast in shards of at most ``SHARD_WORDS`` words, counted as they come to the driver, which holds one shard at
a time (never the benchmark, never the documents), as a Python worker holds one automaton: every shard is one pass over the documents. ``find``
puts the passes' hits together by row, ``decontaminate`` cuts shard by shard till a round changes nothing. Benchmarks of usual
size are one shard, without a shuffle.

Defined cases: a null text or item has no words; a text without words has n_words 0 and no hits; repeated items count by
their item_ids, null item_ids are left out of the items found, but their windows are hits; rows are kept one to one,
repeated doc_ids included; other columns are ignored by ``find`` and kept by ``decontaminate``. No documents or no items:
no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import arrow_rows, emit, kept_in_worker, lower_ascii, new_key, row_number, unused_name, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Most words of the items in one automaton; it has up to twice as many states.
SHARD_WORDS = 500_000


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[int | None, list[str]]], window: int = WINDOW) -> None:
        self.window = window
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]  # of a state: the items with a window that ends in it
        wholes: dict[int, dict[int, set[int]]] = {}  # of a state: lengths of short items that end there, and their ids
        for item_id, words in items:
            last, ids = 0, set() if item_id is None else {item_id}
            for n, word in enumerate(words, 1):
                last = self._extend(last, self.number.setdefault(word, len(self.number)))
                while len(ends) < len(self.next):
                    ends.append(set())
                if n >= window:
                    ends[last] |= ids
            if 0 < len(words) < window:
                wholes.setdefault(last, {}).setdefault(len(words), set()).update(ids)
        # suffix links go from longer to shorter: what ends in a state also ends in its link
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            ends[self.link[s]] |= ends[s]
        #: items of the state's last ``window`` words, where it has as many
        self.items: list[frozenset[int] | None] = [None] * len(self.next)
        #: short items that are suffixes of the state: (length, ids)
        self.short: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            up = self.link[s]
            self.short[s] = (*self.short[up], *((n, frozenset(i)) for n, i in sorted(wholes.get(s, {}).items())))
            if self.length[up] >= window:
                self.items[s] = self.items[up]
            elif self.length[s] >= window:
                self.items[s] = frozenset(ends[s])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = twin
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        return twin

    def hits(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words (merged, end exclusive), and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, length, window, items, short = self.next, self.link, self.length, self.window, self.items, self.short
        state = run = 0
        for i, c in enumerate(map(self.number.get, words)):
            if c is None:
                state = run = 0
                continue
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = nxt[state].get(c)
            if to is None:
                run = 0
                continue
            state = to
            run += 1
            reach = 0
            if run >= window:
                reach = window
                found |= self._items_at(state, run)
            for n, ids in short[state]:
                if n <= run:
                    reach = max(reach, n)
                    found |= ids
            if reach:
                a = i + 1 - reach
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, found

    def _items_at(self, state: int, run: int) -> frozenset[int]:
        """Items of the last ``window`` words, given that ``run`` words match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return self.items[state] or frozenset()


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lower_ascii(text)) if text else []


def _shards(items: DataFrame, shard_words: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in shards of bounded size, one at least; a longer item is cut into pieces that overlap by all but one word of a window."""
    rows, n = [], 0
    for item_id, text in items.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        words = words_of(text)
        step = max(1, shard_words - WINDOW + 1)
        for at in range(0, len(words), step) if len(words) > shard_words else [0]:
            piece = words[at : at + shard_words]
            if not piece or at and len(piece) < WINDOW:
                continue
            if rows and n + len(piece) > shard_words:
                yield rows
                rows, n = [], 0
            rows.append((item_id, " ".join(piece)))
            n += len(piece)
    yield rows


def _scan(docs: DataFrame, items: list[tuple[int | None, str]], window: int) -> DataFrame:
    """row, doc_id, n_words, hit spans as a flat array of starts and ends, and items, by one automaton."""
    shared, key = docs.sparkSession.sparkContext.broadcast(items), new_key()
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = kept_in_worker("decontamination", key, shared, lambda rows: Automaton([(i, t.split(" ")) for i, t in rows], window))

        def rows():
            for r, doc_id, text in arrow_rows(batches, ["row", "doc_id", "text"]):
                words = words_of(text)
                spans, found = automaton.hits(words)
                yield r, doc_id, len(words), [x for s in spans for x in s], sorted(found)

        return emit(rows(), schema)

    plan = docs.select(row_number().alias("row"), F.col("doc_id").cast("long"), "text")
    return plan.mapInArrow(run, "row long, doc_id long, n_words long, spans array<long>, items array<long>")


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """row, doc_id, n_words, n_hit, spans (starts and ends of hit words) and items (sorted ids) for each row of ``docs``."""
    if shard_words < window:
        raise ValueError("a shard must hold a window")
    parts = [_scan(docs, shard, window) for shard in _shards(items, shard_words)]
    if len(parts) == 1:
        found = parts[0]
    else:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionAll(p)
        # spans of a document are as many as its words at most: a row each, merged in order
        held = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        pairs = every.where("size(spans) > 0").select("row", F.explode(F.expr("transform(sequence(0, size(spans) - 2, 2), i -> struct(spans[i] as a, spans[i + 1] as b))")).alias("s")).select("row", "s.a", "s.b")
        by_row = Window.partitionBy("row").orderBy("a", "b")
        far = F.max("b").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
        grouped = pairs.withColumn("opens", F.when(far.isNull() | (F.col("a") > far), 1).otherwise(0)).withColumn("g", F.sum("opens").over(by_row))
        merged = grouped.groupBy("row", "g").agg(F.min("a").alias("a"), F.max("b").alias("b")).groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("a", "b"))), lambda s: F.array(s["a"], s["b"]))).alias("spans"))
        found = held.join(merged, "row", "left").select("row", "doc_id", "n_words", F.coalesce("spans", F.expr("array()").cast("array<long>")).alias("spans"), "items")
    hit = F.expr("aggregate(spans, struct(0L as n, -1L as sign), (x, v) -> struct(x.n + x.sign * v as n, -x.sign as sign)).n")
    return found.select("row", "doc_id", "n_words", hit.alias("n_hit"), "spans", "items")


def digests(found: DataFrame) -> DataFrame:
    """The result of ``find`` with the items as a digest."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _without(text: str, automaton: Automaton, max_share: float, before: int | None) -> tuple[str | None, int]:
    """The text without its hit words, repeated till none is left, and its words at first; None where more than the share allowed go.

    before: its words at first, where an earlier shard has cut it already.
    """
    while True:
        at = [m.span() for m in WORD.finditer(lower_ascii(text))]
        words = [lower_ascii(text[a:b]) for a, b in at]
        before = len(words) if before is None else before
        spans = sorted(automaton.hits(words)[0])
        if not spans:
            return text, before
        kept, end, cut_words = [], 0, set()
        for a, b in spans:
            cut_words.update(range(a, b))
            if at[a][0] >= end:
                kept.append(text[end : at[a][0]])
            end = max(end, at[b - 1][1])
        kept.append(text[end:])
        if len(words) - len(cut_words) < before * (1 - max_share):
            return None, before
        text = "".join(kept)


def _cut_shard(docs: DataFrame, shard: list[tuple[int | None, str]], window: int, max_share: float, out: str, before: str) -> DataFrame:
    """``docs`` with its texts cut by one shard's automaton in column ``out``, and their words at first in ``before``."""
    shared, key = docs.sparkSession.sparkContext.broadcast(shard), new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = kept_in_worker("decontaminate", key, shared, lambda rows: Automaton([(i, t.split(" ")) for i, t in rows], window))
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                texts, first = batch.column(batch.schema.get_field_index(out)).to_pylist(), batch.column(batch.schema.get_field_index(before)).to_pylist()
                clean, sizes = zip(*(_without(t, automaton, max_share, n) if t else (t, n) for t, n in zip(texts, first, strict=True)))
                keep = pa.array([c is not None or t is None for c, t in zip(clean, texts)])
                new = {out: pa.array(clean, pa.string()), before: pa.array(sizes, pa.int64())}
                yield pa.RecordBatch.from_arrays([new.get(f.name, c) for f, c in zip(batch.schema, batch.columns, strict=True)], names=batch.schema.names).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_share: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without the spans that are in windows of the items; documents of which more than ``max_share`` is hit go.

    With one shard this is one pass; with more, each shard's pass is written to the shared folder, and rounds go on till no
    text gets shorter, as a cut may bring the words of another shard's window together. No window is left either way; where
    windows of different shards overlap, words of the later one may stay that one pass over both would have cut.
    """
    out, before = unused_name(docs, "clean_text"), unused_name(docs, "words_before")
    left = docs.withColumn(out, F.col("text")).withColumn(before, F.lit(None).cast("long"))
    shards = _shards(items, shard_words)
    shard, following = next(shards), next(shards, None)
    if following is None:
        left = _cut_shard(left, shard, window, max_share, out, before)
    else:
        size, last = None, -1
        while size != last:
            last = size
            for shard in _shards(items, shard_words):
                left = written(_cut_shard(left, shard, window, max_share, out, before))
            size = left.agg(F.count("*"), F.sum(F.length(out))).first()
    return left.select(*(F.col(f"`{out}`").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))
