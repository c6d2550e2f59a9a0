"""Transcripts as lines of text: rendering, regular-expression search with context, pages and character budgets.

All windows are over one session, in order of sequence.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from recollect.operators.dealing import in_order
from recollect.sources.folders import shared_folder

READ_LIMIT, READ_CHARS = 2_000, 20_000
#: Characters of a session that are read before a search over several lines is tried.
WINDOW = 1 << 16


def rendered(events: DataFrame) -> DataFrame:
    """session_id, sequence and the line's text: compact JSON of sequence, role and content (PRJ3; ``numbered`` puts the number in front)."""
    return events.select("session_id", "sequence", F.to_json(F.struct("sequence", "role", "content")).alias("text"))


def numbered(lines: DataFrame) -> Column:
    """A line as it is shown: its sequence, a tab and its text (PRJ3)."""
    return F.concat_ws("\t", F.col("sequence").cast("string"), "text")


def matching(lines: DataFrame, pattern: str, ignore_case: bool = True) -> Column:
    """Whether a line's text holds the pattern; keys of the JSON count, too (GRP1)."""
    return F.col("text").rlike(("(?i)" if ignore_case else "") + pattern)


class _Unsettled:
    """The lines of one session that matches may still touch; lines whose matches no later line can change are told and forgotten.

    ``unsure`` finds the first place from which a match could still run into the end of what is held, by the partial matches of
    the regex module; what matches before it is settled. A match at that very place is, too, if ``first`` comes to it before it
    meets the end (as a lazy repeat does). While nothing settles, twice as much is read before the next attempt.
    """

    def __init__(self, pattern: str, flags: int) -> None:
        self.found = regex.compile(pattern, flags)
        self.unsure = regex.compile(f"(?:{pattern})(?!)", flags)
        self.first = regex.compile(f"(?:{pattern})(?P<_whole>).*+(?!)", flags)  # goes on to the end behind the match
        self.looks_back = "(?<=" in pattern or "(?<!" in pattern  # then nothing is forgotten
        self.begin()

    def begin(self) -> None:
        self.lines, self.parts, self.size, self.due, self.pos, self.told = [], [], 0, WINDOW, 0, 0

    def add(self, sequence: int, line: str) -> list[int]:
        self.lines.append(sequence)
        self.parts.append(line)
        self.size += len(line) + 1
        return self.matched(False) if self.size >= self.due else []

    def _settled(self, text: str, last: int | None) -> Iterator[tuple[int, int]]:
        """Spans of the matches from ``pos`` on that end before ``last`` and cannot change; ``pos`` moves behind them."""
        while True:
            doubt = self.unsure.search(text, self.pos, partial=True) if last is not None else None
            limit = doubt.start() if doubt else len(text) + 1
            for m in self.found.finditer(text, self.pos):
                if m.start() >= limit or last is not None and m.end() >= last:
                    break
                self.pos = m.end()
                yield m.span()
            else:
                m = None
            if m and limit == m.start() < m.end() < last and (own := self.first.match(text, limit, partial=True)) and own.span("_whole")[0] == m.end():
                self.pos = m.end()
                yield m.span()
                continue
            if last is not None:
                self.pos = max(self.pos, min(limit, last, m.start() if m else last))
            return

    def matched(self, at_end: bool) -> list[int]:
        text = "\n".join(self.parts)
        ends = list(accumulate(len(p) + 1 for p in self.parts))
        out = []
        for start, end in self._settled(text, None if at_end else ends[-2] if len(ends) > 1 else 0):
            first, last = bisect_right(ends, start), bisect_right(ends, max(start, end - 1))
            out += self.lines[max(first, self.told) : last + 1]
            self.told = max(self.told, last + 1)
        gone = 0 if self.looks_back else max(0, bisect_right(ends, self.pos) - 1)  # the line before stays, for what is asked at borders
        if gone:
            shift = ends[gone - 1]
            self.lines, self.parts = self.lines[gone:], self.parts[gone:]
            self.pos, self.told, self.size = self.pos - shift, max(0, self.told - gone), self.size - shift
        self.due = max(WINDOW, 2 * self.size)
        return out


def multiline_matches(lines: DataFrame, pattern: str, ignore_case: bool = True) -> DataFrame:
    """session_id and sequence of each line that a match touches, line ends included (GRP2).

    The text that is searched is the whole session. Its lines come as a sorted stream, and only those are held that a match may
    still reach back to: a few for patterns that end soon, all from its beginning on for one that goes on to the session's end.
    Patterns that look behind hold the session. Matches are those of one search through the whole text.
    """
    flags = regex.MULTILINE | regex.DOTALL | (regex.IGNORECASE if ignore_case else 0)
    schema = StructType([StructField(c, lines.schema[c].dataType) for c in ("session_id", "sequence")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, session, kinds = _Unsettled(pattern, flags), None, None
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["session_id", "sequence"])
        for batch in batches:
            kinds, out = [batch.schema.field(i).type for i in (0, 1)], []
            for id_, sequence, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if id_ != session:
                    if held.lines:
                        out += [(session, n) for n in held.matched(True)]
                    session = id_
                    held.begin()
                out += [(session, n) for n in held.add(sequence, f"{sequence}\t{text}")]
            if out:
                yield batch_of(out)
        if held.lines and (rest := held.matched(True)):
            yield batch_of([(session, n) for n in rest])

    return in_order(lines.select("session_id", "sequence", "text"), ["session_id"], "sequence").mapInArrow(run, schema)


def with_context(lines: DataFrame, is_match: Column, before: int, after: int) -> DataFrame:
    """Matching lines with ``before`` lines in front and ``after`` behind; overlaps are one (GRP3)."""
    near = Window.partitionBy("session_id").orderBy("sequence").rowsBetween(-after, before)
    return lines.withColumn("is_match", is_match).withColumn("_near", F.bool_or("is_match").over(near)).where("_near").drop("_near")


def counts(lines: DataFrame, is_match: Column, offset: int = 0) -> DataFrame:
    """Matching lines of each session that has any; with an offset of one or more the count is 0 (GRP4)."""
    n = F.count("*") if offset < 1 else F.lit(0).cast("long")
    return lines.where(is_match).groupBy("session_id").agg(n.alias("matches"))


def files_with_matches(lines: DataFrame, is_match: Column) -> DataFrame:
    """Sessions with a matching line (GRP4)."""
    return lines.where(is_match).select("session_id").distinct()


def page(lines: DataFrame, offset: int, limit: int) -> DataFrame:
    """By session, lines after the offset, ``limit`` of them (0: all), and whether more follow (SRT6)."""
    by = Window.partitionBy("session_id").orderBy("sequence")
    numbered = lines.withColumn("_n", F.row_number().over(by)).withColumn("truncated", (F.max("_n").over(Window.partitionBy("session_id")) > offset + limit) if limit else F.lit(False))
    kept = F.col("_n") > offset
    return numbered.where(kept & (F.col("_n") <= offset + limit) if limit else kept).drop("_n")


def read(lines: DataFrame, from_sequence: int, limit: int = READ_LIMIT, chars: int = READ_CHARS) -> DataFrame:
    """By session, up to ``limit`` lines from a sequence on; nothing but a flag where they have too many characters (SRT7)."""
    if not 0 < limit <= READ_LIMIT:
        raise ValueError("limit out of range")
    by = Window.partitionBy("session_id").orderBy("sequence")
    first = lines.where(F.col("sequence") >= from_sequence).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= limit)
    sums = first.withColumn("_chars", F.sum(F.length("text")).over(Window.partitionBy("session_id")))
    return sums.select("session_id", "sequence", F.when(F.col("_chars") <= chars, F.col("text")).alias("text"), (F.col("_chars") > chars).alias("too_long"))


def within_budget(lines: DataFrame, chars: int) -> DataFrame:
    """By session, whole lines up to the first that goes over the budget, a line end counted for each (SRT8)."""
    so_far = Window.partitionBy("session_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_used", F.sum(F.length("text").cast("long") + 1).over(so_far)).where(F.col("_used") <= chars).drop("_used")


def resolve_markers(starts: DataFrame, contents: DataFrame, depth: int = 5, separator: str = "\n---\n") -> DataFrame:
    """The original content behind each start: what its markers lead to, depth first in the order of markers (GRP6).

    starts: start and hash; contents: hash, content and refs (the markers it names). A content with markers gives way to what
    these lead to, ``depth`` steps from the start at most and each hash once; only where they lead to nothing it stands itself. A
    start that reaches a hash without content has none: content is null. What a start can reach is found by one join a step;
    then each start's rows, which its result is made of, are read together.
    """
    shared_folder(starts.sparkSession)
    front = starts.select("start", "hash").distinct().checkpoint()
    seen, links = front, contents.select("hash", F.explode("refs").alias("ref"))
    for _ in range(depth):
        reached = front.join(links, "hash").select("start", F.col("ref").alias("hash")).distinct()
        front = reached.join(seen, ["start", "hash"], "left_anti").checkpoint()
        seen = seen.unionByName(front)
    first = starts.select("start", "hash", F.lit(True).alias("first"))
    rows = seen.join(first, ["start", "hash"], "left").join(contents.select("hash", "content", "refs"), "hash", "left").select("start", "first", "hash", "content", "refs")
    schema = StructType([StructField("start", starts.schema["start"].dataType), StructField("content", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def resolved(begin, held: dict) -> str | None:
            done, missing = set(), False

            def text(name, left: int) -> str:
                nonlocal missing
                if left < 0 or name in done:
                    return ""
                done.add(name)
                content, refs = held.get(name, (None, None))
                if content is None:
                    missing = True
                    return ""
                parts = [x for x in (text(r, left - 1) for r in dict.fromkeys(refs or [])) if x]
                return separator.join(parts) if parts else content

            out = text(begin, depth)
            return None if missing else out

        start, begin, held, names = None, None, {}, ["start", "content"]
        for batch in batches:
            out = []
            for key, first_, name, content, refs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and key != start:
                    out.append((start, resolved(begin, held)))
                    held = {}
                start = key
                begin = name if first_ else begin
                held[name] = content, refs
            kind = batch.schema.field(0).type
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], kind), pa.array([x for _, x in out], pa.string())], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([start], kind), pa.array([resolved(begin, held)], pa.string())], names=names)

    return in_order(rows, ["start"], "first").mapInArrow(run, schema)
