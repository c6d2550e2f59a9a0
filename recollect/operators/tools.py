"""Grep and Read as table functions of SQL, over lines (session_id, sequence, text) by session in order of sequence.

    SELECT * FROM grep(TABLE(lines) PARTITION BY session_id ORDER BY sequence, pattern => 'error', mode => 'content', before => 1)
    SELECT * FROM read_lines(TABLE(lines) PARTITION BY session_id ORDER BY sequence, from_sequence => 10)

Rows of a session pass one after the other; held are the lines in front of a match, or those of one answer, never a session.
A null text matches nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SkipRestOfInputTableException

from recollect.operators.transcript import READ_CHARS, READ_LIMIT

MODES = ("content", "files_with_matches", "count")
HEAD_LIMIT = 250


def _fields(lines: AnalyzeArgument, *names: str) -> list[T.StructField]:
    """The columns as the table has them."""
    if not lines.isTable:
        raise ValueError("the first argument is a table")
    missing = {*names} - {*lines.dataType.names}
    if missing:
        raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
    return [T.StructField(n, lines.dataType[n].dataType) for n in names]


def _number(name: str, argument: AnalyzeArgument | None, least: int = 0) -> None:
    if argument is not None and argument.value is not None and argument.value < least:
        raise ValueError(f"{name} is at least {least}")


class Grep:
    """Lines that match, with lines around them; sessions with a match; or their number (GRP1, GRP3, GRP4).

    The pattern is Python's and must be constant. By session, ``skip`` leaves out the first rows and ``head_limit`` ends the answer (0: no limit);
    an answer of mode count has one row, with 0 where it is skipped.
    """

    @staticmethod
    def analyze(lines: AnalyzeArgument, pattern: AnalyzeArgument, mode: AnalyzeArgument | None = None, before: AnalyzeArgument | None = None, after: AnalyzeArgument | None = None, ignore_case: AnalyzeArgument | None = None, head_limit: AnalyzeArgument | None = None, skip: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not pattern.value:
            raise ValueError("a pattern is needed")
        re.compile(pattern.value)
        for name, argument in (("before", before), ("after", after), ("head_limit", head_limit), ("skip", skip)):
            _number(name, argument)
        kind = mode.value if mode else "files_with_matches"
        if kind not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        session, sequence, text = _fields(lines, "session_id", "sequence", "text")
        more = {"content": [sequence, text, T.StructField("is_match", T.BooleanType())], "count": [T.StructField("matches", T.LongType())]}
        return AnalyzeResult(T.StructType([session, *more.get(kind, [])]))

    def __init__(self) -> None:
        self.session, self.matches, self.rows, self.left = None, 0, 0, 0
        self.front: deque | None = None
        self.pattern = None
        self.mode, self.skip = MODES[1], 0

    def eval(self, lines: Row, pattern: str, mode: str = MODES[1], before: int = 0, after: int = 0, ignore_case: bool = True, head_limit: int = HEAD_LIMIT, skip: int = 0) -> Iterator[tuple]:
        if self.pattern is None:
            self.pattern, self.front = re.compile(pattern, re.IGNORECASE if ignore_case else 0), deque(maxlen=before)
            self.session, self.mode, self.skip = lines["session_id"], mode, skip
        found = lines["text"] is not None and self.pattern.search(lines["text"]) is not None
        self.matches += found
        if mode == "files_with_matches":
            if found:
                if skip < 1:
                    yield (self.session,)
                raise SkipRestOfInputTableException("one match is enough")
            return
        if mode == "count":
            return
        line = (self.session, lines["sequence"], lines["text"])
        out = []
        if found:
            out, self.left = [(*x, False) for x in self.front] + [(*line, True)], after
            self.front.clear()
        elif self.left:
            out, self.left = [(*line, False)], self.left - 1
        else:
            self.front.append(line)
        for x in out:
            self.rows += 1
            if head_limit and self.rows > skip + head_limit:
                raise SkipRestOfInputTableException("the answer is full")
            if self.rows > skip:
                yield x

    def terminate(self) -> Iterator[tuple]:
        if self.mode == "count" and self.matches:
            yield self.session, 0 if self.skip else self.matches


class ReadLines:
    """Lines from a sequence on, up to ``max_lines``; with too many characters a flag only (SRT7)."""

    @staticmethod
    def analyze(lines: AnalyzeArgument, from_sequence: AnalyzeArgument | None = None, max_lines: AnalyzeArgument | None = None, chars: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, argument in (("max_lines", max_lines), ("chars", chars)):
            _number(name, argument, 1)
        if max_lines is not None and max_lines.value > READ_LIMIT:
            raise ValueError(f"max_lines is at most {READ_LIMIT}")
        return AnalyzeResult(T.StructType([*_fields(lines, "session_id", "sequence", "text"), T.StructField("too_long", T.BooleanType())]))

    def __init__(self) -> None:
        self.held: list[tuple] = []
        self.used = self.most = 0

    def eval(self, lines: Row, from_sequence: int = 1, max_lines: int = READ_LIMIT, chars: int = READ_CHARS) -> Iterator[tuple]:
        self.most = chars
        if lines["sequence"] < from_sequence:
            return
        self.used += len(lines["text"] or "")
        self.held.append((lines["session_id"], lines["sequence"], lines["text"] if self.used <= chars else None))
        if len(self.held) == max_lines:
            raise SkipRestOfInputTableException("the answer is full")
        yield from ()

    def terminate(self) -> Iterator[tuple]:
        long = self.used > self.most
        for session, sequence, text in self.held:
            yield session, sequence, None if long else text, long


def register(spark: SparkSession) -> None:
    """Makes ``grep`` and ``read_lines`` known to the session's SQL."""
    spark.udtf.register("grep", udtf(Grep))
    spark.udtf.register("read_lines", udtf(ReadLines))
