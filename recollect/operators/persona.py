"""Persona statements: which statement a candidate belongs to, and what becomes of both.

Candidates of a user are folded in order, as each depends on what those before have made of the memory. A user's candidates
come to one task as a sorted stream behind the user's stored statements; what the task keeps is one user's statements, with an
index of their tokens, so that a candidate is not compared with every statement.

A statement grows with all that is merged into it. ``steps`` says what each candidate adds, and each statement once, so that its rows grow
with the candidates; ``canonicalised`` has the whole statement in every row, which grows with the square of a user's candidates.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import values as V
from recollect.operators.dealing import in_order

# Words in common, and their share of the shorter statement, from which two statements are about one thing;
# the heading over what is added.
LEAST_OVERLAP, LEAST_SHARE = 2, 0.08
ADDED = "Additional durable requirements:\n"
MERGES = ("", "new", "duplicate", "update", "merge", "conflict")
#: Characters of statements that are handed on at once: a statement can be as long as all that was merged into it.
HELD = 1 << 23
#: Characters from which the places of a plain form's words are kept; places that are looked at one by one (where a word has more, the text is searched).
LONG, PLACES = 4096, 64


def plain(text: str) -> str:
    return " ".join(text.split()).casefold()


def tokens(text: str) -> set[str]:
    """As ``values.merge_tokens``."""
    low = text.casefold()
    words = {w for w in re.findall("[a-z0-9]+", low) if len(w) > 1 and w not in V.STOP_WORDS}
    return words | {run[i : i + 2] for run in re.findall("[一-鿿]+", low) for i in range(max(1, len(run) - 1))}


class _Statement:
    """A text that is added to: its parts, characters and SHA-256, and how many texts it has had. No part is copied when one is added."""

    def __init__(self, text: str, version: int) -> None:
        self.parts, self.n, self.sha, self.version = [text], len(text), hashlib.sha256(text.encode()), version

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.n += len(text)
        self.sha.update(text.encode())
        self.version += 1

    def __str__(self) -> str:
        self.parts = ["".join(self.parts)]
        return self.parts[0]


class _Plain:
    """The plain form of a statement by its words, which are taken from ``known`` (as many statements have the same), and the places of each."""

    def __init__(self, text: str, known: dict[str, str]) -> None:
        self.words: list[str] = []
        self.known, self.at, self.placed = known, {}, 0
        self.n, self.sha = 0, hashlib.sha256()
        self.add(text)

    def add(self, text: str) -> None:
        if more := plain(text):
            between = " " if self.words else ""
            self.n += len(between) + len(more)
            self.sha.update((between + more).encode())
            self.words.extend(self.known.setdefault(w, w) for w in more.split(" "))

    def __str__(self) -> str:
        return " ".join(self.words)

    def holds(self, text: str) -> bool:
        """Whether a plain text is a part of this one. In long ones at the places of its rarest word between the first and last, as these are whole words here."""
        if len(text) > self.n:
            return False
        if self.n < LONG:
            return text in str(self)
        for i in range(self.placed, len(self.words)):
            self.at.setdefault(self.words[i], array("i")).append(i)
        self.placed = len(self.words)
        words = text.split(" ")
        places = [self.at.get(w, ()) for w in words[1:-1]]
        if not all(places):
            return False
        if not places or len(least := min(places, key=len)) > PLACES:
            return text in str(self)
        before = 1 + next(i for i, x in enumerate(places) if x is least)
        for start in (i - before for i in least):
            mine = self.words[max(start, 0) : start + len(words)]
            if len(mine) == len(words) and mine[1:-1] == words[1:-1] and mine[0].endswith(words[0]) and mine[-1].startswith(words[-1]):
                return True
        return False


class _Domain:
    """Statements of a domain by their tokens. A slot is a statement's, with its place among all and its number of tokens (0: it is elsewhere now)."""

    def __init__(self) -> None:
        self.slots: dict[str, array] = {}
        self.ids: list[str] = []
        self.place, self.size = array("q"), array("q")

    def nearest(self, mine: set[str]) -> tuple[str | None, int, float]:
        """The statement with most tokens in common, then the greatest share of the shorter one, then the first; how many, and the share."""
        held = [np.frombuffer(self.slots[t], np.int32) for t in mine if t in self.slots]
        if not held:
            return None, 0, 0.0
        size = np.array(self.size)
        both = np.bincount(np.concatenate(held), minlength=len(size)) * (size > 0)
        best = np.flatnonzero(both == both.max())
        if not both[best[0]]:
            return None, 0, 0.0
        share = both[best] / np.minimum(len(mine), size[best])
        first = best[share == share.max()]
        return self.ids[first[np.argmin(np.array(self.place)[first])]], int(both[first[0]]), float(share.max())


class Memory:
    """One user's statements: id to (domain, statement), in order; ``put`` takes them in.

    Plain forms and tokens stand beside them. What is added to a statement is added to these, as statements grow with all that is merged
    into them.
    """

    def __init__(self, items: dict[str, tuple[str, str]] | None = None) -> None:
        self._domain: dict[str, str] = {}
        self._text: dict[str, _Statement] = {}
        self._known: dict[str, str] = {}
        self._plain: dict[str, _Plain] = {}
        self._words: dict[str, dict[str, None]] = {}
        self._place: dict[str, int] = {}
        #: By the digest of the plain form.
        self._equal: dict[bytes, list[tuple[int, str]]] = {}
        self._domains: dict[str, _Domain] = {}
        #: Of each statement and domain it has been in: its slot, and how many of its words are known there.
        self._slots: dict[str, dict[str, tuple[int, int]]] = {}
        for i, (domain, statement) in (items or {}).items():
            self.put(i, domain, statement)

    @property
    def items(self) -> dict[str, tuple[str, str]]:
        return {i: (self._domain[i], str(text)) for i, text in self._text.items()}

    def text(self, own: str) -> _Statement:
        return self._text[own]

    def put(self, own: str, domain: str, statement: str = "", added: str | None = None) -> None:
        """A statement, new or with another text; ``added``: the lines that its text has more than the one before, if it stays in front."""
        there = own in self._text
        place, slots = self._place.setdefault(own, len(self._place)), self._slots.setdefault(own, {})
        if there:
            was, before = self._domain[own], self._plain[own].sha.digest()
            self._domains[was].size[slots[was][0]] = 0
            same = self._equal[before]
            del same[bisect_left(same, (place, own))]
            if not same:
                del self._equal[before]
        if added is None:
            slots.clear()  # its tokens may be others
            self._text[own] = _Statement(statement, self._text[own].version + 1 if there else 0)
            self._plain[own], self._words[own] = _Plain(statement, self._known), dict.fromkeys(tokens(statement))
        else:
            self._text[own].add(added)
            self._plain[own].add(added)
            self._words[own].update(dict.fromkeys(tokens(added)))
        self._domain[own] = domain
        insort(self._equal.setdefault(self._plain[own].sha.digest(), []), (place, own))
        of, words = self._domains.setdefault(domain, _Domain()), self._words[own]
        slot, known = slots.get(domain, (len(of.ids), 0))
        if domain not in slots:
            of.ids.append(own)
            of.place.append(place)
            of.size.append(0)
        for t in islice(reversed(words), len(words) - known):
            of.slots.setdefault(t, array("i")).append(slot)
        slots[domain], of.size[slot] = (slot, len(words)), len(words)

    def target(self, wanted: str, own_id: str, domain: str, content: str) -> str | None:
        """The statement meant: the one named, the candidate's own, an equal one, or the one with most in common in the domain (SRT3)."""
        if wanted and wanted not in self._text:
            raise ValueError("the target is no statement of the memory")
        equal = next((i for _, i in self._equal.get(hashlib.sha256(plain(content).encode()).digest(), ())), None)
        found = wanted or (own_id if own_id in self._text else equal)
        if found:
            other = self._domain[found]
            if other != domain and "general" not in (other, domain):
                raise ValueError("the target belongs to another domain")
            return found
        of = self._domains.get(domain)
        near, both, share = of.nearest(tokens(content)) if of else (None, 0, 0.0)
        return near if both >= LEAST_OVERLAP and share >= LEAST_SHARE else None

    def take(self, c: dict) -> dict:
        """The outcome of a candidate, which changes the memory (GOV4) and says what is to be written (GOV5)."""
        got = self.step(c)
        return {k: got[k] for k in ("merge_type", "target", "operation")} | {"statement": str(self._text[got["own"]])}

    def step(self, c: dict) -> dict:
        """As ``take``, with what is added to which statement (own) in place of the whole, and whether the text before stays in front of it."""
        said = {"extension": "update"}.get(c["merge_type"] or "", c["merge_type"] or "")
        if said not in MERGES:
            raise ValueError("the kind of merge is unknown")
        content, own = c["content"].strip(), c["candidate_id"]
        target = None if said == "new" else self.target(c["target_memory_id"] or "", own, c["domain"], content)
        parts = [p for p in dict.fromkeys(c["new_information"] or ()) if plain(p) and plain(p) not in plain(content)]
        if said in ("update", "merge") and target is None:
            raise ValueError("there is no statement to change")
        # a declared duplicate is not trusted: it is one if the memory has the statement
        same = plain(content)
        was = None if target is None else self._plain[target]
        kind = said if said not in ("", "duplicate") else ("new" if was is None else "duplicate" if was.n == len(same) and str(was) == same and not parts else "extension")
        if kind == "duplicate":
            return {"merge_type": kind, "target": target, "operation": "none", "own": target, "added": "", "stays": True}
        listed = "\n" + ADDED + "\n".join(f"- {p}" for p in parts) if parts else ""
        stays = was is not None and not (was.n <= len(same) and str(was) in same)
        if stays:
            added = listed if was.holds(same) else f"\n{content}{listed}"
            self.put(target, c["domain"], added=added)
        else:
            added = content + listed
            self.put(own if target is None else target, c["domain"], added)
        operation = "error" if kind == "conflict" else "add" if target is None else "replace"
        return {"merge_type": kind, "target": target, "operation": operation, "own": own if target is None else target, "added": added, "stays": stays}


_IN = ("user_id", "stored", "candidate_id", "domain", "content", "merge_type", "target_memory_id", "new_information")
OUTCOMES = "user_id string, candidate_id string, domain string, merge_type string, target_memory_id string, statement string, operation string, error string"
STEPS = OUTCOMES + ", added string, stays boolean, version int, n_chars long, statement_sha256 string"


def canonicalised(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Of each candidate its kind of merge, the statement it becomes, and what is to be done (GOV4, GOV5).

    candidates: user_id, pos, candidate_id (unique, and not that of a stored statement unless it is meant), content,
    merge_type, target_memory_id, new_information and domain (null: from the text); stored: user_id, memory_id, pos, domain and
    statement. A statement that a candidate changes takes the candidate's domain. A declared conflict is an error row that
    changes the memory all the same; what may not be merged is an error row and changes nothing.
    """
    return _folded(candidates, stored, OUTCOMES, _outcomes)


def steps(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """``canonicalised`` in rows that together are as long as what comes in: only the last row that speaks of a statement has it whole.

    Each row says what its candidate adds: ``added`` comes behind the text before if that ``stays``, and in its place if not. Any text that a
    statement has had is the parts added, by version, from the last that took the place of what was before (of a stored statement: from its
    text, which is version 0). n_chars and statement_sha256 are of the whole text. Rows of operation none add nothing and have the version that they found.
    """
    return _folded(candidates, stored, STEPS, _steps)


def _folded(candidates: DataFrame, stored: DataFrame, schema: str, outcomes: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]) -> DataFrame:
    no = lambda kind="string": F.lit(None).cast(kind)
    mine = stored.select("user_id", F.lit(True).alias("stored"), "pos", F.col("memory_id").alias("candidate_id"), "domain", F.col("statement").alias("content"), no().alias("merge_type"), no().alias("target_memory_id"), no("array<string>").alias("new_information"))
    domain = V.persona_domain(F.concat_ws(" ", "content", F.array_join(F.coalesce("new_information", F.array().cast("array<string>")), " ")), F.col("domain"))
    asked = candidates.select("user_id", F.lit(False).alias("stored"), "pos", "candidate_id", domain.alias("domain"), F.coalesce("content", F.lit("")).alias("content"), F.lower(F.trim("merge_type")).alias("merge_type"), "target_memory_id", "new_information")
    # by number, as a small table of many candidates is much work: tasks are not to be put together
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = in_order(mine.unionByName(asked), ["user_id"], F.desc("stored"), "pos", tasks=tasks).select(*_IN)

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}.get(x.split()[1], pa.string()) for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in chain(outcomes(batches), (None,)):
            if row:
                out.append(row)
                size += sum(len(x) for x in row if isinstance(x, str))
            if out and (not row or len(out) >= 4096 or size >= HELD):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=names)
                out, size = [], 0

    return stream.mapInArrow(run, schema)


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Memory, dict, dict | None, str | None]]:
    """Of each candidate the user's memory, the candidate, the step that it makes, or the error."""
    user, memory = None, Memory()
    for c in (c for batch in batches for c in batch.to_pylist()):
        if user is None or c["user_id"] != user[0]:
            user, memory = (c["user_id"],), Memory()
        if c["stored"]:
            memory.put(c["candidate_id"], c["domain"], c["content"])
            continue
        try:
            if not c["content"].strip():
                raise ValueError("the statement is empty")
            yield memory, c, memory.step(c), None
        except ValueError as e:
            yield memory, c, None, str(e)


def _row(c: dict, got: dict | None, statement: str | None, error: str | None) -> tuple:
    got = got or {"merge_type": c["merge_type"], "target": None, "operation": "error"}
    return c["user_id"], c["candidate_id"], c["domain"], got["merge_type"], got["target"], statement, got["operation"], error


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for memory, c, got, error in _taken(batches):
        yield _row(c, got, got and str(memory.text(got["own"])), error)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    of, last = Memory(), {}  # the latest row of each of a user's statements, which is the last if the user ends

    def ended() -> Iterator[tuple]:
        for own, (row, more) in last.items():
            yield (*row[:5], str(of.text(own)), *row[6:], *more)

    for memory, c, got, error in _taken(batches):
        if memory is not of:
            yield from ended()
            of, last = memory, {}
        row = _row(c, got, None, error)
        if got is None:
            yield (*row, None, None, None, None, None)
            continue
        if got["own"] in last:
            before, more = last[got["own"]]
            yield (*before, *more)
        text = memory.text(got["own"])
        last[got["own"]] = row, (got["added"], got["stays"], text.version, text.n, text.sha.hexdigest())
    yield from ended()
