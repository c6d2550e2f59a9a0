"""Operators whose work must not grow with the length of a session or an ancestry, against plain versions."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from recollect.operators import blocks as B
from recollect.operators import provenance as O
from recollect.operators import transcript as X
from tests.test_blocks import SCHEMA, T0, result, use

ENTRIES = "chain_id string, sequence_id int, entry_id string, entity_id string, derived_from array<string>"
STARTS = "chain_id string, start string"


def in_depth(parents, start):
    """Entries in the order in which a search in depth meets them first."""
    seen, todo = [], [start]
    known = set()
    while todo:
        e = todo.pop()
        if e not in known:
            known.add(e)
            seen.append(e)
            todo += reversed(parents[e])
    return seen


@pytest.mark.parametrize("seed,many", [(1, 0.5), (2, 0.15), (3, 0.9)])
def test_lineage_is_a_search_in_depth(spark, seed, many):
    rng = random.Random(seed)
    parents = {}
    for i in range(60):
        n = rng.choice([2, 3]) if rng.random() < many else rng.choice([0, 1, 1, 1, 1])
        parents[f"e{i}"] = [f"e{rng.randrange(max(0, i - 9), i)}" for _ in range(n)] if i else []
    rows = [("k", i, e, f"x{e}", [p if rng.random() < 0.5 else f"x{p}" for p in ps] + ["nowhere"]) for i, (e, ps) in enumerate(parents.items())]
    rows += [("l", i, e, f"x{e}", []) for i, e in enumerate(parents)]
    starts = [("k", f"xe{i}") for i in (59, 58, 40, 0)] + [("k", "e57"), ("l", "e3")]
    got = O.lineage(spark.createDataFrame(rows, ENTRIES), spark.createDataFrame(starts, STARTS)).collect()
    for chain, start in starts:
        mine = [r.entry_id for r in sorted(got, key=lambda r: r.place) if (r.chain_id, r.start) == (chain, start)]
        assert mine == (in_depth(parents, start.lstrip("x")) if chain == "k" else [start])


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """10,000 entries in a row, with a ring that nothing leads to; rounds are counted by what is checkpointed."""
    n = 10_000
    rows = [("k", i, f"e{i}", f"x{i}", [f"e{i - 1}"] if i else []) for i in range(n)] + [("k", n + 1, "r1", "r", ["r2"]), ("k", n + 2, "r2", "q", ["r1"])]
    rounds = []
    kind = type(spark.range(1))
    plain = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, eager=True: rounds.append(1) or plain(self, eager))
    got = O.lineage(spark.createDataFrame(rows, ENTRIES), spark.createDataFrame([("k", f"e{n - 1}"), ("k", "e3")], STARTS))
    assert [r.entry_id for r in got.where(F.col("start") == f"e{n - 1}").orderBy("place").collect()] == [f"e{i}" for i in range(n - 1, -1, -1)]
    assert [r.entry_id for r in got.where("start = 'e3'").orderBy("place").collect()] == ["e3", "e2", "e1", "e0"]
    assert len(rounds) <= 30


def touched(lines, pattern, ignore_case=True):
    flags = regex.MULTILINE | regex.DOTALL | (regex.IGNORECASE if ignore_case else 0)
    out = set()
    for session in {s for s, _, _ in lines}:
        mine = sorted((n, t) for s, n, t in lines if s == session)
        parts = [f"{n}\t{t}" for n, t in mine]
        at = [i for i, p in enumerate(parts) for _ in range(len(p) + 1)]
        for m in regex.finditer(pattern, "\n".join(parts), flags):
            out |= {(session, mine[i][0]) for i in {at[k] for k in range(m.start(), max(m.end(), m.start() + 1)) if k < len(at)}}
    return out


PATTERNS = ["end\n\\d+\tbegin", "begin.*?end", "begin.*end", "(a|b)x\\1", "^7\\d\t[^\n]*$", "a(?=[^\n]*\n\\d+\tb)", "(?<=end\n)\\d+\tbegin", "b\\b\n", "x*", "zz\\Z", "\\A1\t", "begin(?!.*end)", "b+\n\\d+\tb+"]


@pytest.mark.parametrize("window", [40, 400])
def test_search_over_lines_is_that_of_the_whole_session(spark, monkeypatch, window):
    rng = random.Random(window)
    words = ["begin", "end", "a", "b", "axa", "bxa", "zz", "some", "other"]
    lines = [(s, n, " ".join(rng.choice(words) for _ in range(rng.randrange(4)))) for s in range(3) for n in range(1, 120)]
    wrong = []
    for pattern in PATTERNS:
        held, got = None, set()
        monkeypatch.setattr(X, "WINDOW", window)
        held = X._Unsettled(pattern, regex.MULTILINE | regex.DOTALL | regex.IGNORECASE)
        for s in range(3):
            held.begin()
            for session, n, t in lines:
                if session == s:
                    got |= {(s, k) for k in held.add(n, f"{n}\t{t}")}
            got |= {(s, k) for k in held.matched(True)}
        if got != touched(lines, pattern):
            wrong.append(pattern)
    assert not wrong


def test_a_session_of_a_million_lines_is_not_held(monkeypatch):
    held = X._Unsettled("end\n\\d+\tbegin", regex.MULTILINE | regex.DOTALL)
    found, most = 0, 0
    for n in range(1, 1_000_001):
        found += len(held.add(n, f"{n}\t" + ("begin of text" if n % 1000 == 1 else "text to its end" if n % 1000 == 0 else "some other words here")))
        most = max(most, held.size)
    found += len(held.matched(True))
    assert found == 2 * 999 and most <= 2 * X.WINDOW


def test_calls_and_results_of_long_sessions(spark):
    rng = random.Random(5)
    rows = []
    for s in range(4):
        for p in range(60):
            picked = [rng.choice([use(str(rng.randrange(40)), rng.choice(["read", "write"])), result(str(rng.randrange(60)))]) for _ in range(rng.randrange(4))]
            rows.append((s, p, "user", None, None, T0, picked if picked or p % 2 else None))
    m = spark.createDataFrame(rows, SCHEMA)
    calls = {s: [b[1] for r in rows if r[0] == s for b in r[6] or [] if b[0] == "tool_use"] for s in range(4)}
    want = {}
    for s, p, *_, blocks in rows:
        left = blocks and [b for b in blocks if b[0] != "tool_result" or b[2] in calls[s]]
        if not blocks or left:
            want[s, p] = left
    assert {(r.session_id, r.pos): r.blocks and [tuple(b) for b in r.blocks] for r in B.without_orphans(m).collect()} == want
    for keep in (0, 1, 7, 1000):
        old = {s: [b[1] for r in rows if r[0] == s for b in r[6] or [] if b[0] == "tool_use" and b[3] == "read"][: -max(1, keep)] for s in range(4)}
        got = {(r.session_id, r.pos): r.blocks and [b.content for b in r.blocks] for r in B.cleared_results(m, ("read",), keep).collect()}
        assert got == {(s, p): blocks and [B.CLEARED if b[0] == "tool_result" and b[2] in old[s] else b[5] for b in blocks] for s, p, *_, blocks in rows}


def test_sources_by_parts_of_names(spark):
    rules = [("a", "policy_handbook.pdf#3"), ("b", "hr"), ("c", "x#1"), ("d", ""), ("e", None), ("f", "#9"), ("g", "policy_hand")]
    docs = ["2024/policy_handbook.pdf", "hr/x", "policy_handbook.doc", "h", "", None, "xx"]
    want = {(r, d) for r, ref in rules if ref for d in docs if d is not None and ref.split("#")[0] in d}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = O.policy_sources(frame(rules, "rule_id string, source_ref string"), frame([(d,) for d in docs], "source_id string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert O.policy_sources(frame([], "rule_id string, source_ref string"), frame([("x",)], "source_id string")).count() == 0


def test_rules_explain_themselves(spark):
    from recollect.operators import audit as A

    rule = lambda r, n, *c: (r, "3", 1, "stop", "doc#1", n, *c)
    schema = "rule_id string, version string, priority int, conclusion string, source_ref string, nth int, field string, op string, wanted string"
    rules = [rule("b", 0, "n", "gte", "2"), rule("b", 1, "n", "lt", "10"), rule("a", 0, "n", "eq", "9.0"), rule("c", 0, "missing", "eq", "1"), rule("d", 0, "name", "gt", "3")]
    facts = spark.createDataFrame([(1, "n", "9"), (1, "name", "x")], "subject long, field string, value string")
    got = A.explained_rules(spark.createDataFrame(rules, schema), facts).orderBy("place").collect()
    assert [(r.rule_id, r.steps, r.source_ref) for r in got] == [("a", ["n == 9.0 matched actual value 9"], "doc#1"), ("b", ["n >= 2 matched actual value 9", "n < 10 matched actual value 9"], "doc#1")]
    with pytest.raises(Exception, match="unsupported operator: like"):
        A.explained_rules(spark.createDataFrame([rule("e", 0, "n", "like", "9")], schema), facts).collect()


def test_participants_and_objects_take_resolved_names(spark):
    from recollect.operators import graph as K

    names = spark.createDataFrame([("a", "z"), ("b", "z")], "entity_id string, resolved_id string")
    events = spark.createDataFrame([(1, ["b", "c", "a", "b"]), (2, []), (3, None)], "event_id long, participants array<string>")
    assert {r.event_id: r.participants for r in K.rewritten_participants(events, names).collect()} == {1: ["z", "c", "z", "z"], 2: [], 3: None}
    triplets = spark.createDataFrame([("a", "p", "b", "str"), ("b", "p", "a", "int"), (None, "p", None, "str")], "subject string, predicate string, object string, value_type string")
    assert sorted(map(str, (tuple(r) for r in K.rewritten_triplets(triplets, names).collect()))) == sorted(map(str, [("z", "p", "z", "str"), ("z", "p", "a", "int"), (None, "p", None, "str")]))


def test_facts_are_dealt_by_subject_not_by_the_few_fields(spark):
    from recollect.plans.catalogue import QUERIES

    for name in ("rule_evaluation", "explained_rules"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(field" not in plan and plan.count("Exchange hashpartitioning(subject") == 1, plan
