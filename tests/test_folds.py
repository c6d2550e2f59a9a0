"""Operators whose result hangs on the order of rows, against plain folds over the same rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from recollect.functions import values as V
from recollect.operators import governance as G
from recollect.operators import graph as K
from recollect.operators import persona
from recollect.operators import provenance as O
from recollect.operators import state as U
from recollect.operators import transcript as X
from recollect.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.01"
REQUEST = "pos long, approval_id string, decision_id string, approver string, role string, action string"


def plain_requests(rows, status, allowed):
    approvals, exceptions, status, out = {}, {}, dict(status), []
    for pos, name, decision, approver, role, action in sorted(rows):
        record, held = (decision, approver, role, action), exceptions if action == "exception" else approvals
        if (approver, role) not in allowed:
            out.append((pos, "not authorized", None))
        elif name in held:
            out.append((pos, "replay" if held[name] == record else "id conflict", None))
        elif decision not in status:
            out.append((pos, "unknown decision", None))
        elif status[decision] != "PENDING_APPROVAL":
            out.append((pos, "not pending", None))
        else:
            held[name] = record
            final = None
            if action != "exception":
                status[decision] = final = "APPROVED" if action == "approve" else "REJECTED"
            out.append((pos, "accepted", final))
    return out


def submitted(spark, rows, status, allowed):
    got = G.submitted(spark.createDataFrame(rows, REQUEST), spark.createDataFrame(sorted(status.items()), "decision_id string, status string"), spark.createDataFrame(allowed, "approver string, role string"))
    return [(r.pos, r.outcome, r.final_status) for r in got.orderBy("pos").collect()]


def test_a_refused_request_uses_up_neither_its_id_nor_its_decision(spark):
    rows = [(1, "X", "D1", "b", "l", "approve"), (2, "X", "D2", "b", "l", "approve"), (3, "Y", "D2", "b", "l", "reject"), (4, "E", "D3", "b", "l", "exception"), (5, "E", "D3", "b", "l", "exception"), (6, "E", "D3", "b", "l", "approve"), (7, "F", "D3", "b", "l", "exception"), (8, "Z", "D9", "b", "l", "approve")]
    got = submitted(spark, rows, {"D1": "PENDING_APPROVAL", "D2": "PENDING_APPROVAL", "D3": "PENDING_APPROVAL"}, [("b", "l")])
    assert [o for _, o, _ in got] == ["accepted", "id conflict", "accepted", "accepted", "replay", "accepted", "not pending", "unknown decision"]
    assert [f for *_, f in got] == ["APPROVED", None, "REJECTED", None, None, "APPROVED", None, None]


def test_requests_against_a_plain_fold(spark):
    rng = random.Random(6)
    rows = [(i, f"a{rng.randrange(400)}", f"d{rng.randrange(300)}", rng.choice(["boss", "boss", "guest"]), "lead", rng.choice(["approve", "reject", "exception"])) for i in range(3000)]
    status = {f"d{i}": rng.choice(["PENDING_APPROVAL", "PENDING_APPROVAL", "EVALUATED"]) for i in range(280)}
    shuffled = rng.sample(rows, len(rows))
    want = plain_requests(rows, status, {("boss", "lead")})
    assert submitted(spark, shuffled, status, [("boss", "lead")]) == want
    assert {o for _, o, _ in want} == {"accepted", "replay", "id conflict", "not pending", "not authorized", "unknown decision"}


def plain_entities(rows):
    """rows: (id, pos, canonical name, canonical aliases in order, type)."""
    index, resolved, out = {}, {}, {}
    for entity, _, name, aliases, kind in sorted(rows, key=lambda r: r[1]):
        names = [name, *aliases]
        key = next((index[kind, n] for n in names if (kind, n) in index), (kind, name))
        resolved.setdefault(key, entity)
        out[entity] = resolved[key]
        index.update({(kind, n): key for n in names})
    return out


def test_aliases_against_a_single_pass(spark):
    rng = random.Random(8)
    rows = []
    for i in range(10_000):
        name = f"Name-{rng.randrange(9000)}"
        rows.append((f"e{i}", i, name, [f"NAME {rng.randrange(9000)}" for _ in range(rng.choice([0, 0, 1, 2]))], rng.choice(["Org", "ORG", "Person"]), rng.random()))
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "entity_id string, pos long, name string, aliases array<string>, entity_type string, confidence double")
    plain = [(e, p, n.lower().replace("-", ""), sorted({a.lower().replace(" ", "") for a in al}), t.lower()) for e, p, n, al, t, _ in rows]
    want = plain_entities(plain)
    got = K.resolved_by_alias(df).collect()
    assert {r.entity_id: r.resolved_id for r in got} == want and len(got) == len(rows)
    most = {}
    for e, *_, c in rows:
        most[want[e]] = max(c, most.get(want[e], 0))
    assert all(r.confidence == most[r.resolved_id] for r in got)
    assert len(set(want.values())) < 0.9 * len(rows)


def test_query_of_aliases_against_a_single_pass(spark):
    rows = [(f"c{i}", i, f"customer{i * 7 % 400}", [f"customer{(i * 7 + 1) % 400}"], t.lower()) for i, t in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_mktsegment").collect()]
    assert {r.entity_id: r.resolved_id for r in QUERIES["alias_resolution"](spark, SF).collect()} == plain_entities(rows)


def test_components_of_long_paths_and_stars(spark):
    path = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1001, 1100).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    got = {r.node: r.root for r in K.components(path.unionAll(star).unionAll(star)).collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, **{i: 1000 for i in range(1000, 1100)}}
    assert K.components(path.where(F.lit(False))).count() == 0


def plain_recall(start, contents, depth=5):
    seen = set()

    def go(name, d):
        if d > depth or name in seen:
            return ""
        seen.add(name)
        content, refs = contents[name]
        parts = [p for p in (go(r, d + 1) for r in refs) if p]
        return "\n---\n".join(parts) if parts else content

    try:
        return go(start, 0)
    except KeyError:
        return None


@pytest.mark.parametrize("missing", [False, True])
def test_markers_against_plain_recursion(spark, missing):
    rng = random.Random(3)
    contents = {f"h{i}": (f"text {i}" if rng.random() < 0.95 else "", [f"h{x}" for x in rng.sample(range(60 if i < 40 else 30, 90), rng.choice([0, 0, 1, 2, 3]))]) for i in range(90)}
    contents |= {f"c{i}": (f"chain {i}", [f"c{i + 1}"] if i < 9 else []) for i in range(10)}
    if missing:
        del contents["h70"]
    starts = [(i, h) for i, h in enumerate(contents)]
    df = spark.createDataFrame([(h, c, r) for h, (c, r) in contents.items()], "hash string, content string, refs array<string>")
    got = {r.start: r.content for r in X.resolve_markers(spark.createDataFrame(starts, "start long, hash string"), df).collect()}
    assert got == {i: plain_recall(h, contents) for i, h in starts}
    assert got[dict((h, i) for i, h in starts)["c0"]] == "chain 5"  # six levels
    one = spark.createDataFrame([(1, "m")], "start long, hash string")
    two = spark.createDataFrame([("m", "see a1 and a2", ["a1", "a2"]), ("a1", "one", []), ("a2", "two", None)], "hash string, content string, refs array<string>")
    assert X.resolve_markers(one, two).first().content == "one\n---\ntwo"


def test_jobs_against_a_plain_fold(spark):
    rng = random.Random(5)
    jobs = [(rng.randrange(20), j, rng.randrange(6), f := rng.randrange(1, 40), f + rng.randrange(9)) for j in range(2000)]
    envelopes = [(s, rng.randrange(2), rng.randrange(12)) for s in range(18)]
    state, want = {s: (v, t) for s, v, t in envelopes}, {}
    for s, j, expected, begins, ends in sorted(jobs, key=lambda x: x[1]):
        if s not in state:
            want[j] = "missing", None, None
        elif expected == state[s][0]:
            state[s] = expected + 1, max(ends, state[s][1])
            want[j] = "acked", *state[s]
        else:
            want[j] = "rebase" if begins == state[s][1] + 1 else "stale", None, None
    got = U.applied_jobs(spark.createDataFrame(envelopes, "session_id long, version long, through long"), spark.createDataFrame(jobs, "session_id long, job_id long, expected_version long, from_sequence long, through long"))
    assert {r.job_id: (r.outcome, r.new_version, r.new_through) for r in got.collect()} == want
    assert {w[0] for w in want.values()} == {"acked", "rebase", "stale", "missing"} and sum(w[0] == "acked" for w in want.values()) > 40


def test_lineage_beyond_its_depth_is_an_error(spark):
    rows = [("k", i, f"e{i}", f"x{i}", [f"x{i - 1}"] if i else []) for i in range(8)]
    entries = spark.createDataFrame(rows, "chain_id string, sequence_id int, entry_id string, entity_id string, derived_from array<string>")
    start = spark.createDataFrame([("k", "x7")], "chain_id string, start string")
    assert O.lineage(entries, start).count() == 8
    with pytest.raises(RuntimeError, match="beyond 3 steps"):
        O.lineage(entries, start, depth=3)


def test_numbers_and_escapes(spark):
    texts = ["１２３", "about 1,234.5万 or 7", "-3亿", "none", None, "...", "１．５"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(V.number(F.col("t"))).collect()]
    assert got == [123.0, 12_345_000.0, -3e8, None, None, None, 1.5]
    row = spark.createDataFrame([("<a href='x'>\"&\"</a>",)], "t string")
    assert row.select(O.html_rows(row)).first()[0] == "<tr><td>&lt;a href=&#x27;x&#x27;&gt;&quot;&amp;&quot;&lt;/a&gt;</td></tr>"


def test_persona_merges_trust_no_declared_duplicate_and_take_the_new_domain():
    memory = persona.Memory({"a": ("general", "Likes tea")})
    ask = lambda i, domain, content, kind="", target=None: memory.take({"candidate_id": i, "domain": domain, "content": content, "merge_type": kind, "target_memory_id": target, "new_information": None})
    assert ask("c1", "travel", "Prefers window seats", "duplicate")["operation"] == "add"
    assert ask("c2", "travel", " prefers  WINDOW seats", "duplicate")["operation"] == "none"
    assert ask("c3", "travel", "Likes tea with milk", target="a")["merge_type"] == "extension" and memory.items["a"] == ("travel", "Likes tea with milk")
    assert ask("c4", "travel", "Never drinks tea", "conflict", "a")["operation"] == "error" and "Never drinks tea" in memory.items["a"][1]
    with pytest.raises(ValueError, match="unknown"):
        ask("c5", "travel", "x", "perhaps")


def test_persona_merges_do_not_go_through_all_statements(monkeypatch):
    """Work for each candidate does not grow with the memory, and near statements are those that a pass over all finds."""
    calls, words = [0], persona.tokens
    monkeypatch.setattr(persona, "tokens", lambda text: (calls.__setitem__(0, calls[0] + 1), words(text))[1])
    memory = persona.Memory()
    for i in range(300):
        text, kind = f"likes word{i % 97} word{i % 89} word{i % 7}", ("new" if i % 3 == 0 else "")
        mine, best, near = words(text), (1, 0.08), None
        for k, (_, s) in memory.items.items():
            theirs = words(s)
            both = len(mine & theirs)
            if (rank := (both, both / max(1, min(len(mine), len(theirs))))) > best and both > 1:
                best, near = rank, k
        got = memory.take({"candidate_id": f"c{i}", "domain": "general", "content": text, "merge_type": kind, "target_memory_id": None, "new_information": None})
        assert got["target"] == (None if kind else near) and memory.items[near or f"c{i}" if not kind else f"c{i}"][1] == got["statement"]
    assert calls[0] <= 2 * 300


def test_rows_of_persona_merges_grow_with_the_candidates(spark, tmp_path):
    """A statement into which all is merged is not repeated in the row of each candidate."""
    docs = [(40 * i, f"likes green tea with word{i} in the morning\nand thing{i}") for i in range(400)]  # one user's
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["persona_merges"](spark, str(tmp_path)).collect()
    assert len(got) == 399
    assert sum(len(x) for r in got for x in r if isinstance(x, str)) < 10 * sum(len(t) for _, t in docs)


def test_steps_of_persona_merges_give_each_statement_that_was(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"word{rng.randrange(30)}" for _ in range(rng.randrange(7)))
    stored = [(f"u{u}", f"m{u}-{i}", i, "general", text()) for u in range(3) for i in range(3)]
    rows = [(f"u{i % 3}", 10 + i, f"c{i}", rng.choice([text(), " ".join(text() for _ in range(5))]), rng.choice([None] * 6 + ["new", "update", "conflict", "perhaps"]), rng.choice([None] * 8 + [f"m{i % 3}-0", "nowhere"]), rng.choice([None, None, [text()]]), rng.choice(["general", "general", "travel"])) for i in range(300)]
    rows += [("u0", 400 + i, f"c{400 + i}", "said three times", "new" if i == 0 else None, None, None, "general") for i in range(3)]
    candidates = spark.createDataFrame(rows, "user_id string, pos long, candidate_id string, content string, merge_type string, target_memory_id string, new_information array<string>, domain string")
    memory = spark.createDataFrame(stored, "user_id string, memory_id string, pos long, domain string, statement string")
    want = {r.candidate_id: r.asDict() for r in persona.canonicalised(candidates, memory).collect()}
    got = {r.candidate_id: r.asDict() for r in persona.steps(candidates, memory).collect()}
    now, last = {(u, i): (0, s) for u, i, _, _, s in stored}, {}
    for _, _, name, *_ in sorted(rows, key=lambda r: r[1]):
        step, whole = got[name], want[name]["statement"]
        assert all(step[k] == v for k, v in want[name].items() if k != "statement")
        if whole is None:
            assert all(step[k] is None for k in ("statement", "added", "stays", "version", "n_chars", "statement_sha256"))
            continue
        own = step["user_id"], step["target_memory_id"] or name
        version, before = now.get(own, (-1, ""))
        assert (before if step["stays"] else "") + step["added"] == whole
        assert step["version"] == version + (step["operation"] != "none")
        assert (step["n_chars"], step["statement_sha256"]) == (len(whole), hashlib.sha256(whole.encode()).hexdigest())
        now[own], last[own] = (step["version"], whole), name
    assert {n: g["statement"] for n, g in got.items() if g["statement"] is not None} == {n: want[n]["statement"] for n in last.values()}
    assert len(got) == len(rows) and {"none", "add", "replace", "error"} == {g["operation"] for g in got.values()}


def test_parts_of_long_statements_are_found_by_their_words(monkeypatch):
    monkeypatch.setattr(persona, "LONG", 0)
    monkeypatch.setattr(persona, "PLACES", 3)
    rng, found = random.Random(4), 0
    for _ in range(300):
        names = rng.choice([["ab", "abc", "bc", "c"], [f"w{i}" for i in range(40)]])
        text = lambda least, most: " ".join(rng.choice(names) for _ in range(rng.randint(least, most)))
        mine = persona._Plain(text(0, 9), {})
        for _ in range(4):
            mine.add(text(0, 9))
            whole = str(mine)
            i = rng.randrange(len(whole) + 1)
            for part in (persona.plain(whole[i : i + rng.randrange(20)]), text(1, 6), whole, whole + " c", ""):
                assert mine.holds(part) == (part in whole)
                found += len(part.split()) > 2 and part in whole
    assert found > 500


def test_rows_of_a_key_are_dealt_for_the_fold_itself(spark):
    """A shuffle that only the join before asks for is read in other parts once the join becomes a broadcast one, or has large parts."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        jobs = spark.range(2_000).selectExpr("id % 50 as session_id", "id as job_id", "floor(id / 50) + 1 as expected_version", "id as from_sequence", "id as through")
        got = U.applied_jobs(jobs.select("session_id").distinct().selectExpr("session_id", "1L as version", "0L as through"), jobs)
        assert "REPARTITION_BY_COL" in got._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in got.groupBy("outcome").count().collect()] == [("acked", 2_000)]  # each job waits for the one before it
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
