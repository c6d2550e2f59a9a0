"""Small cases that the tables do not hold."""

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import governance as G
from recollect.operators import journal as J
from recollect.operators import retrieval as R
from recollect.operators import scheduling as S
from recollect.operators import transcript as X
from recollect.plans import audit, streams
from recollect.sources import readers

AS_OF = datetime(2025, 1, 1, tzinfo=timezone.utc)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize("text,risky", [("please SKIP the final approval", True), ("never skip the approval", False), ("My  password", True), ("用户的密码", True), ("a normal text", False), ("don't need any confirmation", True)])
def test_high_risk(spark, text, risky):
    assert one(spark, G.high_risk(F.col("t")), t=text) is risky


def test_text_functions(spark):
    assert one(spark, T.token_set(F.col("t")), t="Cats cats 汉字 A1") == ["cats", "汉", "字", "a1"]
    assert one(spark, T.semantic_set(F.col("t")), t="cats cat gas") == ["cat", "gas"]
    assert one(spark, T.inferred_domain(F.col("t")), t="bank code") == "finance"
    assert one(spark, T.inferred_domain(F.col("t")), t="nothing") is None
    assert one(spark, T.slug(F.col("t")), t=" A  b!C ") == "a-b-c"
    assert [tuple(one(spark, T.coerced(F.col("t")), t=x)) for x in ("True", "12", "1.5", "x")] == [("bool", "true"), ("int", "12"), ("float", "1.5"), ("str", "x")]


def test_recent_turns_rules(spark):
    roles = ["system", "assistant", "user", "system", "user", "tool", "assistant", "user", "assistant"]
    events = spark.createDataFrame([(1, i + 1, r, "x") for i, r in enumerate(roles)], "session_id long, sequence long, role string, content string")
    kept = lambda n: [r.sequence for r in J.recent_turns(events, n).orderBy("sequence").collect()]
    assert kept(1) == [1, 8, 9] and kept(2) == [1, 3, 4, 5, 6, 7, 8, 9]


def records(spark):
    rows = [("a", "user_persona", "alpha beta gamma", "t", "a", "u", 0.5, None, AS_OF, None), ("b", "user_persona", "alpha betas gamma", "t", "a", None, 0.9, None, AS_OF, None), ("c", "skill_candidate", "alpha delta", "t", "a", "u", 0.5, None, AS_OF, "k"), ("d", "skill_candidate", "alpha epsilon", "t", "a", "u", 0.5, None, None, "k"), ("x", "user_persona", "alpha", "t2", "a", "u", 0.5, None, AS_OF, None)]
    return spark.createDataFrame(rows, "memory_id string, kind string, content string, tenant_id string, agent_id string, user_id string, confidence double, domain string, updated_at timestamp, conflict_key string")


def test_retrieval_context(spark):
    q = R.Query("alpha beta", "t", "a", "u", AS_OF)
    ranked = R.ranked(records(spark), q)
    assert [r.memory_id for r in ranked.orderBy("rank").collect()] == ["a", "b", "c", "d"]
    out = R.context(records(spark), q).first()
    assert out.memory_ids == "a,c" and out.markdown.startswith("[user_persona:a]\nalpha beta gamma\n\n[skill_candidate:c]")
    cut = R.context(records(spark), q, 5).first()
    assert cut.memory_ids == "a" and cut.markdown == "[user_persona:a]\nalpha beta\n" and cut.estimated_tokens == 5


def test_batches_take_a_large_first_event(spark):
    rows = [(1, AS_OF, i, n) for i, n in enumerate([500, 10, 20, 90, 5])]
    e = spark.createDataFrame(rows, "scope_id long, completed_at timestamp, event_id long, tokens long")
    assert {r.event_id: r.batch_no for r in S.batched(e, 100, 3).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2}


def test_batches_hold_no_list_of_a_scope(spark):
    e = spark.range(60_000).select(F.expr("id % 3 div 2").alias("scope_id"), F.lit(AS_OF).cast("timestamp").alias("completed_at"), F.col("id").alias("event_id"), (F.col("id") % 7).alias("tokens"))
    out = S.batched(e, 20, 5)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    want, state = {}, {}
    for i in range(60_000):
        no, used, n = state.get(i % 3 // 2, (0, 0, 0))
        no, used, n = (no + 1, i % 7, 1) if n and (used + i % 7 > 20 or n >= 5) else (no, used + i % 7, n + 1)
        state[i % 3 // 2] = (no, used, n)
        want[i] = no
    assert {r.event_id: r.batch_no for r in out.collect()} == want


def test_multiline_match_touches_lines(spark):
    lines = spark.createDataFrame([(1, 1, "abc"), (1, 2, "dbe"), (1, 3, "f")], "session_id long, sequence long, text string")
    assert sorted(r.sequence for r in X.multiline_matches(lines, "c\n2\td").collect()) == [1, 2]
    assert sorted(r.sequence for r in X.multiline_matches(lines, "c\n").collect()) == [1]


def test_streams_give_the_batch_rows(spark):
    sf = "/root/testdata/sf0.01"
    batch = {r.event_id: r.batch_no for r in audit.review_batches(spark, sf).collect()}
    got = {r.event_id: r.batch_no for r in streams.stream_batches(spark, sf).collect()}
    assert got and all(batch[i] == n for i, n in got.items())


def test_journal_lines(spark, tmp_path):
    good = json.dumps({"type": "message", "role": "user", "sequence": 1, "timestamp": "2024-01-01T00:00:00Z"})
    (tmp_path / "2024-01-01-s.jsonl").write_text(f"{good}\n\n{{broken}}\n{good.replace('message', 'other')}\n{good[:20]}")
    rows = readers.journal_lines(spark, str(tmp_path))
    assert [r.error for r in rows.orderBy("pos").collect()] == [None, "blank", "bad", "unknown type"]
    verdict = readers.expired_files(rows, F.lit(AS_OF).cast("timestamp"), 30).first()
    assert verdict.verdict == "delete"


def test_journals_are_read_in_byte_ranges(spark, tmp_path):
    """Files cut into some twenty ranges: places, blank and bad lines, and a torn last line as if read whole."""
    rng, want = random.Random(1), {}
    for f, end in enumerate(["\n", "", "torn", "\n\n"]):
        lines = []
        for i in range(120):
            good = json.dumps({"type": rng.choice(["message", "file", "compaction_checkpoint"]), "content": "x" * rng.randrange(60) + "é", "sequence": i}, ensure_ascii=False)
            lines.append(rng.choice([good] * 8 + ["", "{bad", good.replace('"type": "', '"type": "un')]))
        lines.append('{"type": "message", "sequence": 120}')
        (tmp_path / f"j{f}.jsonl").write_text("\n".join(lines) + (f"\n{lines[-1][:9]}" if end == "torn" else end), encoding="utf-8")
        errors = [None if '": "un' not in x and x not in ("", "{bad") else "blank" if not x else "bad" if x == "{bad" else "unknown type" for x in lines]
        want[f"j{f}.jsonl"] = errors + (["blank"] if end == "\n\n" else [])
    conf = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = readers.journal_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 60
        rows = df.select("file", "pos", "record.sequence", "error").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {n: sorted(((r.pos, r.error, r.sequence) for r in rows if r.file.endswith(n)), key=lambda x: x[0]) for n in want}
    assert {n: [e for _, e, _ in x] for n, x in got.items()} == want
    assert all([p for p, *_ in x] == list(range(len(x))) and all(s == p for p, e, s in x if e is None) for x in got.values())


def test_chunks_cover_the_text(spark):
    text = "ab\ncdef\n\ng" + "x" * 30 + "\nz"
    got = readers.chunks(spark.createDataFrame([("s", text)], "source_id string, text string"), 8).orderBy("start").collect()
    assert [r.chunk for r in got] == ["ab\ncdef\n", "g" + "x" * 30, "z"] and all(text[r.start : r.end] == r.chunk for r in got)
    card = spark.createDataFrame([("---\nname: x y\nkind: z\n---\nbody",)], "c string")
    assert card.select(readers.front_matter(F.col("c"))).first()[0] == {"name": "x y", "kind": "z"}
