"""Messages of blocks: the tables hold none, so each rule has a small case."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from recollect.operators import blocks as B

SCHEMA = "session_id long, pos long, role string, message_id string, group_id string, ts timestamp, blocks array<struct<type:string,id:string,tool_use_id:string,name:string,text:string,content:string>>"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def use(i, name="read"):
    return ("tool_use", i, None, name, None, None)


def result(i, content="x" * 40):
    return ("tool_result", None, i, None, None, content)


def text(t):
    return ("text", None, None, None, t, None)


def messages(spark, rows):
    return spark.createDataFrame([(1, p, role, m, g, T0, b) for p, (role, m, g, b) in enumerate(rows)], SCHEMA)


def test_orphans_go_and_emptied_messages(spark):
    m = messages(spark, [("user", None, None, None), ("assistant", "a", None, [use("1")]), ("user", None, None, [result("1"), result("9")]), ("user", None, None, [result("8")])])
    got = {r.pos: r.blocks for r in B.without_orphans(m).collect()}
    assert sorted(got) == [0, 1, 2] and got[0] is None and [b.tool_use_id for b in got[2]] == ["1"]


def test_old_results_are_cleared(spark):
    m = messages(spark, [("assistant", "a", None, [use("1"), use("2", "write")]), ("user", None, None, [result("1"), result("2")]), ("assistant", "b", None, [use("3")]), ("user", None, None, [result("3")])])
    got = {b.tool_use_id: b.content for r in B.cleared_results(m, ("read",), 0).collect() for b in r.blocks if b.type == "tool_result"}
    assert got == {"1": B.CLEARED, "2": "x" * 40, "3": "x" * 40}


def test_tokens(spark):
    m = messages(spark, [("user", None, None, [text("a" * 10), ("image", None, None, None, None, None)]), ("system", None, None, [text("b" * 99)]), ("user", None, None, None)])
    assert B.tokens(m).first().tokens == -(-(3 + 2_000) * 4 // 3)


def test_cuts_move_left(spark):
    m = messages(spark, [("user", None, None, [text("q")]), ("assistant", "a", "g", [text("t")]), ("assistant", "a", "g", [use("1")]), ("user", None, None, [text("x")]), ("user", None, None, [result("1")]), ("user", None, None, [text("y")])])
    cuts = spark.createDataFrame([(1, 4)], "session_id long, cut long")
    assert B.closed_cuts(m, cuts).first().cut == 1
    assert B.closed_cuts(m, cuts.withColumn("cut", F.lit(5))).first().cut == 5


def test_rounds_idle_and_mutations(spark):
    rounds = spark.createDataFrame([(1, i, 10) for i in range(6)], "session_id long, round_no long, tokens long")
    left = lambda gap: sorted(r.round_no for r in B.dropped_rounds(rounds, gap).collect())
    assert left(F.lit(15)) == [2, 3, 4, 5] and left(F.lit(999)) == [5] and left(F.lit(None).cast("long")) == [1, 2, 3, 4, 5]
    m = messages(spark, [("assistant", "a", None, [text("t")])])
    now = lambda n: F.timestamp_micros(F.lit(int(T0.timestamp() * 10**6) + n * 60_000_000))
    assert B.idle(m, now(30), 30).count() == 1 and B.idle(m, now(29), 30).count() == 0
    rows = [(1, 1, "add", "a", "x", None), (1, 2, "add", "b", "x", None), (1, 3, "replace", "a", "y", "z"), (1, 4, "replace", "a", "x", "w"), (1, 5, "add", "c", "q", None), (1, 6, "remove", "c", "q", None)]
    a = spark.createDataFrame(rows, "scope_id long, pos long, action string, memory_id string, text string, new_text string")
    assert [tuple(r) for r in B.mutated(a).collect()] == [(1, "a", "w")]
