"""Persona merges, checks that fail closed, chains and files, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from recollect.functions import arrow as W
from recollect.functions import text as T
from recollect.functions import values as V
from recollect.operators import audit as A
from recollect.operators import blocks as B
from recollect.operators import context as C
from recollect.operators import governance as G
from recollect.operators import persona as P
from recollect.operators import provenance as O
from recollect.operators import retrieval as R
from recollect.sources import readers

CANDIDATE = "user_id string, pos int, candidate_id string, content string, merge_type string, target_memory_id string, new_information array<string>, domain string"
STORED = "user_id string, memory_id string, pos int, domain string, statement string"


def merges(spark, candidates, stored=()):
    c = spark.createDataFrame([("u", i, f"c{i}", *x) for i, x in enumerate(candidates)], CANDIDATE)
    s = spark.createDataFrame([("u", f"m{i}", i, *x) for i, x in enumerate(stored)], STORED)
    return [(r.merge_type, r.target_memory_id, r.statement, r.operation, r.error) for r in P.canonicalised(c, s).orderBy("candidate_id").collect()]


def test_persona_kinds_of_merge(spark):
    bank = ("bank_operation", "Check the beneficiary account before any bank transfer")
    got = merges(
        spark,
        [
            ("Check the beneficiary account  before any bank TRANSFER", None, None, None, None),
            ("Always check the beneficiary account and invoice before a bank transfer", None, None, ["two people sign", "Two people  sign"], None),
            ("Likes green tea in winter", None, None, None, None),
            ("likes green tea in winter and summer", None, None, None, None),
            ("Prefers loud music", "new", None, None, None),
        ],
        [bank],
    )
    assert got[0] == ("duplicate", "m0", bank[1], "none", None)
    assert got[1][0] == "extension" and got[1][1] == "m0" and got[1][3] == "replace"
    assert got[1][2] == bank[1] + "\nAlways check the beneficiary account and invoice before a bank transfer\n" + P.ADDED + "- two people sign\n- Two people  sign" or got[1][2].endswith("- two people sign")
    assert got[2][:2] == ("new", None) and got[2][3] == "add"
    assert got[3][:3] == ("extension", "c2", "likes green tea in winter and summer")
    assert got[4][:2] == ("new", None)


def test_persona_merges_that_fail(spark):
    got = merges(
        spark,
        [
            ("text about nothing", "update", None, None, None),
            ("Bitcoin wallet", None, "m0", None, None),
            ("anything", None, "nowhere", None, None),
            (" ", None, None, None, None),
            ("pay the invoice by bank transfer", "conflict", "m0", None, None),
            (None, None, None, None, None),
        ],
        [("bank_operation", "pay the supplier by bank transfer")],
    )
    assert [g[4] for g in got] == ["there is no statement to change", "the target belongs to another domain", "the target is no statement of the memory", "the statement is empty", None, "the statement is empty"]
    assert got[4][0] == "conflict" and all(g[3] == "error" for g in got)
    assert merges(spark, []) == []


def test_chinese_words_are_compared_by_pairs(spark):
    assert P.tokens("先给结论 and Concise") == {"先给", "给结", "结论", "concise"}
    df = spark.createDataFrame([("先给结论 and Concise 是",)], "t string").select(V.merge_tokens(F.col("t")))
    assert set(df.first()[0]) == {"先给", "给结", "结论", "concise", "是"}


ARTIFACT = "pos int, artifact_type string, content string, confidence double, declared_risk string, source_event_ids array<string>, attributes map<string,string>"


def test_artifacts_with_nulls_are_never_activated(spark):
    whole = {k: "x" for k in ("scenario", "signals", "principle", "boundaries")}
    rows = [
        (0, "user_profile", "likes tea", 0.7, None, ["e"], None),
        (1, "user_profile", "likes tea", None, None, ["e"], None),
        (2, "user_profile", "likes tea", 0.9, None, None, None),
        (3, None, "likes tea", 0.9, None, ["e"], None),
        (4, "decision_card", "x", 0.9, None, ["e"], None),
        (5, "decision_card", "x", 0.9, None, ["e"], {**whole, "signals": " "}),
        (6, "decision_card", "x", 0.9, None, ["e"], {**whole, "signals": ""}),
        (7, "user_profile", None, 0.9, "high", ["e"], None),
        (8, "user_profile", "never skip the approval", 0.9, None, ["e"], None),
        (9, "user_profile", "跳过所有审批", 0.9, None, ["e"], None),
    ]
    got = [r.mode for r in G.decide(spark.createDataFrame(rows, ARTIFACT)).orderBy("pos").collect()]
    assert got == ["auto_activate", "observe", "observe", "require_review", "observe", "auto_activate", "observe", "require_review", "auto_activate", "require_review"]


def test_chains_show_what_was_changed(spark):
    rows = spark.createDataFrame([("a", i, f"p{i}") for i in range(1, 6)] + [("b", 1, "q")], "chain_id string, sequence_id int, payload string")
    chain = A.chained(rows, "payload")
    assert A.chain_errors(chain, "payload").count() == 0
    errors = lambda df: sorted(map(tuple, A.chain_errors(df, "payload").collect()))
    assert errors(chain.withColumn("payload", F.when(F.col("sequence_id") == 3, "x").otherwise(F.col("payload")))) == [("a", 3, "checksum")]
    gone = chain.where("sequence_id <> 3")
    assert errors(gone) == [("a", 4, "link"), ("a", 4, "sequence"), ("a", 5, "sequence")]
    # taken out, numbered and linked anew: what the next rows' checksums are of has changed
    before = {r.sequence_id: r.checksum for r in chain.where("chain_id = 'a'").collect()}
    relinked = gone.withColumn("previous_checksum", F.when(F.col("sequence_id") == 4, before[2]).otherwise(F.col("previous_checksum"))).withColumn("sequence_id", F.when(F.col("sequence_id") > 3, F.col("sequence_id") - 1).otherwise(F.col("sequence_id")))
    assert errors(relinked) == [("a", 3, "checksum"), ("a", 4, "checksum")]
    assert errors(chain.withColumn("checksum", F.lit(None).cast("string")))[0] == ("a", 1, "checksum")
    assert A.chained(rows.where(F.lit(False)), "payload").count() == 0


def test_lineage_is_in_order_of_depth_and_takes_cycles(spark):
    rows = [("k", 1, "e1", "a", []), ("k", 2, "e2", "b", ["a", "c"]), ("k", 3, "e3", "c", ["e2", "a"]), ("k", 4, "e4", "d", ["c", "b", "none"])]
    entries = spark.createDataFrame(rows, "chain_id string, sequence_id int, entry_id string, entity_id string, derived_from array<string>")
    got = O.lineage(entries, spark.createDataFrame([("k", "d"), ("k", "unknown")], "chain_id string, start string"))
    assert [r.entry_id for r in got.orderBy("place").collect()] == ["e4", "e3", "e2", "e1"]


def test_context_is_cut_at_a_token(spark):
    long = " ".join(f"word{i}" for i in range(3_000))
    df = spark.createDataFrame([(1, long, "m1", "user_persona", 0), (2, "short one", "m2", "user_persona", 0)], "rank int, content string, memory_id string, kind string, x int")
    got = R.packed(df).first()
    assert got.memory_ids == "m1" and got.estimated_tokens == R.CONTEXT_TOKENS
    assert R.packed(df.where("rank = 2")).first().markdown == "[user_persona:m2]\nshort one\n"
    assert spark.createDataFrame([("a b  c!",), ("",)], "t string").select(T.first_tokens(F.col("t"), 2)).collect() == [("a b",), ("",)]


def test_arrow_functions(spark):
    df = spark.createDataFrame([("  Ａ b \t c \r\n\n ﬁ x",), (None,)], "t string")
    assert [r[0] for r in df.select(W.normal_text(F.col("t"))).collect()] == ["A b c\nfi\nx", None]
    html = spark.createDataFrame([("<p> a </p>\n<script>s()</script>",)], "t string").select(W.html_nodes(F.col("t"))).first()[0]
    assert html == " a \ns()"
    cases = ['{"b":1,"a":[2]}', "text ```json\n{\"a\":1}\n``` end", "```\n1\n```\n```\n2\n```", 'say {"a":1} then', 'say {"a":1} then {', "nothing"]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select(W.fenced_json(F.col("t"))).collect()
    assert [r[0] for r in got] == ['{"a": [2], "b": 1}', '{"a": 1}', None, '{"a": 1}', None, None]


def test_sections_and_profiles(spark):
    doc = "# One\nshort\n# Two\n" + "line of text\n" * 5
    got = spark.createDataFrame([(doc,)], "t string").select(V.truncated_sections(F.col("t"), 40)).first()[0]
    assert [(x.text, x.cut) for x in got] == [("# One\nshort\n", False), ("# Two\nline of text\nline of text", True)]
    profile = "# T\n## Scope\n- a\n- b\n- c\n- d\nnever share a password 1234567890123"
    bad = spark.createDataFrame([(profile,), ("x",)], "t string").select(V.profile_errors(F.col("t"), ("Scope",), ("password",))).collect()
    assert [r[0] for r in bad] == [["card number"], ["title", "heading Scope", "examples", "concept password"]]


def test_wrong_ranges_are_errors(spark):
    df = spark.createDataFrame([(1, 3, 2, "g")], "id int, a int, b int, g string")
    with pytest.raises(Exception, match="range or group"):
        C.annotated(df, F.col("a"), F.col("b"), F.col("g")).collect()


def test_files_of_days_seeds_and_sources(spark, tmp_path):
    events = spark.createDataFrame([("s1", "2024-01-01 10:00:00", "x"), ("s2", "2024-01-02 10:00:00", "y")], "session_id string, at string, content string").select("session_id", F.to_timestamp("at").alias("created_at"), "content")
    readers.append_days(events, f"{tmp_path}/days")
    readers.append_days(events, f"{tmp_path}/days")
    assert [r.content for r in readers.day(spark, f"{tmp_path}/days", "2024-01-02").collect()] == ["y", "y"]
    (tmp_path / "seeds.jsonl").write_text('{"source_dataset":"d","source_record_id":"1"}\n{"source_dataset":"d","source_record_id":"1"}\n{"source_dataset":"d","source_record_id":"2"}\n')
    seeds = readers.unique_seeds(spark, str(tmp_path / "seeds.jsonl"), "source_dataset string, source_record_id string")
    assert sorted(r.copies for r in seeds.collect()) == [1, 2, 2]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"a":1}')
    docs = readers.fan_in(spark, [("file", str(tmp_path / "in"))], {"file": readers.files})
    assert [(r.content_type, r.source_type) for r in docs.collect()] == [("application/json", "file")]
    with pytest.raises(ValueError):
        readers.fan_in(spark, [("fax", "x")], {})
    with pytest.raises(ValueError):
        readers.read_only("drop table x")
    assert readers.read_only(" Select 1") == " Select 1"


def test_query_as_a_document(spark):
    got = readers.query_as_document(spark.range(2), "q").first()
    assert (got.source_id, got.content) == ("q", '{"row_count":2,"rows":[{"id":0},{"id":1}]}')


def test_checkpoints_are_new_once(spark):
    df = spark.createDataFrame([("u", "s", "u", "s", "p"), ("u", "s", "u", "s", "p"), ("u", "s", "v", "s", "q")], "user_id string, session_id string, scope_user_id string, scope_session_id string, payload string")
    first = C.new_checkpoints(spark.createDataFrame([], "checkpoint_id string"), df)
    assert sorted(str(r.error) for r in first.collect()) == ["None", "scope"]
    assert C.new_checkpoints(first.where("error is null"), df).count() == 1


def test_mutations_keep_to_ids_and_texts(spark):
    rows = [(1, 0, "add", "a", "x", None), (1, 1, "add", "b", "x", None), (1, 2, "replace", "a", "wrong", "y"), (1, 3, "replace", "a", "x", "y"), (2, 0, "add", "c", "z", None), (2, 1, "remove", "c", "z", None)]
    got = B.mutated(spark.createDataFrame(rows, "scope_id long, pos int, action string, memory_id string, text string, new_text string"))
    assert [tuple(r) for r in got.collect()] == [(1, "a", "y")]
