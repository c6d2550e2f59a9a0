"""Table functions against the operators on DataFrames, and what they refuse."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from recollect.operators import tools
from recollect.operators import transcript as X
from recollect.plans import tables

SF = "/root/testdata/sf0.001"
BY = "PARTITION BY session_id ORDER BY sequence"


@pytest.fixture(scope="module")
def lines(spark):
    tools.register(spark)
    rows = X.rendered(tables.journal(spark, SF))
    rows.createOrReplaceTempView("tool_lines")
    return rows


def got(spark, call, *columns):
    return sorted(map(tuple, spark.sql(f"SELECT * FROM {call}").select(*columns).collect()))


def test_grep_is_the_operator(spark, lines):
    match = X.matching(lines, "ANDTH")
    for before, after in ((0, 0), (1, 2), (3, 0), (0, 5)):
        want = X.with_context(lines, match, before, after).select("session_id", "sequence", "text", "is_match").collect()
        assert want
        assert got(spark, f"grep(TABLE(tool_lines) {BY}, pattern => 'andth', mode => 'content', before => {before}, after => {after}, head_limit => 0)", "session_id", "sequence", "text", "is_match") == sorted(map(tuple, want))
    assert got(spark, f"grep(TABLE(tool_lines) {BY}, pattern => 'andth', mode => 'count')", "session_id", "matches") == sorted(map(tuple, X.counts(lines, match).collect()))
    assert got(spark, f"grep(TABLE(tool_lines) {BY}, pattern => 'andth', mode => 'count', skip => 1)", "session_id", "matches") == sorted(map(tuple, X.counts(lines, match, 1).collect()))
    assert got(spark, f"grep(TABLE(tool_lines) {BY}, pattern => 'andth')", "session_id") == sorted(map(tuple, X.files_with_matches(lines, match).collect()))
    assert got(spark, f"grep(TABLE(tool_lines) {BY}, pattern => 'ANDTH\"', ignore_case => false)", "session_id") == []


def test_pages_of_matches(spark, lines):
    by_session = {}
    for r in sorted(lines.where(X.matching(lines, "user")).collect(), key=lambda r: (r.session_id, r.sequence)):
        by_session.setdefault(r.session_id, []).append(r.sequence)
    want = sorted((s, n) for s, ns in by_session.items() for n in ns[1:3])
    assert got(spark, f"grep(TABLE(tool_lines) {BY}, pattern => 'user', mode => 'content', skip => 1, head_limit => 2)", "session_id", "sequence") == want


def test_read_is_the_operator(spark, lines):
    for start, limit, chars in ((1, 2000, 20_000), (2, 5, 400), (3, 1, 10)):
        want = X.read(lines, start, limit, chars).collect()
        assert got(spark, f"read_lines(TABLE(tool_lines) {BY}, from_sequence => {start}, max_lines => {limit}, chars => {chars})", "session_id", "sequence", F.coalesce("text", F.lit("")), "too_long") == sorted((r.session_id, r.sequence, r.text or "", r.too_long) for r in want)


def test_nulls_extra_columns_and_empty_tables(spark, lines):
    spark.createDataFrame([("a", 1, None, 9), ("a", 2, "x", 9), (None, 1, "x", 9)], "session_id string, sequence long, text string, matches int").createOrReplaceTempView("tool_odd")
    assert set(map(tuple, spark.sql(f"SELECT * FROM grep(TABLE(tool_odd) {BY}, pattern => 'x', mode => 'content', before => 1)").collect())) == {("a", 1, None, False), ("a", 2, "x", True), (None, 1, "x", True)}
    assert spark.sql(f"SELECT * FROM grep(TABLE(SELECT * FROM tool_odd WHERE sequence > 5) {BY}, pattern => 'x', mode => 'count')").collect() == []


@pytest.mark.parametrize("call", ["pattern => ''", "pattern => 'x', mode => 'all'", "pattern => '('", "pattern => 'x', before => -1"])
def test_refusals(spark, lines, call):
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM grep(TABLE(tool_lines) {BY}, {call})")
