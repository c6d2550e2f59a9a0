"""What must not grow faster than the input: how often edges are read, texts are parsed, and texts are Python strings."""

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from recollect.functions import arrow
from recollect.operators import extraction as E
from recollect.operators import graph as K


def test_causal_steps_end_with_the_last_front_and_do_not_shuffle_edges_again(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", "CAUSED"), ("b", "c", "CAUSED"), ("b", "c", "CAUSED"), ("x", "c", "OTHER")], "source string, target string, type string")
    cuts, cut = [], K._cut

    def counted(df):
        cuts.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(K, "_cut", counted)
    got = sorted(map(tuple, K.upstream(edges, spark.createDataFrame([("c",)], "id string"), 50).collect()))
    assert got == [("c", "a", 2), ("c", "b", 1)]
    assert len(cuts) == 5  # edges, starts and three fronts, the last one empty
    assert sum("CAUSED" in plan for plan in cuts) == 1


def test_json_texts_are_parsed_once_by_each_kind_of_statement(spark):
    texts = [(1, '[{"entity_id": "e", "a": 1, "b": null}, 5, {"entity_id": 0, "c": 2}]'), (2, '{"entity_id": "f"} x\ntriple|s|p|2'), (3, "Entity|i|t|n"), (4, None), (5, "[]")]
    chunks = spark.createDataFrame(texts, "chunk_id long, content string").withColumn("source_id", F.lit("s"))
    got = E.stated(chunks)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 2
    rows = sorted((r.chunk_id, r.pos, r.nth, r.kind, r.id or r.subject, r.predicate, r.object or r.value) for r in got.collect())
    assert rows == [(1, 0, 0, "entity", "e", "LoanApplication", "Application e"), (1, 0, 1, "triple", "e", "a", "1"), (1, 0, 2, "triple", "e", "b", "null"), (2, 1, 0, "triple", "s", "p", "2"), (3, 0, 0, "entity", "i", "t", "n")]


def test_compatible_texts_by_few_at_a_time(spark):
    texts = ["\ufb01", None, "e\u0301", "plain", "\u1100\u1161\x00", "", "a\u0323\u0307 x\u00e9\u0301\u2460 \n\u65e5\U0001d400b\u0307", "\x00\u0301"] * arrow.STEP
    want = [s if s is None else unicodedata.normalize("NFKC", s) for s in texts]
    assert arrow.compatible_texts(pa.array(texts)).to_pylist() == want
    assert arrow.compatible_texts(pa.array([], pa.string())).to_pylist() == []
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    assert [r.t for r in rows.select("i", arrow.compatible(F.col("t")).alias("t")).orderBy("i").collect()] == want
    sent = rows.select(arrow.compatible(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" in sent  # only what is not ASCII goes through Python
