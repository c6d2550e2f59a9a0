"""Each registered query against its SQL in DuckDB."""

import datetime
import decimal
import json
import re
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest

from recollect.operators import scheduling
from recollect.plans import tables
from recollect.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_gives_the_same(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(map(plain, r)) for r in rel.select(*cols).fetchall()), key=repr)
    assert len(got) > 0
    assert got == want


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_multiline_matches_against_python(spark):
    want = set()
    by_session = defaultdict(list)
    for r in tables.journal(spark, SF).orderBy("session_id", "sequence").collect():
        text = json.dumps({"sequence": r.sequence, "role": r.role, "content": r.content}, ensure_ascii=False, separators=(",", ":"))
        by_session[r.session_id].append((r.sequence, f"{r.sequence}\t{text}\n"))
    for session, lines in by_session.items():
        whole = "".join(t for _, t in lines)
        for m in re.finditer(r"tion\W+\S+\"\}\n\d+\t", whole, re.I | re.M | re.S):
            at = 0
            for sequence, t in lines:
                if at < m.end() and m.start() < at + len(t):
                    want.add((session, sequence))
                at += len(t)
    assert set(map(tuple, rows(spark, "grep_multiline"))) == want and want


def test_chunks_against_packing_line_by_line(spark):
    want = []
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        sep = "\n" if "\n" in d.text else " "
        held, at, spans = None, 0, []
        for part in d.text.split(sep):
            a, b = at, at + len(part)
            at = b + 1
            if not part and sep == " ":
                continue
            if held and b - held[0] <= 800:
                held[1] = b
            else:
                held = [a, b]
                spans.append(held)
        want += [(d.doc_id, a, b, sha256(d.text[a:b].encode()).hexdigest()) for a, b in spans if b > a]
    assert sorted(map(tuple, rows(spark, "text_chunks"))) == sorted(want)


def test_stream_of_batches_against_the_batch_operator(spark):
    """All batches but the open one of each scope, with the events of the batch operator."""
    whole = scheduling.batched(tables.events(spark, SF), 4_000, 12).collect()
    last = {}
    for r in whole:
        last[r.scope_id] = max(last.get(r.scope_id, 0), r.batch_no)
    want = sorted((r.scope_id, r.event_id, r.batch_no) for r in whole if r.batch_no < last[r.scope_id])
    assert sorted((r.scope_id, r.event_id, r.batch_no) for r in rows(spark, "stream_batches")) == want


def test_every_query_has_sql_or_a_test_here():
    assert set(QUERIES) - set(ORACLE_SQL) == {"grep_multiline", "text_chunks", "stream_batches", "persona_merges", "stream_due_batches", "stream_job_queue", "alias_resolution"}  # the last three: test_timers, test_folds
