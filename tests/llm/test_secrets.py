import math
import re
from hashlib import sha256

from pyspark.sql import functions as F

from recollect.llm import secrets as S
from recollect.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PLAIN = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, (p, ok)) in enumerate(PLAIN.items()) for m in p.finditer(text or "") if ok(m)]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def plain(text, table):
    """kind:start:end of all spans."""
    spans = [(a, list(PLAIN).index(k), b, k) for a, b, k in base(text)]
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text or ""):
        p = [S.LETTERS.index(c) for c in m[0]]
        ratio = math.fsum(table[a * len(S.LETTERS) + b] for a, b in zip(p, p[1:]))
        if ratio > S.LIMIT and not any(a < m.end() and m.start() < b for a, _, b, k in spans if k != "markov"):
            spans.append((m.start(), 3, m.end(), "markov"))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]


def check(docs, table, rows):
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in S.digests(S.scan(docs, table)).collect()), key=str)
    want = []
    for doc_id, text in rows:
        b = base(text)
        kinds = [k for *_, k in b]
        want.append((doc_id, *(kinds.count(k) for k in PLAIN), sha256(",".join(f"{k}:{a}:{z}" for a, z, k in b).encode()).hexdigest(), ",".join(plain(text, table))))
    assert got == sorted(want, key=str)
    return got


def test_query_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    table = S.train(docs)
    got = check(docs, table, rows)
    assert sum(g[1] for g in got) and sum(g[3] for g in got)
    assert sorted(tuple(r) for r in QUERIES["op2_secrets"](spark, SF).collect()) == sorted(got)


def test_models_tell_random_strings_from_identifiers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = S.train(docs)
    strings = [sha256(str(i).encode()).hexdigest()[:24].upper() for i in range(40)]
    words = ["internationalisation", "therntndouereding_onthe", "thtionandthereinghere", "antithereforeedandthe"]
    rows = [(i, f"see {w} here") for i, w in enumerate([*strings, *words])]
    got = {r[0]: r[-1] for r in check(spark.createDataFrame(rows, "doc_id long, text string"), table, rows)}
    assert sum("markov" in got[i] for i in range(40)) >= 36
    assert not any("markov" in got[40 + i] for i in range(len(words)))


def test_held_out_half_of_the_labelled_samples(spark):
    table = S.train(spark.read.parquet(f"{SF}/documents.parquet"))
    trains, held = S.halves(S.labelled())
    assert not {v for v, _ in trains if len(v) > 24} & {v for v, r in held if r}
    rows = [(i, f"of {v} and") for i, (v, _) in enumerate(held)]
    got = {r.doc_id for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string"), table).where("size(spans) > 0").collect()}
    base_ = {i for i, t in rows if base(t)}
    random_ = [i for i, (_, r) in enumerate(held) if r and i not in base_]
    ordinary = [i for i, (_, r) in enumerate(held) if not r]
    assert sum(i in got for i in random_) > 0.92 * len(random_)
    assert sum(i in got for i in ordinary) <= 0.005 * len(ordinary)


def test_odd_rows(spark):
    key = "AKIA" + "Q7" * 9
    rows = [(1, None), (2, ""), (2, "Token=short Secret: 'AbC123456789xyz'"), (2, "Token=short Secret: 'AbC123456789xyz'"), (None, f"é😀 {key} token=password: abcdefghijkl"), (3, "deadbeefdeadbeef " * 3 + "x" * 200_000), (4, "password=a1b2c3d4e5f6a7b8c9 api-key=no apikey = zzzzzzzzzzzz")]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, spans string, row string")
    check(docs, S.train(docs), rows)
    assert S.digests(S.scan(docs.where(F.lit(False)), S.train(docs.where(F.lit(False))))).count() == 0
