import random
import re
from hashlib import sha256

from pyspark.sql import functions as F

from recollect.llm import decontamination as D
from recollect.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(words, items, window=10):
    """Every window at every place."""
    hit, found = set(), set()
    for item_id, item in items:
        size = min(window, len(item))
        wins = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if item else set()
        for i in range(len(words) - size + 1 if wins else 0):
            if tuple(words[i : i + size]) in wins:
                hit.update(range(i, i + size))
                found.add(item_id)
    return hit, found - {None}


def test_query_against_brute_force(spark):
    items = [(r.item_id, plain_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = plain_words(r.text)
        hit, found = plain(w, items)
        want[r.doc_id] = (len(w), len(hit), len(found), sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op4_decontamination"](spark, SF).collect()}
    assert got == want
    assert any(w[4] for w in want.values()) and not all(w[4] for w in want.values())


def test_automaton_on_random_words():
    rng = random.Random(5)
    for _ in range(400):
        abc = "abcd"[: rng.randrange(1, 5)]
        items = [(i if rng.random() < 0.9 else None, [rng.choice(abc) for _ in range(rng.randrange(0, 9))]) for i in range(rng.randrange(0, 7))]
        a = D.Automaton(items, 4)
        words = [rng.choice(abc + "z") for _ in range(rng.randrange(0, 40))]
        spans, found = a.hits(words)
        assert ({x for s in spans for x in range(*s)}, found) == plain(words, items, 4)


def test_shards_give_the_same(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert len(list(D._shards(items, 60))) > 5
    one = {r.row: (r.n_hit, r.spans, r.items) for r in D.find(docs, items).collect()}
    few = {r.row: (r.n_hit, r.spans, r.items) for r in D.find(docs, items, shard_words=60).collect()}
    assert {k: v[0::2] for k, v in one.items()} == {k: v[0::2] for k, v in few.items()}


def test_odd_rows_and_removal(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    items = spark.createDataFrame([(1, passage.upper()), (2, None), (3, ""), (None, "x y z"), (4, "tiny item")], "item_id long, text string")
    rows = [(1, f"start {passage}, end " + "more " * 30, 7), (2, None, 7), (3, "", 7), (None, "a tiny  ITEM b " * 1, 7), (5, passage, 7), (5, passage, 7), (6, "fine text " * 20_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in D.find(docs, items).collect()), key=str)
    assert got == sorted([(1, 47, 15, [1]), (2, 0, 0, []), (3, 0, 0, []), (None, 4, 2, [4]), (5, 15, 15, [1]), (5, 15, 15, [1]), (6, 40000, 0, [])], key=str)
    left = {r.doc_id: r.text for r in D.decontaminate(docs, items).collect()}
    assert left == {1: "start , end " + "more " * 30, 2: None, 3: "", None: "a  b ", 6: "fine text " * 20_000}
    assert D.decontaminate(docs, items).columns == docs.columns
    assert D.find(docs.where(F.lit(False)), items).count() == 0
    assert D.find(docs, items.where(F.lit(False))).where("n_hit > 0").count() == 0


def test_shards_one_after_another_leave_no_window(spark):
    """With several shards documents that have no window stay as they are, and no other keeps one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    plain_items = [(r.item_id, plain_words(r.text)) for r in items.collect()]
    out = D.decontaminate(docs, items, shard_words=200)
    left = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns and len(list(D._shards(items, 200))) > 1
    for d in docs.collect():
        hit = plain(plain_words(d.text), plain_items)[0]
        if not hit:
            assert left[d.doc_id] == d.text
        elif d.doc_id in left:
            assert not plain(plain_words(left[d.doc_id]), plain_items)[0]
