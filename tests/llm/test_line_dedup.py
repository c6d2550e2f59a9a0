import random
import re
import struct
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from recollect.llm import line_dedup as L
from recollect.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def signed(x):
    x &= (1 << 64) - 1
    return x - (x >> 63 << 64)


DENSE = "[、-ヿ㐀-鿿！，？]"


def dense(text):
    return len(text.encode()) >= 2 * len(text)


def units(text):
    """Lines: after line ends, words whose last character's code is above 255 or not divisible by three, and kana and Chinese characters."""
    spaced = re.sub(f"\n|{DENSE}", lambda m: m[0] + " ", text) if dense(text) else text.replace("\n", "\n ")
    out, words = [], []
    for word in spaced.split(" "):
        words.append(word)
        if word and (word[-1] == "\n" or ord(word[-1]) > 255 or 32 < ord(word[-1]) and ord(word[-1]) % 3):
            out.append(" ".join(words))
            words = []
    return [*out, " ".join(words)] if words or not out else [*out]


def together(u, text):
    spaced = " ".join(u)
    return re.sub(f"(\n|{DENSE}) ", r"\1", spaced) if dense(text) else spaced.replace("\n ", "\n")


def chunks(text):
    """(first line, line behind the last) of each chunk, by a rolling hash over two line hashes that is least among five on either side."""
    u = units(text)
    h = [signed(xxhash.xxh64_intdigest(x, 42)) for x in u]
    roll = {i: signed(h[i] ^ (h[i - 1] << 1)) for i in range(1, len(h))}
    cuts = [i for i in range(6, len(h) - 5) if all(roll[i] < roll[i - k] and roll[i] <= roll[i + k] for k in range(1, 6))]
    return u, list(zip([0, *cuts], [*cuts, len(u)]))


def plain(texts):
    """By dictionaries with the chunks' lines as keys; texts in the order of their rows."""
    parts = [chunks(t) if t else ([], []) for t in texts]
    owner = {}
    for i, (u, spans) in enumerate(parts):
        for a, b in spans:
            owner.setdefault(tuple(u[a:b]), (i, a, b))
    out = []
    for i, (u, spans) in enumerate(parts):
        shared = [(a, b) for a, b in spans if owner[tuple(u[a:b])][0] != i]
        starts, ends = {a for a, _ in shared}, {b for _, b in shared}
        gone = set()
        for a, b in shared:
            j, c, d = owner[tuple(u[a:b])]
            o = parts[j][0]
            n = m = 0
            while a not in ends and n < min(10, a, c) and u[a - n - 1].rstrip(" \n") == o[c - n - 1].rstrip(" \n"):
                n += 1
            while b not in starts and m < min(10, len(u) - b, len(o) - d) and u[b + m].rstrip(" \n") == o[d + m].rstrip(" \n"):
                m += 1
            gone.update(range(a - n, b + m))
        out.append(together([x for k, x in enumerate(u) if k not in gone], texts[i]) if texts[i] else texts[i])
    return out


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    return [r.text for r in L.dedup_lines(docs).orderBy("doc_id").collect()]


def test_query_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {d.doc_id: t for d, t in zip(docs, plain([d.text for d in docs]))}
    got = {r.doc_id: (r.text, r.n_removed) for r in QUERIES["op8_line_dedup"](spark, SF).collect()}
    assert {i: t for i, (t, _) in got.items()} == want
    assert sum(n for _, n in got.values()) == sum(len(d.text) - len(want[d.doc_id]) for d in docs) > 0


PASSAGE = "Moss grows in slow green rings, under stone arches. Lanterns burn low, near closed doors. No one answers the bell, when evening comes. Gulls turn over the tin roofs. Rain fills each broken cup, then spills across some steps. A clerk signs the last page, and leaves his pen on the sill."


def own(k, n):
    return " ".join(f"Word{k}x{i} then some{i * k} lines, of text{i * k + i}." for i in range(n))


def test_passages_copies_and_odd_rows(spark):
    texts = [own(1, 9), own(2, 22) + " " + PASSAGE, own(3, 25) + " " + PASSAGE, own(4, 21) + "\n" + PASSAGE + "\n" + own(5, 3), own(1, 9), None, "", "Short.", own(6, 4) + "\x01" + own(7, 4), "one word " * 60_000, "Short."]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, row string, Shared string").coalesce(1)
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    got = {r.doc_id: r.text for r in rows}
    assert {(r.row, r.Shared) for r in rows} == {("x", "y")} and len(rows) == len(texts)
    assert [got[i] for i in range(len(texts))] == plain(texts)
    assert got[1] == texts[1] and got[4] == "" and got[10] == ""
    for i, k in ((2, 3), (3, 4)):
        assert PASSAGE[20:-20] not in got[i] and own(k, 5) in got[i] and len(got[i]) < len(texts[i]) - 0.8 * len(PASSAGE)
    assert L.dedup_lines(docs.where(F.lit(False))).count() == 0


def test_of_three_copies_one_stays(spark):
    text = own(8, 40)
    assert run(spark, [text, text, text]) == [text, "", ""]
    assert run(spark, ["One line."] * 4) == ["One line.", "", "", ""]
    assert run(spark, [None, None, ""]) == [None, None, ""]


def test_null_ids_repeated_rows_and_other_types(spark):
    rows = [(None, own(1, 9), ["a"], {"k": 1}), (None, own(1, 9), ["a"], {"k": 1}), (3, own(2, 4), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed array<string>, sign map<string,int>").coalesce(1)
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns
    assert [r.text for r in out.collect()].count("") == 1 and out.count() == 3


@pytest.mark.parametrize("lang", ["en", "fr", "de", "es"])
def test_passages_of_60_words_in_the_middle_of_lines_go_whatever_the_language(spark, lang):
    rng = random.Random(lang)
    pool = [w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("lang") == lang).limit(60).collect() for w in r.text.split()]
    texts, sizes = [], []
    for _ in range(40):
        passage = " ".join(rng.choice(pool) for _ in range(60))
        sizes.append(len(passage))
        for _ in range(2):
            texts.append(" ".join([*(rng.choice(pool) for _ in range(80)), passage, *(rng.choice(pool) for _ in range(80))]))
    got = run(spark, texts)
    assert got[0::2] == texts[0::2]
    shares = [(len(t) - len(g)) / n for t, g, n in zip(texts[1::2], got[1::2], sizes)]
    assert sum(x > 0.5 for x in shares) >= 38 and sum(shares) / 40 > 0.85 and max(shares) < 1.3


def test_chinese_text_without_spaces(spark):
    rng = random.Random(2)
    han = [chr(c) for c in range(0x4E00, 0x4F00)]
    passage = "".join(rng.choice(han) for _ in range(60))
    texts = ["".join(rng.choice(han) for _ in range(70)) + passage + "".join(rng.choice(han) for _ in range(70)) for _ in range(2)]
    got = run(spark, texts)
    assert got == plain(texts) and got[0] == texts[0] and len(got[1]) < 155


def test_colliding_hashes_are_kept(spark, monkeypatch):
    """With hashes of a few bits texts collide: only chunks with the owner's very bytes go."""
    whole = L.chunks
    monkeypatch.setattr(L, "chunks", lambda text: F.struct(F.transform(whole(text)["h"], lambda h: h % 3).alias("h"), whole(text)["e"].alias("e")))
    texts = [own(1, 12), own(2, 12), own(3, 12)]
    assert run(spark, texts) == texts


@pytest.mark.parametrize("text", ["", "a", "a b\nc", "x. y, zebra e w", "q\n\n\n", "alpha. \x01beta. c", "日本 語。x", "日本 語。 字\n 字", "later \n  \n after that  two  spaces", "\n leading"])
def test_lines_join_to_the_text(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    u, back = df.select(L.lines(F.col("text")), L.joined(L.lines(F.col("text")), F.col("text"))).first()
    assert back == text and u == units(text)


def test_texts_are_shuffled_once_and_no_python_runs(spark):
    n = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
        out = L.dedup_lines(docs)
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", n)
    assert "Python" not in plan and "Arrow" not in plan
    assert sum("FileScan" in x and "documents.parquet" in x for x in plan.splitlines()) == 1 and "ReusedExchange" in plan
