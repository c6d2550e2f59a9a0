import random
import time
from zlib import crc32

from pyspark.sql import functions as F

from recollect.llm import toxicity as T
from recollect.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    marked = [(got[r.doc_id], r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(r.predicted, t) for r, t in marked if r.held_out]
    assert sum(p == t for p, t in held) / len(held) >= 0.95
    assert not any(p and not t for p, t in held)


def test_folding_and_exceptions():
    s = T.Scorer(T.Model({" idiot ": 5.0, " scum": 4.0}, (" pond scum ",), 0.0, 1.0, -2.0))
    for text in ("You 1d10t!", "іdiоt", "IDIOT", "ｉdiot", "scumbag"):
        assert s.score(text) > 0.5, text
    for text in ("", None, "idiotic is another word", "Green pond scum.", "a scam"):
        assert s.score(text) < 0.5, text
    assert s.measure("idiot " + "word " * 99, 0.5) == 0.5


def plain_found(model, folded):
    """Every entry and phrase at every place; a word entry starts at its space in front."""
    spared = [(a, a + len(p) - 1) for p in model.exceptions for a in range(len(folded)) if folded.startswith(p, a)]
    out = []
    for a in range(len(folded)):
        here = [(len(e.rstrip()), w) for e, w in model.weights.items() if folded.startswith(e, a)]
        if here and not any(x <= a < y for x, y in spared):
            out.append((a, max(here)[1]))
    return out


def test_matching_against_every_place():
    rng = random.Random(4)
    for _ in range(300):
        word = lambda: "".join(rng.choices("ab", k=rng.randrange(1, 6)))
        entries = {f" {word()}{rng.choice(['', ' '])}": rng.randrange(1, 99) / 8 for _ in range(6)}
        entries = {e: w for e, w in entries.items() if not (e.endswith(" ") and e.rstrip() in entries)}
        model = T.Model(entries, tuple({f" {word()} {word()} " for _ in range(4)}))
        folded = T.fold(" ".join(word() for _ in range(rng.randrange(40))))
        assert T.Scorer(model).found(folded) == plain_found(model, folded), (model, folded)


def test_folding_keeps_whole_decompositions():
    assert T.fold("ﬁlth ﬃ ９ Ⅳ b8d") == " filth ffi g iv bbd "
    assert T.fold("no! yes|no") == " no  yes no "


def test_very_long_texts_with_many_exceptions_take_linear_time():
    model = T.Model({" scum": 4.0}, (" pond scum ",))
    folded = T.fold("pond scum " * 60_000)
    began = time.process_time()
    assert T.Scorer(model).found(folded) == [] and time.process_time() - began < 5


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"fine words number n{i} here", "x") for i in range(40)] + [(100 + i, f"you w{i} snarfle in t{i} place", "x") for i in range(20)] + [(None, None, "y"), (7, "", "y"), (7, "snarfle", "y"), (8, "long " * 100_000 + "snarfle", "z")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(20)] + [(None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    assert " snarfle " in model.weights or any(w.startswith(" snar") for w in model.weights)
    out = T.score(docs, model).collect()
    assert len(out) == docs.count()
    assert {r.predicted for r in out if r.doc_id is not None and 100 <= r.doc_id} == {1}
    assert [r.score < 0.5 and not r.held_out for r in out if r.doc_id is None] == [True]
    kept = T.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id >= 100").count() == 0 and kept.where("text is null").count() == 1
    none = T.train(docs.where(F.lit(False)), labels)
    assert none.weights == {} and T.score(docs, none).where("score >= 0.5").count() == 0
    assert T.score(docs.where(F.lit(False)), model).count() == 0
