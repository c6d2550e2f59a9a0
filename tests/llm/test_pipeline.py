import base64
from hashlib import sha256

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from recollect.llm import toxicity
from recollect.llm.queries import QUERIES
from tests.llm import test_decontamination as four
from tests.llm import test_line_dedup as eight
from tests.llm import test_minhash as near

SF = "/root/testdata/sf0.001"


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(enc, text):
    ids = enc.encode_ordinary(text or "")
    return len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((text or "").encode()).hexdigest()


def test_pipeline_against_plain_stages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    docs = {r.doc_id: r.text for r in table.collect() if scorer.score(r.text) < 0.5}
    docs = dict(zip(docs, eight.plain(list(docs.values()))))
    roots = near.plain_roots(docs)
    docs = {i: t for i, t in docs.items() if roots[i] == i}
    items = [(r.item_id, four.plain_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF).collect()}
    enc = encoding()
    hit = set()
    for i, t in docs.items():
        words = four.plain_words(t)
        n = len(four.plain(words, items)[0])
        if n:
            hit.add(i)
            assert (i in got) == (n <= len(words) / 2)
        else:
            assert got[i] == digests(enc, t)
    assert hit and set(got) <= set(docs) and len(docs) < table.count()


def test_decontaminated_texts_have_no_windows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, four.plain_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in corpus_pipeline.decontaminate(spark, docs, SF).collect():
        assert not four.plain(four.plain_words(r.text), items)[0] and r.n_chars == len(r.text)


def test_stages_keep_columns_and_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    odd = spark.createDataFrame([(None, None, None, None, None), (3, "", "en", "s", 0), (3, "", "en", "s", 0)], docs.schema)
    for rows in (docs.unionByName(odd), docs.where(F.lit(False))):
        rows = spark.createDataFrame(rows.collect(), docs.schema).coalesce(1)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SF)
            assert out.columns == rows.columns
            assert out.count() <= rows.count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count()


def test_stages_take_extra_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for name in ("row", "text_is", "fp", "node", "block", "root", "removed", "clean_text"):
        docs = docs.withColumn(name, F.lit("own"))
    docs = spark.createDataFrame(docs.collect(), docs.schema).coalesce(1)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r.fp for r in out.collect()} == {"own"}


def test_byte_bpe_and_counts_against_libraries(spark):
    import sentencepiece

    enc = encoding()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    odd = [(900, "  two  spaces \n\n\t tab　wide ▁ mark é 日本語 😀 <s></s> don't I'LL 123456 \x1c\x1d"), (901, ""), (902, None), (None, "x" * 5_000), (901, "again " * 3)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    from recollect.llm import byte_bpe, token_counts

    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    got = sorted(map(tuple, byte_bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()), key=str)
    assert got == sorted(((i, *digests(enc, t)) for i, t in rows), key=str)
    ids = {r.doc_id: r.ids for r in byte_bpe.encode(docs.where("doc_id < 20"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    assert all(ids[i] == enc.encode_ordinary(t) for i, t in rows if i is not None and i < 20)
    counted = sorted(map(tuple, token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()), key=str)
    assert counted == sorted(((i, len(t.encode()), n, n > 4096) for i, t in rows for n in (len(sp.encode(t)),)), key=str)
    assert set(QUERIES) == {f"op{n}_{x}" for n, x in enumerate("html_text secrets lm_scoring decontamination toxicity simhash token_counts line_dedup byte_bpe topk".split(), 1)}
