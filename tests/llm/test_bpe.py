import public_tokenizers
import pytest
from pyspark.sql import functions as F

from recollect.llm import byte_bpe, token_counts

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def test_empty_tables_null_ids_and_clashing_names(spark):
    rows = [(None, "two words", 1, "a", "b", 3), (None, "two words", 2, "a", "b", 3), (3, None, 3, "a", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids_sha256 string, decoded_sha256 string, n_bytes int")
    for run in (lambda d: byte_bpe.encode_digests(d, RANKS, public_tokenizers.PATTERN), lambda d: token_counts.count_tokens(d, PIECES)):
        got = run(docs).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("3", 0), ("None", 2), ("None", 2)]
        assert run(docs.where(F.lit(False))).count() == 0
    assert byte_bpe.encode(docs.where(F.lit(False)), RANKS, public_tokenizers.PATTERN).count() == 0


def test_other_patterns_are_errors():
    with pytest.raises(ValueError):
        byte_bpe.spaced(r"\w+")
