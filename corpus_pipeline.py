"""A training-corpus pipeline: five stages, each on all that the one before kept, written as Parquet in between.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``:

1. toxicity: documents that the weighted lexicon rejects go; it is learnt from the labels of all remaining rows' ids
2. line_dedup: passages that other documents have too stay in the first of them; ``n_chars`` is that of the text left
3. near_duplicates: of each component of near copies, by SimHash and besides by five-word shingles, the document with the smallest doc_id stays
4. decontamination: spans of benchmark items are cut out; documents that mostly consist of them go
5. byte_bpe: token count and digests of the ids and of the decoded bytes of each text that is left

Documents of which a stage leaves no text stay, with an empty one: nothing but a toxic text, a near copy or a benchmark
passage removes a document. Null texts and ids pass through the stages as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import byte_bpe, decontamination, line_dedup, simhash, toxicity
from recollect.llm.common import checkpoint_dir, table


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now, where the table has that column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: SQL has no lexicon that learns, no XXH64 and no BPE: tests hold the pipeline against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
