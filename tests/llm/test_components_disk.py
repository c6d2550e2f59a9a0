"""Rounds of components leave few files, however many partitions a shuffle has."""

import os

from recollect.llm.common import checkpoint_dir
from recollect.llm.simhash import connected


def _files(spark):
    return sum(len(f) for _, _, f in os.walk(checkpoint_dir(spark).removeprefix("file:")))


def test_a_round_leaves_no_file_for_each_empty_partition(spark):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "61")
        spark.conf.set(keys[1], "false")
        before = _files(spark)
        got = sorted(map(tuple, connected(spark.createDataFrame([(1, 2), (3, 2), (7, 8)], "a long, b long")).collect()))
        assert got == [(2, 1), (3, 1), (8, 7)]
        assert 0 < _files(spark) - before < 61
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
