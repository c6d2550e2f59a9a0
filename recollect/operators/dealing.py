"""How rows are dealt to tasks that fold them in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_order(rows: DataFrame, keys: list[str], *order: str | Column, tasks: int | None = None) -> DataFrame:
    """All rows of equal keys in one task, one behind the other, sorted by keys and ``order``; over ``tasks`` tasks, if so many are wanted.

    Dealt by a hash of the keys, not by the keys: where a join has dealt the rows by these already, Spark leaves a repartition by them out,
    and once it makes the join a broadcast one, or splits its large parts, a key's rows come to several tasks.
    """
    key = F.xxhash64(*keys)
    return (rows.repartition(tasks, key) if tasks else rows.repartition(key)).sortWithinPartitions(*keys, *order)
