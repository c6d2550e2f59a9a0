"""What the operators of this package share: reading tables, reliable cut points in the lineage, and fields of Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, the session's own (spark.checkpoint.dir); only where none is set and all is one machine, as in tests, a temporary one is made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written as a table to the shared checkpoint folder, which takes less room than ``cut``; in any order."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_number() -> Column:
    """A number for each row of a table, the same whenever the table is read again with the same settings."""
    return F.monotonically_increasing_id()


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front till no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words_ascii_space(text: str | None) -> list[str]:
    """Words between ASCII white space of a text with A-Z in lower case."""
    return lower_ascii(text).encode().split() if text else []


_LOWER = {c: c + 32 for c in range(65, 91)}


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def arrow_rows(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """Rows of the named columns, in order, batch by batch."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):  # so that only some of a batch's texts are there twice
            part = batch.slice(i, 1024)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def emit(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class Recent(dict):
    """A bounded memo of a function: two generations, of which the older is dropped when the newer is full.

    Used as a dict, a known key costs one look-up; ``__missing__`` does the rest. Python workers keep it from task to task.
    """

    def __init__(self, compute: Callable, limit: int = 200_000) -> None:
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_kept: dict[str, tuple[str, object]] = {}


def kept_in_worker(name: str, key: str, shared, make: Callable):
    """``make(shared.value)``, made once by a Python worker for each ``key`` and kept from task to task, till another is made."""
    if _kept.get(name, ("", None))[0] != key:
        _kept.clear()  # what an earlier stage has left would only take memory
        _kept[name] = key, make(shared.value)
    return _kept[name][1]


def new_key() -> str:
    return uuid.uuid4().hex
