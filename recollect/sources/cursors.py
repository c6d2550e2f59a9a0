"""Newline-delimited JSON that grows in a folder, as a stream whose offsets are cursors, and its records taken into a ledger once.

Files are finished in the order of their paths: when a later one is there, the earlier ones no longer change. The last one may still
grow; its last line is read when its line end is there. The folder is a path or an address that pyarrow opens, and all executors see it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from recollect.functions import variants as V

LINES = "file string, position long, line string"
RECORD = "cursor string, event_id string, user_id string, session_id string, round_id string, completed_at string, messages array<struct<role:string,content:string>>, final_response string"
ROLES = ("user", "assistant", "system", "tool")
STEP = 1 << 16
RANGE_BYTES = 64 << 20


class Range(InputPartition):
    """The lines of a file that begin in a range of bytes."""

    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


class CursorReader(DataSourceStreamReader):
    """An offset is a file and the place after its last line taken; a batch is cut into ranges of bytes, so no task reads a whole file.

    The driver lists the folder and reads the end of its last file back to a line end; all else is read in tasks.
    """

    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes = re.sub(r"^file:/+", "/", path), range_bytes

    def _folder(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def _files(self) -> list[tuple[str, int]]:
        system, root = self._folder()
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        named = [(f.path[len(root) :].lstrip("/"), f.size) for f in found if f.is_file]
        return sorted((name, size) for name, size in named if not re.search(r"(^|/)[._]", name))

    def initialOffset(self) -> dict:
        return {"file": "", "position": 0}

    def latestOffset(self) -> dict:
        files = self._files()
        if not files:
            return self.initialOffset()
        name, size = files[-1]
        whole = self._whole(name, size)
        if not whole and len(files) > 1:
            name, whole = files[-2]
        return {"file": name, "position": whole} if whole else self.initialOffset()

    def _whole(self, name: str, size: int) -> int:
        """The place after the file's last line end."""
        system, root = self._folder()
        with system.open_input_file(f"{root}/{name}") as f:
            while size:
                begin = max(0, size - STEP)
                at = f.read_at(size - begin, begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                size = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, size in self._files():
            if start["file"] <= name <= end["file"]:
                first = start["position"] if name == start["file"] else 0
                last = end["position"] if name == end["file"] else size
                out += [Range(name, a, min(a + self.range_bytes, last)) for a in range(first, last, self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, root = self._folder()
        with system.open_input_file(f"{root}/{partition.file}") as f:
            at, rest = max(0, partition.start - 1), b""
            begins = partition.start == 0  # else the line that is open before the range belongs to the range before
            while at < partition.end or rest:
                read = f.read_at(STEP, at + len(rest))
                parts = (rest + read).split(b"\n")
                if read:
                    rest = parts.pop()
                else:
                    parts, rest = [rest], b""
                places, lines = [], []
                for part in parts:
                    if begins and at < partition.end and part.strip():
                        places.append(at)
                        lines.append(part.rstrip(b"\r").decode("utf-8", "replace"))
                    begins = True
                    at += len(part) + 1
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(lines)), pa.array(places, pa.int64()), pa.array(lines)], names=["file", "position", "line"])
                if not read or at >= partition.end:
                    break

    def commit(self, end: dict) -> None:
        """Nothing to do: the stream's checkpoint keeps the cursor."""


class CursorFolder(DataSource):
    """``spark.readStream.format("cursor_folder").option("path", folder)``; option rangeBytes: bytes a task reads."""

    @classmethod
    def name(cls) -> str:
        return "cursor_folder"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema: StructType) -> CursorReader:
        return CursorReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The folder's lines that are not blank as a stream: file, position in bytes and line (SRC9)."""
    spark.dataSource.register(CursorFolder)
    return spark.readStream.format("cursor_folder").option("path", path).option("rangeBytes", range_bytes).load()


def records(lines_: DataFrame) -> DataFrame:
    """Lines as records with what is wrong with each: not JSON, a blank field, no time zone, messages (SRC9)."""
    r = lines_.withColumn("record", F.from_json("line", RECORD))
    texts = ("cursor", "event_id", "user_id", "session_id", "round_id", "final_response")
    blank = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(f"record.{c}").rlike(r"\S"), F.lit(False)), c) for c in texts)))
    zoned = F.coalesce(F.col("record.completed_at").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.lit(False)) & F.try_to_timestamp("record.completed_at").isNotNull()
    good = F.forall("record.messages", lambda m: m["role"].isin(*ROLES) & F.coalesce(m["content"].rlike(r"\S"), F.lit(False)))
    is_one = F.coalesce(V.kind(V.one_json(F.col("line"))) == "OBJECT", F.lit(False))
    wrong = F.when(F.col("record").isNull() | ~is_one, "not JSON").when(F.size(blank) > 0, F.concat(F.lit("blank "), F.get(blank, F.lit(0))))
    wrong = wrong.when(~zoned, "completed_at").when(~F.coalesce(good & (F.size("record.messages") > 0), F.lit(False)), "messages")
    return r.select("file", "position", "record.*", wrong.alias("error"))


def into_ledger(path: str, strict: bool = False) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each event of a stream of records goes to the ledger once, with the batch's counts beside it (STR9).

    ``path``/events, errors and status have a folder for each batch, which is written anew when a batch is repeated, so a restart neither
    loses nor repeats a record. An event that an earlier batch has is a duplicate, as is a second one in its batch. Bad records become
    rows of errors; with ``strict`` the batch fails instead, and the cursor stays before it. Counts are of one batch: one row each.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        if strict and not rows.where(F.col("error").isNotNull()).isEmpty():
            rows.unpersist()
            raise ValueError(f"bad records in batch {batch_id}")
        good = rows.where(F.col("error").isNull()).drop("error")
        nth = F.row_number().over(Window.partitionBy("event_id").orderBy("file", "position"))
        first = good.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
        # the schema makes the first batch's empty folder a table, too; only ids of earlier batches are read
        known = spark.read.schema("event_id string, batch long").parquet(f"{path}/events").where(F.col("batch") < batch_id).select("event_id") if batch_id else None
        new = first if known is None else first.join(known, "event_id", "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")
        rows.where(F.col("error").isNotNull()).select("file", "position", "error").write.mode("overwrite").parquet(f"{path}/errors/batch={batch_id}")
        taken = spark.read.schema("event_id string").parquet(f"{path}/events/batch={batch_id}").agg(F.count("*").alias("ingested"))
        seen = rows.agg(F.count("*").alias("fetched"), F.count("error").alias("errors"), F.max_by("cursor", F.struct("file", "position")).alias("cursor"))
        # two rows of one each
        both = seen.crossJoin(F.broadcast(taken)).select("fetched", "ingested", (F.col("fetched") - F.col("errors") - F.col("ingested")).alias("duplicates"), "errors", "cursor")
        both.coalesce(1).write.mode("overwrite").parquet(f"{path}/status/batch={batch_id}")
        rows.unpersist()

    return take


def sync(spark: SparkSession, folder: str, path: str, strict: bool = False, interval: str | None = None, range_bytes: int = RANGE_BYTES):
    """The started stream from folder to ledger: all that is there, or one batch an interval (STR9); its checkpoint holds the cursor."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = records(lines(spark, folder, range_bytes)).writeStream.foreachBatch(into_ledger(path, strict))
    return writer.option("checkpointLocation", f"{path}/cursor").trigger(**trigger).start()


def as_lines(records_: DataFrame) -> DataFrame:
    """Records as lines of JSON, for a folder that this source reads."""
    return records_.select(F.to_json(F.struct(*records_.columns)).alias("value"))
