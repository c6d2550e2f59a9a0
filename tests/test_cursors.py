"""The cursor source and its ledger, held against a plain pass over the same lines."""

import json
import tempfile

import pytest
from pyspark.errors import StreamingQueryException

from recollect.sources import cursors as C


def record(i, **changes):
    r = {"cursor": f"c{i}", "event_id": f"e{i}", "user_id": "u", "session_id": "s", "round_id": f"r{i}", "completed_at": "2024-01-01T00:00:00Z", "messages": [{"role": "user", "content": "é" * (i % 7 + 1)}], "final_response": "x"}
    return json.dumps({**r, **changes}, ensure_ascii=False)


def add(folder, name, text):
    with open(f"{folder}/{name}", "a", encoding="utf-8") as f:
        f.write(text)


def run(spark, folder, ledger, **kwargs):
    query = C.sync(spark, folder, ledger, **kwargs)
    query.awaitTermination(120)
    assert query.exception() is None


def ids(spark, ledger):
    return sorted(r.event_id for r in spark.read.schema("event_id string").parquet(f"{ledger}/events").collect())


@pytest.fixture
def folders():
    return tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")


def test_restarts_neither_lose_nor_repeat(spark, folders):
    """Files grow, end without a line end, and go on in the next; ranges of 97 bytes cut lines anywhere."""
    folder, ledger = folders
    add(folder, "0.json", record(0) + "\n\n" + record(1) + "\r\n" + record(2)[:40])
    run(spark, folder, ledger, range_bytes=97)
    assert ids(spark, ledger) == ["e0", "e1"]
    add(folder, "0.json", record(2)[40:] + "\n" + record(3))  # no line end, but a later file is there
    add(folder, "1.json", "".join(record(i) + "\n" for i in (4, 1, 5, 5)))
    run(spark, folder, ledger, range_bytes=97)
    assert ids(spark, ledger) == [f"e{i}" for i in range(6)]
    run(spark, folder, ledger, range_bytes=97)
    add(folder, "1.json", "".join(record(i) + "\n" for i in range(40)))
    run(spark, folder, ledger, range_bytes=97)
    assert ids(spark, ledger) == sorted(f"e{i}" for i in range(40))
    status = [tuple(r) for r in spark.read.parquet(f"{ledger}/status").orderBy("batch").select("fetched", "ingested", "duplicates", "errors", "cursor").collect()]
    assert status == [(2, 2, 0, 0, "c1"), (6, 4, 2, 0, "c5"), (40, 34, 6, 0, "c39")]


@pytest.mark.parametrize("size", [1, 2, 13, 100, 1_000_000])
def test_ranges_of_any_size_give_each_line_once(folders, size):
    folder, _ = folders
    text = "".join(record(i) + "\n" * (i % 3 + 1) for i in range(5))
    add(folder, "a.json", text)
    reader = C.CursorReader(folder, size)
    found = [(at, line) for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for b in reader.read(p) for at, line in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
    raw = text.encode()
    assert [line for _, line in found] == [record(i) for i in range(5)]
    assert all(raw[at:].startswith(line.encode()) for at, line in found)


def test_lines_longer_than_a_read(folders):
    folder, _ = folders
    long = [record(i, final_response="y" * (C.STEP * 2 + i)) for i in range(3)]
    add(folder, "a.json", "\n".join(long) + "\nopen" + "z" * C.STEP)
    reader = C.CursorReader(folder, 50_000)
    ranges = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [x for p in ranges for b in reader.read(p) for x in b.column(2).to_pylist()] == long


def test_what_is_wrong_with_records(spark):
    cases = {
        "not JSON": ["{", "[1]x", "7", record(0) + record(1), record(0) + "," + record(1)], "blank cursor": [record(0, cursor=" ")], "blank final_response": [record(0, final_response=None)], "completed_at": [record(0, completed_at="2024-01-01T00:00:00"), record(0, completed_at="soonZ")],
        "messages": [record(0, messages=[]), record(0, messages=[{"role": "robot", "content": "x"}]), record(0, messages=[{"role": "user", "content": " "}])], None: [record(0, completed_at="2024-01-01T00:00:00+02:00", more=1)],
    }
    rows = [("f", i, line, why) for i, (why, line) in enumerate((w, x) for w, xs in cases.items() for x in xs)]
    want = {r[1]: r[3] for r in rows}
    got = C.records(spark.createDataFrame([r[:3] for r in rows], C.LINES)).select("position", "error").collect()
    assert dict(map(tuple, got)) == want


def test_bad_records_are_rows_or_stop_the_stream(spark, folders):
    folder, ledger = folders
    add(folder, "a.json", record(0) + "\nbad\n")
    with pytest.raises((StreamingQueryException, AssertionError)):
        run(spark, folder, ledger, strict=True)
    run(spark, folder, ledger)
    assert ids(spark, ledger) == ["e0"]
    assert [(r.position, r.error) for r in spark.read.parquet(f"{ledger}/errors").collect()] == [(len(record(0).encode()) + 1, "not JSON")]


def test_empty_folder(spark, folders):
    run(spark, *folders)
    reader = C.CursorReader(folders[0] + "/none", 10)
    assert reader.latestOffset() == reader.initialOffset()
