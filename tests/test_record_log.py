"""The record log as a source: restarts, growing files, half lines, splits."""

import json

import pytest
from pyspark.sql import functions as F

from helixmart.sources import record_log as L
from helixmart.streaming import jobs


def write(folder, partition, segment, text):
    home = folder / f"partition={partition}"
    home.mkdir(parents=True, exist_ok=True)
    with open(home / segment, "a", encoding="utf-8", newline="") as f:
        f.write(text)


def lines(*numbers):
    return "".join(f"{1000 + n}\t" + json.dumps({"event_id": str(n), "note": "é\\n" * (n % 3)}) + "\n" for n in numbers)


def drained(spark, folder, run):
    stream = L.log_records(spark, str(folder))
    rows = jobs.drain(stream, str(run)).collect()
    return sorted(int(json.loads(r["record_content"])["event_id"]) for r in rows)


def test_restart_without_loss_or_repeats(spark, tmp_path):
    log, run = tmp_path / "log", tmp_path / "run"
    write(log, 0, "0001", lines(1, 2, 3))
    write(log, 1, "0001", lines(10))
    assert drained(spark, log, run) == [1, 2, 3, 10]
    # The segment grows, a line is half written, a segment and a partition appear.
    write(log, 0, "0001", lines(4))
    write(log, 0, "0002", lines(5, 6) + lines(7)[:9])
    write(log, 2, "0001", lines(20))
    assert drained(spark, log, run) == [1, 2, 3, 4, 5, 6, 10, 20]
    assert drained(spark, log, run) == [1, 2, 3, 4, 5, 6, 10, 20]
    write(log, 0, "0002", lines(7)[9:])
    write(log, 0, "0003", lines(8))
    assert drained(spark, log, run) == [1, 2, 3, 4, 5, 6, 7, 8, 10, 20]


def test_empty_log(spark, tmp_path):
    write(tmp_path / "log", 0, "0001", "")
    assert drained(spark, tmp_path / "log", tmp_path / "run") == []
    write(tmp_path / "log", 0, "0001", lines(1)[:-1])
    assert drained(spark, tmp_path / "log", tmp_path / "run") == []


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_splits_hold_every_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(L, "SPLIT_BYTES", size)
    monkeypatch.setattr(L, "TAIL_BYTES", 5)
    write(tmp_path, 3, "0001", lines(*range(20)) + "half")
    log = L.Log(str(tmp_path))
    spans = log.spans({}, log.end())
    rows = [r for s in spans for b in log.read(s) for r in b.to_pylist()]
    assert [json.loads(r["value"])["event_id"] for r in rows] == [str(n) for n in range(20)]
    assert {r["partition"] for r in rows} == {3} and [r["create_time"] for r in rows] == [1000 + n for n in range(20)]


def test_batch_and_metadata(spark, tmp_path):
    write(tmp_path, 0, "0001", lines(1, 2))
    rows = L.log_records(spark, str(tmp_path), stream=False).orderBy("record_content").collect()
    assert [json.loads(r["record_metadata"])["CreateTime"] for r in rows] == [1001, 1002]


def test_append_then_read(spark, tmp_path):
    df = spark.range(100).select(
        F.format_string('{"CreateTime":%d}', "id").alias("record_metadata"), F.format_string('{"event_id":"%d"}', "id").alias("record_content"))
    L.append_log(df, str(tmp_path / "log"))
    assert drained(spark, tmp_path / "log", tmp_path / "run") == list(range(100))
    L.append_log(df.where("id < 3"), str(tmp_path / "log"))
    assert drained(spark, tmp_path / "log", tmp_path / "run") == sorted([*range(100), 0, 1, 2])
