"""A landed record log as a batch and stream source.

A log folder holds ``partition=<n>`` folders with segment files that only grow at the end, in the order of their names;
a line is ``<creation time in ms> <tab> <record as JSON>``, as a topic's consumer lands them. The position in a partition
is its last segment and the bytes of it that are whole lines, so a query's checkpoint has one entry per partition. A line
that is not ended yet is left for a later batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "partition int, segment string, position long, create_time long, value string"
#: Bytes that one task reads, and that are searched for the end of a line at a time.
SPLIT_BYTES, TAIL_BYTES = 32 << 20, 1 << 16


@dataclass
class Span(InputPartition):
    """Lines of a segment that begin within [start, end)."""

    partition: int
    segment: str
    start: int
    end: int


class Log:
    def __init__(self, folder: str):
        self.fs, self.root = FileSystem.from_uri(folder)

    def segments(self) -> dict[int, list[tuple[str, int]]]:
        """partition -> its segments (name, bytes), in order."""
        out: dict[int, list[tuple[str, int]]] = {}
        for f in self.fs.get_file_info(FileSelector(self.root, recursive=True)):
            parent, _, name = f.path.rpartition("/")
            folder = parent.rpartition("/")[2]
            if f.type == FileType.File and folder.startswith("partition=") and not name.startswith((".", "_")):
                out.setdefault(int(folder.removeprefix("partition=")), []).append((name, f.size))
        return {p: sorted(s) for p, s in out.items()}

    def path(self, partition: int, segment: str) -> str:
        return f"{self.root}/partition={partition}/{segment}"

    def whole(self, partition: int, segment: str, size: int) -> int:
        """Bytes up to the end of the last whole line."""
        with self.fs.open_input_file(self.path(partition, segment)) as f:
            end = size
            while end > 0:
                start = max(0, end - TAIL_BYTES)
                at = f.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def end(self) -> dict[str, list]:
        """partition -> [last segment, bytes of it]."""
        return {str(p): [s[-1][0], self.whole(p, *s[-1])] for p, s in self.segments().items()}

    def spans(self, start: dict, end: dict) -> list[Span]:
        """What lies between two positions. Segments before the last one are complete."""
        out = []
        for p, segments in self.segments().items():
            if str(p) not in end:
                continue
            last, limit = end[str(p)]
            first, begun = start.get(str(p), ["", 0])
            for name, size in segments:
                low, high = (begun if name == first else 0), (limit if name == last else size)
                if first <= name <= last:
                    out += [Span(p, name, a, min(a + SPLIT_BYTES, high)) for a in range(low, high, SPLIT_BYTES)]
        return out

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        with self.fs.open_input_file(self.path(span.partition, span.segment)) as f:
            at = span.start
            f.seek(max(at - 1, 0))
            reader = _Lines(f, max(at - 1, 0))
            if at > 0:  # the line that holds the byte before belongs to the span before
                at = reader.skip_line()
            while at < span.end:
                line, following = reader.line()
                if line is None:
                    break
                time, _, value = line.partition(b"\t")
                rows.append((span.partition, span.segment, at, int(time), value.decode("utf-8", "replace")))
                at = following
                if len(rows) >= 10_000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


class _Lines:
    """Lines of an open file from its position on, with the byte at which the next one begins."""

    def __init__(self, file, at: int):
        self.file, self.at, self.left = file, at, b""

    def line(self) -> tuple[bytes | None, int]:
        while (cut := self.left.find(b"\n")) < 0:
            more = self.file.read(1 << 20)
            if not more:
                return None, self.at
            self.left += more
        out, self.left = self.left[:cut], self.left[cut + 1 :]
        self.at += cut + 1
        return out, self.at

    def skip_line(self) -> int:
        return self.line()[1]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      ["partition", "segment", "position", "create_time", "value"])


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return Log(self.folder).end()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return Log(self.folder).spans(start, end)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return Log(self.folder).read(partition)


class _Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Span]:
        log = Log(self.folder)
        return log.spans({}, log.end())

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return Log(self.folder).read(partition) if partition is not None else iter(())


class RecordLog(DataSource):
    """``spark.readStream.format("record_log").load(folder)`` after ``spark.dataSource.register(RecordLog)``."""

    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])


def landing(records: DataFrame) -> DataFrame:
    """Log rows as the two landing columns."""
    meta = F.to_json(F.struct(F.col("create_time").alias("CreateTime"), "partition", F.col("position").alias("offset")))
    return records.select(meta.alias("record_metadata"), F.col("value").alias("record_content"))


def log_records(spark: SparkSession, folder: str, stream: bool = True) -> DataFrame:
    spark.dataSource.register(RecordLog)
    reader = spark.readStream if stream else spark.read
    return landing(reader.format("record_log").load(folder))


def append_log(records: DataFrame, folder: str, partitions: int = 4) -> None:
    """Append (record_metadata, record_content) rows to a log, dealt out by content; every append adds segments whose
    names sort behind the ones before."""
    line = F.concat(F.get_json_object("record_metadata", "$.CreateTime"), F.lit("\t"), F.replace(F.col("record_content"), F.lit("\n"), F.lit(" ")))
    rows = records.select(line.alias("value"), F.pmod(F.xxhash64("record_content"), F.lit(partitions)).cast("int").alias("partition"))
    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    number = 1 + max((int(name.split("-")[0]) for s in Log(folder).segments().values() for name, _ in s), default=-1)
    part = f"{folder}/.append-{number}"
    rows.write.mode("overwrite").partitionBy("partition").text(part)
    source, path = FileSystem.from_uri(part)
    for f in source.get_file_info(FileSelector(path, recursive=True)):
        home, _, name = f.path.rpartition("/")
        folder_name = home.rpartition("/")[2]
        if f.type == FileType.File and folder_name.startswith("partition=") and name.startswith("part-"):
            fs.create_dir(f"{root}/{folder_name}", recursive=True)
            fs.move(f.path, f"{root}/{folder_name}/{number:012d}-{name}")
