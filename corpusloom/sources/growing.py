"""Files that grow line by line, as a stream; and streams appended to a log of JSON lines, exactly once.

`growing_lines` follows files by byte offsets, which the query commits.  Only whole
lines are passed on; the start of a line that isn't ended yet is read again with its
rest.  A file that is shorter than before, or whose first line is another, began
anew and is read from its start.  So a query that is stopped and started again
neither loses nor repeats a line, whatever happened to the files in between; only a
file that is cut and grows beyond its old size with an equal first line, all between
two looks, can't be told from one that grew.

`json_log` writes each batch in files of its own and then lists them in one file
named after the batch, which appears whole.  Of a batch that is run again the first
listing counts, so its rows are there once.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from .shard_files import exists, filesystem, read_json, write_json

#: Bytes of a file that a task reads; bytes looked at together; rows passed on together.
PART, BLOCK, ROWS = 32 << 20, 1 << 16, 8_192


@dataclass
class Span(InputPartition):
    """Lines of a file that begin in [begin, end); `first` is where the lines to be read begin."""

    path: str
    head: int
    first: int
    begin: int
    end: int
    last: int


def _head(f: pa.NativeFile) -> int:
    """A number for the first line of a file, 0 for none that is ended."""
    start = f.read_at(BLOCK, 0)
    n = start.find(b"\n")
    return zlib.crc32(start if n < 0 else start[: n + 1])


def _whole(f: pa.NativeFile, size: int) -> int:
    """Where the last ended line of a file ends."""
    end = size
    while end:
        begin = max(0, end - BLOCK)
        n = f.read_at(end - begin, begin).rfind(b"\n")
        if n >= 0:
            return begin + n + 1
        end = begin
    return 0


class GrowingLines(DataSource):
    """Options: path, a folder; pattern, of the paths below it (*.jsonl)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "path string, at long, value string"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Tail(self.options["path"], self.options.get("pattern", "*.jsonl"), int(self.options.get("part", PART)))


class _Tail(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, part: int) -> None:
        self.folder, self.pattern, self.part = folder, pattern, part

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """For each file where its last whole line ends, and its first line's number; the driver reads a block or two of each."""
        store, base = filesystem(self.folder)
        found = {}
        for info in sorted(store.get_file_info(pafs.FileSelector(base, allow_not_found=True, recursive=True)), key=lambda x: x.path):
            name = info.path[len(base) :].lstrip("/")
            if info.type != pafs.FileType.File or not fnmatch(name, self.pattern):
                continue
            with store.open_input_file(info.path) as f:
                if end := _whole(f, info.size):
                    found[name] = {"end": end, "head": _head(f)}
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for name, now in end.items():
            before = start.get(name, {"end": 0, "head": 0})
            first = before["end"] if before["head"] == now["head"] and before["end"] <= now["end"] else 0
            out += [Span(name, now["head"], first, at, min(at + self.part, now["end"]), now["end"]) for at in range(first, now["end"], self.part)]
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(self.folder)
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("value", pa.string())])
        at, values = [], []
        with store.open_input_file(f"{base}/{partition.path}") as f:
            for place, line in _lines(f, partition):
                at.append(place)
                values.append(line.decode(errors="replace"))
                if len(at) == ROWS:
                    yield pa.record_batch([pa.array([partition.path] * len(at)), pa.array(at, pa.int64()), pa.array(values)], schema=schema)
                    at, values = [], []
        if at:
            yield pa.record_batch([pa.array([partition.path] * len(at)), pa.array(at, pa.int64()), pa.array(values)], schema=schema)


def _lines(f: pa.NativeFile, span: Span) -> Iterator[tuple[int, bytes]]:
    """Places and texts of the lines that begin in a span; the last one may go on beyond it, up to `last`."""
    at, rest, place = span.begin, b"", span.begin
    if span.begin > span.first:  # the line that goes on from before belongs to the span before
        while True:
            block = f.read_at(min(BLOCK, span.last - at + 1), at - 1)
            n = block.find(b"\n")
            if n >= 0 or not block:
                at = place = at + n
                break
            at += len(block)
    while place < span.end and at < span.last:
        block = f.read_at(min(BLOCK, span.last - at), at)
        if not block:
            return
        at += len(block)
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            if place >= span.end:
                return
            yield place, line.rstrip(b"\r")
            place += len(line) + 1


def growing_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl", part: int = PART) -> DataFrame:
    """A stream of lines (path under the folder, at: the byte where it begins, value)."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", folder).option("pattern", pattern).option("part", str(part)).load()


def tail_into(lines: DataFrame, folder: str, keep_running: bool = False) -> None:
    """Everything there is now, or all that comes, into a table of lines with the batch that brought them; a batch that is run again replaces itself.

    A query that broke off within a batch runs that again, and comes to what is new when it is called next.
    """

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/lines/batch={batch}")

    writer = lines.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(put)
    (writer if keep_running else writer.trigger(availableNow=True)).start().awaitTermination()


def current_records(spark: SparkSession, folder: str, schema: str, keep: int | None = 50_000) -> DataFrame:
    """Records (path, at, and those of the schema) of what `tail_into` has gathered: of each file since it last began anew, the last ones of it.

    Broken lines and those without any of the fields are skipped.
    """
    from pyspark.sql import Window

    rows = spark.read.schema("path string, at long, value string, batch long").parquet(f"{folder}/lines")
    file = Window.partitionBy("path")
    rows = rows.withColumn("began_", F.max(F.when(F.col("at") == 0, F.col("batch"))).over(file)).where("batch >= began_")
    parsed = rows.select("path", "at", F.from_json("value", schema).alias("r")).where("r IS NOT NULL AND NOT (to_json(r) = '{}')")
    if keep is not None:
        parsed = parsed.withColumn("from_end_", F.row_number().over(file.orderBy(F.desc("at")))).where(F.col("from_end_") <= keep)
    return parsed.select("path", "at", "r.*")


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class JsonLog(DataSource):
    """A sink of JSON lines.  Option: path, a folder on any store that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "json_log"

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _Log(self.options["path"])


class _Log(DataSourceStreamWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator[T.Row]) -> Written:
        store, base = filesystem(self.folder)
        name, n = f"rows/{uuid.uuid4().hex}.jsonl", 0
        out = None
        for row in iterator:
            if out is None:
                store.create_dir(f"{base}/rows", recursive=True)
                out = store.open_output_stream(f"{base}/{name}")
            out.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, separators=(",", ":"), default=str).encode() + b"\n")
            n += 1
        if out is not None:
            out.close()
        return Written(name, n)

    def commit(self, messages: list, batchId: int) -> None:
        commit_batch(self.folder, batchId, [{"path": m.name, "rows": m.rows} for m in messages if m is not None and m.rows])

    def abort(self, messages: list, batchId: int) -> None:
        """Files that no batch lists are never read."""


def commit_batch(folder: str, batch: int, files: list[dict]) -> bool:
    """List the files of a batch, unless that was done before."""
    place = f"{folder}/batches/{batch:012d}.json"
    if exists(place):
        return False
    write_json(place, files)
    return True


def append_json(stream: DataFrame, folder: str, state: str, keep_running: bool = False) -> None:
    """Append the rows of a stream to a log; `state` is the query's checkpoint."""
    spark = stream.sparkSession
    spark.dataSource.register(JsonLog)
    writer = stream.writeStream.format("json_log").option("path", folder).option("checkpointLocation", state)
    (writer if keep_running else writer.trigger(availableNow=True)).start().awaitTermination()


def append_record(folder: str, record: dict) -> None:
    """One more line from outside of any stream, in a batch of its own after all there are."""
    store, base = filesystem(folder)
    store.create_dir(f"{base}/rows", recursive=True)
    name = f"rows/{uuid.uuid4().hex}.jsonl"
    with store.open_output_stream(f"{base}/{name}") as out:
        out.write(json.dumps(record, ensure_ascii=False, separators=(",", ":")).encode() + b"\n")
    batch = max([-1, *(int(f.base_name[:12]) for f in store.get_file_info(pafs.FileSelector(f"{base}/batches", allow_not_found=True)) if f.base_name.endswith(".json"))]) + 1
    if not commit_batch(folder, batch, [{"path": name, "rows": 1}]):
        raise RuntimeError("another writer appends to this log")


def logged(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of a log that are listed, with the batch that brought them."""
    names = T._parse_datatype_string(schema).names
    if not exists(f"{folder}/batches"):
        return spark.createDataFrame([], f"batch long, {schema}")
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    listed = spark.read.option("multiLine", True).schema("path string, rows long").json(f"{folder}/batches").select(F.element_at(F.split("path", "/"), -1).alias("name_"), F.substring(file, 1, 12).cast("long").alias("batch"))
    lines = spark.read.schema(schema).json(f"{folder}/rows").withColumn("name_", file)
    return lines.join(listed, "name_").select("batch", *names)
