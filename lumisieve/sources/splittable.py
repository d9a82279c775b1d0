"""A splittable source of raw frames and a transactional sink of records, as Spark data sources.

The source cuts files of headerless frames into byte ranges of whole frames: one large file is
read by many tasks, some megabytes at a time.  As a stream it remembers how many frames of each
file were taken; files may be new or may have grown, and an incomplete last frame
waits for its rest.

The sink writes binary records.  Tasks write files that nobody reads yet; the driver then
moves them to names made of batch and task, and lists them in one small file for the
batch.  A batch that is listed is never written again, so a stream that is restarted
repeats nothing, and files in the order of their names are the records in order.

Both reach storage through Arrow's file systems (local paths, s3, gs, hdfs).  Paths that only
Spark's own readers open are for :func:`~.frames.read_raw` and Spark's text writer.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..functions.constants import SIZE
from ..functions.runtime import batch_rows, ship
from ..operators.hashing import BYTES, FRAMES
from .frames import frame_bytes

SOURCE, SINK = "lumisieve-frames", "lumisieve-records"
#: Bytes of frames that one task reads, unless the option partitionBytes says otherwise.
PARTITION_BYTES = 128 << 20
#: Bytes of frames that a reader holds.
READ_BYTES = 8 << 20


def storage(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def data_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files below a folder whose names begin with a letter or digit."""
    fs, at = storage(path)
    found = fs.get_file_info(at)
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.is_file:
        return [(at, found.size)]
    every = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in every if f.is_file and not any(x[:1] in "._" for x in f.path[len(at) :].strip("/").split("/")))


@dataclass
class Span(InputPartition):
    """Frames first to last (not included) of a file; or the error that it ends in."""

    path: str
    first: int
    last: int
    error: str | None = None


def _spans(path: str, first: int, last: int, size: int, limit: int) -> list[Span]:
    step = max(1, limit // size)
    return [Span(path, a, min(last, a + step)) for a in range(first, last, step)]


class _Frames:
    """What the batch reader and the stream reader share."""

    def __init__(self, options: dict):
        self.path, self.fmt = options["path"], options.get("frames", "luma8")
        self.size = frame_bytes(self.fmt)
        self.limit = int(options.get("partitionBytes", PARTITION_BYTES))
        self.permissive = options.get("permissive", "false").lower() == "true"

    def read(self, partition: Span):
        names = ["path", "frame_idx", "fmt", "pixels", "error"]
        row = lambda idx, pixels, error: pa.RecordBatch.from_arrays([pa.array([partition.path] * len(idx)), pa.array(idx, pa.int64()), pa.array([self.fmt] * len(idx)), pixels, pa.array([error] * len(idx), pa.string())], names)
        if partition.error:
            yield row([None], pa.array([None], pa.binary()), partition.error)
            return
        fs, at = storage(self.path)
        step = max(1, min(FRAMES, READ_BYTES // self.size))
        with fs.open_input_file(partition.path) as f:
            for a in range(partition.first, partition.last, step):
                b = min(partition.last, a + step)
                raw = f.read_at((b - a) * self.size, a * self.size)
                if len(raw) != (b - a) * self.size:
                    raise EOFError(f"{partition.path} has become shorter while it was read")
                ends = np.arange(b - a + 1, dtype=np.int32) * self.size
                yield row(range(a, b), pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(raw)]), None)


class FrameReader(_Frames, DataSourceReader):
    def partitions(self) -> list[Span]:
        out, line = [], SIZE * BYTES[self.fmt]
        for path, length in data_files(self.path):
            out += _spans(path, 0, length // self.size, self.size, self.limit)
            if length % self.size % line:  # rows of a frame that are whole are dropped with it
                message = f"unexpected end of file inside a row: {path}"
                if not self.permissive:
                    raise EOFError(message)
                out.append(Span(path, 0, 0, message))
        return out


class FrameStreamReader(_Frames, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"frames": {}}

    def latestOffset(self) -> dict:
        return {"frames": {path: length // self.size for path, length in data_files(self.path) if length >= self.size}}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        before = start.get("frames", {})
        return [s for path, n in sorted(end.get("frames", {}).items()) for s in _spans(path, before.get(path, 0), n, self.size, self.limit)]


class FrameSource(DataSource):
    """Options: path, frames (luma8, rgb8, rgba8), permissive, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return "path string, frame_idx long, fmt string, pixels binary, error string"

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def streamReader(self, schema) -> FrameStreamReader:
        return FrameStreamReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    temporary: str
    records: int
    size: int


class _Records:
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.batch = options.get("batch")

    def write(self, iterator) -> Written:
        fs, at = storage(self.path)
        fs.create_dir(f"{at}/_temporary")
        name, n, size = f"{at}/_temporary/{uuid.uuid4().hex}", 0, 0
        with fs.open_output_stream(name) as out:
            for batch in iterator:
                column = batch.column(batch.schema.get_field_index("record")).cast(pa.large_binary())
                if len(column):
                    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                    out.write(column.buffers()[2][int(offs[0]) : int(offs[-1])])
                    n, size = n + len(column), size + int(offs[-1] - offs[0])
        return Written(TaskContext.get().partitionId(), name, n, size)

    def publish(self, messages: list, batch: int) -> None:
        fs, at = storage(self.path)
        fs.create_dir(f"{at}/_batches")
        listed = f"{at}/_batches/{batch:012d}.json"
        written = sorted((m for m in messages if m), key=lambda m: m.partition)
        if fs.get_file_info(listed).is_file:
            return self.discard(written)
        files = []
        for m in written:
            if m.records:
                name = f"{batch:012d}-{m.partition:06d}.bin"
                fs.move(m.temporary, f"{at}/{name}")
                files.append({"file": name, "records": m.records, "bytes": m.size})
        self.discard([m for m in written if not m.records])
        with fs.open_output_stream(f"{listed}.part") as out:
            out.write(json.dumps({"batch": batch, "files": files}).encode())
        fs.move(f"{listed}.part", listed)

    def discard(self, messages: list) -> None:
        fs, _ = storage(self.path)
        for m in messages:
            if m and fs.get_file_info(m.temporary).is_file:
                fs.delete_file(m.temporary)


class RecordWriter(_Records, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        fs, at = storage(self.path)
        if self.overwrite:
            for name in [f"_batches/{b:012d}.json" for b in sorted(manifest(self.path))]:
                fs.delete_file(f"{at}/{name}")
        self.publish(messages, int(self.batch) if self.batch else 1 + max(manifest(self.path), default=-1))

    def abort(self, messages: list) -> None:
        self.discard(messages)


class RecordStreamWriter(_Records, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.publish(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self.discard(messages)


class RecordSink(DataSource):
    """Takes rows with a binary column ``record``.  Options: path; batch, a number under which a batch is written once."""

    @classmethod
    def name(cls) -> str:
        return SINK

    def schema(self) -> str:
        return "record binary"

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> RecordStreamWriter:
        return RecordStreamWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FrameSource)
    spark.dataSource.register(RecordSink)


def _frames(rows: DataFrame, permissive: bool) -> DataFrame:
    names = [F.xxhash64("path", F.col("frame_idx").cast("int")).alias("image_id"), "frame_idx", "fmt", "pixels", "path", *(["error"] if permissive else [])]
    return rows.select(*names)


def read_frames(spark: SparkSession, path: str, fmt: str = "luma8", permissive: bool = False, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Frames (image_id, frame_idx, fmt, pixels, path) of headerless files of any length; permissive adds ``error``."""
    frame_bytes(fmt)
    register(spark), batch_rows(spark, FRAMES)
    rows = spark.read.format(SOURCE).option("frames", fmt).option("permissive", str(permissive).lower()).option("partitionBytes", partition_bytes).load(path)
    return _frames(rows, permissive)


def stream_frames(spark: SparkSession, path: str, fmt: str = "luma8", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The same, as a stream of new files and of what files have grown by."""
    frame_bytes(fmt)
    register(spark), batch_rows(spark, FRAMES)
    return _frames(spark.readStream.format(SOURCE).option("frames", fmt).option("partitionBytes", partition_bytes).load(path), False)


def manifest(path: str) -> dict[int, list[dict]]:
    """Files of each batch that is complete."""
    fs, at = storage(path.rstrip("/"))
    if fs.get_file_info(f"{at}/_batches").type != pafs.FileType.Directory:
        return {}
    out = {}
    for f in fs.get_file_info(pafs.FileSelector(f"{at}/_batches")):
        if f.path.endswith(".json"):
            with fs.open_input_stream(f.path) as s:
                x = json.loads(s.read())
            out[x["batch"]] = x["files"]
    return out


def record_files(path: str) -> list[str]:
    """Paths of all complete files, in the order of batches and tasks."""
    return [f"{path.rstrip('/')}/{f['file']}" for _, files in sorted(manifest(path).items()) for f in files]
