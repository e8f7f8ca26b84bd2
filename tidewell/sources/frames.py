"""Framed messages of many channels as a table and as a stream: JSON text frames and binary PCM frames.

A folder (a URI that all executors share) holds files of frames, each write's in
a folder of its own, and in `_commits` one small JSON file for each commit,
numbered from 0, that names the files it adds. A write is there with its commit,
or not at all: if it fails its folder is deleted, and what a lost executor may
leave behind no commit names. A stream's offset is the number of commits; a
commit's files are the partitions of the scan, so a restart from a checkpoint
goes on behind the last commit that was read. One writer at a time adds to a
folder.

A frame: kind (T text, B binary), channel and time (microseconds) as 64-bit
numbers, length of the body as 32 bits, little-endian, and the body. Rows are
(channel, at, place, text, data); `place` numbers a file's frames, text is null
in binary frames and data in text frames. A file that ends within a frame, or
holds another kind, is damaged: reading it raises an error that names it.

Nulls: a row with neither text nor data, or without channel or time, can't be a
frame: writing it fails. Rows with both give the text. Empty tables add a commit
without files.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from tidewell.functions.signal import upto
from tidewell.sources.files import decoded

SCHEMA = "channel long, at timestamp, place long, text string, data binary"
ARROW = pa.schema([("channel", pa.int64()), ("at", pa.timestamp("us", "UTC")), ("place", pa.int64()), ("text", pa.string()), ("data", pa.binary())])
_HEAD = struct.Struct("<cqqI")
#: Frames of an Arrow batch; bytes that are read or written at once.
ROWS, BLOCK = 2000, 1 << 20


@dataclass
class Files(WriterCommitMessage):
    """The files that a task has written, with their frames."""

    files: list[tuple[str, int]]


@dataclass
class File(InputPartition):
    path: str


class Folder:
    """Files and commits of a folder."""

    def __init__(self, uri: str):
        self.at, self.base = fs.FileSystem.from_uri(uri)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def there(self, name: str) -> bool:
        return self.at.get_file_info(self.path(name)).type == fs.FileType.File

    def commits(self, known: int = 0) -> int:
        """How many commits there are, when at least `known` are."""
        while self.there(f"_commits/{known}.json"):
            known += 1
        return known

    def files(self, start: int, end: int) -> list[str]:
        out = []
        for n in range(start, end):
            with self.at.open_input_stream(self.path(f"_commits/{n}.json")) as f:
                out += [name for name, _ in json.loads(f.read())["files"]]
        return out

    def commit(self, n: int, messages: list) -> None:
        """Names the files under a number: written aside, then moved, so that a commit is whole."""
        files = [list(x) for m in messages if m is not None for x in m.files]
        self.at.create_dir(self.path("_commits"), recursive=True)
        aside = self.path(f"_commits/.{n}-{uuid.uuid4().hex}")
        with self.at.open_output_stream(aside) as f:
            f.write(json.dumps({"files": files, "frames": sum(x[1] for x in files)}).encode())
        self.at.move(aside, self.path(f"_commits/{n}.json"))

    def begin(self) -> str:
        """A folder for the files of a write, made by the driver, so that a task that is late can't make it again."""
        run = f"write-{uuid.uuid4().hex}"
        self.at.create_dir(self.path(run), recursive=True)
        return run

    def end(self, run: str) -> None:
        """Deletes the folder of a write that failed."""
        if self.at.get_file_info(self.path(run)).type == fs.FileType.Directory:
            self.at.delete_dir(self.path(run))

    def write(self, run: str, batches: Iterator[pa.RecordBatch]) -> Files:
        """One file of the frames of a task, or none."""
        name, n, out = f"{run}/{uuid.uuid4().hex}.frames", 0, None
        try:
            for b in batches:
                b = b.select(["channel", "at", "text", "data"]).cast(pa.schema([ARROW.field(c) for c in ("channel", "at", "text", "data")]))
                rows = zip(b.column(0).to_pylist(), b.column(1).cast(pa.int64()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
                for channel, at, text, data in rows:
                    if channel is None or at is None or (text is None and data is None):
                        raise ValueError(f"no frame: channel {channel}, time {at}, without text and data" if channel is not None and at is not None else "a frame needs a channel and a time")
                    if out is None:
                        out = self.at.open_output_stream(self.path(name), buffer_size=BLOCK)
                    body = data if text is None else text.encode()
                    out.write(_HEAD.pack(b"B" if text is None else b"T", channel, at, len(body)) + body)
                    n += 1
        finally:
            if out is not None:
                out.close()
        return Files([(name, n)] if n else [])

    def read(self, name: str) -> Iterator[pa.RecordBatch]:
        rows, place = [], 0
        with self.at.open_input_stream(self.path(name), buffer_size=BLOCK) as f:
            while head := f.read(_HEAD.size):
                kind, channel, at, size = _HEAD.unpack(head) if len(head) == _HEAD.size else (b"?", 0, 0, 0)
                body = f.read(size)
                if kind not in (b"T", b"B") or len(body) < size:
                    raise ValueError(f"{name} is damaged at frame {place}")
                rows.append((channel, at, place, body.decode("utf-8", "replace") if kind == b"T" else None, body if kind == b"B" else None))
                place += 1
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(t) if pa.types.is_timestamp(t) else pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class _Read(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[File]:
        folder = Folder(self.uri)
        return [File(x) for x in folder.files(0, folder.commits())]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from Folder(self.uri).read(partition.path)


class _Stream(DataSourceStreamReader):
    def __init__(self, uri: str, start: int):
        self.uri, self.start, self.known = uri, start, 0

    def initialOffset(self) -> dict:
        return {"commits": self.start}

    def latestOffset(self) -> dict:
        self.known = Folder(self.uri).commits(self.known)
        return {"commits": self.known}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(x) for x in Folder(self.uri).files(start["commits"], end["commits"])]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        yield from Folder(self.uri).read(partition.path)


class _Write(DataSourceArrowWriter):
    def __init__(self, uri: str):
        self.uri, self.run = uri, Folder(uri).begin()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        return Folder(self.uri).write(self.run, iterator)

    def commit(self, messages: list) -> None:
        folder = Folder(self.uri)
        folder.commit(folder.commits(), messages)

    def abort(self, messages: list) -> None:
        Folder(self.uri).end(self.run)


class _StreamWrite(DataSourceStreamArrowWriter):
    """A micro-batch's number is its commit's, so one that is written again after a restart adds nothing."""

    def __init__(self, uri: str):
        self.uri, self.run = uri, Folder(uri).begin()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        return Folder(self.uri).write(self.run, iterator)

    def commit(self, messages: list, batchId: int) -> None:
        folder = Folder(self.uri)
        if folder.there(f"_commits/{batchId}.json"):
            self.abort(messages, batchId)
        else:
            folder.commit(batchId, messages)

    def abort(self, messages: list, batchId: int) -> None:
        """Deletes the files of this micro-batch alone: the folder is that of all the stream's."""
        folder = Folder(self.uri)
        for name in [x for m in messages if m is not None for x, _ in m.files]:
            folder.at.delete_file(folder.path(name))


class Frames(DataSource):
    """spark.read and spark.readStream.format("frames").load(folder), and the same for writing; option `start`: the commit at which a new stream begins."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def _uri(self) -> str:
        return self.options["path"].rstrip("/")

    def reader(self, schema) -> _Read:
        return _Read(self._uri())

    def streamReader(self, schema) -> _Stream:
        return _Stream(self._uri(), int(self.options.get("start", "0")))

    def writer(self, schema, overwrite: bool) -> _Write:
        if overwrite:
            raise ValueError("frames are appended only")
        return _Write(self._uri())

    def streamWriter(self, schema, overwrite: bool) -> _StreamWrite:
        return _StreamWrite(self._uri())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Frames)


def append(rows: DataFrame, folder: str) -> None:
    """Adds rows (channel, at, text, data) as one commit."""
    register(rows.sparkSession)
    rows.select("channel", F.col("at").cast("timestamp").alias("at"), F.lit(None).cast("long").alias("place"), F.col("text").cast("string").alias("text"), F.col("data").cast("binary").alias("data")).write.format("frames").mode("append").save(folder)


def stream(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("frames").load(folder)


def events_of(frames: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Text frames with their decoded `value`, and those that hold no such JSON object, for a table of their own."""
    return decoded(frames.where("text IS NOT NULL"), "text", schema)


def judged(frames: DataFrame, schema: str) -> DataFrame:
    """All frames with `value`, the decoded text, and `bad`, whether a text frame holds no such JSON object; in one pass."""
    value = F.from_json("text", f"{schema}, _corrupt_record STRING", {"mode": "PERMISSIVE"})
    out = frames.withColumn("value", value)
    bad = F.col("text").isNotNull() & (F.col("value").isNull() | F.col("value._corrupt_record").isNotNull())
    return out.withColumn("bad", bad).withColumn("value", F.when(~F.col("bad"), F.col("value").dropFields("_corrupt_record")))


def samples_of(frames: DataFrame) -> DataFrame:
    """With `pcm`, the signed 16-bit samples of binary frames (null in text frames); half a sample at the end is left out."""
    digits = F.hex("data")
    two = lambda at: F.conv(F.substr(digits, at, F.lit(2)), 16, 10).cast("int")
    code = lambda i: two(i * 4 + 1) + 256 * two(i * 4 + 3)
    n = F.floor(F.octet_length("data") / 2).cast("int")
    every = F.transform(upto(n), lambda i: F.transform(F.array(code(i)), lambda v: F.when(v >= 32768, v - 65536).otherwise(v))[0])
    return frames.withColumn("pcm", F.when(F.col("data").isNotNull(), every))


def pcm_bytes(values: list[Column]) -> Column:
    """Little-endian signed 16-bit bytes of some whole numbers."""
    code = lambda v: F.lpad(F.hex(F.pmod(v.cast("long"), F.lit(65536))), 4, "0")
    return F.unhex(F.concat(*[F.concat(F.substring(code(v), 3, 2), F.substring(code(v), 1, 2)) for v in values]))
