"""Audio and text sources and sinks: WAV files, chunked replay, matrices, manifests."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tidewell import params as P
from tidewell.functions.signal import printed, upto, zeros
from tidewell.sources.files import listing


def wav_bytes(pcm: np.ndarray, rate: int = P.SAMPLE_RATE) -> bytes:
    data = np.asarray(pcm, "<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def wav_samples(raw: bytes, rate: int = P.SAMPLE_RATE) -> np.ndarray:
    """Samples in [-1, 1), channels averaged; raises unless it is 16-bit PCM of the rate."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = raw[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if form is None or data is None or form[0] not in (1, 0xFFFE) or form[5] != 16:
        raise ValueError("only 16-bit PCM is read")
    if form[2] != rate:
        raise ValueError(f"rate is {form[2]}, not {rate}")
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2").reshape(-1, form[1]).astype(np.float64).mean(axis=1) / 32768


@F.pandas_udf(T.BinaryType())
def encode_wav(pcm: pd.Series) -> pd.Series:
    return pcm.map(lambda x: None if x is None else wav_bytes(x))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode_wav(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else wav_samples(x).tolist())


def read_wavs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, samples) of a folder's visible WAV files, sorted by path; a folder without any, or none at all, gives no rows."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, name string, samples array<double>")
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return files.select("path", name, "content").where(~F.col("name").startswith(".")).select("path", "name", decode_wav("content").alias("samples")).orderBy("path")


def read_manifest(spark: SparkSession, sources: list[tuple[str, int, str]], words: list[tuple[str, int, str]] = ()) -> DataFrame:
    """(path, label_index, source, word) of labelled folders; `words` are folders with one folder of files a word, whose
    name becomes `word` (those that begin with _ or . are left out). Folders that aren't there add nothing."""
    out = spark.createDataFrame([], "path string, label_index int, source string, word string")
    none = F.lit(None).cast("string")
    for folder, label, source in sources:
        out = out.unionByName(listing(spark, folder).select("path", F.lit(label).alias("label_index"), F.lit(source).alias("source"), none.alias("word")))
    word = F.element_at(F.split("path", "/"), -2)
    for folder, label, source in words:
        files = listing(spark, f"{folder.rstrip('/')}/*").select("path", F.lit(label).alias("label_index"), F.lit(source).alias("source"), word.alias("word"))
        out = out.unionByName(files.where(~F.col("word").rlike("^[_.]")))
    return out


MANIFEST = "file STRING, label STRING, mic STRING, session STRING, n INT, prompt STRING, cond STRING, device_index INT, device STRING, duration_s DOUBLE, rms_dbfs DOUBLE, peak_dbfs DOUBLE, recorded_at TIMESTAMP_NTZ, redo INT"


def read_capture_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The CSV manifest; of rows of one file the last wins (redone takes append rows): by time of recording, then by the
    time the part file was written and the place in it."""
    rows = spark.read.schema(MANIFEST).csv(path, header=True)
    rows = rows.withColumns({"_t": F.col("_metadata.file_modification_time"), "_f": F.col("_metadata.file_path"), "_o": F.monotonically_increasing_id()})
    w = Window.partitionBy("file").orderBy(F.col("recorded_at").desc_nulls_last(), F.desc("_t"), F.desc("_f"), F.desc("_o"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_t", "_f", "_o", "_r")


def read_matrix(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(path, m) of text matrices: lines of comma-separated values, or one flat list, as rows of `width`."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    flat = F.transform(F.filter(F.split(F.trim("value"), r"[,\s]+"), lambda x: x != ""), lambda x: x.cast("double"))
    m = F.transform(upto(F.floor(F.size("f") / width)), lambda i: F.slice("f", i * width + 1, F.lit(width)))
    return text.select("path", flat.alias("f")).select("path", F.when(F.size("f") % width == 0, m).otherwise(F.raise_error(F.lit("the matrix has another width"))).alias("m"))


def matrix_lines(df: DataFrame, key: str, m: str) -> DataFrame:
    """Lines of a matrix as text, eight decimals in scientific form."""
    return df.select(key, F.posexplode(m).alias("row", "v")).select(key, "row", F.array_join(printed(F.col("v"), "%.8e"), ",").alias("line"))


def chunks(df: DataFrame, key: str, size: int = P.HOP_SAMPLES) -> DataFrame:
    """(key, chunk, n_samples, samples) of arrays in chunks, the last one zero-padded."""
    n = F.ceil(F.size("samples") / size)
    rows = df.select(key, "samples", F.explode(upto(n)).alias("chunk")).select(key, "chunk", F.slice("samples", F.col("chunk") * size + 1, F.lit(size)).alias("c"))
    return rows.select(key, "chunk", F.size("c").alias("n_samples"), F.concat("c", zeros(F.lit(size) - F.size("c"))).alias("samples"))


class _WavWrite(DataSourceArrowWriter):
    """Tasks write their files into the write's own folder, and list them in a file of their own; the driver gets the lists'
    names alone. If the write fails, its folder goes."""

    def __init__(self, folder: str, run: str):
        self.folder, self.run = folder, run
        at, base = self._open()
        at.create_dir(base, recursive=True)

    def _open(self):
        at, base = fs.FileSystem.from_uri(self.folder)
        return at, f"{base}/_written/{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        at, base = self._open()
        path, rows = f"{base}/{uuid.uuid4().hex}.json", []
        for b in iterator:
            for name, raw in zip(b.column("name").to_pylist(), b.column("wav").to_pylist(), strict=True):
                if not name or "/" in name or raw is None:
                    raise ValueError(f"a file needs a plain name and bytes: {name!r}")
                part = f"{uuid.uuid4().hex}.part"
                with at.open_output_stream(f"{base}/{part}") as f:
                    f.write(raw)
                rows.append({"name": name, "bytes": len(raw), "part": part})
        with at.open_output_stream(path) as f:
            f.write("".join(json.dumps(x) + "\n" for x in rows).encode())
        return Written(path)

    def abort(self, messages: list) -> None:
        at, base = self._open()
        if at.get_file_info(base).type == fs.FileType.Directory:
            at.delete_dir(base)


@dataclass
class Written(WriterCommitMessage):
    """The list of the files that a task has written."""

    path: str


class WavFiles(DataSource):
    """Sink of rows (name, wav): one file a row, in the folder (a URI that all executors share) of the write `run`."""

    @classmethod
    def name(cls) -> str:
        return "wavs"

    def schema(self) -> str:
        return "name string, wav binary"

    def writer(self, schema, overwrite: bool) -> _WavWrite:
        if overwrite:
            raise ValueError("files are added only")
        return _WavWrite(self.options["path"].rstrip("/"), self.options["run"])


def write_wavs(df: DataFrame, folder: str) -> DataFrame:
    """Writes (name, wav) rows as WAV files of a folder (a URI that all executors share); what is there already stays, but
    for files of the same names. Returns (name, bytes) of the files, read from the tasks' lists.

    A write that fails leaves no file. Once all are whole, tasks give them their names; one that runs twice finds those
    that have them already."""
    spark, run, folder = df.sparkSession, uuid.uuid4().hex, folder.rstrip("/")
    spark.dataSource.register(WavFiles)
    df.select("name", F.col("wav").cast("binary").alias("wav")).write.format("wavs").option("run", run).mode("append").save(folder)
    try:
        listed = spark.read.schema("name string, bytes long, part string").json(f"{folder}/_written/{run}/*.json")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "name string, bytes long")

    def named(batches):
        at, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if at.get_file_info(f"{base}/_written/{run}/{part}").type == fs.FileType.File:
                    at.move(f"{base}/_written/{run}/{part}", f"{base}/{name}")
            yield b.select(["name"])

    listed.select("name", "part").mapInArrow(named, "name string").write.format("noop").mode("overwrite").save()
    return listed.select("name", "bytes")


def append_csv(df: DataFrame, folder: str) -> None:
    """Appends part files that each have the header."""
    df.write.mode("append").option("header", True).csv(folder)


def write_metrics(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(name, sha256, length) of a folder's files."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length")


def fan_out(stream: DataFrame, sinks: list, checkpoint: str):
    """Writes every micro-batch to all sinks (functions of a DataFrame and a batch number); a failing sink is dropped, the others go on."""
    live = list(sinks)

    def each(df: DataFrame, n: int) -> None:
        for s in list(live):
            try:
                s(df, n)
            except Exception:  # noqa: BLE001  a dead client must not stop the others
                live.remove(s)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
