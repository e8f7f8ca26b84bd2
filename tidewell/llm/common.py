"""What the operators share: shared working folder, table access, let-binding of columns."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: 0x20 and 0x09-0x0D.
SPACE_CLASS = r"[ \t\n\x0B\f\r]"


#: Rows of an Arrow batch: texts are long.
ARROW_ROWS = 2000

_KEPT: dict = {}


def tidy() -> None:
    """Drops what this Python worker keeps, and gives freed memory back to the system."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def kept(name: str, make):
    """What this Python worker keeps under a name; one thing at a time, so operators that share workers don't add up."""
    if name not in _KEPT:
        tidy()
        _KEPT[name] = make()
    return _KEPT[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by Spark's own reader (the folder may be in any store).

    A table of fewer files than cores that Spark would read in no more tasks than cores (a small one, mostly in one row
    group) is dealt out to all cores first; larger ones are read as they lie.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() <= cores:
        return df.repartition(cores)
    return df


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,]*(,\s*\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tidewell/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewell_stash = path
    return out


def unstash(df: DataFrame) -> None:
    """Delete a stashed table that nothing reads any more; any other DataFrame is left alone."""
    path = getattr(df, "_tidewell_stash", None)
    if isinstance(path, str):
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]
