"""Listings and decoded records: JSON tables, faulty events, held-out files, missing files, single matches."""

from __future__ import annotations

import re
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.signal import zeros


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file that holds one JSON array (or one object), by Spark's reader."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer files than cores that Spark would read in no more tasks than cores (a small table, mostly in one row
    group) dealt out to all cores; any larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() <= cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,]*(,\s*\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def listing(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """(path, name, length) of a folder's visible files, one level; a folder that isn't there has none."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, name string, length long")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), "length").where(~F.col("name").startswith("."))


def decoded(rows: DataFrame, raw: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the decoded `value`, and the rows that hold no such JSON object, with `_corrupt_record`."""
    value = F.from_json(raw, f"{schema}, _corrupt_record STRING", {"mode": "PERMISSIVE"})
    out = rows.withColumn("value", value)
    bad = F.col("value").isNull() | F.col("value._corrupt_record").isNotNull()
    return out.where(~bad).withColumn("value", F.col("value").dropFields("_corrupt_record")), out.where(bad).select(*rows.columns, F.coalesce(F.col("value._corrupt_record"), F.col(raw)).alias("_corrupt_record"))


def held(listed: DataFrame, session: str, which) -> DataFrame:
    """Rows of the held-out session."""
    return listed.where(F.col(session) == which)


def missing(needed: DataFrame, there: DataFrame, on: str) -> DataFrame:
    """The needed rows that aren't there."""
    return needed.join(there.select(on), on, "left_anti")


def report(records: DataFrame, there: DataFrame, on: str) -> DataFrame:
    """The records with `missing`: whether their file isn't listed. there: distinct values."""
    return records.join(there.select(on, F.lit(True).alias("_there")), on, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def single(listed: DataFrame, pattern: str, by: str = "name") -> DataFrame:
    """The one row whose name fits; none and several raise an error when the result is read."""
    hits = listed.where(F.col(by).rlike(pattern))
    n = hits.agg(F.count("*").alias("n"), F.first(F.struct(*[F.col(c) for c in listed.columns])).alias("row"))
    what = F.when(F.col("n") == 0, F.lit(f"no file fits {pattern}")).otherwise(F.concat(F.col("n"), F.lit(f" files fit {pattern}")))
    return n.select(F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(what)).alias("row")).select("row.*")


def fit_at_end(x: Column, n: int) -> Column:
    """The first n values, padded with zeros behind them."""
    return F.concat(F.slice(x, 1, n), zeros(F.lit(n) - F.least(F.size(x), F.lit(n))))
