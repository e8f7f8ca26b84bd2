"""Counters of sessions, in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(events: DataFrame, by: str = "stream_id", at: str = "ts") -> DataFrame:
    """(by, n_events, detections, reconnects, uptime_s); the same aggregate for a table and for a stream."""
    e = F.col("event_type")
    us = F.unix_micros(F.col(at).cast("timestamp"))
    return events.groupBy(by).agg(F.count("*").alias("n_events"), F.count_if(e == "purchase").alias("detections"), F.count_if(e == "error").alias("reconnects"), ((F.max(us) - F.min(us)) / 1000000.0).alias("uptime_s"))


def latest(stream: DataFrame, path: str) -> DataFrame:
    """Runs a bounded aggregate stream to its end; the last micro-batch's whole result, read back."""
    names: list[str] = []

    def keep(df: DataFrame, n: int) -> None:
        names.append(f"{path}/out-{n}-{uuid.uuid4().hex}")
        df.write.parquet(names[-1])

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(names[-1]) if names else stream.sparkSession.createDataFrame([], stream.schema)
