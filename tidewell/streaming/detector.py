"""The detector as a stateful stream: k-of-window votes and refractory suppression for each stream id."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidewell.operators import detect
from tidewell.sources.files import remove, shared_folder

STATE = "recent array<double>, last long, hop long, at long"


def detector(theta: float, k: int, window: int, refractory: int):
    """State update for applyInPandasWithState: keeps the last `window` scores, the last fire, the hop count, and the time of
    the last row. A row that is older than one taken before is left out: counted late, it would move all hops behind it."""

    def step(key, batches, state):
        recent, last, hop, at = state.get if state.exists else ([], -1, -1, None)
        recent, fires = list(recent), []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        us = rows["ts"].astype("datetime64[us]").astype("int64")
        own = us >= at if at is not None else us.notna()
        at = int(us.max()) if at is None else max(int(at), int(us.max()))
        for p in rows.loc[own, "value"]:
            hop += 1
            recent = [*recent, float(p)][-window:]
            if len(recent) == window and sum(x > theta for x in recent) >= k and (last < 0 or hop - last >= refractory):
                last = hop
                fires.append(hop)
        state.update((recent, int(last), int(hop), at))
        yield pd.DataFrame({"stream_id": [key[0]] * len(fires), "hop": fires})

    return step


def fires(events: DataFrame, theta: float, k: int, window: int, refractory: int) -> DataFrame:
    """Streaming rows (stream_id, hop); events arrive in order of time for each user."""
    return events.groupBy("user_id").applyInPandasWithState(detector(theta, k, window, refractory), "stream_id long, hop long", STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_levels(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str = "10 minutes") -> DataFrame:
    """Streaming sliding-window levels with a watermark. Time is cast from a zoneless timestamp, which a watermark doesn't take."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", size, slide), "event_type").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a bounded stream to its end into a table of the shared folder, and reads it."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/tidewell-stream/{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").start(f"{path}/out").awaitTermination()
    remove(spark, f"{path}/state")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def compare(spark: SparkSession, path: str, theta: float, k: int, window: int, refractory: int) -> DataFrame:
    """(stream_id, n_stream, n_batch, same): the same events as a stream and as a table."""
    batch = spark.read.parquet(path)
    events = spark.readStream.schema(batch.schema).parquet(path if path.endswith("/") else f"{path}*")
    live = run_to_table(fires(events, theta, k, window, refractory))
    a = live.groupBy("stream_id").agg(F.count("*").alias("n_stream"), F.sum(F.xxhash64("hop").cast("decimal(38,0)")).alias("x"))
    b = detect.detect(detect.events_as_stream(batch), theta, k, window, refractory).groupBy("stream_id").agg(F.count("*").alias("n_batch"), F.sum(F.xxhash64(F.col("hop").cast("long")).cast("decimal(38,0)")).alias("y"))
    return a.join(b, "stream_id", "full").select("stream_id", F.coalesce("n_stream", F.lit(0)).alias("n_stream"), F.coalesce("n_batch", F.lit(0)).alias("n_batch"), F.col("x").eqNullSafe(F.col("y")).alias("same"))
