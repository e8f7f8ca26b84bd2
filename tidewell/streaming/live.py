"""Stateful processors of live channels: utterances and their transcripts, the shown state, a bounded outbound buffer.

Rows of a channel are taken in order of (at, place) within a micro-batch; a row
that is older than one taken before is left out, so a stream cut into other
micro-batches gives the same result as long as its rows come in order of time. Timers
run on event time, to the millisecond: what is due before a row is done before it,
and what is due when no row comes is done once the watermark has passed it. Channels
share groups (`shards`), whose timeout is the first timer of any of them.

Nulls: rows without channel or time are left out. A null event is none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidewell.sources import frames
from tidewell.sources.files import remove, shared_folder
from tidewell.streaming import shards

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stateful(spark: SparkSession):
    """Settings with which a stream of the processors starts: their state store, and one part of the state for each core.
    Both stay with the checkpoint of a stream that has begun."""
    own = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Ordered:
    """A processor whose rows are taken one after the other: `step` for a row, `due` for what is over at a time, both give
    output rows. All that it knows of a channel is the dictionary `s`, kept as JSON between micro-batches: the state store is
    asked once for a shard of channels and a micro-batch, not for every row."""

    columns: list[str] = []

    def begin(self) -> dict:
        """What is known of a new channel."""
        raise NotImplementedError

    def step(self, s: dict, at: int, place, event: str, body: str | None) -> list[tuple]:
        raise NotImplementedError

    def due(self, s: dict, at: int) -> list[tuple]:
        """What is over at this time, before the row of this time is taken."""
        return []

    def done(self, s: dict) -> list[tuple]:
        """After the rows of a micro-batch."""
        return []

    def wake_at(self, s: dict) -> int | None:
        """The time (microseconds) at which something is due though no row comes."""
        return None

    def take(self, shard, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, out, mark = shards.known(state), [], state.getCurrentWatermarkMs()
        fresh = {} if state.hasTimedOut else shards.rows(shard, batches, "channel", ["at", "place", "event", "body"])
        for channel, rows in fresh.items():
            last, s = known[channel] if channel in known else (None, self.begin())
            for at, place, event, body in sorted(rows, key=lambda x: (x[0], x[1] is None or x[1] != x[1], x[1])):
                if last is not None and at < last:
                    continue
                last = at
                out += [(channel, *x) for x in self.due(s, at) + self.step(s, at, place, event, body)]
            out += [(channel, *x) for x in self.done(s)]
            known[channel] = (last, s)
        wake = None
        for channel, (_, s) in known.items():
            at = self.wake_at(s)
            if at is not None and -(-at // 1000) <= mark:  # at the first millisecond that isn't before it
                out += [(channel, *x) for x in self.due(s, mark * 1000)]
                at = self.wake_at(s)
            wake = at if wake is None or at is not None and at < wake else wake
        shards.keep(state, known)
        if wake is not None:  # a timeout is over once the watermark is behind it
            state.setTimeoutTimestamp(max(-(-wake // 1000) - 1, mark))
        if out:
            yield pd.DataFrame(out, columns=["channel", *self.columns])


class Utterances(Ordered):
    """From a wake to its end: the segments in between make the transcript; a partial text is passed on if it isn't empty and
    not the one before. A new wake, and a drop of the connection, discard an unfinished utterance; events without a wake are
    ignored; an utterance that hasn't ended `hold` after its wake is an orphan, which is reported and dropped."""

    columns = ["session", "what", "first_at", "end_at", "n", "transcript"]

    def __init__(self, hold: int):
        self.hold = hold

    def begin(self) -> dict:
        return {"sessions": 0, "open": None, "partial": "", "segments": []}

    def _close(self, s: dict) -> None:
        s.update(open=None, partial="", segments=[])

    def _row(self, s: dict, what: str, at: int) -> list[tuple]:
        out = [(s["sessions"], what, s["open"], at, len(s["segments"]), " ".join(s["segments"]))]
        self._close(s)
        return out

    def due(self, s: dict, at: int) -> list[tuple]:
        if s["open"] is not None and at > s["open"] + self.hold:
            return self._row(s, "orphan", s["open"] + self.hold)
        return []

    def wake_at(self, s: dict) -> int | None:
        return None if s["open"] is None else s["open"] + self.hold + 1

    def step(self, s: dict, at: int, place, event: str, body: str | None) -> list[tuple]:
        if event == "wake":
            self._close(s)
            s.update(sessions=s["sessions"] + 1, open=at)
        elif s["open"] is not None:
            if event == "drop":
                self._close(s)
            elif event == "end":
                return self._row(s, "transcript", at)
            elif event == "segment" and body:
                s["segments"].append(body)
            elif event == "partial" and body and body != s["partial"]:
                s["partial"] = body
                return [(s["sessions"], "partial", s["open"], at, len(s["segments"]), body)]
        return []


class Shown(Ordered):
    """The shown state of each channel at every change; states in `holds` fall back to `idle` after so many microseconds."""

    columns = ["since", "state"]

    def __init__(self, holds: dict[str, int], idle: str = "idle"):
        self.holds, self.idle = holds, idle

    def begin(self) -> dict:
        return {"over": None}

    def due(self, s: dict, at: int) -> list[tuple]:
        if s["over"] is not None and at >= s["over"]:
            over, s["over"] = s["over"], None
            return [(over, self.idle)]
        return []

    def wake_at(self, s: dict) -> int | None:
        return s["over"]

    def step(self, s: dict, at: int, place, event: str, body: str | None) -> list[tuple]:
        if not event:
            return []
        s["over"] = at + self.holds[event] if event in self.holds else None
        return [(at, event)]


class Buffer(Ordered):
    """The newest `most` rows of a channel and how many older ones were dropped, after every micro-batch that has rows of it."""

    columns = ["seen", "dropped", "place", "body"]

    def __init__(self, most: int):
        self.most = most

    def begin(self) -> dict:
        return {"seen": 0, "rows": []}

    def step(self, s: dict, at: int, place, event: str, body: str | None) -> list[tuple]:
        s["seen"] += 1
        s["rows"].append((int(place), body))
        if len(s["rows"]) >= 2 * self.most + 1000:  # the buffer is cut now and then
            del s["rows"][: -self.most]
        return []

    def done(self, s: dict) -> list[tuple]:
        s["rows"] = s["rows"][-self.most :]
        return [(s["seen"], s["seen"] - len(s["rows"]), *x) for x in s["rows"]]


def run(rows: DataFrame, processor: Ordered, schema: str) -> DataFrame:
    """Streaming output rows of a processor over streaming rows (channel, at timestamp, place, event, body)."""
    own = rows.where("channel IS NOT NULL AND at IS NOT NULL").withWatermark("at", "0 seconds")
    own = own.select("channel", shards.shard(F.col("channel")), F.unix_micros("at").alias("us"), "place", F.coalesce("event", F.lit("")).alias("event"), "body", "at").withColumnsRenamed({"at": "stamp", "us": "at"})
    return own.groupBy("shard").applyInPandasWithState(processor.take, f"channel long, {schema}", shards.STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replay(messages: DataFrame, parts: int, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (channel, at, text, data) as `parts` commits of frames in order of time, each read by a stream that starts anew
    from its checkpoint; returns what build(stream of frames) gave, read back."""
    spark = messages.sparkSession
    base = f"{shared_folder(spark)}/tidewell-stream/{uuid.uuid4().hex}"
    us = F.unix_micros(F.col("at").cast("timestamp"))
    lo, hi = messages.agg(F.min(us), F.max(us)).first()
    part = F.floor((us - (lo or 0)) * parts / ((hi or 0) - (lo or 0) + 1))
    out = None
    with stateful(spark):
        for n in range(parts):
            frames.append(messages.where(part == n).sortWithinPartitions("at"), f"{base}/in")
            out = build(frames.stream(spark, f"{base}/in"))
            q = out.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").format("parquet").start(f"{base}/out")
            try:  # until all is read, and what is due by then is done: a stream that ends with its data would leave that out
                q.processAllAvailable()
            finally:
                q.stop()
    for name in ("in", "state"):
        remove(spark, f"{base}/{name}")
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def replay_hops(rows: DataFrame, parts: int, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (stream_id, hop, ...) as a stream of `parts` micro-batches in order of hops, each written by all cores and read by
    a stream that starts anew from its checkpoint; returns what build(streaming rows) gave, read back."""
    spark, schema = rows.sparkSession, rows.schema
    base = f"{shared_folder(spark)}/tidewell-stream/{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/rows")  # hops are numbered once, not for every micro-batch
    rows = spark.read.schema(schema).parquet(f"{base}/rows")
    last = rows.agg(F.max("hop")).first()[0] or 0
    out = None
    with stateful(spark):
        for n in range(parts):
            rows.where(F.floor(F.col("hop").cast("long") * parts / (last + 1)) == n).write.mode("append").parquet(f"{base}/in")
            out = build(spark.readStream.schema(schema).parquet(f"{base}/in"))
            out.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").start(f"{base}/out").awaitTermination()
    for name in ("rows", "in", "state"):
        remove(spark, f"{base}/{name}")
    return spark.read.schema(out.schema).parquet(f"{base}/out")
