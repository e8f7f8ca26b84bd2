"""Utterance sessions in batch: delimiters, latencies, pre-roll, the two-state machine, buffers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell import params as P


def by_marks(rows: DataFrame, begins, by: str, order: list[str]) -> DataFrame:
    """With `session`: the running count of begin marks; rows before the first mark are left out."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("session", F.sum(begins.cast("int")).over(w)).where("session > 0")


def preroll(stream: DataFrame, n: int = P.PREROLL, by: str = "stream_id") -> DataFrame:
    """With `preroll`: the last n scores up to and with this hop."""
    w = Window.partitionBy(by).orderBy("hop").rowsBetween(1 - n, 0)
    return stream.withColumn("preroll", F.collect_list("prob").over(w))


def newest(rows: DataFrame, n: int, by: str, order: list) -> DataFrame:
    """The newest n rows of each group (a bounded buffer that drops the oldest)."""
    w = Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def resumed(rows: DataFrame, old: DataFrame, by: list[str], order: list[str], number: str) -> DataFrame:
    """New rows numbered within their groups, going on from the largest number that the group has in `old`."""
    top = old.groupBy(*by).agg(F.max(number).alias("_top"))
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.join(top, by, "left").withColumn(number, (F.coalesce("_top", F.lit(0)) + n).cast("long")).drop("_top")


def finished(rows: DataFrame, begins, ends, by: str, order: str) -> DataFrame:
    """(by, session, first, end, n) of the sessions that have an end mark; a new begin discards an unfinished one."""
    s = by_marks(rows, begins, by, [order])
    g = s.groupBy(by, "session").agg(F.min(order).alias("first"), F.min(F.when(ends, F.col(order))).alias("end"), F.count("*").alias("n"))
    return g.where("end IS NOT NULL")


def shown_state(rows: DataFrame, now, by: str, order: list[str], at: str, holds: dict[str, float], idle: str = "idle") -> DataFrame:
    """With `state`: the last state set, which falls back to idle once its hold (seconds) is over. now: the state that a row sets, or null."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    us = F.unix_micros(F.col(at).cast("timestamp"))
    state, since = F.last(now, ignorenulls=True).over(w), F.last(F.when(now.isNotNull(), us), ignorenulls=True).over(w)
    out = rows.withColumns({"_state": state, "_since": since})
    over = F.lit(False)
    for name, seconds in holds.items():
        over = over | ((F.col("_state") == name) & (us - F.col("_since") >= int(seconds * 1e6)))
    return out.withColumn("state", F.when(over, F.lit(idle)).otherwise(F.coalesce("_state", F.lit(idle)))).drop("_state", "_since")


class Machine:
    """IDLE until k of the last `window` scores exceed theta and `refractory` idle hops have gone by since the last wake;
    then STREAMING until the level stayed below `silence` for `quiet` hops or `most` hops are over. Idle hops alone count
    and fill the window, which isn't cleared."""

    def __init__(self, theta: float, k: int, window: int, refractory: int, silence: float, quiet: int, most: int):
        self.theta, self.k, self.window, self.refractory, self.silence, self.quiet, self.most = theta, k, window, refractory, silence, quiet, most
        self.recent: list[float] = []
        self.idle, self.last, self.streaming, self.run, self.length = 0, None, False, 0, 0

    def step(self, prob: float, level: float) -> str | None:
        """Takes a hop; `wake`, `end` or None."""
        if self.streaming:
            self.length += 1
            self.run = self.run + 1 if level < self.silence else 0
            if self.run >= self.quiet or self.length >= self.most:
                self.streaming = False
                return "end"
            return None
        self.recent = [*self.recent, prob][-self.window :]
        hop = self.idle
        self.idle += 1
        if len(self.recent) == self.window and sum(p > self.theta for p in self.recent) >= self.k and (self.last is None or hop - self.last >= self.refractory):
            self.last, self.streaming, self.run, self.length = hop, True, 0, 0
            return "wake"
        return None


def utterances(stream: DataFrame, schema_id: str = "long", **policy) -> DataFrame:
    """(stream_id, utterance, wake_hop, end_hop, prob) of the two-state machine; end_hop is null if the stream ends before.

    The state goes from hop to hop, so a stream is one group; its scores go
    through in Arrow batches sorted by hop and the state alone is held.
    """
    p = dict(theta=P.THETA, k=P.K, window=P.WINDOW, refractory=P.REFRACTORY, silence=P.SILENCE_RMS, quiet=P.SILENCE_HOPS, most=P.MAX_HOPS) | policy

    def run(key, batches):
        m, out = Machine(**p), []
        for pdf in batches:
            for hop, prob, level in zip(pdf["hop"], pdf["prob"], pdf["level"], strict=True):
                what = m.step(prob, level)
                if what == "wake":
                    out.append([int(hop), None, float(prob)])
                elif what == "end":
                    out[-1][1] = int(hop)
        yield pd.DataFrame({"stream_id": [key[0]] * len(out), "utterance": range(len(out)), "wake_hop": [o[0] for o in out], "end_hop": pd.array([o[1] for o in out], dtype="Int64"), "prob": [o[2] for o in out]})

    from collections.abc import Iterator

    run.__annotations__ = {"key": tuple, "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    sorted_ = stream.select("stream_id", "hop", "prob", "level").repartition("stream_id").sortWithinPartitions("stream_id", "hop")
    return sorted_.groupBy("stream_id").applyInPandas(run, f"stream_id {schema_id}, utterance long, wake_hop long, end_hop long, prob double")
