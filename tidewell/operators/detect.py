"""Detections on score streams: votes in windows, refractory suppression, scoring, sweeps.

A stream is rows (stream_id, hop, prob). All windows are partitioned by stream.
Refractory suppression depends on its own output, so no window function gives
it; it is a fold over a stream's candidates in order. They come in Arrow batches
sorted by hop, and the last fire alone is held: time and memory don't depend on
how dense the candidates are. A stream is one group; streams are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell import params as P


def events_as_stream(events: DataFrame) -> DataFrame:
    """Rows of an event table as streams: one for each user, hops in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("stream_id"), (F.row_number().over(w) - 1).cast("int").alias("hop"), F.col("value").alias("prob"), "event_type", "ts", "event_id")


def votes(stream: DataFrame, theta: Column | float, window: int, centred: bool = False, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """With `n_over`: how many of the window's scores exceed theta (ties don't), null where the window isn't full."""
    lo, hi = (-(window // 2), window - 1 - window // 2) if centred else (1 - window, 0)
    w = Window.partitionBy(*by).orderBy("hop").rowsBetween(lo, hi)
    over = F.sum((F.col("prob") > theta).cast("int")).over(w)
    return stream.withColumn("n_over", F.when(F.count("*").over(w) == window, over))


def candidates(stream: DataFrame, theta, k: int, window: int, centred: bool = False, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    return votes(stream, theta, window, centred, by).where(F.col("n_over") >= k)


def fire_times(group: np.ndarray, hops: np.ndarray, refractory_hops: int, first: int = 0) -> np.ndarray:
    """Positions of the candidates that fire, of candidates sorted by (group, hop): from each fire the next is the first that
    is late enough, or the next group's first. `first` is the first that may fire."""
    place = group * (int(hops.max()) + refractory_hops + 1) + hops if len(hops) else hops
    after = np.maximum(np.searchsorted(place, place + refractory_hops), np.arange(1, len(place) + 1)).tolist()
    out, i = [], first
    while i < len(after):
        out.append(i)
        i = after[i]
    return np.array(out, np.int64)


def refractory(cand: DataFrame, hops: int, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """(by..., hop) of the candidates that fire: the first, and each at least `hops` after the last that fired."""
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column(n).to_numpy().astype(np.int64)
            new = np.zeros(len(at), bool)
            for c in b.columns[:n]:
                a, z = c[1:], c[:-1]
                other = pc.or_kleene(pc.not_equal(a, z), pc.not_equal(a.is_null(), z.is_null()))
                new[1:] |= pc.fill_null(other, False).to_numpy(zero_copy_only=False)
            group = np.cumsum(new)
            key, first = tuple(c[0].as_py() for c in b.columns[:n]), 0
            if key == last_key:
                mine = int(np.searchsorted(group, 1))
                first = int(np.searchsorted(at[:mine], last + hops))
            fires = fire_times(group, at, hops, first)
            end = tuple(c[b.num_rows - 1].as_py() for c in b.columns[:n])
            if len(fires) and group[fires[-1]] == group[-1]:
                last = int(at[fires[-1]])
            last_key = end
            yield b.take(pa.array(fires))

    rows = cand.select(*by, "hop").repartition(*by).sortWithinPartitions(*by, "hop")
    return rows.mapInArrow(run, rows.schema)


def detect(stream: DataFrame, theta=P.THETA, k: int = P.K, window: int = P.WINDOW, hops: int = P.REFRACTORY, centred: bool = False, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    return refractory(candidates(stream, theta, k, window, centred, by), hops, by)


def score(fires: DataFrame, intervals: DataFrame, hours: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each `by`: fires inside no interval (false), intervals without a fire (missed), rates.

    fires (stream_id, hop, by...), intervals half-open (stream_id, start_hop,
    end_hop), hours (by..., hours), a small table with one row for each `by`.
    Starts and fires of a stream are swept in order of hops: a fire lies in an
    interval if the farthest end of those that began reaches behind it, and an
    interval is found if the next fire from its start on comes before its end.
    """
    begins = intervals.select("stream_id", F.col("start_hop").alias("hop"), F.lit(0).alias("kind"), F.col("end_hop").alias("end"))
    begins = begins.crossJoin(F.broadcast(hours.select(*by))) if by else begins
    points = fires.select("stream_id", "hop", F.lit(1).alias("kind"), F.lit(None).cast(begins.schema["end"].dataType).alias("end"), *by)
    each = Window.partitionBy(*by, "stream_id").rowsBetween(Window.unboundedPreceding, 0)
    swept = begins.unionByName(points).withColumn("reach", F.max("end").over(each.orderBy("hop", "kind")))
    swept = swept.withColumn("next", F.min(F.when(F.col("kind") == 1, F.col("hop"))).over(each.orderBy(F.desc("hop"), F.desc("kind"))))
    fire = F.col("kind") == 1
    n = swept.groupBy(*by).agg(F.count_if(fire).alias("n_fires"), F.count_if(fire & ~F.coalesce(F.col("reach") > F.col("hop"), F.lit(False))).alias("n_false"), F.count_if(~fire & (F.col("next") < F.col("end"))).alias("n_found"))
    out = hours.crossJoin(intervals.agg(F.count("*").alias("n_keywords")))
    out = (out.join(n, list(by), "left") if by else out.crossJoin(n)).fillna(0, ["n_fires", "n_false", "n_found"])
    missed = F.col("n_keywords") - F.col("n_found")
    frr = F.when(F.col("n_keywords") > 0, missed / F.col("n_keywords")).otherwise(0.0)
    return out.select(*by, (F.col("n_false") / F.greatest("hours", F.lit(1e-9))).alias("far_per_hour"), frr.alias("frr"), (1 - frr).alias("tpr"), "n_fires", "n_keywords", "n_false", missed.alias("n_missed"))


def operating_point(grid: DataFrame, most: float = 1.0) -> DataFrame:
    """The highest threshold with a false rate of at most `most`, else the lowest false rate (the first on ties)."""
    ok = F.col("far_per_hour") <= most
    return grid.orderBy(ok.desc(), F.when(ok, F.col("theta")).desc_nulls_last(), F.col("far_per_hour"), F.col("theta")).limit(1)


def recommended(grid: DataFrame, most: float = 1.0) -> DataFrame:
    """The policy of least latency among those with a false rate of at most `most`, else the lowest false rate."""
    ok = F.col("far_per_hour") <= most
    return grid.orderBy(ok.desc(), F.when(ok, F.col("latency_ms")).asc_nulls_last(), F.col("far_per_hour"), "ordinal").limit(1)
