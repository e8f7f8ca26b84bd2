"""Detections on streams of any length: a stream is cut into pieces that go to many tasks.

Votes need the window's hops only, so a piece gets those before it besides its
own. Refractory suppression goes from fire to fire, but what a piece needs to know
of all before it is small: how many of its first hops are still blocked, 0 to
`hops`. So a piece is summed up as a function from that number to the same number
for the next piece, a list of hops + 1 numbers. Functions of neighbouring pieces
are composed by doubling, in as many rounds as the number of pieces has binary
digits; then every piece knows where it may fire first, and all fire at once.

Hops of a stream are numbered without gaps. A piece is longer than the window
and the blocked time. Nulls in `hop` or `prob` aren't allowed. Empty streams have
no fires.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.detect import fire_times
from tidewell.operators.ranks import written

#: Hops of a piece.
PIECE = 1 << 16


def candidates(stream: DataFrame, theta, k: int, window: int, by: tuple[str, ...] = ("stream_id",), piece: int = PIECE) -> DataFrame:
    """(by..., hop, piece) of hops with at least k of the window's scores over theta."""
    home = F.floor(F.col("hop") / piece)
    next_too = F.col("hop") % piece > piece - window
    rows = stream.select(*by, "hop", "prob", home.alias("home"), F.explode(F.when(next_too, F.array(home, home + 1)).otherwise(F.array(home))).alias("piece"))
    w = Window.partitionBy(*by, "piece").orderBy("hop").rowsBetween(1 - window, 0)
    votes = rows.withColumns({"n": F.sum((F.col("prob") > theta).cast("int")).over(w), "m": F.count("*").over(w)})
    return votes.where((F.col("m") == window) & (F.col("n") >= k) & (F.col("home") == F.col("piece"))).select(*by, F.col("hop").cast("long").alias("hop"), "piece")


def exits(at: np.ndarray, hops: int, size: int) -> list[int]:
    """For 0 to `hops` blocked hops at the begin: how many are blocked behind the piece. at: sorted places of candidates in it."""
    after = np.searchsorted(at, at + hops)
    end = np.empty(len(at), np.int64)
    for i in range(len(at) - 1, -1, -1):  # the last fire that follows from each
        end[i] = end[after[i]] if after[i] < len(at) else at[i]
    first = np.searchsorted(at, np.arange(hops + 1))
    return [max(0, int(end[i]) + hops - size) if i < len(at) else 0 for i in first.tolist()]


def refractory(cand: DataFrame, hops: int, by: tuple[str, ...] = ("stream_id",), piece: int = PIECE) -> DataFrame:
    """(by..., hop) of the candidates (by..., hop, piece) that fire: the first, and each at least `hops` after the last that fired."""
    if hops > piece:
        raise ValueError("a piece must be longer than the blocked time")
    cand = written(cand, "candidates")
    kinds = [cand.schema[c] for c in by]
    names = [f"{f.name} {f.dataType.simpleString()}" for f in kinds]

    def summed(t: pa.Table) -> pa.Table:
        at = np.sort(t["hop"].to_numpy()) - t["piece"][0].as_py() * piece
        return t.select([*by, "piece"]).slice(0, 1).append_column("f", pa.array([exits(at, hops, piece)], pa.list_(pa.int64())))

    found = cand.groupBy(*by, "piece").applyInArrow(summed, ", ".join([*names, "piece long", "f array<long>"]))
    each = Window.partitionBy(*by).orderBy("piece")
    free = F.coalesce(F.lead("piece").over(each) > F.col("piece") + 1, F.lit(False))  # a piece without candidates is between: nothing stays blocked
    now = written(found.select(*by, "piece", F.row_number().over(each).alias("i"), F.when(free, F.transform("f", lambda x: F.lit(0).cast("long"))).otherwise(F.col("f")).alias("f")), "pieces")
    most, far = now.agg(F.max("i")).first()[0] or 0, 1
    while far < most:  # f of i: from the begin of piece i - 2 far + 1 to the end of piece i
        left = now.select(*by, (F.col("i") + far).alias("i"), F.col("f").alias("g"))
        both = now.alias("a").join(left.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "i")], "left")
        now = written(both.select(*[F.col(f"a.{c}") for c in (*by, "piece", "i")], F.when(F.col("g").isNull(), F.col("f")).otherwise(F.transform("g", lambda x: F.get("f", x.cast("int")))).alias("f")), "pieces")
        far *= 2
    blocked = now.select(*by, "piece", F.lag(F.get("f", F.lit(0)), 1, 0).over(each).alias("blocked"))

    def fire(t: pa.Table, state: pa.Table) -> pa.Table:
        at = np.sort(t["hop"].to_numpy())
        start = t["piece"][0].as_py() * piece + state["blocked"][0].as_py()
        fires = at[fire_times(np.zeros(len(at), np.int64), at, hops, int(np.searchsorted(at, start)))]
        return pa.table([*(pa.array([t[c][0].as_py()] * len(fires), t.schema.field(c).type) for c in by), pa.array(fires, pa.int64())], names=[*by, "hop"])

    return cand.groupBy(*by, "piece").cogroup(blocked.groupBy(*by, "piece")).applyInArrow(fire, ", ".join([*names, "hop long"]))


def detect(stream: DataFrame, theta, k: int, window: int, hops: int, by: tuple[str, ...] = ("stream_id",), piece: int = PIECE) -> DataFrame:
    """The fires of `operators.detect.detect`, for streams that no task could hold."""
    return refractory(candidates(stream, theta, k, window, by, piece), hops, by, piece)
