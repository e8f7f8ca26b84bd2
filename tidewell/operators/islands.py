"""Gaps and islands: merged runs, the dominant run, silence runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(flagged: DataFrame, gap: Column | int, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Islands of the rows (by..., hop, ...) whose hops follow within `gap`: with column `isle` from 1."""
    w = Window.partitionBy(*by).orderBy("hop")
    begins = F.coalesce(F.col("hop") - F.lag("hop").over(w) > gap, F.lit(True)).cast("int")
    return flagged.withColumn("_begins", begins).withColumn("isle", F.sum("_begins").over(w)).drop("_begins")


def spans(flagged: DataFrame, gap: Column | int, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """(by..., isle, start_hop, end_hop, n) of the islands, end_hop exclusive."""
    return runs(flagged, gap, by).groupBy(*by, "isle").agg(F.min("hop").alias("start_hop"), (F.max("hop") + 1).alias("end_hop"), F.count("*").alias("n"))


def dominant(levels: DataFrame, margin: float = 12.0, below_peak: float = 28.0, dynamic: float = 15.0, gap: int = 30, by: str = "stream_id") -> DataFrame:
    """The island of most summed power in each stream of rows (by, hop, db); streams of little dynamic have none. First on ties."""
    stats = levels.groupBy(by).agg(F.percentile("db", F.lit(0.1)).alias("floor"), F.max("db").alias("top"))
    stats = stats.where(F.col("top") - F.col("floor") >= dynamic).withColumn("limit", F.greatest(F.col("floor") + margin, F.col("top") - below_peak))
    voiced = levels.join(stats, by).select(by, "hop", "db", F.when(F.col("db") > F.col("limit"), F.col("hop")).alias("voiced"))
    w = Window.partitionBy(by).orderBy("hop")
    before = F.max("voiced").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.col("voiced").isNotNull() & (before.isNull() | (F.col("hop") - before > gap))
    own = voiced.withColumn("isle", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("isle > 0")
    own = own.withColumn("end_hop", F.max("voiced").over(Window.partitionBy(by, "isle"))).where("hop <= end_hop")  # quiet hops inside count
    summed = own.groupBy(by, "isle", "end_hop").agg(F.min("hop").alias("start_hop"), F.round(F.sum(F.pow(F.lit(10.0), F.col("db") / 10)), 6).alias("power"))
    best = F.max_by(F.struct("start_hop", "end_hop", "power"), F.struct("power", -F.col("isle")))
    return summed.groupBy(by).agg(best.alias("b")).select(by, "b.*")


def best_split(levels: DataFrame, grid: DataFrame, target: int, least: int, by: str = "stream_id") -> DataFrame:
    """(by, ordinal, clip, start_hop, end_hop): spans of at least `least` hops over a threshold, with the first parameters of
    the grid (ordinal, theta, gap) that come nearest to `target` spans of a stream. levels: (by, hop, prob)."""
    over = levels.crossJoin(F.broadcast(grid)).where("prob > theta")
    found = spans(over, F.col("gap"), (by, "ordinal")).where(F.col("end_hop") - F.col("start_hop") >= least)
    n = found.groupBy(by, "ordinal").agg(F.count("*").alias("n"))
    tried = levels.select(by).distinct().crossJoin(F.broadcast(grid.select("ordinal"))).join(n, [by, "ordinal"], "left")
    best = tried.groupBy(by).agg(F.min(F.struct(F.abs(F.coalesce("n", F.lit(0)) - target).alias("off"), "ordinal")).alias("b")).select(by, "b.ordinal")
    clip = (F.row_number().over(Window.partitionBy(by).orderBy("start_hop")) - 1).alias("clip")
    return found.join(best, [by, "ordinal"]).select(by, "ordinal", clip, "start_hop", "end_hop")


def clips(found: DataFrame, recording: DataFrame, size: int, pad: int, by: str = "stream_id") -> DataFrame:
    """(by, ..., start_sample, samples): the samples of spans (by, ..., start_hop, end_hop), padded within the recording. Its rows
    (by, hop, samples) of `size` samples each meet the spans by equal hops."""
    top = recording.groupBy(by).agg(((F.max("hop") + 1) * size).alias("_size"))
    keys = [c for c in found.columns if c not in ("start_hop", "end_hop")]
    first, behind = F.greatest(F.lit(0), F.col("start_hop") * size - pad), F.least(F.col("_size"), F.col("end_hop") * size + pad)
    s = found.join(top, by).select(*keys, first.cast("long").alias("start_sample"), behind.cast("long").alias("_behind"))
    hop = F.explode(F.sequence(F.floor(F.col("start_sample") / size).cast("int"), F.floor((F.col("_behind") - 1) / size).cast("int")))
    parts = s.withColumn("hop", hop).join(recording.select(by, "hop", "samples"), [by, "hop"])
    g = parts.groupBy(*keys, "start_sample", "_behind").agg(F.array_sort(F.collect_list(F.struct("hop", "samples"))).alias("_x"))
    whole = F.flatten(F.transform("_x", lambda x: x["samples"]))
    return g.select(*keys, "start_sample", F.slice(whole, (F.col("start_sample") % size + 1).cast("int"), (F.col("_behind") - F.col("start_sample")).cast("int")).alias("samples"))


def silence(levels: DataFrame, limit: float, by: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """With `silent_run`: how many hops in a row up to this one have a level below the limit."""
    w = Window.partitionBy(*by).orderBy("hop")
    loud = (F.col("prob") >= limit).cast("int")
    out = levels.withColumn("_loud", F.sum(loud).over(w))
    return out.withColumn("silent_run", F.sum(1 - loud).over(Window.partitionBy(*by, "_loud").orderBy("hop"))).drop("_loud")
