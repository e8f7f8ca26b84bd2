"""Dataset assembly: hash splits, quotas, over- and undersampling, leak guards.

Random choices are ordered by sha1 of (seed, id): the same rows are chosen
whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell import params as P
from tidewell.functions.signal import upto


def hash_percent(key: Column) -> Column:
    """0 .. 100 by the first 32 bits of a sha1, reduced modulo 2^27."""
    return (F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("long") % (P.HASH_MOD + 1)) * F.lit(100.0 / P.HASH_MOD)


def hash_split(key: Column, explicit: dict[str, str] | None = None) -> Column:
    """test, val or train; empty keys train; an explicit map goes first."""
    p = hash_percent(key)
    out = F.when(key == "", "train")
    for k, v in (explicit or {}).items():
        out = out.when(key == k, v)
    return out.when(p < P.TEST_PCT, "test").when(p < P.TEST_PCT + P.VAL_PCT, "val").otherwise("train")


def speaker_disjoint(manifest: DataFrame, explicit: dict[str, str], hashed_source: str) -> DataFrame:
    """With `split`: mapped speakers as mapped, rows of the hashed source by hash (its test part is dropped), all others train."""
    mapped = F.lit(None).cast("string")
    for k, v in explicit.items():
        mapped = F.when(F.col("speaker") == k, v).otherwise(mapped)
    by_hash = F.when(F.col("source") == hashed_source, hash_split(F.col("speaker")))
    out = manifest.withColumn("_m", mapped).withColumn("split", F.coalesce("_m", by_hash, F.lit("train")))
    return out.where(F.col("_m").isNotNull() | (F.col("source") != hashed_source) | (F.col("split") != "test")).drop("_m")


def draw(key: Column, seed: int) -> Column:
    """What random orders sort by."""
    return F.sha1(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def sampled(df: DataFrame, n: Column | int, key: str, seed: int, by: tuple[str, ...]) -> DataFrame:
    """n rows of each group without replacement."""
    w = Window.partitionBy(*by).orderBy(draw(F.col(key), seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def random_split(df: DataFrame, key: str, seed: int) -> DataFrame:
    """With `split`: the first tenths of a seeded order test and validate, rounded half to even.

    The order is cut by counts of the hash's first 16 bits, so only rows of the
    two cutting buckets are ranked.
    """
    d = df.withColumn("_d", draw(F.col(key), seed)).withColumn("_b", F.substring("_d", 1, 4))
    counts = d.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 65,536 rows
    base = counts.select(F.col("_b"), (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    d = d.join(F.broadcast(base), "_b").withColumn("_r", F.col("_base") + F.row_number().over(Window.partitionBy("_b").orderBy("_d", key)))
    test, val = F.rint(F.col("_total") * P.TEST_PCT / 100), F.rint(F.col("_total") * P.VAL_PCT / 100)
    return d.withColumn("split", F.when(F.col("_r") <= test, "test").when(F.col("_r") <= test + val, "val").otherwise("train")).drop("_d", "_b", "_base", "_total", "_r")


def oversampled(df: DataFrame, target: Column, size: Column, key: str, by: tuple[str, ...]) -> DataFrame:
    """Each group repeated in order until it has `target` rows: with `rep` from 0. size: the group's rows."""
    reps = F.ceil(target / F.greatest(size, F.lit(1)))
    w = Window.partitionBy(*by).orderBy(key)
    ordered = df.withColumn("_o", F.row_number().over(w) - 1)
    out = ordered.withColumn("rep", F.explode(upto(F.when(target > 0, reps).otherwise(0))))
    return out.where(F.col("rep") * size + F.col("_o") < target).drop("_o")


def quota_mix(manifest: DataFrame, seed: int, hard: str, talking: str, filler: str, key: str = "path") -> DataFrame:
    """The composition of each split: keywords and others stay; `hard` and `talking` are oversampled to their shares of
    the unknown quota, at least once each; `filler` is sampled to what is left. Columns key, split, kind, source, rep.

    manifest: key, split, kind ('keyword', 'unknown', ...), source.
    """
    n = manifest.groupBy("split").agg(
        F.count_if(F.col("kind") == "keyword").alias("kw"),
        *(F.count_if((F.col("kind") == "unknown") & (F.col("source") == s)).alias(c) for s, c in ((hard, "nh"), (talking, "nt"), (filler, "nf"))),
    )
    n = n.withColumn("quota", F.rint(F.col("kw") * P.UNKNOWN_PCT / 100))
    n = n.withColumn("th", F.when(F.col("nh") > 0, F.greatest(F.rint(F.col("quota") * P.HARD_NEG_SHARE), "nh")).otherwise(0))
    n = n.withColumn("tt", F.when(F.col("nt") > 0, F.greatest(F.rint(F.col("quota") * P.TALKING_SHARE), "nt")).otherwise(0))
    n = n.withColumn("tf", F.greatest(F.col("quota") - F.col("th") - F.col("tt"), F.lit(0)))
    m = manifest.join(F.broadcast(n), "split")  # one row a split
    unknown = F.col("kind") == "unknown"
    cols = [key, "split", "kind", "source"]
    keep = m.where(~unknown).select(*cols, F.lit(0).alias("rep"))
    over = [oversampled(m.where(unknown & (F.col("source") == s)), F.col(t), F.col(c), key, ("split",)).select(*cols, "rep") for s, t, c in ((hard, "th", "nh"), (talking, "tt", "nt"))]
    rest = sampled(m.where(unknown & (F.col("source") == filler)), F.col("tf"), key, seed, ("split",)).select(*cols, F.lit(0).alias("rep"))
    out = keep
    for x in (*over, rest):
        out = out.unionByName(x)
    return out


def silence_rows(manifest: DataFrame) -> DataFrame:
    """Generated silence rows: a tenth of each split's keywords, rounded half to even."""
    n = manifest.groupBy("split").agg(F.count_if(F.col("kind") == "keyword").alias("kw"))
    return n.select("split", F.explode(upto(F.rint(F.col("kw") * P.SILENCE_PCT / 100))).alias("rep")).select(F.concat_ws("-", F.lit("silence"), "split", "rep").alias("path"), "split", F.lit("silence").alias("kind"))


def leaks(rows: DataFrame, held_out: DataFrame, on: str) -> DataFrame:
    """Rows that must not be there: those of held-out keys."""
    return rows.join(held_out, on, "left_semi")
