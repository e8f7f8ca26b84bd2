"""Generated signals and streams: test tones, backgrounds, background picks, stacked streams. All from `range` and hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell import params as P


def uniform(*keys: Column) -> Column:
    """A number in [-1, 1) from a hash of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / float(1 << 29) - 1


def _indices(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def signal(kind: str, n: int = P.CLIP_SAMPLES, rate: int = P.SAMPLE_RATE) -> Column:
    """Samples of a test signal as doubles in 16-bit steps."""
    turn = 2 * math.pi / rate
    shapes = {
        "silence": lambda i: F.lit(0.0),
        "tone": lambda i: 8000 * F.sin(turn * 440 * i),
        "chirp": lambda i: 8000 * F.sin(turn * (100 * i + 3900.0 / (2 * n) * i * i)),
        "square": lambda i: F.when((i * 2 * 250 / rate).cast("int") % 2 == 0, 6000.0).otherwise(-6000.0),
        "impulse": lambda i: F.when(i == n // 2, 30000.0).otherwise(0.0),
        "noise": lambda i: 8 * uniform(F.lit(1), i),
        "white": lambda i: 3000 * uniform(F.lit(2), i),
        "bursts": lambda i: F.when(uniform(F.lit(3), (i / 1600).cast("int")) > 0.6, 9000 * uniform(F.lit(4), i)).otherwise(0.0),
    }
    return F.transform(_indices(n), lambda i: F.rint(shapes[kind](i)))


KINDS = ("silence", "tone", "chirp", "square", "impulse", "noise", "white", "bursts")


def steady_noise(n: int = P.CLIP_SAMPLES) -> Column:
    """Noise in [-1, 1) from products modulo primes: plain arithmetic, the same in any engine."""
    prime = (1 << 31) - 1
    return F.transform(_indices(n), lambda i: F.floor(((i.cast("long") * 48271 + 11) % 65521 * 40692 % prime * 30323 % prime) / 32768) % 2000 / 1000.0 - 1)


def signals(spark: SparkSession, n: int = P.CLIP_SAMPLES) -> DataFrame:
    """(kind, samples), one row a kind."""
    rows = spark.range(1)
    return rows.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*[signal(k, n) for k in KINDS]))).alias("kind", "samples"))


def pink(white: Column) -> Column:
    """Approximately 1/f noise from white samples: the sum of running means over octaves."""

    def octave(x: Column, w: int) -> Column:
        return F.transform(x, lambda v, i: F.get(x, (i / w).cast("int") * w))

    return F.transform(F.arrays_zip(*[octave(white, w).alias(f"o{w}") for w in (1, 2, 4, 8, 16, 32)]), lambda z: (z["o1"] + z["o2"] + z["o4"] + z["o8"] + z["o16"] + z["o32"]) / 6)


def background(clips: DataFrame, pool: DataFrame, key: str, name: str, seed: int) -> DataFrame:
    """Each clip with one of the pool's recordings (name, samples): `picked` and `background`, by a hash of its key among the
    names in order; none from an empty pool."""
    names = pool.select(F.col(name).alias("picked"), (F.row_number().over(Window.orderBy(name)) - 1).alias("_ord"))  # a pool of recordings is a short list
    n = pool.agg(F.count("*").alias("_n"))
    code = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    picked = clips.crossJoin(n).withColumn("_o", F.when(F.col("_n") > 0, code % F.col("_n")))
    picked = picked.join(names, F.col("_o") == F.col("_ord"), "left").drop("_n", "_o", "_ord")
    return picked.join(pool.select(F.col(name).alias("picked"), F.col("samples").alias("background")), "picked", "left")
