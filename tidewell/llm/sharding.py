"""Operator 9: reproducible shuffle into shards by a Feistel permutation with cycle walking.

Rows get global numbers 0..N-1 that depend on their content alone. A Feistel
network permutes the smallest domain of 4^w >= N numbers; a number that it
sends outside 0..N-1 is sent on until it falls inside (cycle walking), which
makes it a permutation of 0..N-1. Position p then has shard p mod S and slot
p div S, so counts are at most one apart (law `rows`), and any row's place can
be computed from its number alone, forth and back.

Only (key, size, checksum) move, never the texts. Global numbers are counted in
hash buckets of bounded size, offset by the buckets' counts; equal rows are
counted by the part that they lie in, and numbered there.

Nulls: a null text has size 1 and checksum 0; a null key is a value like any
other. Repeated rows get numbers of their own. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.llm.common import stash, table

#: Shards, key of the permutation, rounds of the network, rows of a bucket in which numbers are counted.
SHARDS, SEED, ROUNDS, BUCKET = 16, 20_240_601, 6, 50_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Permutation:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n, self.half = n, np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = (np.uint64(1) << self.half) - np.uint64(1)
        self.keys = _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x).astype(np.uint64))
        while (out := x >= np.uint64(self.n)).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def _forth(self, x: np.ndarray) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for k in self.keys:
            a, b = b, a ^ (_mix(b + k) & self.mask)
        return (a << self.half) | b

    def _back(self, x: np.ndarray) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for k in self.keys[::-1]:
            a, b = b ^ (_mix(a + k) & self.mask), a
        return (a << self.half) | b

    def forth(self, x: np.ndarray) -> np.ndarray:
        """Positions of row numbers."""
        return self._walk(x, self._forth)

    def back(self, x: np.ndarray) -> np.ndarray:
        """Row numbers of positions."""
        return self._walk(x, self._back)


def numbered(df: DataFrame, order: list[str], part: str, n: int, bucket: int = BUCKET) -> DataFrame:
    """With `row`: a number from 0 that depends on the rows' content alone; equal rows share a range of numbers. They are
    counted by the part that they are in, so that no task gets all rows of a content."""
    buckets = max(1, -(-n // bucket))
    own = F.struct(*order, part).alias("_c")
    runs = df.groupBy(own).agg(F.count("*").alias("_n")).withColumn("_b", F.pmod(F.xxhash64(*[F.col("_c")[c] for c in order]), F.lit(buckets)))
    base = runs.groupBy("_b").agg(F.sum("_n").alias("_m")).select(F.col("_b").alias("_bb"), (F.sum("_m").over(Window.orderBy("_b")) - F.col("_m")).alias("_base"))  # one row a bucket
    first = F.sum("_n").over(Window.partitionBy("_b").orderBy("_c")) - F.col("_n")
    runs = runs.withColumn("_first", first).join(base, F.col("_b") == F.col("_bb")).select("_c", (F.col("_first") + F.col("_base")).alias("_first"))
    at = df.withColumn("_c", own).withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy("_c")) - 1)
    return at.join(runs, "_c").withColumn("row", F.col("_r") + F.col("_first")).drop("_c", "_r", "_first", part)


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Rows (key, size, text_crc32, row, shard, slot)."""
    t = F.coalesce(F.col(text), F.lit(""))
    slim = stash(docs.select(F.col(key), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("_part")), "sizes")
    n = slim.count()
    schema = StructType([f for f in slim.schema.fields if f.name != "_part"]).add("row", "long").add("shard", "integer").add("slot", "long")

    def place(batches):
        p = Permutation(n, seed)
        for b in batches:
            at = p.forth(b.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((at % shards).astype(np.int32)), pa.array(at // shards)], names=schema.names)

    return numbered(slim, [key, "size", "text_crc32"], "_part", n).withColumn("row", F.col("row").cast("long")).mapInArrow(place, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharded(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")
