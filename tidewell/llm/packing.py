"""Operator 5: best-fit decreasing packing of token sequences, for whole runs of equal lengths at once.

Pieces (documents, or parts of documents longer than a sequence) are sorted by
length, gaps by size. There are at most as many lengths and gaps as a sequence
has tokens, so the sorted lists are kept as runs: how many pieces have a length,
and which ranges of sequences have a gap. From the longest length down, the
smallest gaps that fit take the run's pieces, rank by rank (the piece of rank r
takes the r-th place, so no two pieces meet in one place), and the gaps are
updated. The runs are planned one after the other on the driver, not by
distributed sweeps and rounds: their number depends on the sequence length, not
on the data. Ranks and places are worked out where the pieces are.

Ranks are counted in hash buckets of bounded size and offset by the buckets'
counts, so a length that a third of the pieces share is spread over tasks.

Nulls: a null text counts as empty and gives one piece, the end token. Texts
are taken whole. Repeated rows are packed each on its own (equal rows get
different places). Empty tables give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.llm import encoding
from tidewell.llm.common import stash, table

#: Tokens of a sequence; id that ends a document; pieces of a bucket in which ranks are counted.
TOKENS, END, BUCKET = 2048, 0, 20_000


def cut(n: int, size: int = TOKENS) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than a sequence, if there are several."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


def pieces_of(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = TOKENS, end: int = END, with_ids: bool = False) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32[, ids]): ids are little-endian unsigned 32-bit bytes."""
    kind = docs.schema[key].dataType.simpleString()
    last = int(end).to_bytes(4, "little")

    def run(batches):
        pieces = encoding.pieces(path or encoding.default_path())
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for k, ids in zip(range(b.num_rows), pieces.encode(b.column(1).to_pylist()), strict=True):
                raw = ids + last
                for p, (start, n) in enumerate(cut(len(raw) // 4, size)):
                    part = raw[4 * start : 4 * (start + n)]
                    for c, v in zip(rows, (k, p, start, n, zlib.crc32(part), part if with_ids else b""), strict=True):
                        c.append(v)
            cols = [b.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:5])]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(rows[5], pa.binary())] * with_ids, names=["k", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)
    return out.withColumnRenamed("k", key)


def plan(counts: dict[int, int], size: int = TOKENS) -> np.ndarray:
    """Places of all ranks: rows (length, first rank, ranks, first sequence, pieces in a sequence, offset of the first)."""
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by gap: runs (first sequence, sequences)
    opened, out = 0, []
    for length in sorted(counts, reverse=True):
        rank, left, g = 0, counts[length], length
        while left:
            while g <= size and not gaps[g]:
                g += 1
            if g > size:
                g, need = size, -(-left // (size // length))
                gaps[g].append((opened, need))
                opened += need
            first, n = gaps[g].pop()
            fit = g // length
            full = min(n, left // fit)
            rest = (first + full, n - full)
            if full:
                out.append((length, rank, full * fit, first, fit, size - g))
                gaps[g - full * fit // full * length].append((first, full))
                rank, left = rank + full * fit, left - full * fit
            if left and rest[1]:  # fewer pieces than one more sequence would take
                out.append((length, rank, left, rest[0], fit, size - g))
                gaps[g - left * length].append((rest[0], 1))
                rest, left = (rest[0] + 1, rest[1] - 1), 0
            if rest[1]:
                gaps[g].append(rest)
    return np.array(out, np.int64).reshape(-1, 6)


def ranked(df: DataFrame, group: str, order: list[str], name: str, bucket: int = BUCKET) -> DataFrame:
    """With `name`: the row's rank from 0 among all rows of its group, counted in hash buckets of about `bucket` rows."""
    buckets = max(1, -(-df.count() // bucket))
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    base = df.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    base = base.select(F.col(group).alias("_g"), F.col("_b").alias("_bb"), (F.sum("_n").over(Window.partitionBy(group).orderBy("_b")) - F.col("_n")).alias("_base"))
    at = df.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order)) - 1)
    return at.join(base, (F.col(group) == F.col("_g")) & (F.col("_b") == F.col("_bb"))).withColumn(name, F.col("_r") + F.col("_base")).drop("_b", "_r", "_g", "_bb", "_base")


def pack(pieces: DataFrame, key: str = "doc_id", size: int = TOKENS) -> DataFrame:
    """Stored pieces (columns key, piece, length and any others) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    rows = plan(counts, size)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    schema = StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long")
    n_cols = len(pieces.columns)

    def place(batches):
        keys = rows[:, 0] * (1 << 44) + rows[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = rows[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1]
            j = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_cols], pa.array(at[:, 3] + j // at[:, 4]), pa.array(at[:, 5] + j % at[:, 4] * length)], names=schema.names)

    return ranked(pieces, "length", [key, "piece"], "_rank").select(*pieces.columns, "_rank").mapInArrow(place, schema)


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    return pack(stash(pieces_of(docs, key, text, **how), "pieces"), key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
