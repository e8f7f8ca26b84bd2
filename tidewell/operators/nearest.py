"""Nearest rows by cosine of a set of queries, in blocks that are multiplied as matrices.

Rows are packed where they lie, an Arrow batch to a block; every block of queries
meets every block of rows once, and gives each query's best row of the block. So
what is shuffled is one row for each query and block. Of equal scores (rounded to
nine places) the least id wins. A row isn't its own neighbour.

Nulls: rows without a vector or id, and vectors of another length than the
block's first, are left out. A zero vector has score 0 with any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, scores that are held at once.
BLOCK, SCORES = 4096, 1 << 22


def blocks(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """(ids, m): numbers and unit vectors of a block as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                v = part.column(1).combine_chunks() if isinstance(part.column(1), pa.ChunkedArray) else part.column(1)
                m = np.asarray(v.flatten(), np.float64).reshape(part.num_rows, -1)
                norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
                unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([unit.tobytes()], pa.binary())], names=["ids", "m"])

    width = rows.where(F.col(vec).isNotNull()).select(F.size(vec)).first()
    own = rows.where(F.col(key).isNotNull() & (F.size(vec) == (width[0] if width else 0)) & ~F.exists(vec, lambda x: x.isNull()))
    return own.select(F.col(key).cast("long"), F.col(vec).cast("array<double>")).mapInArrow(run, "ids binary, m binary")


def nearest(rows: DataFrame, queries: DataFrame, key: str, vec: str) -> DataFrame:
    """(query_id, other, score): the nearest of `rows` to each of `queries`."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, q, r_ids, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                q_ids, r_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(r_ids, np.int64)
                q, r = np.frombuffer(q).reshape(len(q_ids), -1), np.frombuffer(r).reshape(len(r_ids), -1)
                step = max(1, SCORES // len(r_ids))
                for at in range(0, len(q_ids), step):
                    own = q_ids[at : at + step]
                    s = np.round(q[at : at + step] @ r.T, 9) + 0.0
                    s[own[:, None] == r_ids[None]] = -np.inf
                    top = s.max(axis=1)
                    other = np.where(s == top[:, None], r_ids[None], np.iinfo(np.int64).max).min(axis=1)
                    keep = np.isfinite(top)
                    yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(other[keep]), pa.array(top[keep])], names=["query_id", "other", "score"])

    pairs = blocks(queries, key, vec).toDF("q_ids", "q").crossJoin(blocks(rows, key, vec).toDF("r_ids", "r"))
    found = pairs.select("q_ids", "q", "r_ids", "r").mapInArrow(best, "query_id long, other long, score double")
    top = found.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("other")).alias("o"))).alias("b"))
    return top.select("query_id", (-F.col("b.o")).alias("other"), F.col("b.score").alias("score"))
