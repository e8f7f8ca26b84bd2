"""Scores of feature windows by a model that the caller brings.

A scorer is a function from a numpy matrix (windows x features) to one of
logits (windows x classes). It runs in Arrow batches on the executors; nothing
else about the model is known here. `scored` gives class probabilities;
`scored_int8` quantises the features, lets an integer scorer work on them and
gives its raw output beside the probabilities. Null features give null scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, StructField, StructType

Scorer = Callable[[np.ndarray], np.ndarray]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that aren't null, as a matrix, and their positions."""
    at = np.flatnonzero(np.asarray(col.is_valid()))
    return np.array(col.take(pa.array(at)).to_pylist(), np.float64).reshape(len(at), -1) if len(at) else np.empty((0, 0)), at


def _spread(rows: np.ndarray, at: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    out: list = [None] * n
    for i, r in zip(at.tolist(), rows.tolist(), strict=True):
        out[i] = r
    return pa.array(out, pa.list_(kind))


def scored(windows: DataFrame, scorer: Scorer, features: str = "features") -> DataFrame:
    """With `probs`: class probabilities of the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = _matrix(b.column(b.schema.get_field_index(features)))
            p = softmax(np.asarray(scorer(x), np.float64)) if len(at) else x
            yield pa.RecordBatch.from_arrays([*b.columns, _spread(p, at, b.num_rows, pa.float64())], names=[*b.schema.names, "probs"])

    return windows.mapInArrow(run, StructType([*windows.schema.fields, StructField("probs", ArrayType(DoubleType()))]))


def quantised(x: np.ndarray, scale: float, zero: int) -> np.ndarray:
    """int8 codes, halves rounded to even."""
    return np.clip(np.rint(x / scale) + zero, -128, 127).astype(np.int8)


def scored_int8(windows: DataFrame, scorer: Scorer, into: tuple[float, int], out: tuple[float, int], features: str = "features") -> DataFrame:
    """With `q` (raw int8 output) and `probs_int8`. into and out: scale and zero point of the input and of the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = _matrix(b.column(b.schema.get_field_index(features)))
            q = np.asarray(scorer(quantised(x, *into)), np.int64).astype(np.int8) if len(at) else np.empty((0, 0), np.int8)
            p = softmax((q.astype(np.float64) - out[1]) * out[0]) if len(at) else x
            yield pa.RecordBatch.from_arrays([*b.columns, _spread(q, at, b.num_rows, pa.int8()), _spread(p, at, b.num_rows, pa.float64())], names=[*b.schema.names, "q", "probs_int8"])

    return windows.mapInArrow(run, StructType([*windows.schema.fields, StructField("q", ArrayType(ByteType())), StructField("probs_int8", ArrayType(DoubleType()))]))


def scale_or(meta: Column, fallback: Column) -> Column:
    """A model file's own scale or zero point; a missing one, and a zero, give the fallback's."""
    return F.coalesce(F.nullif(meta, F.lit(0)), fallback)
