"""Aggregates of the evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tally(rows: DataFrame, word: str) -> DataFrame:
    """Outcomes OK, WRONG, NONE and EMPTY overall and by word, with hit rates."""
    n = {o: F.count_if(F.col("outcome") == o) for o in ("OK", "WRONG", "NONE", "EMPTY")}
    out = rows.groupingSets([[], [word]], word).agg(F.count("*").alias("n"), *(c.alias(o.lower()) for o, c in n.items()))
    return out.select(word, "n", "ok", "wrong", "none", "empty", (F.col("ok") / F.greatest("n", F.lit(1))).alias("hit_rate"), (F.col("ok") / F.greatest(F.col("n") - F.col("empty"), F.lit(1))).alias("hit_rate_nonempty"))


def percentiles(rows: DataFrame, value: str, by: list[str], at: list[int], quiet: Column) -> DataFrame:
    """Exact percentiles (interpolated) in one pass, the count, and how many rows are quiet."""
    p = F.percentile(value, F.array(*[F.lit(x / 100) for x in at]))
    g = rows.groupBy(*by).agg(p.alias("p"), F.count("*").alias("n"), F.count_if(quiet).alias("n_quiet"))
    return g.select(*by, *[F.round(F.col("p")[i], 6).alias(f"p{x}") for i, x in enumerate(at)], "n", "n_quiet")


def summary(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.round(f, 6).alias(n) for n, f in (("least", F.min(value)), ("most", F.max(value)), ("mean", F.avg(value)), ("median", F.percentile(value, F.lit(0.5))))))


def separation(rows: DataFrame, value: str, positive: Column, negative: Column) -> DataFrame:
    """Least positive less greatest negative, and the same between the 10th and 90th percentiles."""
    p, n = F.when(positive, F.col(value)), F.when(negative, F.col(value))
    return rows.agg(F.round(F.min(p) - F.max(n), 6).alias("gap"), F.round(F.percentile(p, F.lit(0.1)) - F.percentile(n, F.lit(0.9)), 6).alias("gap_p10_p90"))


def rates(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    one = F.lit(1)
    return rows.agg(
        F.round(F.count_if(truth & predicted) / F.greatest(F.count_if(truth), one), 9).alias("tpr"),
        F.round(F.count_if(~truth & ~predicted) / F.greatest(F.count_if(~truth), one), 9).alias("tnr"),
    )


def precision_recall(rows: DataFrame, truth: Column, predicted: Column, epsilon: float = 1e-7) -> DataFrame:
    tp, fp, fn = F.count_if(truth & predicted), F.count_if(~truth & predicted), F.count_if(truth & ~predicted)
    return rows.agg(F.round(tp / (tp + fp + epsilon), 9).alias("precision"), F.round(tp / (tp + fn + epsilon), 9).alias("recall"))


def confusion(rows: DataFrame, truth: str, predicted: str, values: list) -> DataFrame:
    return rows.groupBy(truth).agg(*(F.count_if(F.col(predicted) == v).alias(f"pred_{v}") for v in values))
