"""Places of rows in an order of all rows, and what is selected by them: no group is ever in one task.

Rows are dealt out by ranges of the order, sorted, and written to the shared
folder; a row's place is that in its part behind the rows of the parts before.
Percentiles weigh distinct values by their counts, so a value that a third of the
rows share is one row.

Nulls: null groups are a group of their own; null values are left out of
percentiles, as `percentile` does. Empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.files import shared_folder

#: Groups whose counts are broadcast.
FEW = 100_000


def written(df: DataFrame, tag: str) -> DataFrame:
    """A table in the shared folder, read back: what is numbered by its place stays as it is."""
    path = f"{shared_folder(df.sparkSession)}/tidewell/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def behind(parts: DataFrame, weight: Column) -> DataFrame:
    """(part, before): the weight of all parts before each; one row a part."""
    n = parts.groupBy("part").agg(F.sum(weight).alias("n"))
    return n.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def placed(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """With `name`: the row's place from 0 in the order of all rows."""
    each = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    each = written(each.withColumns({"part": F.spark_partition_id(), "i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "placed")
    return each.join(F.broadcast(behind(each, F.lit(1))), "part").withColumn(name, F.col("i") + F.col("before")).drop("part", "i", "before")


def percentiles(rows: DataFrame, value: str, by: list[str], at: list[int]) -> DataFrame:
    """(by..., p<at>..., n): exact percentiles, interpolated between the two nearest places."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    each = counts.repartitionByRange(*by, value).sortWithinPartitions(*by, value)
    each = written(each.withColumns({"part": F.spark_partition_id(), "i": F.monotonically_increasing_id()}), "values")
    run = F.sum("c").over(Window.partitionBy("part").orderBy("i")) - F.col("c")
    each = each.withColumn("run", run).join(F.broadcast(behind(each, F.col("c"))), "part").withColumn("low", F.col("run") + F.col("before"))
    groups = each.groupBy(*by).agg(F.min("low").alias("first"), F.sum("c").alias("n"))
    few = groups.count() <= FEW
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]
    side = F.broadcast(groups) if few else groups
    joined = each.alias("e").join(side.alias("g"), same) if by else each.alias("e").crossJoin(F.broadcast(groups).alias("g"))
    low = F.col("low") - F.col("first")  # place in the group; the value holds c places from there
    holds = lambda place: (place >= low) & (place < low + F.col("c"))
    target = {x: (F.col("n") - 1) * (x / 100) for x in at}
    ends = {x: (F.floor(t), F.ceil(t)) for x, t in target.items()}
    picked = joined.where(F.array_contains(F.array(*[holds(p) for e in ends.values() for p in e]), True))
    out = picked.groupBy(*[F.col(f"e.{c}").alias(c) for c in by]).agg(F.first("n").alias("n"), *[F.max(F.when(holds(p), F.col(value))).alias(f"v{x}_{k}") for x, e in ends.items() for k, p in enumerate(e)])
    part = {x: (F.col("n") - 1) * (x / 100) - F.floor((F.col("n") - 1) * (x / 100)) for x in at}
    return out.select(*by, *[(F.col(f"v{x}_0") + part[x] * (F.col(f"v{x}_1") - F.col(f"v{x}_0"))).alias(f"p{x}") for x in at], "n")
