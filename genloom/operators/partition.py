"""Partition of ordered variants at several resolutions by single linkage of neighbours, and merging of chromosomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Resolutions in centimorgan; fixed values.
RESOLUTIONS = [0, 0.01, 0.05, 0.1, 0.2, 0.5, 1]


def multi_resolution(df: DataFrame, keys: list[str], position: str, cuts: list[float] = RESOLUTIONS, tie: str | None = None) -> DataFrame:
    """df with (res, group_id) for each cut: a group ends where the gap to the next row is above the cut; groups count from 0.

    The gap is found once; resolutions are rows, not loops, and running sums are by key and resolution.
    """
    order = [position, tie] if tie else [position]
    gap = F.col(position) - F.lag(position).over(W.partitionBy(*keys).orderBy(*order))
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("res"), F.lit(float(c)).alias("cut")) for i, c in enumerate(cuts)]))
    out = df.withColumn("__gap", gap).withColumn("__l", levels).withColumn("res", F.col("__l.res"))
    split = F.coalesce((F.col("__gap") > F.col("__l.cut")).cast("long"), F.lit(0))
    by = W.partitionBy(*keys, "res").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return out.withColumn("group_id", F.sum(split).over(by)).drop("__gap", "__l")


def merge(parts: list[DataFrame]) -> DataFrame:
    """Union of equally named tables with the place of each part as column part; duplicates stay."""
    return reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
