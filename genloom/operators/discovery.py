"""Group statistics and the false-discovery filter (Barber & Candès 2015; grouped as in Sesia et al. 2020)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genloom.runtime import materialize

#: Distinct |W| of a threshold without keys from which their running sums go by ranges instead of in one sort.
ONE_SORT = 2_000_000


def group_statistic(rows: DataFrame, keys: list[str], importance: Column, is_control: Column, digits: int | None = None) -> DataFrame:
    """W of each group: summed |importance| of its original variables less that of its negative controls."""
    size = F.abs(importance)
    w = F.sum(F.when(~is_control, size).otherwise(0.0)) - F.sum(F.when(is_control, size).otherwise(0.0))
    return rows.groupBy(*keys).agg((F.round(w, digits) if digits is not None else w).alias("w"))


def discovery_threshold(stats: DataFrame, keys: list[str], q: float = 0.1, offset: int = 1) -> DataFrame:
    """The smallest t among |W| > 0 with (offset + #{W <= -t}) / max(1, #{W >= t}) <= q, for each key; absent if none is.

    Ties share one row: counts are aggregated by |W| before the running sums, so a window holds distinct values only.
    """
    at = stats.filter("w <> 0").groupBy(*keys, F.abs("w").alias("t")).agg(
        F.count_if(F.col("w") > 0).alias("pos"), F.count_if(F.col("w") < 0).alias("neg")
    )
    if keys:
        down = W.partitionBy(*keys).orderBy(F.desc("t")).rangeBetween(W.unboundedPreceding, W.currentRow)
        run = at.withColumn("p", F.sum("pos").over(down)).withColumn("n", F.sum("neg").over(down))
    else:
        run = _running_counts(at)
    ratio = (F.lit(offset) + F.col("n")) / F.greatest(F.lit(1), F.col("p"))
    return run.withColumn("ratio", ratio).filter(F.col("ratio") <= q).groupBy(*keys).agg(F.min("t").alias("threshold")).filter("threshold IS NOT NULL")


def _running_counts(at: DataFrame) -> DataFrame:
    """at with p and n, the sums of pos and neg over rows with as large a t or a larger one; t is distinct.

    Many rows are dealt into ranges of t. Sums of whole ranges, of which there are few, give each range its start; the rest
    runs within ranges, in parallel.
    """
    at = materialize(at, "thresholds")
    if at.count() <= ONE_SORT:
        down = W.orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, W.currentRow)
        return at.withColumn("p", F.sum("pos").over(down)).withColumn("n", F.sum("neg").over(down))
    dealt = materialize(at.repartitionByRange(F.desc("t")).withColumn("r", F.spark_partition_id()), "ranges")
    before = W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy("r").agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn"))
    starts = sums.select("r", F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("sp"), F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("sn"))
    down = W.partitionBy("r").orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = dealt.join(F.broadcast(starts), "r")  # a row a range
    return run.withColumn("p", F.col("sp") + F.sum("pos").over(down)).withColumn("n", F.col("sn") + F.sum("neg").over(down)).drop("r", "sp", "sn")


def discoveries(stats: DataFrame, keys: list[str], q: float = 0.1, offset: int = 1) -> DataFrame:
    """The groups with W at or above the threshold of their key; empty where no threshold qualifies."""
    cut = discovery_threshold(stats, keys, q, offset)
    joined = stats.join(cut, keys) if keys else stats.crossJoin(F.broadcast(cut))  # without keys cut is one row
    return joined.filter(F.col("w") >= F.col("threshold"))
