"""Ordered sequences as rows with an explicit order key, inside keys: adaptors, algorithms and rolling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _by(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order)


def _trailing(keys: list[str], order: list[str], size: int):
    return _by(keys, order).rowsBetween(1 - size, 0)


def rolling_count(x: str, keys: list[str], order: list[str], size: int = 3) -> Column:
    return F.count(x).over(_trailing(keys, order, size))


def rolling_sum(x: str, keys: list[str], order: list[str], size: int = 3) -> Column:
    return F.coalesce(F.sum(x).over(_trailing(keys, order, size)), F.lit(0))


def rolling_mean(x: str, keys: list[str], order: list[str], size: int = 5) -> Column:
    return F.avg(x).over(_trailing(keys, order, size))


def partial_sum(x: str, keys: list[str], order: list[str]) -> Column:
    return F.sum(x).over(_by(keys, order).rowsBetween(W.unboundedPreceding, 0))


def index(keys: list[str], order: list[str]) -> Column:
    """Place from 0."""
    return F.row_number().over(_by(keys, order)) - 1


def uniqued(df: DataFrame, x: str, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose value differs from that of the row before; not distinct()."""
    before = F.lag(x).over(_by(keys, order))
    first = F.row_number().over(_by(keys, order)) == 1
    return df.withColumn("__k", first | ~F.col(x).eqNullSafe(before)).filter("__k").drop("__k")


def adjacent_filtered(items: Column, pred) -> Column:
    """The first element of an array, then each that pred(last kept, it) holds for."""
    fold = F.aggregate(items, F.slice(items, 1, 0), lambda kept, x: F.when((F.size(kept) == 0) | pred(F.element_at(kept, -1), x), F.concat(kept, F.array(x))).otherwise(kept))
    return fold


def sliced(df: DataFrame, keys: list[str], order: list[str], start: int, end: int) -> DataFrame:
    """Rows start to end - 1 of each key, from 0."""
    return df.withColumn("__i", index(keys, order)).filter((F.col("__i") >= start) & (F.col("__i") < end)).drop("__i")


def strided(df: DataFrame, keys: list[str], order: list[str], step: int) -> DataFrame:
    return df.withColumn("__i", index(keys, order)).filter(F.col("__i") % step == 0).drop("__i")


def replaced(x: Column, old, new) -> Column:
    return F.when(x == F.lit(old), F.lit(new)).otherwise(x)


def replaced_if(x: Column, pred: Column, new) -> Column:
    return F.when(pred, F.lit(new)).otherwise(x)


def is_sorted(df: DataFrame, x: str, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, is_sorted)."""
    step = F.coalesce(F.col(x) >= F.lag(x).over(_by(keys, order)), F.lit(True))
    return df.withColumn("__s", step).groupBy(*keys).agg(F.every("__s").alias("is_sorted"))


def is_partitioned(df: DataFrame, pred: Column, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, is_partitioned): no row that meets pred comes after one that doesn't."""
    out = df.withColumn("__p", pred)
    before = F.lag("__p").over(_by(keys, order))
    return out.withColumn("__b", F.coalesce(F.col("__p") & ~before, F.lit(False))).groupBy(*keys).agg((~F.bool_or("__b")).alias("is_partitioned"))


def stable_partition(keys: list[str], order: list[str], pred: Column) -> Column:
    """Place of each row if those that meet pred come first, otherwise in order."""
    return F.row_number().over(W.partitionBy(*keys).orderBy((~pred).cast("int"), *order)) - 1


def search_n(df: DataFrame, x: str, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Runs of n or more equal values: (keys, value, first, length), first by place from 0."""
    i, j = index(keys, order), F.row_number().over(W.partitionBy(*keys, x).orderBy(*order)) - 1
    runs = df.withColumn("__i", i).withColumn("__g", F.col("__i") - j)
    return runs.groupBy(*keys, x, "__g").agg(F.min("__i").alias("first"), F.count(F.lit(1)).alias("length")).filter(F.col("length") >= n).drop("__g")


def nth_element(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The row at place n, from 0, of each key."""
    return sliced(df, keys, order, n, n + 1)


def rotated(items: Column, by: int) -> Column:
    """An array turned left by so many places."""
    return F.concat(F.slice(items, by + 1, F.greatest(F.size(items) - by, F.lit(0))), F.slice(items, 1, by))


def shuffled(key: Column, seed: int) -> Column:
    """A pseudo-random order key that doesn't depend on partitions."""
    return F.xxhash64(F.lit(seed), key)


def combined(a: DataFrame, b: DataFrame, keys: list[str], order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows of a and b side by side by place."""
    x, y = a.withColumn("place", index(keys, order_a)), b.withColumn("place", index(keys, order_b))
    return x.join(y, [*keys, "place"])


def irange(spark, first: int, last: int, step: int = 1) -> DataFrame:
    """first, first + step, ... before last."""
    return spark.range(first, last, step)


def chained(items: Column, start: int, end: int, step: int, function) -> Column:
    """An array sliced from start to end - 1, then every step-th of it, then function of each."""
    some = F.slice(items, start + 1, end - start)
    return F.transform(F.filter(some, lambda x, i: i % step == 0), function)


def indirected(df: DataFrame, reference: str, target: DataFrame, key: str) -> DataFrame:
    """Rows of df with what their reference points to; a reference to nothing gives nulls."""
    return df.join(target.withColumnRenamed(key, "__key"), F.col(reference) == F.col("__key"), "left").drop("__key")


def swapped(a: Column, b: Column, start: int, size: int) -> tuple[Column, Column]:
    """Two arrays with their elements start to start + size - 1 exchanged."""

    def put(x, y):
        return F.concat(F.slice(x, 1, start), F.slice(y, start + 1, size), F.slice(x, F.lit(start + size + 1), F.greatest(F.size(x) - start - size, F.lit(0))))

    return put(a, b), put(b, a)


def gathered(items: Column, pivot: int, pred) -> Column:
    """An array with the elements that meet pred gathered around place pivot; both kinds keep their order."""
    left, right = F.slice(items, 1, pivot), F.slice(items, F.lit(pivot + 1), F.greatest(F.size(items) - pivot, F.lit(0)))
    other = lambda x: ~pred(x)
    return F.concat(F.filter(left, other), F.filter(left, pred), F.filter(right, pred), F.filter(right, other))


def next_permutation(items: Column) -> Column:
    """The next order of an array's elements; the last one is followed by the sorted one."""
    at = F.array_max(F.transform(F.filter(F.sequence(F.lit(1), F.size(items) - 1), lambda i: F.get(items, i - 1) < F.get(items, i)), lambda i: i))

    def turned(i):
        tail = F.slice(items, i + 1, F.size(items) - i)
        old = F.element_at(items, i)
        new = F.array_min(F.filter(tail, lambda x: x > old))
        rest = F.concat(F.array_remove(tail, new), F.array_repeat(new, F.size(F.filter(tail, lambda x: x == new)) - 1), F.array(old))
        return F.concat(F.slice(items, F.lit(1), i - 1), F.array(new), F.array_sort(rest))

    return F.when((F.size(items) < 2) | at.isNull(), F.array_sort(items)).otherwise(turned(at))
