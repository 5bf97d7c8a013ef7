"""Clusters of related haplotypes of bounded size, and each haplotype's nearest references within its cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genloom.operators.haplo import nearest
from genloom.runtime import materialize, small_or_not


#: Quantiles of a feature that the cut of a large cluster chooses its borders from.
QUANTILES = 256


def clusters(df: DataFrame, ident: str, features: str, least: int = 1000, most: int = 10_000, seed: int = 2020) -> DataFrame:
    """df with cluster_id: bisecting k-means on an array column; clusters over most are cut along their widest feature, and
    what is still larger (rows alike in it) by a hash of the id.

    The bound on a cluster bounds what nearest() pairs, so pairs grow with the rows times most. A nearest reference on the
    other side of a cut is not found; tests measure how many are.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    n = df.count()
    k = max(1, -(-n // most))
    vec = df.withColumn("__features", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    if k == 1:
        out = vec.withColumn("__c", F.lit(0)).drop("__features")
    else:
        model = BisectingKMeans(k=k, minDivisibleClusterSize=float(max(1, least)), seed=seed, featuresCol="__features", predictionCol="__c").fit(vec)
        out = model.transform(vec).drop("__features")
    out = _cut(materialize(out, "clusters"), features, most)
    parts = _parts(out, ["__c", "__slice"], most, "__subs")
    out = out.join(small_or_not(parts), ["__c", "__slice"], "left")
    sub = F.pmod(F.xxhash64(ident), F.coalesce("__subs", F.lit(1)).cast("long"))
    return out.withColumn("cluster_id", F.concat_ws("-", "__c", "__slice", sub)).drop("__c", "__slice", "__subs")


def _parts(df: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """(keys, name): into how many parts each group of more than most rows is to be cut."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    return materialize(size.select(*keys, F.ceil(F.col("__n") / most).cast("int").alias(name)), "large")


def _cut(df: DataFrame, features: str, most: int) -> DataFrame:
    """df with __slice: the place of a row along the widest feature of its cluster, where that is over most; else 0."""
    large = small_or_not(_parts(df, ["__c"], most, "__parts"))
    some = df.select("__c", features).join(large, "__c")
    spread = some.select("__c", F.posexplode(features).alias("i", "x")).groupBy("__c", "i").agg(F.var_pop("x").alias("v"))
    wide = spread.groupBy("__c").agg(F.max_by("i", F.struct("v", -F.col("i"))).alias("__i"))
    wide = materialize(wide, "widest")
    at = [i / QUANTILES for i in range(1, QUANTILES)]
    x = F.element_at(features, F.col("__i") + 1).cast("double")
    borders = some.join(small_or_not(wide), "__c").groupBy("__c", "__parts", "__i").agg(F.percentile_approx(x, at, F.lit(10_000)).alias("__q"))
    out = df.join(small_or_not(materialize(borders, "borders")), "__c", "left")
    rank = F.size(F.filter("__q", lambda q: q < x))
    return out.withColumn("__slice", F.coalesce(F.floor(rank * F.col("__parts") / QUANTILES), F.lit(0)).cast("int")).drop("__q", "__parts", "__i")


def references(df: DataFrame, ident: str, words: str, k: int = 10) -> DataFrame:
    """(cluster_id, hap_id, refs): the k nearest others of the cluster, sorted by distance."""
    near = nearest(df, ["cluster_id"], ident, words, k)
    return near.groupBy("cluster_id", F.col("id").alias("hap_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref"))), lambda x: x["ref"]).alias("refs"))


def check_references(refs: DataFrame) -> DataFrame:
    """(rows, self_references, duplicates, empty): counts that must be rows, 0, 0, 0."""
    return refs.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.array_contains("refs", F.col("hap_id"))).alias("self_references"), F.count_if(F.size("refs") != F.size(F.array_distinct("refs"))).alias("duplicates"), F.count_if(F.size("refs") == 0).alias("empty"))
