"""Queries of the discovery family, with a synthetic stand-in for importances: groups are parts, lines with flag A or R
are the original variables and lines with flag N are the negative controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from genloom.operators.discovery import discoveries, group_statistic
from genloom.runtime import table


def _stats(spark, sf_dir, original, control):
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin(*original, *control))
    return group_statistic(lines, ["l_partkey"], F.col("l_extendedprice"), F.col("l_returnflag").isin(*control), 2)


def knockoff_filter_discoveries(spark, sf_dir):
    return discoveries(_stats(spark, sf_dir, "AR", "N"), [], 0.1).select("l_partkey", F.round("w", 2).alias("w"), "threshold")


def knockoff_filter_null_control(spark, sf_dir):
    return discoveries(_stats(spark, sf_dir, "A", "R"), [], 0.1).select("l_partkey", F.round("w", 2).alias("w"), "threshold")


def _sql(original, control):
    return f"""
        WITH s AS (SELECT l_partkey, round(sum(CASE WHEN l_returnflag IN ({original}) THEN abs(l_extendedprice) ELSE 0.0 END)
                     - sum(CASE WHEN l_returnflag IN ({control}) THEN abs(l_extendedprice) ELSE 0.0 END), 2) AS w
                   FROM lineitem WHERE l_returnflag IN ({original}, {control}) GROUP BY 1),
             a AS (SELECT abs(w) AS t, count(*) FILTER (w > 0) AS pos, count(*) FILTER (w < 0) AS neg FROM s WHERE w <> 0 GROUP BY 1),
             c AS (SELECT t, (1 + sum(neg) OVER d) / greatest(1, sum(pos) OVER d) AS ratio FROM a
                   WINDOW d AS (ORDER BY t DESC RANGE UNBOUNDED PRECEDING)),
             m AS (SELECT min(t) AS threshold FROM c WHERE ratio <= 0.1)
        SELECT l_partkey, w, threshold FROM s, m WHERE w >= threshold
    """


QUERIES = {"knockoff_filter_discoveries": knockoff_filter_discoveries, "knockoff_filter_null_control": knockoff_filter_null_control}
ORACLES = {"knockoff_filter_discoveries": _sql("'A', 'R'", "'N'"), "knockoff_filter_null_control": _sql("'A'", "'R'")}
