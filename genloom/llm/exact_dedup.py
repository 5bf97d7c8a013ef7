"""Exact dedup [native]: group by a 128-bit content hash, compare bytes inside groups, keep one stable id of each group.

Only texts whose hash occurs twice or more travel, and copies collapse before the shuffle: the aggregate has the hash and
the text itself as keys, so texts that merely collide stay apart and a group of any size leaves each map task as one row.
Membership comes back by a join on the hash, by broadcast if the duplicated classes are few, else by a shuffle whose hot
keys AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genloom.runtime import materialize, scratch, small_or_not, table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256) for every input row; row is a struct of the input's columns.

    keep: "min" or "max", the id of a group that stays. A null text counts as empty. Rows with equal id and text are all
    in the group and are all kept or all dropped. Null ids are never chosen unless the group has no other; then keep_id
    is null and the group's rows are kept. An empty table gives no rows. Other columns may have any names.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.md5(F.col("t").cast("binary")))
    with scratch(docs.sparkSession) as made:
        seen = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
        twice = small_or_not(materialize(seen, "dup-hashes"))
        classes = rows.select("doc_id", "h", "t").join(twice, "h", "left_semi").groupBy("h", "t").agg(best("doc_id").alias("k"), F.count(F.lit(1)).alias("n"))
        classes = materialize(classes.select("h", F.sha2(F.col("t").cast("binary"), 256).alias("s"), "k", "n"), "dup-classes")
        made.keep(classes)
    out = rows.select("row", "doc_id", "h", F.sha2(F.col("t").cast("binary"), 256).alias("s")).join(small_or_not(classes), ["h", "s"], "left")
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("k"))
    return out.select("row", "doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.col("s").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row of docs for each distinct text, with docs' columns; a row repeated in full stays once."""
    out = exact_dedup(docs, id_col, text_col, keep).filter("kept")
    alone, several = out.filter("group_size = 1"), out.filter("group_size > 1").dropDuplicates(["doc_id", "text_sha256"])
    return alone.unionByName(several).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="max").drop("row")


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
}
