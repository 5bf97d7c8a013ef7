"""A corpus pipeline: quality rules, exact dedup, near-duplicate removal, mixing to target weights, BPE encoding.

Each stage works on all that its predecessor kept, written as Parquet in between. All but the last return the columns of
documents. Nulls, repeated rows and empty tables are as the operators define them: rows of a null id pass the stages that
decide by id, a row repeated in full leaves exact dedup once, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genloom.llm import bpe, exact_dedup, mixing, ngram_join, quality
from genloom.runtime import discard, materialize, scratch, table

#: Percent of the tokens that reach the mix which it may give; each document is taken once at most.
PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents without their hosts' boilerplate lines; n_chars, where there is one, is that of the text that stays."""
    out = quality.cleaned(docs)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), size).otherwise(F.col("n_chars")))
    return out


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mix(docs, F.expr(mixing.DOMAIN_SQL), F.col("lang"), F.col("source"), mixing.WEIGHTS, PERCENT, max_epochs=1)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, bpe.vocabulary_path())


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing to target weights", mixed), ("BPE encoding", encoded)]

#: SQL can express neither the linked components at this size nor the encoding; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's tables go as soon as the next stage's result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            last, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            made.keep(docs)
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
