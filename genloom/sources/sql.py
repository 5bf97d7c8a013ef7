"""Raw SQL over DataFrames with named parameters, and tables of a SQLite file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def run(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, **args) -> DataFrame:
    """Runs text with :name parameters bound as values, never spliced in; tables are temporary views while it is analysed."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(text, args=args)
    finally:
        for name in tables or {}:
            spark.catalog.dropTempView(name)


def replaced_at_once(df: DataFrame, path: str) -> None:
    """df as the Parquet table at path, by two renames once it is written whole: the old table stays if writing fails. Between
    the renames, for a moment, there is no table."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    at = jvm.org.apache.hadoop.fs.Path
    system = at(path).getFileSystem(conf)
    if system.exists(at(path)):
        system.rename(at(path), at(old))
    if not system.rename(at(new), at(path)):
        system.rename(at(old), at(path))
        raise OSError(f"no table could be put at {path}")
    system.delete(at(old), True)


def sqlite_table(spark: SparkSession, path: str, query: str, schema: str, params: tuple = ()) -> DataFrame:
    """Rows of a query on a SQLite file that every executor can read, by one task; for small side tables."""

    def read(_):
        import sqlite3

        import pandas as pd

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
            cur = con.execute(query, params)
            names = [c[0] for c in cur.description]
            while rows := cur.fetchmany(10_000):
                yield pd.DataFrame(rows, columns=names)

    return spark.range(0, 1, 1, 1).mapInPandas(read, schema)
