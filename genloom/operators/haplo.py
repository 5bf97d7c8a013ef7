"""Bit-packed haplotypes: packing, Hamming distances, nearest references, allele frequencies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, StructField, StructType


def pack(alleles: str) -> Column:
    """array<bigint> words of an array column of 0/1 alleles; allele i is bit i & 63 of word i >> 6."""
    return F.expr(
        f"transform(sequence(0, greatest(0, cast(ceil(size({alleles}) / 64.0) AS INT) - 1)), __w -> aggregate(sequence(0, 63), 0L, "
        f"(__s, __k) -> __s | CASE WHEN coalesce(get({alleles}, __w * 64 + __k), 0) = 1 THEN shiftleft(1L, __k) ELSE 0L END))"
    )


def unpack(words: str, n: str) -> Column:
    """The n alleles of packed words."""
    return F.expr(f"transform(slice(sequence(0, greatest({n} - 1, 0)), 1, cast({n} AS INT)), __i -> cast(getbit(get({words}, cast(__i DIV 64 AS INT)), cast(__i % 64 AS INT)) AS INT))")


def hamming(a: str, b: str) -> Column:
    """Differing bits of two arrays of words; the shorter is padded with zeros."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (__x, __y) -> bit_count(coalesce(__x, 0L) ^ coalesce(__y, 0L))), 0, (__s, __d) -> __s + __d)")


def hamming_range(a: str, b: str, low: int, high: int) -> Column:
    """Differing bits at places low to high, both included; words at the edges are masked."""
    first, last = low // 64, high // 64
    mask = f"CASE WHEN __i = {first} THEN shiftleft(-1L, {low % 64}) ELSE -1L END & CASE WHEN __i = {last} THEN shiftrightunsigned(-1L, {63 - high % 64}) ELSE -1L END"
    return F.expr(f"aggregate(transform(sequence({first}, {last}), __i -> bit_count((coalesce(get({a}, __i), 0L) ^ coalesce(get({b}, __i), 0L)) & ({mask}))), 0, (__s, __d) -> __s + __d)")


def capped(distance: Column, most: int) -> Column:
    return F.least(distance, F.lit(most))


#: Rows of a block of queries and of a block of candidates; a task compares one block of each at a time.
QUERIES, CANDIDATES = 4096, 16_384


def _bits(column) -> np.ndarray:
    """(rows, words) of an Arrow column of arrays of words, shorter arrays padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), max(1, size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False)
    return out.view(np.uint64)


def _closest(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, k: int):
    """(rows of a, rows of b, distances): for each row of a the k nearest rows of b under another id, ties by place in b."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    step = max(1, (1 << 20) // len(b))
    kind = np.int32 if (width * 64 + 1) * len(b) < 2**31 else np.int64
    far = np.iinfo(kind).max
    place, out = np.arange(len(b), dtype=kind), []
    for at in range(0, len(a), step):
        d = sum(np.bitwise_count(a[at : at + step, None, w] ^ b[None, :, w]).astype(kind) for w in range(width))
        d = d * kind(len(b)) + place
        d[ia[at : at + step, None] == ib] = far
        rows = np.arange(len(d))
        for _ in range(min(k, len(b))):
            j = d.argmin(axis=1)
            low = d[rows, j]
            some = low < far
            out.append((at + rows[some], j[some], low[some] // len(b)))
            d[rows, j] = far
    return [np.concatenate(x) for x in zip(*out)]


def nearest(df: DataFrame, keys: list[str], ident: str, words: str, k: int) -> DataFrame:
    """(keys, id, ref, distance, rank): the k nearest others of the same cluster by Hamming distance, ties by id.

    Every pair of a cluster is compared, but none becomes a row: a cluster's rows are dealt to blocks by a hash of the id, a
    task takes a block of queries and one of candidates and gives each query's k nearest of these; the nearest of all blocks
    are merged. Work is quadratic in a cluster, memory is that of two blocks. Rows of a null key or id have no others.
    """
    rows = df.select(*keys, F.col(ident).alias("id"), F.col(words).alias("w")).dropna(subset=[*keys, "id"])
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    cut = lambda most: F.greatest(F.lit(1), F.ceil(F.col("__n") / most)).cast("int")
    dealt = rows.join(size, keys).withColumns({"__nq": cut(QUERIES), "__nc": cut(CANDIDATES)})
    mine = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = dealt.select(*keys, "id", "w", F.lit(True).alias("__a"), mine("__nq", 0).alias("__q"), every("__nc").alias("__c"))
    both = asking.unionByName(dealt.select(*keys, "id", "w", F.lit(False).alias("__a"), every("__nq").alias("__q"), mine("__nc", 1).alias("__c")))
    found = StructType([*[rows.schema[x] for x in keys], StructField("id", rows.schema["id"].dataType), StructField("ref", rows.schema["id"].dataType), StructField("distance", IntegerType())])

    def compare(cell: pa.Table) -> pa.Table:
        a, b = cell.filter(pc.field("__a")), cell.filter(~pc.field("__a")).sort_by("id")
        ids = [np.unique(np.concatenate([x.column("id").to_numpy() for x in (a, b)]), return_inverse=True)[1].ravel()] if len(a) and len(b) else []
        i, j, d = _closest(_bits(a.column("w")), _bits(b.column("w")), ids[0][: len(a)], ids[0][len(a) :], k) if ids else [np.zeros(0, np.int64)] * 3
        got = a.select([*keys, "id"]).take(pa.array(i))
        return got.append_column("ref", b.column("id").take(pa.array(j))).append_column("distance", pa.array(d, pa.int32()))

    pairs = both.groupBy(*keys, "__q", "__c").applyInArrow(compare, found)
    rank = F.row_number().over(W.partitionBy(*keys, "id").orderBy("distance", "ref"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def phased(p: str) -> Column:
    """The allele pair of four phased probabilities; ties take the reference allele."""
    return F.expr(f"struct(CAST({p}[1] > {p}[0] AS INT) AS first, CAST({p}[3] > {p}[2] AS INT) AS second)")


def allele_frequencies(df: DataFrame, words: str = "words", n: str = "n") -> DataFrame:
    """(chr, snp_idx, maf) of packed haplotypes."""
    long = df.select("chr", F.posexplode(unpack(words, n)).alias("snp_idx", "allele"))
    p = F.avg("allele")
    return long.groupBy("chr", "snp_idx").agg(F.least(p, 1 - p).alias("maf"))
