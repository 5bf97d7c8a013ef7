"""Row and column selection: keep and extract lists, position ranges, original/control split, thinning, family masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in ids."""
    return df.join(ids.select(on) if isinstance(on, str) else ids.select(*on), on, "left_semi")


def exclude(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is not in ids; rows of a null key stay."""
    return df.join(ids.select(on) if isinstance(on, str) else ids.select(*on), on, "left_anti")


def check(df: DataFrame, on: str, excluded: DataFrame | None = None, included: DataFrame | None = None) -> DataFrame:
    """Exclusions first, then inclusions if that list is not empty."""
    if excluded is not None:
        df = exclude(df, excluded, on)
    return keep(df, included, on) if included is not None and not included.isEmpty() else df


def position_range(df: DataFrame, position: str, low: int, high: int) -> DataFrame:
    """Both bounds belong to the range."""
    return df.filter(F.col(position).between(low, high))


def split_control(df: DataFrame, is_control: str = "Knockoff", columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(original rows, control rows), with the given columns only."""
    pick = columns or df.columns
    return df.filter(~F.col(is_control)).select(*pick), df.filter(F.col(is_control)).select(*pick)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns chosen, ordered and renamed at once: {old: new}."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def fields_at(df: DataFrame, line: str, picks: dict[int, str]) -> DataFrame:
    """White-space separated fields of a text column by ordinal, from 1."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    return df.select(*[F.get(parts, i - 1).alias(n) for i, n in picks.items()])


def viewport(center_mb: Column, window_mb: Column, last_bp: Column) -> tuple[Column, Column]:
    """Left and right bound in base pairs of a window around a center, clamped to [0, last_bp]."""
    return F.lit(1e6) * F.greatest(F.lit(0.0), center_mb - window_mb), F.lit(1e6) * F.least(center_mb + window_mb, last_bp * F.lit(1e-6))


def boundaries(df: DataFrame, key: str, position: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(position).alias("min_bp"), F.max(position).alias("max_bp"))


def thin(df: DataFrame, index: str, step: int) -> DataFrame:
    """Every step-th row by index, from 0."""
    return df.filter(F.col(index) % step == 0)


def mask_by_family(df: DataFrame, family: str, order: str, value: str) -> DataFrame:
    """value replaced by that of the family's first member; rows of a null family are one family. A family's first member
    comes from an aggregate with map-side combine, so a large family is sorted nowhere."""
    first = df.groupBy(F.col(family).alias("__family")).agg(F.min(F.struct(order, value)).alias("__first"))
    out = df.join(first, F.col(family).eqNullSafe(F.col("__family")), "left").withColumn(value, F.col("__first")[value])
    return out.select(*df.columns)


def get_bit(words: Column, i: Column) -> Column:
    """Allele i of packed words, 64 to a word; null past the end."""
    return F.getbit(F.get(words, (i / 64).cast("int")), (i % 64).cast("int")).cast("int")


def set_bit(words: str, i: int, on: bool) -> Column:
    """Packed words with bit i set or cleared."""
    w, mask = i // 64, f"shiftleft(1L, {i % 64})"
    op = f"x | {mask}" if on else f"x & ~{mask}"
    return F.expr(f"transform({words}, (x, j) -> CASE WHEN j = {w} THEN {op} ELSE x END)")
