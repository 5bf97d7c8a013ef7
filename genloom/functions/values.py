"""JSON trees, vectors, hashes, random numbers and other value functions."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def json_tree(s: Column) -> Column:
    """Top level of a JSON object as untyped strings."""
    return F.from_json(s, "map<string,string>")


def json_path(s: Column, path: str) -> Column:
    return F.get_json_object(s, "$." + path)


def ini_pairs(line: Column) -> Column:
    """(key, value) of an INI line; null for others."""
    return F.when(line.rlike(r"^\s*[^;#\[\s=][^=]*="), F.struct(F.trim(F.regexp_extract(line, r"^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract(line, r"=(.*)$", 1)).alias("value")))


def norm(v: Column, p: int | str) -> Column:
    """1, 2 or "inf" norm of an array."""
    size = F.transform(v, lambda x: F.abs(x).cast("double"))
    if p == "inf":
        return F.array_max(size)
    if p == 1:
        return F.aggregate(size, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.aggregate(size, F.lit(0.0), lambda a, x: a + x * x))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def add(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def rounded(x: Column, places: int) -> Column:
    """x to so many decimal places by binary arithmetic, as C and DuckDB have it: scaled, to the nearest whole number with
    halves away from zero, scaled back. Spark's round() takes the shortest decimal form, which may fall on the other side of
    a half, and gives 0.0 for -0.0."""
    unit = F.lit(10.0**places)
    y = x.cast("double") * unit
    near = F.rint(y)
    whole = F.when((y > 0) & (y - near == 0.5), near + 1).when((y < 0) & (y - near == -0.5), near - 1).otherwise(near)
    return F.when(F.isnan(whole) | (F.abs(whole) == float("inf")), x.cast("double")).otherwise(whole / unit)


def fnv1(s: Column, bits: int = 32) -> Column:
    """FNV-1 of a string's UTF-8 bytes, 32 bits, without Python: a fold with prime and basis, kept in 64-bit arithmetic."""
    codes = F.transform(F.filter(F.split(F.hex(F.encode(s, "UTF-8")), "(?<=\\G..)"), lambda x: x != ""), lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: F.pmod(h * F.lit(16777619), F.lit(1 << 32)).bitwiseXOR(b))


def name_uuid(name: Column, namespace: str = uuid.NAMESPACE_DNS.hex) -> Column:
    """Version 5 UUID of a name, from the SHA-1 of namespace and name; no Python."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    at = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(at(17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", at(1, 8), at(9, 4), F.concat(F.lit("5"), at(14, 3)), F.concat(variant, at(18, 3)), at(21, 12))


class Taus88:
    """Three linear feedback shift registers, combined by exclusive or; seeded from three words."""

    REGISTERS = ((31, 13, 12), (29, 2, 4), (28, 3, 17))

    def __init__(self, seeds: tuple[int, int, int]):
        self.state = list(seeds)

    def __call__(self) -> int:
        out = 0
        for i, (k, q, s) in enumerate(self.REGISTERS):
            x = self.state[i]
            b = (((x << q) & 0xFFFFFFFF) ^ x) >> (k - s)
            x = (((x & (0xFFFFFFFF << (32 - k))) << s) & 0xFFFFFFFF) ^ b
            self.state[i] = x
            out ^= x
        return out


def generator(seed: int, *key: int) -> np.random.Generator:
    """Random numbers that depend on the seed and the key only, not on partitions."""
    return np.random.Generator(np.random.Philox(key=np.random.SeedSequence([seed, *[k & 0xFFFFFFFF for k in key]]).generate_state(2, np.uint64)))


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") / float(1 << 53)


def draw(u: Column, name: str, *p: float) -> Column:
    """A draw from a distribution by its inverse CDF of a uniform column."""
    u_ = F.greatest(u, F.lit(1e-300))
    if name == "bernoulli":
        return (u < p[0]).cast("int")
    if name == "exponential":
        return -F.log(1 - u) / p[0]
    if name == "geometric":
        return F.floor(F.log(1 - u) / np.log1p(-p[0]))
    if name == "cauchy":
        return p[0] + p[1] * F.tan(np.pi * (u - 0.5))
    if name == "weibull":
        return p[1] * F.pow(-F.log(1 - u), F.lit(1.0 / p[0]))
    if name == "extreme_value":
        return p[0] - p[1] * F.log(-F.log(u_))
    if name == "triangle":
        a, b, c = p
        cut = (b - a) / (c - a)
        return F.when(u < cut, a + F.sqrt(u * ((c - a) * (b - a)))).otherwise(c - F.sqrt((1 - u) * ((c - a) * (c - b))))
    if name == "uniform_int":
        return (F.floor(u * (p[1] - p[0] + 1)) + p[0]).cast("long")
    if name == "uniform_real":
        return p[0] + u * (p[1] - p[0])
    raise ValueError(name)


def draw_np(name: str, seed: int):
    """A pandas function of (key) for distributions without a simple inverse: numpy by keyed generator."""

    def out(key: pd.Series) -> pd.Series:
        return key.map(lambda k: float(getattr(generator(seed, int(k)), name)()))

    return F.pandas_udf(out, "double")


def weighted_choice(u: Column, weights: list[float]) -> Column:
    """The index drawn by weights."""
    total_, run, out = sum(weights), 0.0, F.lit(len(weights) - 1)
    for i in reversed(range(len(weights) - 1)):
        run = sum(weights[: i + 1]) / total_
        out = F.when(u < run, F.lit(i)).otherwise(out)
    return out
