"""Windows, interval joins, segment algebra and clumping. Positions are integers; [start, end) unless said otherwise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genloom.runtime import dealt, pieces


def windows_from_starts(starts: DataFrame, keys: list[str], start: str, size: Column) -> DataFrame:
    """Half-open windows numbered from 0 by start; the last ends at size."""
    by = W.partitionBy(*keys).orderBy(start)
    return starts.select(*keys, (F.row_number().over(by) - 1).alias("w"), F.col(start).alias("start"), F.coalesce(F.lead(start).over(by), size).alias("end"))


def _bins(lo: Column, hi: Column, width: int) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], position: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points with the half-open spans that hold them, by an equi join on bins of the given width.

    A span is in each bin that it touches and a point in one, so a pair meets once and the join scales with the matches.
    """
    p = points.withColumn("__bin", F.floor(F.col(position) / width))
    s = spans.filter(F.col(start) < F.col(end)).withColumn("__bin", F.explode(_bins(F.col(start), F.col(end) - 1, width)))
    s = s.select(*[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in s.columns]).withColumnRenamed("__bin", "__sbin")
    on = (F.col("__bin") == F.col("__sbin")) & (F.col(position) >= F.col(start)) & (F.col(position) < F.col(end))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__k_{k}"))
    return p.join(s, on, how).drop("__bin", "__sbin", *[f"__k_{k}" for k in keys])


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int, parts: int = 0) -> DataFrame:
    """Pairs of closed spans that share a position. Both sides go into all their bins; a pair counts only in the bin where
    the later of its starts lies, so none is made twice and nothing needs to be deduplicated. parts: as of dealt()."""
    (a0, a1), (b0, b1) = a_span, b_span
    x = a.withColumn("__bin", F.explode(_bins(F.col(a0), F.col(a1), width)))
    y = b.withColumn("__bin", F.explode(_bins(F.col(b0), F.col(b1), width)))
    y = y.select(*[F.col(c).alias(f"__k_{c}") if c in [*keys, "__bin"] else F.col(c) for c in y.columns])
    on = (F.col("__bin") == F.col("__k___bin")) & (F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1)) & (F.floor(F.greatest(F.col(a0), F.col(b0)) / width) == F.col("__bin"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__k_{k}"))
    x, y = dealt(x, parts, "__bin", *keys), dealt(y, parts, "__k___bin", *[f"__k_{k}" for k in keys])
    return x.join(y, on).drop("__bin", "__k___bin", *[f"__k_{k}" for k in keys])


def touches(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Closed spans that share no position but leave none between them."""
    return (b0 == a1 + 1) | (a0 == b1 + 1)


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Positions between two closed spans, 0 if they touch or overlap."""
    return F.greatest(F.lit(0), F.greatest(a0, b0) - F.least(a1, b1) - 1)


def length(j_min: Column, j_max: Column) -> Column:
    return j_max - j_min + 1


def shared(a: Column, b: Column) -> Column:
    """The shared part of two segments (structs of j_min, j_max, indices): the overlap for the indices of both; else null."""
    lo, hi = F.greatest(a["j_min"], b["j_min"]), F.least(a["j_max"], b["j_max"])
    return F.when(lo <= hi, F.struct(lo.alias("j_min"), hi.alias("j_max"), F.array_sort(F.array_union(a["indices"], b["indices"])).alias("indices")))


def subtract(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """What is left of closed span a without b: an array of at most two structs (start, end)."""
    whole = F.array(F.struct(a0.alias("start"), a1.alias("end")))
    left = F.struct(a0.alias("start"), F.least(a1, b0 - 1).alias("end"))
    right = F.struct(F.greatest(a0, b1 + 1).alias("start"), a1.alias("end"))
    return F.when((b1 < a0) | (b0 > a1), whole).otherwise(F.filter(F.array(left, right), lambda x: x["start"] <= x["end"]))


def shave(j_min: Column, j_max: Column, from_start: int = 0, from_end: int = 0) -> Column:
    """(j_min, j_max) shorter by so many positions at either end; null if nothing is left."""
    lo, hi = j_min + from_start, j_max - from_end
    return F.when(lo <= hi, F.struct(lo.alias("j_min"), hi.alias("j_max")))


def gap_islands(df: DataFrame, keys: list[str], start: str, end: str, reach: int = 0, touching: bool = True) -> DataFrame:
    """Merged spans of each key: spans merge if the next starts within reach of the furthest end so far.

    A running maximum of ends is needed, not the last end, because a long span may cover several short ones.
    """
    return _islands(dealt(df, pieces(df), *keys), keys, start, end, reach, touching, [start, end])


def _islands(df: DataFrame, keys: list[str], start: str, end: str, reach: int, touching: bool, order: list[str]) -> DataFrame:
    """gap_islands of rows as they are dealt; order: just start where starts are distinct."""
    by = W.partitionBy(*keys).orderBy(*order)
    far = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    apart = F.col(start) > far + reach if touching else F.col(start) >= far + reach
    out = df.withColumn("__new", F.coalesce(apart.cast("int"), F.lit(1)))
    out = out.withColumn("island", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return out.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n"))


def short(df: DataFrame, j_min: str, j_max: str, least: int) -> DataFrame:
    return df.filter(length(F.col(j_min), F.col(j_max)) < least)


def expand_close(df: DataFrame, keys: list[str], start: str, end: str, reach: int) -> DataFrame:
    """Ends moved to the next start where the gap between is reach or less."""
    nxt = F.lead(start).over(W.partitionBy(*keys).orderBy(start, end))
    return df.withColumn(end, F.when((nxt > F.col(end)) & (nxt - F.col(end) - 1 <= reach), nxt - 1).otherwise(F.col(end)))


def sweep(spans: dict[str, DataFrame], keys: list[str], start: str, end: str, value: str | None = None) -> DataFrame:
    """Elementary segments of several span sets: (keys, start, end, n_<name> cover counts, v_<name> summed values).

    Every start adds and every end takes away; running sums over the borders of a key give what covers each segment.
    """
    rows = None
    for n, df in enumerate(spans.values()):
        v = F.col(value).cast("double") if value else F.lit(0.0)
        side = df.select(*keys, F.lit(n).alias("__n"), F.col(start).alias("__start"), F.col(end).alias("__end"), v.alias("__v"))
        rows = side if rows is None else rows.unionByName(side)
    ends = F.array(F.struct(F.col("__start").alias("at"), F.lit(1).alias("d"), F.col("__v").alias("v")), F.struct(F.col("__end").alias("at"), F.lit(-1).alias("d"), (-F.col("__v")).alias("v")))
    both = dealt(rows, pieces(*spans.values()), *keys).select(*keys, "__n", F.explode(ends).alias("e")).select(*keys, "__n", "e.*")
    own = lambda n, c, none: F.sum(F.when(F.col("__n") == n, F.col(c)).otherwise(F.lit(none)))
    at = both.groupBy(*keys, "at").agg(*[own(n, "d", 0).alias(f"d_{name}") for n, name in enumerate(spans)], *[own(n, "v", 0.0).alias(f"x_{name}") for n, name in enumerate(spans)])
    by = W.partitionBy(*keys).orderBy("at")
    run = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = at.select(*keys, F.col("at").alias("start"), F.lead("at").over(by).alias("end"), *[F.sum(f"d_{n}").over(run).alias(f"n_{n}") for n in spans], *[F.sum(f"x_{n}").over(run).alias(f"v_{n}") for n in spans])
    return out.filter(F.col("end").isNotNull())


def set_algebra(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str, op: str) -> DataFrame:
    """Merged half-open spans of a union, intersection, difference or symmetric difference."""
    x, y = F.col("n_a") > 0, F.col("n_b") > 0
    rule = {"union": x | y, "intersection": x & y, "difference": x & ~y, "symmetric": x != y}[op]
    return _islands(sweep({"a": a, "b": b}, keys, start, end).filter(rule), keys, "start", "end", 0, True, ["start"]).select(*keys, "start", "end")


def combine(df: DataFrame, keys: list[str], start: str, end: str, style: str) -> DataFrame:
    """Half-open spans combined: joining merges what touches, separating only what overlaps, splitting cuts at every border,
    elemental gives each position a span of its own."""
    if style == "elemental":
        whole = gap_islands(df, keys, start, end).filter(F.col("start") < F.col("end"))  # merged first, so no position comes twice
        at = whole.select(*keys, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("start"))
        return at.withColumn("end", F.col("start") + 1)
    if style == "splitting":
        return sweep({"a": df}, keys, start, end).filter("n_a > 0").select(*keys, "start", "end")
    return gap_islands(df, keys, start, end, touching=style == "joining").select(*keys, "start", "end")


def clump(df: DataFrame, keys: list[str], position: str, score: str, reach: int) -> DataFrame:
    """Greedy clumps of each key: the smallest score leads and takes all free rows within reach, and so on; a lead column.

    Rows that no gap above reach parts form an island, and no clump crosses such a gap. A task reads its islands in order and
    works on all that a batch completes at once, so many small islands cost no call each; an island is held whole.
    """
    schema = df.withColumn("lead", F.col(position).cast("long")).schema
    apart = F.coalesce(F.col(position) - F.lag(position).over(W.partitionBy(*keys).orderBy(position)) > reach, F.lit(True))
    dealt = df.withColumn("__new", apart).sortWithinPartitions(*keys, position)

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        pos, new = rows[position].to_numpy(), rows["__new"].to_numpy()
        order = rows[[score, position]].reset_index(drop=True).sort_values([score, position], kind="stable").index
        at = np.where(new, reach + 1, np.diff(pos, prepend=pos[:1])).cumsum()  # islands side by side, out of each other's reach
        lo, hi = at.searchsorted(at - reach, "left").tolist(), at.searchsorted(at + reach, "right").tolist()
        lead, taken = np.full(len(rows), -1), bytearray(len(rows))
        for i in order.tolist():
            if not taken[i]:
                taken[lo[i] : hi[i]] = b"\1" * (hi[i] - lo[i])
                some = lead[lo[i] : hi[i]]
                some[some < 0] = i
        return rows.drop(columns="__new").assign(lead=pd.Series(pos[lead], rows.index).astype("Int64"))

    def part(batches):
        held = []
        for b in batches:
            if len(starts := np.flatnonzero(b["__new"].to_numpy())):
                whole = pd.concat([*held, b.iloc[: starts[-1]]])
                if len(whole):
                    yield greedy(whole)
                held = []
            held.append(b.iloc[starts[-1] :] if len(starts) else b)
        if held:
            yield greedy(pd.concat(held))

    return dealt.mapInPandas(part, schema)


def in_order(a: Column, b: Column) -> Column:
    """Whether segment a comes before b (structs of j_min, j_max, indices): by start, then end, then indices."""
    return F.struct(a["j_min"], a["j_max"], a["indices"]) < F.struct(b["j_min"], b["j_max"], b["indices"])


def interpolate(points: DataFrame, knots: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """value of each point between its flanking knots, linear; flat outside. One sort by key, no pair of a point and a knot."""
    p = points.withColumn("__v", F.lit(None).cast("double")).withColumn("__point", F.lit(1))
    k = knots.select(*keys, F.col(position), F.col(value).cast("double").alias("__v")).withColumn("__point", F.lit(0))
    all_ = p.unionByName(k, allowMissingColumns=True)
    knot = F.when(F.col("__point") == 0, F.struct(F.col(position).cast("double").alias("x"), F.col("__v").alias("y")))
    before = F.last(knot, True).over(W.partitionBy(*keys).orderBy(position, "__point").rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.first(knot, True).over(W.partitionBy(*keys).orderBy(position, F.desc("__point")).rowsBetween(W.currentRow, W.unboundedFollowing))
    out = all_.withColumn("__b", before).withColumn("__a", after).filter("__point = 1")
    x, b, a = F.col(position).cast("double"), F.col("__b"), F.col("__a")
    y = F.when(b.isNull(), a["y"]).when(a.isNull() | (a["x"] == b["x"]), b["y"]).otherwise(b["y"] + (a["y"] - b["y"]) * (x - b["x"]) / (a["x"] - b["x"]))
    return out.withColumn(value, y).select(*points.columns, value)


def tidy_overlapping(df: DataFrame, keys: list[str], start: str, end: str, indices: str) -> DataFrame:
    """Segments of a cluster made disjoint: cut at every border, each piece with the sorted union of the indices of what
    covers it, and touching pieces of equal indices joined. Closed segments; (keys, start, end, indices)."""
    n = pieces(df)
    cut = sweep({"a": df.withColumn("__stop", F.col(end) + 1)}, keys, start, "__stop").filter("n_a > 0").select(*keys, F.col("start").alias("__lo"), (F.col("end") - 1).alias("__hi"))
    by = W.partitionBy(*keys).orderBy("__at")
    # each segment's indices enter at its start and leave after its end; an index is on where its running count is above 0
    ids = dealt(df.select(*keys, F.explode(indices).alias("__i"), F.col(start).alias("__s"), (F.col(end) + 1).alias("__e")), n, *keys)
    spans = _islands(ids, [*keys, "__i"], "__s", "__e", 0, True, ["__s", "__e"]).select(*keys, "__i", F.col("start").alias("__s"), (F.col("end") - 1).alias("__e"))
    width = 1 << 16
    hit = dealt(overlap_join(cut, spans, keys, ("__lo", "__hi"), ("__s", "__e"), width, n), n, *keys)
    piece = hit.groupBy(*keys, "__lo", "__hi").agg(F.array_sort(F.collect_set("__i")).alias("indices")).withColumn("__at", F.col("__lo"))
    new = ~((F.lag("__hi").over(by) + 1).eqNullSafe(F.col("__lo")) & F.lag("indices").over(by).eqNullSafe(F.col("indices")))
    run = piece.withColumn("__g", new.cast("int"))
    run = run.withColumn("__g", F.sum("__g").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return run.groupBy(*keys, "__g").agg(F.min("__lo").alias("start"), F.max("__hi").alias("end"), F.first("indices").alias("indices")).drop("__g")


def box_join(a: DataFrame, b: DataFrame, a_box: tuple[str, str, str, str], b_box: tuple[str, str, str, str], width: float) -> DataFrame:
    """Pairs of closed boxes (x0, y0, x1, y1) that meet, by an equi join on grid cells; a pair counts in the cell of the
    lower corner of its overlap only. Column names of a and b must differ."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a_box, b_box
    cell = lambda df, x0, y0, x1, y1, n: df.withColumn(f"__x{n}", F.explode(_bins(F.col(x0), F.col(x1), width))).withColumn(f"__y{n}", F.explode(_bins(F.col(y0), F.col(y1), width)))
    on = (F.col("__x1") == F.col("__x2")) & (F.col("__y1") == F.col("__y2")) & (F.col(ax0) <= F.col(bx1)) & (F.col(bx0) <= F.col(ax1)) & (F.col(ay0) <= F.col(by1)) & (F.col(by0) <= F.col(ay1))
    own = (F.floor(F.greatest(F.col(ax0), F.col(bx0)) / width) == F.col("__x1")) & (F.floor(F.greatest(F.col(ay0), F.col(by0)) / width) == F.col("__y1"))
    return cell(a, *a_box, 1).join(cell(b, *b_box, 2), on & own).drop("__x1", "__y1", "__x2", "__y2")
