"""Negative controls for haplotypes by a hidden Markov model (Li & Stephens 2003; Sesia, Sabatti & Candès 2019; Sesia et
al. 2020 for groups).

A haplotype copies one of its K references at each variant, switches with a probability that grows with distance, and
miscopies with a small probability. States are sampled given the haplotype; a control chain of states is sampled group by
group so that swapping any set of whole groups leaves the joint law as it is; control alleles are emitted from it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genloom.functions.values import generator
from genloom.operators.haplo import unpack


def switch_probability(cm: np.ndarray, rho: float) -> np.ndarray:
    """Probability of a switch before each variant from map positions; the first is 1 by convention."""
    return np.concatenate(([1.0], 1 - np.exp(-rho * np.maximum(0, np.diff(cm)))))


def _step(v: np.ndarray, r: float) -> np.ndarray:
    """v times the transition matrix: stay with 1 - r, else any of the K states."""
    return (1 - r) * v + r * v.mean(axis=1, keepdims=True)


def _pick(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    run = weights.cumsum(axis=1)
    return np.minimum((run < (u * run[:, -1])[:, None]).sum(axis=1), weights.shape[1] - 1)


def _toward(state: np.ndarray, r: float, k: int) -> np.ndarray:
    """(n, K): probability of going to state from each state, which is also that of coming from it."""
    out = np.full((len(state), k), r / k)
    out[np.arange(len(state)), state] += 1 - r
    return out


def sample_states(match: np.ndarray, r: np.ndarray, mutation: float, u: np.ndarray) -> np.ndarray:
    """(n, p) states given whether each reference matches: match is (n, K, p); u are uniforms (n, p)."""
    n, k, p = match.shape
    f, v = np.empty((p, n, k)), np.full((n, k), 1.0 / k)
    for j in range(p):
        v = (_step(v, r[j]) if j else v) * np.where(match[:, :, j], 1 - mutation, mutation)
        v /= v.sum(axis=1, keepdims=True)
        f[j] = v
    z = np.empty((n, p), np.int64)
    z[:, -1] = _pick(f[-1], u[:, -1])
    for j in range(p - 2, -1, -1):
        z[:, j] = _pick(f[j] * _toward(z[:, j + 1], r[j + 1], k), u[:, j])
    return z


def control_states(z: np.ndarray, r: np.ndarray, k: int, starts: list[int], u: np.ndarray) -> np.ndarray:
    """(n, p) control states of a chain. starts are the first variants of the groups.

    Group by group, given the original states outside the group and the control states before it: forward messages through
    the group (weighted at its left end by both chains over the last normaliser), then a backward draw; the normaliser
    that the next group divides by is the message one step beyond.
    """
    n, p = z.shape
    out, norm = np.empty_like(z), np.ones((n, k))
    for s, e in zip(starts, [*starts[1:], p]):
        v = _toward(z[:, s - 1], r[s], k) * _toward(out[:, s - 1], r[s], k) / norm if s else np.full((n, k), 1.0 / k)
        v /= v.sum(axis=1, keepdims=True)
        f = [v]
        for j in range(s + 1, e):
            v = _step(v, r[j])
            f.append(v)
        last = f[-1] * _toward(z[:, e], r[e], k) if e < p else f[-1]
        out[:, e - 1] = _pick(last, u[:, e - 1])
        for j in range(e - 2, s - 1, -1):
            out[:, j] = _pick(f[j - s] * _toward(out[:, j + 1], r[j + 1], k), u[:, j])
        if e < p:
            norm = _step(f[-1], r[e])
    return out


def controls(h: np.ndarray, refs: np.ndarray, r: np.ndarray, mutation: float, starts: list[int], rngs: list[np.random.Generator]) -> np.ndarray:
    """(n, p) control alleles of h given each row's reference alleles (n, K, p); a row draws from its own generator."""
    n, k, p = refs.shape
    u = np.stack([g.random((3, p)) for g in rngs], axis=1)
    z = sample_states(refs == h[:, None, :], r, mutation, u[0])
    zk = control_states(z, r, k, starts, u[1])
    copied = refs[np.arange(n)[:, None], zk, np.arange(p)]
    return np.where(u[2] < mutation, 1 - copied, copied)


def generate(haplotypes: DataFrame, refs: DataFrame, group_size: int, rho: float, mutation: float, seed: int, block: int = 512) -> DataFrame:
    """(chr, hap_id, alleles, controls) of packed haplotypes. refs: (chr, hap_id, refs).

    References' alleles come by a join, so a task holds block haplotypes with their K references and no more. Draws depend
    on seed, chromosome and haplotype only, so results are the same however rows are dealt.
    """
    rows = panels(haplotypes, refs)

    def part(batches):
        for b in batches:
            for at in range(0, len(b), block):
                some = b.iloc[at : at + block]
                for (p, k), same in some.groupby([some["alleles"].map(len), some["panel"].map(len)]):
                    h = np.stack(same["alleles"].to_list()).astype(np.int64)
                    panel_ = np.stack([np.stack(list(x)) for x in same["panel"]]).astype(np.int64)
                    r = switch_probability(np.arange(p, dtype=float), rho)
                    rngs = [generator(seed, int(c), int(i)) for c, i in zip(same["chr"], same["hap_id"])]
                    out = controls(h, panel_, r, mutation, list(range(0, p, group_size)), rngs)
                    yield pd.DataFrame({"chr": same["chr"].to_numpy(), "hap_id": same["hap_id"].to_numpy(), "alleles": list(h), "controls": list(out)})

    return rows.mapInPandas(part, "chr int, hap_id long, alleles array<long>, controls array<long>")


def shared_by_relatives(generated: DataFrame, segments: DataFrame, group_size: int) -> DataFrame:
    """generated, with equal controls where relatives share a segment: (chr, hap_id, alleles, controls).

    segments are (chr, indices, j_min, j_max): haplotypes that descend from one ancestor at variants j_min to j_max, both
    included. On a group of variants that lies whole in a segment its haplotypes are one family, segments with a haplotype
    in common are joined, and all of the family take the controls of its smallest haplotype, which were drawn given the
    alleles that they share. Groups at a segment's ends keep their own. Ids must be below 2 ** 36, groups below 2 ** 19,
    chromosomes below 128.
    """
    from genloom.operators.graph import connected_components

    first, last = F.ceil(F.col("j_min") / group_size), F.floor((F.col("j_max") + 1) / group_size) - 1
    on = segments.filter(F.size("indices") > 1).select("chr", "indices", F.explode(F.when(first <= last, F.sequence(first, last))).alias("g"))
    code = lambda hap: F.shiftleft(F.col("chr").cast("long"), 55).bitwiseOR(F.shiftleft(F.col("g").cast("long"), 36)).bitwiseOR(hap)
    edges = on.select("chr", "g", F.array_min("indices").alias("a"), F.explode("indices").alias("b"))
    found = connected_components(edges.select(code(F.col("a")).alias("src"), code(F.col("b")).alias("dst"))).filter("vertex <> component")
    low = F.lit((1 << 36) - 1)
    of = found.select(F.shiftright("vertex", 55).cast("int").alias("chr"), F.shiftright("vertex", 36).bitwiseAND(F.lit((1 << 19) - 1)).alias("g"), F.col("vertex").bitwiseAND(low).alias("hap_id"), F.col("component").bitwiseAND(low).alias("from"))
    groups = F.sequence(F.lit(0), F.ceil(F.size("controls") / group_size).cast("int") - 1)
    cells = generated.select("chr", "hap_id", F.explode(groups).alias("g"), "controls").select("chr", "hap_id", F.col("g").cast("long").alias("g"), F.slice("controls", F.col("g") * group_size + 1, F.lit(group_size)).alias("own"))
    given = cells.select("chr", "g", F.col("hap_id").alias("from"), F.col("own").alias("given")).join(of, ["chr", "g", "from"]).drop("from")
    mixed = cells.join(given, ["chr", "g", "hap_id"], "left").groupBy("chr", "hap_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("g", F.coalesce("given", "own").alias("c")))), lambda x: x["c"])).alias("controls"))
    return generated.select("chr", "hap_id", "alleles").join(mixed, ["chr", "hap_id"])


def pair_table(generated: DataFrame) -> DataFrame:
    """Long form (chr, snp_idx, hap_id, allele, Knockoff) with original and control rows; see pair_order."""
    both = generated.select("chr", "hap_id", F.explode(F.array(F.struct(F.col("alleles").alias("a"), F.lit(False).alias("k")), F.struct(F.col("controls").alias("a"), F.lit(True).alias("k")))).alias("x"))
    return both.select("chr", "hap_id", F.posexplode("x.a").alias("snp_idx", "allele"), F.col("x.k").alias("Knockoff"))


def pair_order(seed: int, *key: str) -> F.Column:
    """Whether a variant's control is written before its original: a coin that depends on the seed and the key only."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(2)) == 1


def marginal_importance(long: DataFrame, phenotype: DataFrame) -> DataFrame:
    """(chr, snp_idx, Knockoff, beta): slope of the phenotype (hap_id, y) on each variant, in one aggregate."""
    df = long.join(phenotype, "hap_id")
    return df.groupBy("chr", "snp_idx", "Knockoff").agg(F.coalesce(F.covar_pop("allele", "y") / F.nullif(F.var_pop("allele"), F.lit(0.0)), F.lit(0.0)).alias("beta"))


def log_likelihood(match: np.ndarray, r: np.ndarray, mutation: float) -> np.ndarray:
    """Log likelihood of each haplotype under the copying model; match is (n, K, p)."""
    n, k, p = match.shape
    v, total = np.full((n, k), 1.0 / k), np.zeros(n)
    for j in range(p):
        v = (_step(v, r[j]) if j else v) * np.where(match[:, :, j], 1 - mutation, mutation)
        s = v.sum(axis=1, keepdims=True)
        total += np.log(s[:, 0])
        v /= s
    return total


def tune(rows: DataFrame, cm: list[float], rhos: list[float], mutations: list[float]) -> DataFrame:
    """(chr, rho, mutation, log_likelihood) of a grid, summed over haplotypes; rows are (chr, alleles, panel) as generate()
    makes them. The row with the largest sum is the fit: .groupBy("chr").agg(max_by(...))."""
    grid = [(a, b) for a in rhos for b in mutations]

    def part(batches):
        for b in batches:
            out = []
            for (c, _), same in b.groupby(["chr", b["panel"].map(len)]):
                h = np.stack(same["alleles"].to_list()).astype(np.int64)
                panel = np.stack([np.stack(list(x)) for x in same["panel"]]).astype(np.int64)
                match = panel == h[:, None, :]
                out += [(int(c), a, m, float(log_likelihood(match, switch_probability(np.array(cm), a), m).sum())) for a, m in grid]
            yield pd.DataFrame(out, columns=["chr", "rho", "mutation", "ll"])

    found = rows.select("chr", "alleles", "panel").mapInPandas(part, "chr int, rho double, mutation double, ll double")
    return found.groupBy("chr", "rho", "mutation").agg(F.sum("ll").alias("log_likelihood"))


def write_model(model: DataFrame, path: str) -> None:
    """A fitted model (chr, snp_idx, rho, mutation), by chromosome."""
    model.write.mode("overwrite").partitionBy("chr").parquet(path)


def read_model(spark, path: str) -> DataFrame:
    return spark.read.schema("snp_idx long, rho double, mutation double, chr int").parquet(path).select("chr", "snp_idx", "rho", "mutation")


def panels(haplotypes: DataFrame, refs: DataFrame) -> DataFrame:
    """(chr, hap_id, alleles, panel): each haplotype with the alleles of its references, in their order."""
    alleles = haplotypes.select("chr", "hap_id", unpack("words", "n").alias("alleles"))
    panel = refs.select("chr", "hap_id", F.posexplode("refs").alias("place", "ref"))
    panel = panel.join(alleles.select("chr", F.col("hap_id").alias("ref"), F.col("alleles").alias("ra")), ["chr", "ref"])
    panel = panel.groupBy("chr", "hap_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ra"))), lambda x: x["ra"]).alias("panel"))
    return alleles.join(panel, ["chr", "hap_id"])
