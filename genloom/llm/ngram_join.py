"""N-gram Jaccard self-join by a count-vector R-tree.

A document is the set of its distinct word shingles. Shingles hash into groups; the counts of a document's shingles by
group are its point. The groups of a set of n number about n / DENSITY, a power of two and GROUPS at least, by the low bits
of the hash, so a finer point folds onto a coarser one and bounds stay sharp at any size. The overlap of two sets is at most the sum of the coordinate minima of their points, and of a
query and anything below an R-tree node at most the sum of the minima with the node's upper corner. Nodes and pairs whose
bound falls short of the threshold are cut, surviving pairs are verified on the shingles of the whole texts.

One tree over a whole corpus would sit on one machine and, in high dimension, prune little; so the index is a forest with
one tree for each routing key. A document is routed by its rarest shingles, enough of them that two documents that reach
the threshold share a key in every case (the prefix principle), which keeps the join exact. Rarity is a fixed order: by a
frequency class from a sketch of fixed width, then by hash; so a passage that many documents share routes almost nothing.

Copies collapse to one representative first. Large groups of near copies are joined to a hub of their key and become one
component before any tree is built, so no group emits all its pairs. Keys that still hold several components deal their
documents to trees: one for a family of documents that such keys chain together, or one a key where a family is large.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genloom.llm import textkernel as tk
from genloom.operators.graph import connected_components
from genloom.runtime import discard, materialize, scratch, small_or_not, table

GROUPS, DENSITY = 64, 1
WIDTH = 1 << 20
SPLIT = 100_000
BLOCK = 2048
FAMILY, STRONG = 1024, 3
LEAF = 16
#: What a search holds at once: so many pairs, and so many coordinates.
PAIRS, CELLS = 200_000, 1_000_000
_SIZES = (np.uint8, np.uint16, np.uint32)
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1, write_checksum=False), zstandard.ZstdDecompressor()
#: The threshold as a fraction: 75 of 100.
NUM, DEN = 75, 100


def document_sets(texts: pa.Array, k: int):
    """Yields (row, sorted distinct shingle hashes) of every text of an Arrow array."""
    for first, data, off in tk.slices(texts):
        words = tk.Words(data, off, lower=True)
        row, h = words.shingles(k)
        cut = np.searchsorted(row, np.arange(len(off)))
        for i in range(len(off) - 1):
            u = np.sort(h[cut[i] : cut[i + 1]])
            yield first + i, u[np.concatenate(([True], u[1:] != u[:-1]))] if len(u) else u


def _sketch(k: int):
    def part(batches):
        count, held, n = np.zeros(WIDTH, np.int64), [], 0
        for b in batches:
            for _, data, off in tk.slices(b.column(0)):
                held.append((tk.Words(data, off, lower=True).shingles(k)[1] >> tk.U(44)).astype(np.int32))
                n += len(held[-1])
                if n > WIDTH:
                    count += np.bincount(np.concatenate(held), minlength=WIDTH)
                    held, n = [], 0
        if held:
            count += np.bincount(np.concatenate(held), minlength=WIDTH)
        if count.any():
            yield _blocks(range(WIDTH // 4096), count.reshape(-1, 4096))

    return part


def _blocks(at, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(at), pa.int32()), pa.array([_PACK.compress(c.tobytes()) for c in counts], pa.binary())], ["block", "counts"])


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for at, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            c = np.frombuffer(_UNPACK.decompress(c), np.int64)
            total[at] = total[at] + c if at in total else c
    if total:
        yield _blocks(total, total.values())


def frequency_classes(texts: DataFrame, k: int) -> np.ndarray:
    """For each of WIDTH slots of the hash space the binary logarithm of its excess over the mean, or 0 within the noise.

    Every map task sends WIDTH counters whatever it has read and WIDTH counters come to the driver; they only order
    shingles and never drop any.
    """
    parts = tk.map_batches(tk.map_batches(texts, _sketch(k), "block int, counts binary").repartition("block"), _summed, "block int, counts binary")
    count = np.zeros(WIDTH, np.int64)
    for r in parts.toLocalIterator():
        count[r.block * 4096 : r.block * 4096 + 4096] += np.frombuffer(_UNPACK.decompress(bytes(r.counts)), np.int64)
    mean = count.mean()
    over = np.maximum(0, count - mean)
    return np.where(over > 5 * np.sqrt(mean) + 8, np.ceil(np.log2(over + 1)), 0).astype(np.uint8)


def _vector(u: np.ndarray) -> bytes:
    """The point of a set: a byte with the binary logarithm of its groups, one with that of a count's bytes, packed counts."""
    bits = max(GROUPS.bit_length() - 1, (len(u) // DENSITY).bit_length())
    c = np.bincount((u & tk.U((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    top = c.max(initial=0)
    size = 0 if top < 256 else 1 if top < 65536 else 2
    return bytes([bits, size]) + _PACK.compress(c.astype(_SIZES[size]).tobytes())


def _point(v: bytes, bits: int | None = None) -> np.ndarray:
    """The counts of a point, folded onto 2 ** bits groups if it has more."""
    c = np.frombuffer(_UNPACK.decompress(v[2:]), _SIZES[v[1]])
    if bits is not None and bits < v[0]:
        c = c.reshape(-1, 1 << bits).sum(axis=0)
    return c.astype(np.int32)


_SIG = "doc_id long, n long, digest binary, vec binary, keys array<long>, parts array<int>"


def _signatures(k: int, classes):
    def part(batches):
        hot = classes.value
        for b in batches:
            ids, n, digest, vec, keys, parts, size = b.column(0).to_pylist(), [], [], [], [], [], [0]
            for i, u in document_sets(b.column(1), k):
                m = len(u)
                n.append(m)
                digest.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                vec.append(_vector(u))
                p = m - (NUM * m + DEN - 1) // DEN + 1 if m else 0
                c = hot[(u >> tk.U(44)).astype(np.int64)]
                at = np.lexsort((u, c))[:p] if c.any() else slice(0, p)
                keys.append(u[at].view(np.int64))
                many = np.maximum(1, (np.int64(1) << c[at].astype(np.int64)) // SPLIT)
                parts.append(np.where(many > 1, (ids[i] or 0) % many + 1, 0).astype(np.int32))
                size.append(size[-1] + p)
            off = pa.array(size, pa.int32())
            cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(vec, pa.binary()), pa.ListArray.from_arrays(off, pa.array(cat(keys, np.int64))), pa.ListArray.from_arrays(off, pa.array(cat(parts, np.int32)))],
                ["doc_id", "n", "digest", "vec", "keys", "parts"],
            )

    return part


def _bounded(batches):
    """Keeps (a, b) whose bound reaches the threshold."""
    for b in batches:
        na, nb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
        va, vb = b.column("va").to_pylist(), b.column("vb").to_pylist()
        both = [min(x[0], y[0]) for x, y in zip(va, vb)]
        keep = [i for i, k in enumerate(both) if (DEN + NUM) * int(np.minimum(_point(va[i], k), _point(vb[i], k)).sum()) >= NUM * (na[i] + nb[i])]
        yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _verified(k: int):
    def part(batches):
        for b in batches:
            ids = b.column("b").to_pylist()
            tb = b.column("tb")
            fresh = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            hubs = {ids[i]: u for i, (_, u) in zip(fresh, document_sets(tb.take(pa.array(fresh, pa.int64())), k))}
            keep = []
            for i, u in document_sets(b.column("ta"), k):
                v = hubs[ids[i]]
                both = len(np.intersect1d(u, v, assume_unique=True))
                if DEN * both >= NUM * (len(u) + len(v) - both) and both:
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return part


class RTree:
    """Points in packed leaves: sorted by total, then by their widest coordinates; nodes hold upper corner and least total."""

    def __init__(self, points: np.ndarray, totals: np.ndarray):
        self.order = np.arange(len(points))
        if len(points) > LEAF:
            wide = np.argsort(-points.var(axis=0))[:2]
            strip = np.argsort(np.argsort(totals, kind="stable"), kind="stable") // (LEAF * LEAF)
            self.order = np.lexsort((points[:, wide[1]], points[:, wide[0]] // 2, strip))
        self.levels = [(points[self.order], totals[self.order], totals[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            p, lo, hi = self.levels[-1]
            at = np.arange(0, len(p), LEAF)
            self.levels.append((np.maximum.reduceat(p, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))

    def search(self, q: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, bound) of every pair whose bound reaches the threshold; q holds the queries' points as rows."""
        found = []
        step = max(1, PAIRS // len(self.levels[0][0]))
        rows = max(1, CELLS // q.shape[1])
        for at in range(0, len(q), step):
            nodes = len(self.levels[-1][0])
            i = np.repeat(np.arange(at, min(len(q), at + step)), nodes)
            j = np.tile(np.arange(nodes), len(i) // nodes)
            for depth in range(len(self.levels) - 1, -1, -1):
                p, lo, hi = self.levels[depth]
                ok = (DEN * totals[i] >= NUM * lo[j]) & (DEN * hi[j] >= NUM * totals[i])
                i, j = i[ok], j[ok]
                bound = np.zeros(len(i), np.int64)
                for c in range(0, len(i), rows):
                    bound[c : c + rows] = np.minimum(p[j[c : c + rows]], q[i[c : c + rows]]).sum(axis=1)
                ok = (DEN + NUM) * bound >= NUM * (totals[i] + lo[j])
                i, j, bound = i[ok], j[ok], bound[ok]
                if depth:
                    i, j = np.repeat(i, LEAF), (j[:, None] * LEAF + np.arange(LEAF)).ravel()
                    ok = j < len(self.levels[depth - 1][0])
                    i, j = i[ok], j[ok]
            found.append((i, self.order[j], bound))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _tree_pairs(best: bool):
    """From rows (g, side, doc, comp, n, vec) sorted by g, the pairs of different components that survive the tree of g.

    side 0 is a block joined with itself; 1 and 2 are two blocks. In a block joined with itself the documents of its largest
    component needn't ask: what could link them to others comes from the others' queries, so a block of near copies and one
    outlier is one query. best: for each document only the pair with the largest bound, as a first round that merges what
    belongs together; a group that held back others gives a row (null, null, g).
    """

    def group(side, doc, comp, n, vec):
        bits, out, found = np.array([v[0] for v in vec]), {}, []
        ids, at = np.unique(doc, return_inverse=True)
        left, right = side != 2, side != 1
        if not side.any():
            names, of, size = np.unique(comp, return_inverse=True, return_counts=True)
            right = of != size.argmax()
        if len(np.unique(np.concatenate((comp[left], comp[right])))) < 2:
            return set(), False
        for own in np.unique(bits[left]):
            mine = np.flatnonzero(left & (bits == own))
            for k in (own - 1, own):  # folded for queries with half the groups; as it is for those with as many or more
                q = np.flatnonzero(right & (bits == k if k < own else bits >= own) & (n * DEN >= n[mine].min() * NUM) & (n[mine].max() * DEN >= n * NUM))
                if not len(q) or (len(q) == 1 and len(mine) == 1 and q[0] == mine[0]):
                    continue
                tree = RTree(np.stack([_point(vec[i], k) for i in mine]), n[mine])
                a, b, bound = tree.search(np.stack([_point(vec[i], k) for i in q]), n[q])
                a, b = q[a], mine[b]
                ok = comp[a] != comp[b]
                for i, j, w in zip(a[ok], b[ok], bound[ok]):
                    pair = (max(doc[i], doc[j]), min(doc[i], doc[j]))
                    key = doc[i] if best else pair
                    if key not in out or out[key][0] < w:
                        out[key] = (w, pair)
                if best:
                    x, y = at[a[ok]], at[b[ok]]
                    found.append(np.unique(np.maximum(x, y) * len(ids) + np.minimum(x, y)))
        pairs = {p for _, p in out.values()}
        # a document keeps one pair over all classes of size, so what is held back shows only after the last of them
        return pairs, bool(found) and len(np.unique(np.concatenate(found))) > len(pairs)

    def part(batches):
        held, gid, seen = [], None, set()

        def flush():
            fresh, held_back = group(*(np.concatenate(c) for c in zip(*held)))
            fresh = sorted(fresh - seen)
            if len(seen) < 100_000:
                seen.update(fresh)
            return [(*map(int, p), None) for p in fresh] + [(None, None, gid)] * held_back

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], ["a", "b", "g"])

        for b in batches:
            g = b.column("g").to_pylist()
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("side", "doc", "comp", "n")]
            vec = np.empty(len(g), object)
            vec[:] = b.column("vec").to_pylist()
            cut = [0, *[i for i in range(1, len(g)) if g[i] != g[i - 1]], len(g)]
            for lo, hi in zip(cut, cut[1:]):
                if lo == hi:
                    continue
                if g[lo] != gid and held:
                    if pairs := flush():
                        yield batch(pairs)
                    held = []
                gid = g[lo]
                held.append([*(c[lo:hi] for c in cols), vec[lo:hi]])
        if held and (pairs := flush()):
            yield batch(pairs)

    return part


def _verify(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on the shingles of their whole texts."""
    with scratch(docs.sparkSession) as made:
        pairs = materialize(pairs, "pairs")
        mark = small_or_not(pairs)
        left = docs.join(mark, docs.doc_id == F.col("a")).select("a", "b", F.col("text").alias("ta"))
        hubs = small_or_not(materialize(pairs.select("b").distinct(), "hubs"))
        right = docs.join(hubs, docs.doc_id == F.col("b"), "left_semi").select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        links = materialize(tk.map_batches(left.join(right.hint("merge"), "b").select("a", "b", "ta", "tb"), _verified(k), "a long, b long"), "links")
        made.keep(links)
    return links


def _with_points(pairs: DataFrame, points: DataFrame) -> DataFrame:
    a = points.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
    b = points.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))
    near = (F.col("na") * DEN >= F.col("nb") * NUM) & (F.col("nb") * DEN >= F.col("na") * NUM)
    return tk.map_batches(pairs.join(a, "a").join(b, "b").filter(near), _bounded, "a long, b long")


def _deal(posts: DataFrame, comp: DataFrame, points: DataFrame) -> DataFrame:
    """(g, side, doc): which documents meet in which tree, for all keys that still have two components.

    Documents that share STRONG such keys with a hub chain to families. A family of at most FAMILY documents is one tree, so
    that each of its pairs is looked at once however many keys it shares. A key that several families or a larger one hold
    is a tree of its own, keys with equal members share one, and a key of more than BLOCK documents is dealt as pairs of
    blocks, see _block_pairs.
    """
    lab = posts.join(small_or_not(comp), posts.doc == comp.vertex, "left").select("key", "part", "doc", "hub", F.coalesce("component", "doc").alias("comp"))
    h = F.xxhash64("doc")
    of = lab.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("y"))
    of = small_or_not(materialize(of.filter("lo < hi").drop("lo", "hi"), "tree-keys"))
    rows = materialize(lab.join(of, "key").select("key", "doc", "hub", "comp", "size", "x", "y"), "tree-postings")
    strong = rows.filter("doc <> hub").groupBy("doc", "hub").agg(F.count(F.lit(1)).alias("keys")).filter(F.col("keys") >= STRONG)
    family = materialize(connected_components(strong, "doc", "hub"), "families")
    large = materialize(family.groupBy("component").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > FAMILY).select("component", F.lit(True).alias("large")), "large-families")
    family = materialize(family.join(small_or_not(large), "component", "left").select("vertex", F.col("component").alias("family"), F.coalesce("large", F.lit(False)).alias("large")), "family-of")
    few = family.filter("NOT large").select(F.concat(F.lit("f"), "family").alias("g"), F.lit(0).alias("side"), F.col("vertex").alias("doc"))
    by_key = rows.join(small_or_not(family), rows.doc == family.vertex, "left").withColumn("family", F.coalesce("family", "doc"))
    one = by_key.groupBy("key", "size", "x", "y").agg(F.min("family").alias("lo"), F.max("family").alias("hi"), F.bool_or(F.coalesce("large", F.lit(False))).alias("any"))
    one = one.filter("lo < hi OR any").groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key")
    by_key = materialize(rows.join(small_or_not(materialize(one, "distinct-keys")), "key", "left_semi").select("key", "doc", "comp", "size"), "key-postings")
    alone = few.unionByName(by_key.filter(F.col("size") <= BLOCK).select(F.col("key").cast("string").alias("g"), F.lit(0).alias("side"), "doc"))
    # a document without a neighbour in size has no partner in its tree, nor has a tree of one component any work
    alone = alone.join(points.select(F.col("doc_id").alias("doc"), "n"), "doc").join(small_or_not(comp), F.col("doc") == F.col("vertex"), "left")
    alone = alone.select("g", "side", "doc", "n", F.coalesce("component", "doc").alias("comp"))
    by_size, by_tree = W.partitionBy("g").orderBy("n", "doc"), W.partitionBy("g")
    near = (F.lag("n").over(by_size) * DEN >= F.col("n") * NUM) | (F.col("n") * DEN >= F.lead("n").over(by_size) * NUM)
    alone = alone.withColumn("near", near).filter("near").withColumn("lo", F.min("comp").over(by_tree)).withColumn("hi", F.max("comp").over(by_tree))
    alone = alone.filter("lo < hi").select("g", "side", "doc")
    many = by_key.filter(F.col("size") > BLOCK)
    return materialize(alone if many.isEmpty() else alone.unionByName(_block_pairs(many)), "trees")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """(g, side, doc) of the pairs of blocks of large keys, from (key, doc, comp, size).

    A component of more than BLOCK documents of a key has blocks of its own, the others share theirs; documents go to blocks
    by a hash. Blocks of one component never meet, so a key of a million near copies and an outlier is a million rows and a
    row of the outlier for each of their blocks.
    """
    own = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("members"))
    own = own.withColumn("big", F.col("members") > BLOCK)
    block = F.when(F.col("big"), F.col("comp"))
    sets = own.groupBy("key", block.alias("owner")).agg(F.sum("members").alias("held"))
    sets = materialize(sets.withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int")), "block-sets")
    # a block is (owner, number); owner is null for the shared ones
    all_ = sets.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.col("owner"), i.alias("b")))).alias("other"))
    mine = rows.join(small_or_not(materialize(own.filter("big").select("key", "comp", F.lit(True).alias("big")), "big-components")), ["key", "comp"], "left")
    mine = mine.withColumn("owner", F.when(F.col("big"), F.col("comp")))
    n = sets.select(F.col("key").alias("k"), F.col("owner").alias("o"), "blocks")
    mine = mine.join(small_or_not(n), (mine.key == F.col("k")) & mine.owner.eqNullSafe(F.col("o")))
    mine = mine.select("key", "doc", F.struct("owner", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("b")).alias("own"))
    pair = mine.join(small_or_not(materialize(all_, "blocks")), "key")
    pair = pair.filter(F.col("own.owner").isNull() | ~F.col("own.owner").eqNullSafe(F.col("other.owner")))
    name = lambda c: F.concat_ws("/", F.coalesce(F.col(f"{c}.owner").cast("string"), F.lit("")), F.col(f"{c}.b").cast("string"))
    a, b = name("own"), name("other")
    return pair.select(F.concat_ws(":", F.col("key").cast("string"), F.least(a, b), F.greatest(a, b)).alias("g"), F.when(a == b, 0).when(a < b, 1).otherwise(2).alias("side"), "doc")


def _tree_rows(trees: DataFrame, comp: DataFrame, points: DataFrame) -> DataFrame:
    lab = trees.join(small_or_not(comp), trees.doc == comp.vertex, "left").select("g", "side", "doc", F.coalesce("component", "doc").alias("comp"))
    return lab.join(points.select(F.col("doc_id").alias("doc"), "n", "vec"), "doc")


def ngram_components(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every distinct document of docs.

    Words are lower-cased (A-Z) runs of characters other than 0x20 and 0x09-0x0D. Two documents link when 100 * shared
    shingles >= 75 * shingles of either; component_id is the smallest id reachable. A text of fewer than k words is one
    shingle; an empty or null text has none, links with nothing and is its own component. Rows repeated in full count
    once; a null id gets a null component and links with nothing. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession) as made:
        sig, comp, same = _linked(docs, k)
        made.keep(sig, comp, same)
    out = sig.select("doc_id", "n", "digest").distinct().join(small_or_not(same), "digest", "left")
    own = F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("rep"))
    return out.join(small_or_not(comp), out.rep == F.col("vertex"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def _linked(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, components (vertex, component) of the distinct sets' representatives, and (digest, rep) of
    the sets that several documents have; docs are (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    classes = spark.sparkContext.broadcast(frequency_classes(docs.select("text"), k))
    sig = materialize(tk.map_batches(docs, _signatures(k, classes), _SIG), "signatures")
    full = sig.filter("n > 0 AND doc_id IS NOT NULL")
    reps = full.groupBy("digest").agg(F.min(F.struct("doc_id", "keys", "parts")).alias("r"))
    posts = reps.select(F.col("r.doc_id").alias("doc"), F.explode(F.arrays_zip("r.keys", "r.parts")).alias("z")).select("doc", F.col("z.keys").alias("key"), F.col("z.parts").alias("part"))
    of_key = W.partitionBy("key", "part")
    posts = posts.withColumn("size", F.count(F.lit(1)).over(of_key)).withColumn("hub", F.min("doc").over(of_key))
    posts = materialize(posts.filter("size > 1 OR part > 0").select("key", "part", "doc", "hub"), "postings")
    points = full.select("doc_id", "n", "vec")
    pairs = posts.filter("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct()
    links = _verify(_with_points(pairs, points).distinct(), docs, k)
    comp = materialize(connected_components(links, "a", "b"), "components")
    with scratch(spark) as made:
        trees = _deal(posts, comp, points)
        made.keep(trees)
    discard(posts)
    for best in (True, False):
        rows = _tree_rows(trees, comp, points).repartition("g").sortWithinPartitions("g")
        found = materialize(tk.map_batches(rows, _tree_pairs(best), "a long, b long, g string"), "tree-pairs")
        more = _verify(found.select("a", "b").dropna().distinct(), docs, k)
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = materialize(connected_components(links, "a", "b"), "components")
        rest = found.filter("g IS NOT NULL").select("g").distinct()
        if rest.isEmpty():
            break
        trees = trees.join(small_or_not(materialize(rest, "rest")), "g", "left_semi")
    same = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("digest", "rep"), "copies")
    return sig, comp, same


def drop_near_copies(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with docs' columns; rows of a null id stay."""
    with scratch(docs.sparkSession) as made:
        gone = ngram_components(docs, k, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
        gone = materialize(gone, "near-copies")
        made.keep(gone)
    return docs.join(small_or_not(gone), F.col(id_col) == F.col("__gone"), "left_anti")


def op1_ngram_jaccard(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}
ORACLES = {
    "op1_ngram_jaccard": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(v, w) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.v, u.b FROM r JOIN u ON r.w = u.a)
        SELECT v AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(w) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.v GROUP BY v
    """
}
