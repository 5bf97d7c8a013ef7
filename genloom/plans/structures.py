"""Queries of intervals, partitions and graphs.

Events stand in for segments: one starts at its second and lasts an hour and a minute for each unit of its value.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genloom.functions import dates
from genloom.operators import graph, haplo, intervals, kinship, knockoffs, partition
from genloom.runtime import table

T = table
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _spans(s, d, kind: str | None = None):
    e = T(s, d, "events")
    if kind:
        e = e.filter(F.col("event_type") == kind)
    start = dates.to_seconds(F.col("ts"))
    return e.select("event_id", "user_id", "value", start.alias("s"), (start + 3600 + F.floor("value") * 60).alias("e"))


_V = "SELECT event_id, user_id, value, event_type, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 3600 + floor(value)::BIGINT * 60 AS e FROM events"


@query("""WITH w AS (SELECT row_number() OVER (ORDER BY s) - 1 AS w, s AS start, coalesce(lead(s) OVER (ORDER BY s), (SELECT max(p_partkey) + 1 FROM part)) AS "end" FROM (SELECT DISTINCT s_suppkey * 3 AS s FROM supplier))
   SELECT p_partkey, w, start, "end" FROM part JOIN w ON p_partkey >= start AND p_partkey < "end" """)
def window_assign(s, d):
    part = T(s, d, "part").select(F.lit(1).alias("chr"), "p_partkey")
    size = part.agg((F.max("p_partkey") + 1).alias("size"))
    starts = T(s, d, "supplier").select(F.lit(1).alias("chr"), (F.col("s_suppkey") * 3).alias("at")).distinct().crossJoin(F.broadcast(size))
    win = intervals.windows_from_starts(starts, ["chr"], "at", F.col("size"))
    return intervals.range_join(part, win, ["chr"], "p_partkey", "start", "end", 64).select("p_partkey", "w", "start", "end")


@query(f"WITH v AS ({_V}) SELECT a.event_id AS a, b.event_id AS b, greatest(a.s, b.s) AS lo, least(a.e, b.e) AS hi FROM v a JOIN v b USING (user_id) WHERE a.event_id < b.event_id AND a.s <= b.e AND b.s <= a.e")
def interval_overlap(s, d):
    v = _spans(s, d)
    a, b = v.select("user_id", F.col("event_id").alias("a"), F.col("s").alias("s1"), F.col("e").alias("e1")), v.select("user_id", F.col("event_id").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    out = intervals.overlap_join(a, b, ["user_id"], ("s1", "e1"), ("s2", "e2"), 14_400).filter("a < b")
    return out.select("a", "b", F.greatest("s1", "s2").alias("lo"), F.least("e1", "e2").alias("hi"))


@query(f"""WITH v AS ({_V}), p AS (SELECT a.event_id AS a, b.event_id AS b, a.s AS a0, a.e AS a1, b.s AS b0, b.e AS b1 FROM v a JOIN v b USING (user_id) WHERE a.event_id <> b.event_id AND a.s <= b.e AND b.s <= a.e)
   SELECT a, b, a0 AS lo, least(a1, b0 - 1) AS hi FROM p WHERE a0 < b0 UNION ALL SELECT a, b, greatest(a0, b1 + 1), a1 FROM p WHERE b1 < a1""")
def interval_subtract(s, d):
    v = _spans(s, d)
    a, b = v.select("user_id", F.col("event_id").alias("a"), F.col("s").alias("s1"), F.col("e").alias("e1")), v.select("user_id", F.col("event_id").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    out = intervals.overlap_join(a, b, ["user_id"], ("s1", "e1"), ("s2", "e2"), 14_400).filter("a <> b")
    left = F.explode(intervals.subtract(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))).alias("x")
    return out.select("a", "b", left).select("a", "b", F.col("x.start").alias("lo"), F.col("x.end").alias("hi"))


@query(f"""WITH v AS ({_V}), n AS (SELECT *, coalesce((s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 600)::INT, 1) AS nw FROM v),
   i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM n) SELECT user_id, min(s) AS lo, max(e) AS hi, count(*) AS n FROM i GROUP BY user_id, g""")
def gap_islands(s, d):
    return intervals.gap_islands(_spans(s, d), ["user_id"], "s", "e", 600).select("user_id", F.col("start").alias("lo"), F.col("end").alias("hi"), "n")


_SWEEP = f"""WITH v AS ({_V}), p AS (SELECT user_id, s AS x, (event_type = 'click')::INT AS a, (event_type = 'view')::INT AS b, value AS w FROM v WHERE event_type IN ('click', 'view')
     UNION ALL SELECT user_id, e, -(event_type = 'click')::INT, -(event_type = 'view')::INT, -value FROM v WHERE event_type IN ('click', 'view')),
   c AS (SELECT user_id, x, sum(a) AS a, sum(b) AS b, sum(w) AS w FROM p GROUP BY 1, 2),
   r AS (SELECT user_id, x AS lo, lead(x) OVER o AS hi, sum(a) OVER u AS na, sum(b) OVER u AS nb, sum(w) OVER u AS w FROM c WINDOW o AS (PARTITION BY user_id ORDER BY x), u AS (PARTITION BY user_id ORDER BY x ROWS UNBOUNDED PRECEDING))"""


def _merged(rule: str) -> str:
    return f"""SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY lo ROWS UNBOUNDED PRECEDING) AS g FROM
      (SELECT *, coalesce((lo > lag(hi) OVER (PARTITION BY user_id ORDER BY lo))::INT, 1) AS nw FROM r WHERE hi IS NOT NULL AND ({rule}))) GROUP BY user_id, g"""


_RULES = {"union": "na > 0 OR nb > 0", "intersection": "na > 0 AND nb > 0", "difference": "na > 0 AND NOT nb > 0", "symmetric": "(na > 0) <> (nb > 0)"}


@query(_SWEEP + " " + " UNION ALL ".join(f"SELECT '{k}' AS op, * FROM ({_merged(v)})" for k, v in _RULES.items()))
def interval_set_algebra(s, d):
    a, b = _spans(s, d, "click"), _spans(s, d, "view")
    out = None
    for op in _RULES:
        x = intervals.set_algebra(a, b, ["user_id"], "s", "e", op).select(F.lit(op).alias("op"), "user_id", F.col("start").alias("lo"), F.col("end").alias("hi"))
        out = x if out is None else out.unionByName(x)
    return out


@query(_SWEEP + " SELECT user_id, lo, hi, na + nb AS n, round(w, 4) AS total FROM r WHERE hi IS NOT NULL AND na + nb > 0")
def interval_map_sum(s, d):
    v = _spans(s, d, "click").unionByName(_spans(s, d, "view"))
    return intervals.sweep({"v": v}, ["user_id"], "s", "e", "value").filter("n_v > 0").select("user_id", F.col("start").alias("lo"), F.col("end").alias("hi"), F.col("n_v").alias("n"), F.round("v_v", 4).alias("total"))


@query(f"""WITH v AS ({_V}), g AS (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS gap FROM v), r AS (SELECT * FROM g, (VALUES (0, 0.0), (1, 600.0), (2, 3600.0), (3, 14400.0), (4, 86400.0)) AS l(res, cut))
   SELECT event_id, res, sum(coalesce((gap > cut)::INT, 0)) OVER (PARTITION BY user_id, res ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS group_id FROM r""")
def multi_resolution_partition(s, d):
    return partition.multi_resolution(_spans(s, d), ["user_id"], "s", [0, 600, 3600, 14_400, 86_400], "event_id").select("event_id", "res", "group_id")


@query("""WITH k AS (SELECT user_id, s, avg(value) AS y FROM (SELECT user_id, floor(epoch(ts))::BIGINT AS s, value FROM events WHERE event_type = 'purchase') GROUP BY 1, 2), p AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s FROM events WHERE event_type <> 'purchase'),
   j AS (SELECT p.*, b.s AS bs, b.y AS b_y FROM p ASOF LEFT JOIN k b ON p.user_id = b.user_id AND p.s >= b.s), l AS (SELECT j.*, a.s AS a_s, a.y AS a_y FROM j ASOF LEFT JOIN k a ON j.user_id = a.user_id AND j.s <= a.s)
   SELECT event_id, round(CASE WHEN bs IS NULL THEN a_y WHEN a_s IS NULL OR a_s = bs THEN b_y ELSE b_y + (a_y - b_y) * (s - bs) / (a_s - bs) END, 4) AS y FROM l""")
def asof_interpolate(s, d):
    e = T(s, d, "events").withColumn("s", dates.to_seconds(F.col("ts")))
    knots = e.filter("event_type = 'purchase'").groupBy("user_id", "s").agg(F.avg("value").alias("y"))
    return intervals.interpolate(e.filter("event_type <> 'purchase'").select("user_id", "event_id", "s"), knots, ["user_id"], "s", "y").select("event_id", F.round("y", 4).alias("y"))


@query("""WITH s AS (SELECT l_suppkey AS k, l_orderkey * 3 AS lo, l_orderkey * 3 + l_quantity::BIGINT AS hi, l_linenumber AS i FROM lineitem),
   b AS (SELECT k, lo AS x FROM s UNION SELECT k, hi + 1 FROM s), c AS (SELECT k, x AS lo, lead(x) OVER (PARTITION BY k ORDER BY x) - 1 AS hi FROM b),
   p AS (SELECT c.k, c.lo, c.hi, list_sort(list(DISTINCT i)) AS ix FROM c JOIN s ON s.k = c.k AND s.lo <= c.lo AND s.hi >= c.hi GROUP BY 1, 2, 3),
   n AS (SELECT *, CASE WHEN lag(hi) OVER w + 1 = lo AND lag(ix) OVER w = ix THEN 0 ELSE 1 END AS nw FROM p WINDOW w AS (PARTITION BY k ORDER BY lo)),
   g AS (SELECT *, sum(nw) OVER (PARTITION BY k ORDER BY lo ROWS UNBOUNDED PRECEDING) AS g FROM n)
   SELECT k, min(lo) AS lo, max(hi) AS hi, any_value(ix) AS indices FROM g GROUP BY k, g""")
def tidy_segments(s, d):
    seg = T(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 3).alias("lo"), (F.col("l_orderkey") * 3 + F.col("l_quantity").cast("long")).alias("hi"), F.array("l_linenumber").alias("ix"))
    return intervals.tidy_overlapping(seg, ["k"], "lo", "hi", "ix").select("k", F.col("start").alias("lo"), F.col("end").alias("hi"), "indices")


@query("""SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size - 2 <= s_nationkey + 3 AND s_nationkey - 3 <= p_size + 2 AND p_partkey - 5 <= s_suppkey * 10 + 5 AND s_suppkey * 10 - 5 <= p_partkey + 5""")
def box_join(s, d):
    a = T(s, d, "part").select("p_partkey", (F.col("p_size") - 2).alias("ax0"), (F.col("p_size") + 2).alias("ax1"), (F.col("p_partkey") - 5).alias("ay0"), (F.col("p_partkey") + 5).alias("ay1"))
    b = T(s, d, "supplier").select("s_suppkey", (F.col("s_nationkey") - 3).alias("bx0"), (F.col("s_nationkey") + 3).alias("bx1"), (F.col("s_suppkey") * 10 - 5).alias("by0"), (F.col("s_suppkey") * 10 + 5).alias("by1"))
    return intervals.box_join(a, b, ("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1"), 16).select("p_partkey", "s_suppkey")


# graphs: parts of a brand are linked where their prices are within two units of the next; some edges run from the larger
# id to the smaller, and by the rule of ordered edges these don't count


def _price_edges(s, d):
    by = W.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    p = T(s, d, "part").select(F.col("p_partkey").alias("src"), F.lead("p_partkey").over(by).alias("dst"), (F.lead("p_retailprice").over(by) - F.col("p_retailprice")).alias("gap"))
    return p.filter("gap <= 2.0").select("src", "dst")


_PRICE = """e AS (SELECT src, dst FROM (SELECT p_partkey AS src, lead(p_partkey) OVER o AS dst, lead(p_retailprice) OVER o - p_retailprice AS gap FROM part WINDOW o AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)) WHERE gap <= 2.0 AND src <= dst),
   u AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e), r(v, w) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.v, u.b FROM r JOIN u ON r.w = u.a), c AS (SELECT v AS vertex, min(w) AS component FROM r GROUP BY v)"""


@query(f"WITH RECURSIVE {_PRICE} SELECT * FROM c")
def connected_components(s, d):
    return graph.components_of(T(s, d, "part").select(F.col("p_partkey").alias("vertex")), _price_edges(s, d))


@query(f"WITH RECURSIVE {_PRICE} SELECT component, count(*) AS size, list_sort(list(vertex)) AS members FROM c GROUP BY component")
def co_membership(s, d):
    return graph.co_membership(connected_components(s, d))


def _trade(s, d):
    """Nations by the lines that suppliers of one sell to customers of the other."""
    l = T(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(T(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    l = l.join(T(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("dst")), "c_custkey").join(T(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("src")), "l_suppkey")
    return l.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def _top_trade(s, d):
    t = _trade(s, d).filter("src <> dst")
    return t.groupBy("src").agg(F.max_by("dst", F.struct("weight", -F.col("dst"))).alias("dst"))


_TRADE = "t AS (SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
_TOP = f"{_TRADE}, e AS (SELECT src, dst FROM t WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) = 1), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


@query(f"WITH RECURSIVE {_TOP} SELECT * FROM r")
def transitive_closure(s, d):
    return graph.transitive_closure(_top_trade(s, d))


@query(f"WITH RECURSIVE {_TOP}, v AS (SELECT src AS x FROM e UNION SELECT dst FROM e) SELECT x AS vertex, least(x, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON a.dst = b.src AND b.dst = a.src WHERE a.src = x), x)) AS component FROM v")
def strong_components(s, d):
    return graph.strong_components(_top_trade(s, d))


@query(f"WITH {_TRADE}, m AS (SELECT src, dst, min(w) AS w FROM (SELECT src, dst, weight AS w FROM t UNION ALL SELECT n_nationkey, n_nationkey, 0 FROM nation) GROUP BY 1, 2), m1 AS (SELECT a.src, b.dst, min(a.w + b.w) AS w FROM m a JOIN m b ON a.dst = b.src GROUP BY 1, 2), m2 AS (SELECT a.src, b.dst, min(a.w + b.w) AS w FROM m1 a JOIN m1 b ON a.dst = b.src GROUP BY 1, 2), m3 AS (SELECT a.src, b.dst, min(a.w + b.w) AS w FROM m2 a JOIN m2 b ON a.dst = b.src GROUP BY 1, 2), m4 AS (SELECT a.src, b.dst, min(a.w + b.w) AS w FROM m3 a JOIN m3 b ON a.dst = b.src GROUP BY 1, 2), m5 AS (SELECT a.src, b.dst, min(a.w + b.w) AS w FROM m4 a JOIN m4 b ON a.dst = b.src GROUP BY 1, 2) SELECT src AS source, dst AS vertex, w::DOUBLE AS distance FROM m5")
def shortest_paths(s, d):
    return graph.shortest_paths(_trade(s, d), T(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("vertex")))


@query(f"WITH {_TRADE} SELECT v AS vertex, count(*) FILTER (o) AS out_degree, count(*) FILTER (NOT o) AS in_degree FROM (SELECT src AS v, true AS o FROM t UNION ALL SELECT dst, false FROM t) GROUP BY v")
def degree_centrality(s, d):
    return graph.degrees(_trade(s, d))


@query(f"WITH {_TRADE} SELECT dst AS src, src AS dst, weight FROM t")
def transpose_graph(s, d):
    return graph.transpose(_trade(s, d))


def _tree(s, d):
    """Customers and suppliers point to nations, nations to regions; ids of a kind have their own range."""
    c = T(s, d, "customer").select((F.col("c_custkey") + 10_000_000).alias("src"), (F.col("c_nationkey") + 100).cast("long").alias("dst"))
    p = T(s, d, "supplier").select((F.col("s_suppkey") + 20_000_000_000).alias("src"), (F.col("s_nationkey") + 100).cast("long").alias("dst"))
    n = T(s, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    return c.unionByName(p).unionByName(n)


_TREE = "e AS (SELECT c_custkey + 10000000 AS src, c_nationkey::BIGINT + 100 AS dst FROM customer UNION ALL SELECT s_suppkey + 20000000000, s_nationkey::BIGINT + 100 FROM supplier UNION ALL SELECT n_nationkey::BIGINT + 100, n_regionkey::BIGINT FROM nation)"


@query(f"WITH RECURSIVE {_TREE}, r(vertex, level) AS (SELECT src, 0 FROM e UNION SELECT e.dst, level + 1 FROM r JOIN e ON e.src = vertex) SELECT vertex, max(level) AS level FROM r GROUP BY vertex")
def toposort_levels(s, d):
    return graph.topological_levels(_tree(s, d))


@query(f"WITH RECURSIVE {_TREE}, r(vertex, level) AS (SELECT src, 0 FROM e WHERE src BETWEEN 100 AND 124 UNION SELECT e.dst, level + 1 FROM r JOIN e ON e.src = vertex) SELECT vertex, min(level) AS level FROM r GROUP BY vertex")
def breadth_first(s, d):
    return graph.breadth_first(_tree(s, d), T(s, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("vertex")))


@query("SELECT l_partkey, max_by(l_suppkey, l_orderkey * 10 + l_linenumber) AS l_suppkey FROM lineitem GROUP BY l_partkey")
def reconcile(s, d):
    return graph.reconcile(T(s, d, "lineitem").withColumn("version", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "l_partkey", "l_suppkey", "version")


# kinship and negative controls on embeddings' sign bits


def _haplotypes(s, d):
    e = T(s, d, "embeddings").withColumn("alleles", F.transform("embedding", lambda x: (x > 0).cast("int")))
    return e.select(F.col("label").alias("chr"), F.col("vec_id").alias("hap_id"), "embedding", haplo.pack("alleles").alias("words"), F.size("alleles").alias("n"))


@query()
def kinship_clusters(s, d):
    return kinship.references(kinship.clusters(_haplotypes(s, d), "hap_id", "embedding", least=20, most=200), "hap_id", "words", 5)


@query()
def hmm_knockoffs(s, d):
    """References come from clusters of bounded size within a chromosome."""
    h = kinship.clusters(_haplotypes(s, d), "hap_id", "embedding", least=20, most=200)
    h = h.withColumn("cluster_id", F.concat_ws("/", "chr", "cluster_id"))
    refs = kinship.references(h, "hap_id", "words", 5).select(F.substring_index("cluster_id", "/", 1).cast("int").alias("chr"), "hap_id", "refs")
    return knockoffs.generate(h.select("chr", "hap_id", "words", "n"), refs, group_size=4, rho=0.05, mutation=1e-3, seed=2020)
