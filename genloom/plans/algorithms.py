"""Queries of segments, sequences, strings, times, values and graph algorithms that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genloom.functions import dates, strings, values
from genloom.operators import graph, intervals, kinship, knockoffs, seq, stats
from genloom.plans.structures import _PRICE, _TOP, _TRADE, _TREE, _V, _haplotypes, _price_edges, _spans, _top_trade, _trade, _tree
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


# segments: an event's span and the next one of its user

_NEXT = f"""v AS ({_V}), n AS (SELECT event_id AS a, lead(event_id) OVER w AS b, s AS a0, e AS a1, lead(s) OVER w AS b0, lead(e) OVER w AS b1 FROM v WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))"""


@query(f"""WITH {_NEXT} SELECT a, b, a1 - a0 + 1 AS len, 2 AS members, greatest(0, greatest(a0, b0) - least(a1, b1) - 1) AS gap, b0 = a1 + 1 OR a0 = b1 + 1 AS touches,
   CASE WHEN greatest(a0, b0) <= least(a1, b1) THEN greatest(a0, b0) END AS lo, CASE WHEN greatest(a0, b0) <= least(a1, b1) THEN least(a1, b1) END AS hi,
   CASE WHEN greatest(a0, b0) <= least(a1, b1) THEN list_sort([a, b]) END AS both, CASE WHEN a0 + 600 <= a1 - 3900 THEN a0 + 600 END AS shaved_lo, CASE WHEN a0 + 600 <= a1 - 3900 THEN a1 - 3900 END AS shaved_hi,
   a0 < b0 OR (a0 = b0 AND (a1 < b1 OR (a1 = b1 AND a < b))) AS before FROM n WHERE b IS NOT NULL""")
def segment_algebra(s, d):
    by = W.partitionBy("user_id").orderBy("s", "event_id")
    v = _spans(s, d)
    nxt = lambda c: F.lead(c).over(by)
    n = v.select(F.col("event_id").alias("a"), nxt("event_id").alias("b"), F.col("s").alias("a0"), F.col("e").alias("a1"), nxt("s").alias("b0"), nxt("e").alias("b1")).filter("b IS NOT NULL")
    x, y = (F.struct(F.col(f"{k}0").alias("j_min"), F.col(f"{k}1").alias("j_max"), F.array(k).alias("indices")) for k in "ab")
    n = n.withColumn("x", x).withColumn("y", y).withColumn("z", intervals.shared(F.col("x"), F.col("y"))).withColumn("c", intervals.shave(F.col("a0"), F.col("a1"), 600, 3900))
    a0, a1, b0, b1 = map(F.col, ("a0", "a1", "b0", "b1"))
    return n.select("a", "b", intervals.length(a0, a1).alias("len"), F.size(F.array("a", "b")).alias("members"), intervals.gap(a0, a1, b0, b1).alias("gap"), intervals.touches(a0, a1, b0, b1).alias("touches"), F.col("z.j_min").alias("lo"), F.col("z.j_max").alias("hi"), F.col("z.indices").alias("both"), F.col("c.j_min").alias("shaved_lo"), F.col("c.j_max").alias("shaved_hi"), intervals.in_order(F.col("x"), F.col("y")).alias("before"))


@query(f"WITH v AS ({_V}), n AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s, e) AS nxt FROM v) SELECT event_id, s, CASE WHEN nxt > e AND nxt - e - 1 <= 7200 THEN nxt - 1 ELSE e END AS e FROM n WHERE CASE WHEN nxt > e AND nxt - e - 1 <= 7200 THEN nxt - 1 ELSE e END - s + 1 < 6000")
def segment_finders(s, d):
    v = intervals.expand_close(_spans(s, d), ["user_id"], "s", "e", 7200)
    return intervals.short(v, "s", "e", 6000).select("event_id", "s", "e")


@query(f"""WITH RECURSIVE v AS ({_V}), r AS (SELECT user_id, list({{'v': value, 's': s, 'id': event_id}} ORDER BY value, s, event_id) AS free, NULL::BIGINT AS lead, []::STRUCT(v DOUBLE, s BIGINT, id BIGINT)[] AS taken FROM v GROUP BY user_id
   UNION ALL SELECT user_id, list_filter(free, lambda x: abs(x.s - free[1].s) > 7200), free[1].s, list_filter(free, lambda x: abs(x.s - free[1].s) <= 7200) FROM r WHERE len(free) > 0)
   SELECT user_id, x.id AS event_id, x.s AS s, x.v AS value, lead FROM (SELECT user_id, lead, unnest(taken) AS x FROM r)""")
def clump(s, d):
    return intervals.clump(_spans(s, d).select("user_id", "event_id", "s", "value"), ["user_id"], "s", "value", 7200)


def _islands(sql: str, sign: str) -> str:
    return f"""SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM
      (SELECT *, coalesce((lo {sign} max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS nw FROM ({sql}))) GROUP BY user_id, g"""


_HOURS = f"SELECT user_id, s // 3600 AS lo, s // 3600 + 1 + floor(value / 60)::BIGINT AS hi FROM ({_V})"


@query(f"""SELECT 'joining' AS style, * FROM ({_islands(_HOURS, '>')}) UNION ALL SELECT 'separating', * FROM ({_islands(_HOURS, '>=')})
   UNION ALL SELECT DISTINCT 'elemental', user_id, h, h + 1 FROM (SELECT user_id, unnest(range(lo, hi)) AS h FROM ({_HOURS}))
   UNION ALL SELECT 'splitting', user_id, b, n FROM (SELECT user_id, b, lead(b) OVER (PARTITION BY user_id ORDER BY b) AS n FROM (SELECT user_id, lo AS b FROM ({_HOURS}) UNION SELECT user_id, hi FROM ({_HOURS}))) x
     WHERE n IS NOT NULL AND EXISTS (SELECT 1 FROM ({_HOURS}) y WHERE y.user_id = x.user_id AND y.lo <= x.b AND y.hi >= x.n)""")
def interval_styles(s, d):
    v = _spans(s, d).select("user_id", F.floor(F.col("s") / 3600).alias("a"), (F.floor(F.col("s") / 3600) + 1 + F.floor(F.col("value") / 60)).alias("b"))
    out = [intervals.combine(v, ["user_id"], "a", "b", k).select(F.lit(k).alias("style"), "user_id", F.col("start").alias("lo"), F.col("end").alias("hi")) for k in ("joining", "separating", "elemental", "splitting")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


# aggregates


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, sum(l_quantity) AS quantity, grouping(l_returnflag) * 4 + grouping(l_linestatus) * 2 + grouping(l_linenumber) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
def cube(s, d):
    return T(s, d, "lineitem").cube("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.grouping_id().alias("level"))


@query("SELECT n_regionkey, n_name, c_mktsegment, count(*) AS n, min(c_acctbal) AS lo FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name, c_mktsegment)")
def rollup(s, d):
    c = T(s, d, "customer").join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("n_regionkey", "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("lo"))


@query("SELECT event_type, lang, count(*) AS n FROM (SELECT event_type, user_id % 20 AS k FROM events) JOIN (SELECT DISTINCT doc_id AS k, lang FROM documents WHERE doc_id < 20) USING (k) GROUP BY GROUPING SETS ((event_type), (lang), ())")
def grouping_sets(s, d):
    e = T(s, d, "events").select("event_type", (F.col("user_id") % 20).alias("k"))
    j = e.join(T(s, d, "documents").filter("doc_id < 20").select(F.col("doc_id").alias("k"), "lang").distinct(), "k")
    return j.groupingSets([["event_type"], ["lang"], []], "event_type", "lang").agg(F.count(F.lit(1)).alias("n")).select("event_type", "lang", "n")


@query("SELECT l_returnflag, sum(round(l_extendedprice, 2)::DECIMAL(19, 9) * round(l_tax, 2)::DECIMAL(19, 9))::DOUBLE AS weighted, sum(round(l_extendedprice, 2)::DECIMAL(38, 18))::DOUBLE AS total, round(sum(l_extendedprice), 1) AS scaled FROM lineitem GROUP BY 1")
def exact_weighted_sum(s, d):
    return T(s, d, "lineitem").groupBy("l_returnflag").agg(stats.exact_weighted_sum(F.round("l_extendedprice", 2), F.round("l_tax", 2)).alias("weighted"), stats.exact_sum(F.round("l_extendedprice", 2)).alias("total"), F.round(stats.scaled_sum("l_extendedprice"), 1).alias("scaled"))


_PROBS = [0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999]


@query(f"SELECT event_type, p, true AS near FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest({_PROBS}::DOUBLE[]) AS p)")
def sketched_quantiles(s, d):
    """Whether each quantile of the sketch stands within one percent of its rank."""
    e = T(s, d, "events")
    q = e.groupBy("event_type").agg(stats.quantiles("value", _PROBS, accuracy=1000).alias("q")).select("event_type", F.explode(F.arrays_zip(F.col("q").alias("q"), F.array(*map(F.lit, _PROBS)).alias("p"))).alias("x"))
    q = q.select("event_type", F.col("x.p").alias("p"), F.col("x.q").alias("q"))
    rank = e.join(F.broadcast(q), "event_type").groupBy("event_type", "p").agg(F.avg((F.col("value") < F.col("q")).cast("double")).alias("lo"), F.avg((F.col("value") <= F.col("q")).cast("double")).alias("hi"))  # nine rows a type
    return rank.select("event_type", "p", ((F.col("lo") - 0.01 <= F.col("p")) & (F.col("p") <= F.col("hi") + 0.01)).alias("near"))


@query("SELECT l_linestatus, 7 AS named, count(*) AS n, min(l_tax) AS lo, sum(l_quantity) / count(*) AS mean, round(sum(l_quantity * l_discount) / sum(l_quantity), 8) AS weighted FROM lineitem GROUP BY 1")
def composed_accumulators(s, d):
    """Several aggregates over one pass, one of them a named constant passed through, some with weights from outside."""
    return T(s, d, "lineitem").groupBy("l_linestatus").agg(F.any_value(F.lit(7)).alias("named"), F.count(F.lit(1)).alias("n"), F.min("l_tax").alias("lo"), F.avg("l_quantity").alias("mean"), F.round(stats.weighted_mean("l_discount", "l_quantity"), 8).alias("weighted"))


@query("SELECT c_nationkey, c_custkey, c_acctbal / sum(c_acctbal) OVER () AS part, count(*) OVER () AS everyone FROM customer WHERE c_acctbal > 5000")
def all_reduce(s, d):
    """Every row with what all rows add up to: a reduction whose one row goes back to all tasks."""
    c = T(s, d, "customer").filter("c_acctbal > 5000")
    total = c.agg(F.sum("c_acctbal").alias("total"), F.count(F.lit(1)).alias("everyone"))
    return c.crossJoin(F.broadcast(total)).select("c_nationkey", "c_custkey", (F.col("c_acctbal") / F.col("total")).alias("part"), "everyone")  # total is one row


# sequences as arrays: a vector's values in thousandths

_INTS = "[round(x * 1000)::BIGINT for x in embedding]"


def _ints(s, d):
    """The product is in the vectors' own precision, as SQL has it: one in double may fall on the other side of a half."""
    e = T(s, d, "embeddings")
    thousand = F.lit(1000).cast(e.schema["embedding"].dataType.elementType)
    return e.select("vec_id", "label", F.transform("embedding", lambda x: F.round((x * thousand).cast("double")).cast("long")).alias("e"))


@query(f"""SELECT vec_id, e[3:40] AS part, list_reverse(e) AS back, list_sort(e) AS ordered, list_contains(e, e[2]) AS has, e < list_reverse(e) AS less, list_sum(e)::BIGINT AS total,
   [e[i] * 2 for i in range(11, 41, 3)] AS chained, list_filter(e, lambda x: x % 2 <> 0) AS odd, e[1:5] || [7] || e[6:] AS inserted, e || [1] AS pushed, [1] || e AS led, e[1:3] || [0, 0] || e[6:] AS overwritten FROM (SELECT vec_id, {_INTS} AS e FROM embeddings)""")
def whole_arrays(s, d):
    e = F.col("e")
    put = F.concat(F.slice(e, 1, 3), F.array_repeat(F.lit(0).cast("long"), 2), F.slice(e, F.lit(6), F.size(e) - 5))
    return _ints(s, d).select(
        "vec_id", F.slice("e", 3, 38).alias("part"), F.reverse("e").alias("back"), F.array_sort("e").alias("ordered"), F.array_contains("e", e[1]).alias("has"), (e < F.reverse("e")).alias("less"), F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        seq.chained(e, 10, 40, 3, lambda x: x * 2).alias("chained"), F.filter("e", lambda x: x % 2 != 0).alias("odd"), F.array_insert("e", 6, F.lit(7).cast("long")).alias("inserted"), F.array_append("e", F.lit(1).cast("long")).alias("pushed"), F.array_prepend("e", F.lit(1).cast("long")).alias("led"), put.alias("overwritten"))


@query(f"SELECT vec_id, list_reduce([[x] for x in e], lambda a, b: CASE WHEN b[1] > a[-1] THEN a || b ELSE a END) AS rising, list_filter(e[1:20], lambda x: x <= 0) || list_filter(e[1:20], lambda x: x > 0) || list_filter(e[21:], lambda x: x > 0) || list_filter(e[21:], lambda x: x <= 0) AS gathered, e[1:4] || list_reverse(e)[5:9] || e[10:] AS one, list_reverse(e)[1:4] || e[5:9] || list_reverse(e)[10:] AS other FROM (SELECT vec_id, {_INTS} AS e FROM embeddings)")
def adjacent_gathered_swapped(s, d):
    e = F.col("e")
    one, other = seq.swapped(e, F.reverse("e"), 4, 5)
    return _ints(s, d).select("vec_id", seq.adjacent_filtered(e, lambda a, b: b > a).alias("rising"), seq.gathered(e, 20, lambda x: x > 0).alias("gathered"), one.alias("one"), other.alias("other"))


@query("SELECT i, [7 for j in range(0, i)] AS filled, range(i, i + 5) AS iota, [j * j for j in range(0, 4)] AS made FROM (SELECT unnest(range(1, 50)) AS i)")
def fill_and_iota(s, d):
    i = F.col("id")
    return seq.irange(s, 1, 50).select(i.alias("i"), F.array_repeat(F.lit(7), i.cast("int")).alias("filled"), F.sequence(i, i + 4).alias("iota"), F.transform(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), lambda j: j * j).alias("made"))


_P4 = "SELECT list_sort(list(DISTINCT p)) AS l FROM (SELECT [a, b, c, d] AS p FROM (VALUES (1), (2), (3)) t(a), (VALUES (1), (2), (3)) u(b), (VALUES (1), (2), (3)) v(c), (VALUES (1), (2), (3)) w(d))"


@query(f"WITH a AS (SELECT unnest(l) AS p FROM ({_P4})) SELECT p, coalesce((SELECT min(q.p) FROM a q WHERE q.p > x.p AND list_sort(q.p) = list_sort(x.p)), list_sort(p)) AS nxt FROM a x")
def permutations(s, d):
    digits = [F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias(c) for c in "abcd"]
    rows = s.range(1)
    for c in digits:
        rows = rows.select("*", c)
    p = rows.select(F.array(*"abcd").alias("p"))
    return p.select("p", seq.next_permutation(F.col("p")).alias("nxt"))


@query("SELECT event_id, ts, n_name FROM events LEFT JOIN nation ON n_nationkey = user_id % 30")
def indirected(s, d):
    e = T(s, d, "events").withColumn("at", (F.col("user_id") % 30).cast("int"))
    return seq.indirected(e, "at", T(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("event_id", "ts", "n_name")


@query("SELECT doc_id, unnest(w) AS token, unnest(range(0, len(w))) AS place FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents)")
def stream_tokens(s, d):
    return T(s, d, "documents").select("doc_id", F.posexplode(strings.tokens(F.col("text"), r"[^ \t\n\x0B\f\r]+")).alias("place", "token"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids, true AS moved FROM events")
def shuffled_rows(s, d):
    """A random order that depends on the seed and the key only; nothing is lost and the order is another."""
    key = seq.shuffled(F.col("event_id"), 7)
    e = T(s, d, "events").select("event_id", key.alias("k"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"), (F.min_by("event_id", "k") != F.min("event_id")).alias("moved"))


# strings


@query(r"SELECT doc_id, md5(lower(t)) AS low, md5(ltrim(t)) AS l, md5(rtrim(t)) AS r, starts_with(t, 'The') AS starts, ends_with(t, '.') AS ends, contains(t, 'tion') AS has, strpos(t, 'th') - 1 AS first, left(t, 5) AS head, right(t, 5) AS tail, CASE WHEN contains(t, 'th') THEN length(t) - strpos(reverse(t), 'ht') - 1 ELSE -1 END AS last, len(regexp_extract_all(t, '(?i)the')) AS n_the FROM (SELECT doc_id, replace(text, chr(0), '') AS t FROM documents)")
def find_in_text(s, d):
    """Whole texts of all documents."""
    t = F.col("t")
    df = T(s, d, "documents").select("doc_id", F.replace("text", F.lit("\0"), F.lit("")).alias("t"))
    return df.select("doc_id", F.md5(F.lower(t).cast("binary")).alias("low"), F.md5(F.ltrim(t).cast("binary")).alias("l"), F.md5(F.rtrim(t).cast("binary")).alias("r"), t.startswith("The").alias("starts"), t.endswith(".").alias("ends"), t.contains("tion").alias("has"), strings.find_first(t, "th").alias("first"), strings.find_head(t, 5).alias("head"), strings.find_tail(t, 5).alias("tail"), strings.find_last(t, "th").alias("last"), F.size(strings.ifind_all(t, "the")).alias("n_the"))


@query("SELECT p_partkey, replace(p_name, 'e', '') AS erased, CASE WHEN contains(p_name, 'e') THEN left(p_name, strpos(p_name, 'e') - 1) || 'EE' || substr(p_name, strpos(p_name, 'e') + 1) ELSE p_name END AS first, CASE WHEN contains(p_name, 'e') THEN reverse(left(reverse(p_name), strpos(reverse(p_name), 'e') - 1) || 'EE' || substr(reverse(p_name), strpos(reverse(p_name), 'e') + 1)) ELSE p_name END AS last, regexp_replace(p_brand, '(?i)bRAND', 'x$', 'g') AS any_case, substr(p_brand, 3) AS headless, regexp_full_match(p_brand, '[A-Za-z0-9]*') AS alnum, regexp_full_match(p_name, '[a-z]*') AS lower FROM part")
def replace_erase_classify(s, d):
    n, b = F.col("p_name"), F.col("p_brand")
    return T(s, d, "part").select("p_partkey", strings.erase_all(n, "e").alias("erased"), strings.replace_nth(n, "e", "EE", 0).alias("first"), strings.replace_nth(n, "e", "EE", -1).alias("last"), strings.ireplace_all(b, "bRAND", "x$").alias("any_case"), strings.erase_head(b, 2).alias("headless"), strings.is_class(b, "alnum").alias("alnum"), strings.is_class(n, "lower").alias("lower"))


@query("SELECT c_custkey, upper(c_name) AS up, row_number() OVER (ORDER BY lower(c_mktsegment), c_custkey) AS place FROM customer")
def collated_order(s, d):
    c = T(s, d, "customer")
    at = F.row_number().over(W.orderBy(F.collate("c_mktsegment", "UTF8_LCASE"), "c_custkey"))
    return c.select("c_custkey", F.upper("c_name").alias("up"), at.alias("place"))


# times


@query("SELECT event_id, user_id * 1000000 * 61 + event_id AS a, -(event_id % 60) * 1000000 AS b, NULL::BIGINT AS c, date_trunc('second', ts) AS iso, date_trunc('second', ts) AS basic FROM events")
def parse_times(s, d):
    u, i = F.col("user_id"), F.col("event_id")
    total = u * 1_000_000 * 61 + i
    sec = F.expr("(user_id * 61000000 + event_id) DIV 1000000")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    text = F.concat_ws(":", F.expr("(user_id * 61000000 + event_id) DIV 3600000000").cast("string"), pad(F.floor(sec / 60) % 60, 2), F.concat_ws(".", pad(sec % 60, 2), pad(total % 1_000_000, 6)))
    ts = F.col("ts")
    return T(s, d, "events").select("event_id", dates.parse_duration(text).alias("a"), dates.parse_duration(F.concat(F.lit("-0:00:"), pad(i % 60, 2))).alias("b"), dates.parse_duration(F.lit("1 hour")).alias("c"), dates.parse_iso(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("iso"), dates.parse_iso(F.date_format(ts, "yyyyMMdd'T'HHmmss")).alias("basic"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '9999-12-31 23:59:59.999999' WHEN 2 THEN TIMESTAMP '0001-01-01 00:00:00' ELSE TIMESTAMP '2001-02-03 04:05:06' END AS t, o_orderkey % 4 <> 3 AS special FROM orders")
def special_times(s, d):
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, "not-a-date-time").when(k == 1, "+infinity").when(k == 2, "-infinity").otherwise("2001-02-03 04:05:06")
    df = T(s, d, "orders").select("o_orderkey", dates.parse_special(name).alias("t"))
    return df.select("o_orderkey", "t", dates.is_special(F.col("t")).alias("special"))


@query("SELECT event_id, (ts::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS there FROM events")
def time_zones(s, d):
    return T(s, d, "events").select("event_id", dates.in_zone(F.col("ts").cast("timestamp"), "America/New_York").cast("timestamp_ntz").alias("there"))


# values


@query("SELECT c_custkey, 'name' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer")
def ini_pairs(s, d):
    c = T(s, d, "customer").select("c_custkey", F.explode(F.array(F.lit("[section]"), F.lit("; remark = none"), F.concat(F.lit("name = "), "c_name"), F.concat(F.lit("segment="), "c_mktsegment"), F.lit("no pair"))).alias("line"))
    return c.select("c_custkey", values.ini_pairs(F.col("line")).alias("p")).filter("p IS NOT NULL").select("c_custkey", "p.key", "p.value")


@query("SELECT event_id, (u < 0.3)::INT AS bernoulli, round(-ln(1 - u) / 2.0, 6) AS exponential, floor(ln(1 - u) / ln(0.75))::BIGINT AS geometric, round(1.0 + 2.0 * tan(pi() * (u - 0.5)), 4) AS cauchy, round(3.0 * power(-ln(1 - u), 1 / 1.5), 6) AS weibull, round(1.0 - 2.0 * ln(-ln(u)), 6) AS extreme, round(CASE WHEN u < 0.25 THEN sqrt(u * 4.0) ELSE 4.0 - sqrt((1 - u) * 12.0) END, 6) AS triangle, (floor(u * 6) + 1)::BIGINT AS die, round(2.0 + u * 3.0, 6) AS uniform, CASE WHEN u < 0.5 THEN 0 WHEN u < 0.6 THEN 1 WHEN u < 0.7 THEN 2 WHEN u < 0.8 THEN 3 WHEN u < 0.9 THEN 4 ELSE 5 END AS chosen FROM (SELECT event_id, (event_id % 997 + 0.37) / 997.6 AS u FROM events)")
def distributions(s, d):
    u = F.col("u")
    e = T(s, d, "events").select("event_id", ((F.col("event_id") % 997 + F.lit(0.37)) / F.lit(997.6)).alias("u"))
    r = lambda name, *p, n=6: F.round(values.draw(u, name, *p), n)
    return e.select("event_id", values.draw(u, "bernoulli", 0.3).alias("bernoulli"), r("exponential", 2.0).alias("exponential"), values.draw(u, "geometric", 0.25).cast("long").alias("geometric"), r("cauchy", 1.0, 2.0, n=4).alias("cauchy"), r("weibull", 1.5, 3.0).alias("weibull"), r("extreme_value", 1.0, 2.0).alias("extreme"), r("triangle", 0.0, 1.0, 4.0).alias("triangle"), values.draw(u, "uniform_int", 1, 6).alias("die"), r("uniform_real", 2.0, 5.0).alias("uniform"), values.weighted_choice(u, [0.5, 0.1, 0.1, 0.1, 0.1, 0.1]).alias("chosen"))


def _register(k: int, q: int, sh: int, x: str) -> str:
    return f"xor((({x} & {(0xFFFFFFFF << (32 - k)) & 0xFFFFFFFF}) << {sh}) & 4294967295, xor(({x} << {q}) & 4294967295, {x}) >> {k - sh})"


@query(f"WITH RECURSIVE r(i, a, b, c) AS (SELECT 0, 12345::BIGINT, 23456::BIGINT, 34567::BIGINT UNION ALL SELECT i + 1, {_register(31, 13, 12, 'a')}, {_register(29, 2, 4, 'b')}, {_register(28, 3, 17, 'c')} FROM r WHERE i < 500) SELECT i, xor(xor(a, b), c) AS x FROM r WHERE i > 0")
def taus88(s, d):
    """One stream is sequential: a generator's first numbers, made by one task."""

    def run(_):
        import pandas as pd

        g = values.Taus88((12345, 23456, 34567))
        yield pd.DataFrame([(i, g()) for i in range(1, 501)], columns=["i", "x"])

    return s.range(0, 1, 1, 1).mapInPandas(run, "i int, x long")


@query("SELECT c_custkey, list_reduce([2166136261::BIGINT] || [unicode(x)::BIGINT for x in string_split(c_name, '')], lambda h, b: xor((h * 16777619) % 4294967296, b)) AS fnv1, xor(list_reduce([4294967295::BIGINT] || [unicode(x)::BIGINT for x in string_split(c_name, '')], lambda h, b: list_reduce([xor(h, b)] || range(0, 8), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) AS crc32 FROM customer")
def checksums(s, d):
    return T(s, d, "customer").select("c_custkey", values.fnv1(F.col("c_name")).alias("fnv1"), F.crc32(F.col("c_name").cast("binary")).alias("crc32"))


@query("WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || c_name::BLOB) AS h FROM customer) SELECT c_custkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM h")
def name_uuids(s, d):
    return T(s, d, "customer").select("c_custkey", values.name_uuid(F.col("c_name")).alias("id"))


@query("SELECT vec_id, [round(x[1] + x[2], 5) for x in list_zip(e, list_reverse(e))] AS added, [round(x[1] - x[2], 5) for x in list_zip(e, list_reverse(e))] AS less FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def vector_sums(s, d):
    e = T(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    r = lambda c: F.transform(c, lambda x: values.rounded(x, 5))
    return e.select("vec_id", r(values.add(F.col("e"), F.reverse("e"))).alias("added"), r(values.add(F.col("e"), F.reverse("e"), -1)).alias("less"))


@query("WITH t AS (SELECT doc_id, CASE WHEN quality = 1 THEN true WHEN toxic = 1 THEN NULL ELSE false END AS a, CASE WHEN toxic = 1 THEN true WHEN quality = 0 THEN false END AS b FROM labels) SELECT doc_id, a AND b AS both, a OR b AS either, NOT a AS inverse, a IS NULL AS unknown, a IS NOT DISTINCT FROM b AS same FROM t")
def three_valued(s, d):
    a = F.when(F.col("quality") == 1, True).when(F.col("toxic") == 1, F.lit(None)).otherwise(False)
    b = F.when(F.col("toxic") == 1, True).when(F.col("quality") == 0, False)
    return T(s, d, "labels").select("doc_id", a.alias("a"), b.alias("b")).select("doc_id", (F.col("a") & F.col("b")).alias("both"), (F.col("a") | F.col("b")).alias("either"), (~F.col("a")).alias("inverse"), F.col("a").isNull().alias("unknown"), F.col("a").eqNullSafe(F.col("b")).alias("same"))


@query("SELECT 'by name' AS side, n_name AS key, n_nationkey::VARCHAR AS value FROM nation WHERE n_name BETWEEN 'B' AND 'K' UNION ALL SELECT 'by key', n_nationkey::VARCHAR, n_name FROM nation WHERE n_nationkey BETWEEN 5 AND 9")
def two_way_map(s, d):
    n = T(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name", "n_nationkey")
    left = n.filter(F.col("n_name").between("B", "K")).select(F.lit("by name").alias("side"), F.col("n_name").alias("key"), F.col("k").alias("value"))
    return left.unionByName(n.filter(F.col("n_nationkey").between(5, 9)).select(F.lit("by key").alias("side"), F.col("k").alias("key"), F.col("n_name").alias("value")))


# graphs


@query(f"WITH RECURSIVE {_PRICE} SELECT * FROM c")
def incremental_components(s, d):
    """The price graph in two instalments: edges of even vertices first, then the others."""
    e = graph.ordered_edges(_price_edges(s, d))
    first = graph.connected_components(e.filter("src % 2 = 0"))
    both = graph.incremental_components(first, e.filter("src % 2 <> 0"))
    alone = T(s, d, "part").select(F.col("p_partkey").alias("vertex")).join(both, "vertex", "left")
    return alone.select("vertex", F.coalesce("component", "vertex").alias("component"))


@query(f"WITH RECURSIVE {_TREE}, w AS (SELECT src, dst, (src % 7 + 1)::DOUBLE AS weight FROM e), r(vertex, far) AS (SELECT src, 0::DOUBLE FROM w WHERE src NOT IN (SELECT dst FROM w) UNION ALL SELECT w.dst, far + weight FROM r JOIN w ON w.src = vertex) SELECT vertex, max(far) AS longest, min(far) AS shortest FROM r GROUP BY vertex")
def dag_paths(s, d):
    e = _tree(s, d).withColumn("weight", (F.col("src") % 7 + 1).cast("double"))
    return graph.dag_paths(e, True).withColumnRenamed("distance", "longest").join(graph.dag_paths(e, False).withColumnRenamed("distance", "shortest"), "vertex")


@query("WITH e AS (SELECT event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id AS vertex, i AS discovered, 2 * n - 1 - i AS finished FROM e WHERE n > 1")
def depth_first(s, d):
    """A user's events in order of their ids, each with an edge to the next."""
    nxt = F.lead("event_id").over(W.partitionBy("user_id").orderBy("event_id"))
    return graph.depth_first(T(s, d, "events").select(F.col("event_id").alias("src"), nxt.alias("dst")).filter("dst IS NOT NULL"))


_UNDIRECTED = "m AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(weight) AS weight FROM t WHERE src <> dst GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {_TRADE}, {_UNDIRECTED}, o AS (SELECT *, row_number() OVER (ORDER BY weight, src, dst) AS k FROM m), r(k, v) AS (SELECT k, src FROM o UNION SELECT r.k, CASE WHEN o.src = r.v THEN o.dst ELSE o.src END FROM r JOIN o ON o.k < r.k AND (o.src = r.v OR o.dst = r.v))
   SELECT src, dst, weight FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = o.k AND r.v = o.dst)""")
def minimum_spanning_tree(s, d):
    """An edge is in the tree if lighter ones don't join its ends."""
    e = _trade(s, d).filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight"))
    return graph.minimum_spanning_forest(e)


def _regions(s, d):
    n = T(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))
    t = _trade(s, d).join(n, F.col("src") == F.col("k")).withColumnRenamed("r", "a").drop("k").join(n, F.col("dst") == F.col("k"))
    return t.groupBy(F.col("a").alias("src"), F.col("r").alias("dst")).agg(F.sum("weight").alias("weight")).filter("src <> dst")


_REGIONS = f"{_TRADE}, g AS (SELECT a.n_regionkey::BIGINT AS src, b.n_regionkey::BIGINT AS dst, sum(weight)::BIGINT AS weight FROM t JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2)"


@query(f"WITH {_REGIONS}, cuts AS (SELECT m, sum(weight)::DOUBLE AS c FROM g, (SELECT unnest(range(0, 32)) AS m) WHERE m & 1 = 1 AND m & 16 = 0 AND (m >> src::INT) & 1 = 1 AND (m >> dst::INT) & 1 = 0 GROUP BY m) SELECT min(c) AS flow FROM cuts")
def maximum_flow(s, d):
    """From region 0 to region 4; the least cut has the same value."""
    f = graph.max_flow(_regions(s, d).withColumnRenamed("weight", "capacity"), 0, 4)
    return f.agg((F.sum(F.when(F.col("src") == 0, F.col("flow")).otherwise(0.0)) - F.sum(F.when(F.col("dst") == 0, F.col("flow")).otherwise(0.0))).alias("flow"))


@query(f"WITH {_REGIONS}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g WHERE (weight + src + dst) % 3 <> 0), v AS (SELECT a AS x FROM u UNION SELECT b FROM u), cuts AS (SELECT m, count(*) FILTER ((m >> a::INT) & 1 <> (m >> b::INT) & 1) AS c FROM u, (SELECT unnest(range(1, 31)) AS m) GROUP BY m), p AS (SELECT m, c, (SELECT count(*) FROM v WHERE (m >> x::INT) & 1 = 1) AS inside, (SELECT count(*) FROM v) AS n FROM cuts) SELECT min(c)::INT AS connectivity FROM p WHERE inside BETWEEN 1 AND n - 1")
def edge_connectivity(s, d):
    """Of the graph of regions less some edges; 0 if that leaves several components."""
    c = graph.edge_connectivity(_regions(s, d).filter("(weight + src + dst) % 3 <> 0"))
    return c.agg(F.when(F.count(F.lit(1)) > 1, 0).otherwise(F.min("connectivity")).cast("int").alias("connectivity"))


@query(f"WITH RECURSIVE {_PRICE}, k AS (SELECT DISTINCT component AS x FROM c) SELECT lag(x) OVER (ORDER BY x) AS src, x AS dst FROM k QUALIFY src IS NOT NULL")
def make_connected(s, d):
    return graph.make_connected(graph.components_of(T(s, d, "part").select(F.col("p_partkey").alias("vertex")), _price_edges(s, d)))


@query(f"WITH {_TRADE} SELECT t.src, t.dst, weight FROM t JOIN nation ON n_nationkey = src AND n_regionkey = dst % 5 WHERE NOT (weight < 3)")
def edge_lookup_and_removal(s, d):
    n = T(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), "n_regionkey")
    pairs = n.select("src", F.explode(F.sequence(F.col("n_regionkey").cast("long"), F.lit(24).cast("long"), F.lit(5).cast("long"))).alias("dst"))
    return graph.without_edges(graph.lookup(_trade(s, d), pairs), F.col("weight") < 3)


_FEW = f"{_TRADE}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM (SELECT src, dst FROM t WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 2))"


def _few(s, d):
    """Each nation and the two that it sells most to, as an undirected graph."""
    by = W.partitionBy("src").orderBy(F.desc("weight"), "dst")
    t = _trade(s, d).filter("src <> dst").withColumn("k", F.row_number().over(by)).filter("k <= 2")
    return t.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


@query(f"WITH RECURSIVE {_FEW}, x AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u), q(c) AS (SELECT [a, b] FROM u UNION SELECT c || [x.b] FROM q JOIN x ON x.a = c[1] AND x.b > c[-1] WHERE (SELECT count(*) FROM x y WHERE y.b = x.b AND list_contains(c, y.a)) = len(c)) SELECT c AS clique FROM q WHERE NOT EXISTS (SELECT 1 FROM x WHERE list_contains(q.c, x.a) AND NOT list_contains(q.c, x.b) GROUP BY x.b HAVING count(*) = len(q.c))")
def maximal_cliques(s, d):
    return graph.maximal_cliques(_few(s, d)).select("clique")


@query(f"WITH RECURSIVE {_FEW}, x AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u), v AS (SELECT a AS v, row_number() OVER (ORDER BY a) AS k, list(b) AS near FROM x GROUP BY a), r(k, ids, colours) AS (SELECT 0, []::BIGINT[], []::BIGINT[] UNION ALL SELECT r.k + 1, ids || [v.v], colours || [list_min(list_filter(range(0, 30), lambda z: NOT list_contains([colours[i] for i in range(1, len(ids) + 1) if list_contains(v.near, ids[i])], z)))] FROM r JOIN v ON v.k = r.k + 1) SELECT unnest(ids) AS vertex, unnest(colours)::INT AS colour FROM (SELECT * FROM r ORDER BY k DESC LIMIT 1)")
def vertex_colouring(s, d):
    return graph.vertex_colouring(_few(s, d))


@query(f"WITH RECURSIVE {_FEW}, e AS (SELECT a, b, row_number() OVER (ORDER BY a, b) AS k FROM u), r(k, ea, eb, colours) AS (SELECT 0, []::BIGINT[], []::BIGINT[], []::BIGINT[] UNION ALL SELECT r.k + 1, ea || [e.a], eb || [e.b], colours || [list_min(list_filter(range(0, 60), lambda z: NOT list_contains([colours[i] for i in range(1, len(ea) + 1) if ea[i] = e.a OR ea[i] = e.b OR eb[i] = e.a OR eb[i] = e.b], z)))] FROM r JOIN e ON e.k = r.k + 1) SELECT unnest(ea) AS src, unnest(eb) AS dst, unnest(colours)::INT AS colour FROM (SELECT * FROM r ORDER BY k DESC LIMIT 1)")
def edge_colouring(s, d):
    return graph.edge_colouring(_few(s, d))


_WITHOUT = "x AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u), vs AS (SELECT DISTINCT a AS v FROM x), r(cut, v, w) AS (SELECT c.v, y.v, y.v FROM vs c JOIN vs y ON c.v <> y.v UNION SELECT r.cut, r.v, x.b FROM r JOIN x ON x.a = r.w AND x.b <> r.cut), l AS (SELECT cut, v, min(w) AS part FROM r GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE {_FEW}, {_WITHOUT}, z AS (SELECT a, b, cut, part FROM u JOIN l ON l.cut <> u.a AND l.v = u.a UNION ALL SELECT a, b, cut, part FROM u JOIN l ON l.cut = u.a AND l.v = u.b),
   f AS (SELECT a, b, list(part ORDER BY cut) AS sides FROM z GROUP BY a, b) SELECT f.a AS src, f.b AS dst, m.e.a AS block_src, m.e.b AS block_dst FROM f JOIN (SELECT sides, min({{'a': a, 'b': b}}) AS e FROM f GROUP BY sides) m USING (sides)""")
def biconnected_components(s, d):
    """Two edges are in one block if they lie on the same side of every other vertex."""
    return graph.biconnected(_few(s, d))


@query(f"WITH RECURSIVE {_FEW}, {_WITHOUT} SELECT l.cut AS vertex FROM l JOIN x ON x.a = l.cut AND x.b = l.v GROUP BY 1 HAVING count(DISTINCT part) > 1")
def articulation_points(s, d):
    return graph.articulation(_few(s, d))


@query(f"WITH RECURSIVE {_TRADE}, e AS (SELECT src, dst FROM t WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 2), p(c) AS (SELECT [src, dst] FROM e WHERE dst > src UNION ALL SELECT c || [dst] FROM p JOIN e ON e.src = c[-1] WHERE dst > c[1] AND NOT list_contains(c, dst) AND len(c) < 6) SELECT c AS cycle FROM p JOIN e ON e.src = c[-1] AND e.dst = c[1]")
def simple_cycles(s, d):
    by = W.partitionBy("src").orderBy(F.desc("weight"), "dst")
    e = _trade(s, d).filter("src <> dst").withColumn("k", F.row_number().over(by)).filter("k <= 2")
    return graph.simple_cycles(e, 6)


@query(f"WITH {_TRADE} SELECT src AS vertex, list_sort(list(dst)) AS targets FROM t GROUP BY src")
def compressed_rows(s, d):
    return graph.offsets(_trade(s, d))


@query("SELECT n_nationkey AS vertex, round(3 * cos(2 * pi() * n_nationkey / 25), 9) AS x, round(3 * sin(2 * pi() * n_nationkey / 25), 9) AS y FROM nation")
def circle_layout(s, d):
    out = graph.circle_layout(T(s, d, "nation").select("n_nationkey"), "n_nationkey", 3.0)
    return out.select("vertex", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


_SALES = "e AS (SELECT l_orderkey AS src, -1 - l_suppkey AS dst FROM lineitem UNION SELECT -1 - l_suppkey, l_orderkey FROM lineitem WHERE l_suppkey % 3 = 0)"


@query(f"WITH RECURSIVE {_SALES}, r(vertex, level) AS (SELECT o_orderkey, 0 FROM orders WHERE o_custkey % 100 = 1 UNION SELECT e.dst, level + 1 FROM r JOIN e ON e.src = vertex WHERE level < 6) SELECT vertex, min(level) AS level FROM r GROUP BY vertex")
def breadth_first_sales(s, d):
    """Orders and suppliers, linked by lines; from the orders of some customers. Every vertex is at most four edges away."""
    l = T(s, d, "lineitem").select("l_orderkey", (-1 - F.col("l_suppkey")).alias("k"), "l_suppkey")
    e = l.select(F.col("l_orderkey").alias("src"), F.col("k").alias("dst")).unionByName(l.filter("l_suppkey % 3 = 0").select(F.col("k").alias("src"), F.col("l_orderkey").alias("dst"))).distinct()
    return graph.breadth_first(e, T(s, d, "orders").filter("o_custkey % 100 = 1").select(F.col("o_orderkey").alias("vertex")))


# kinship and negative controls

_BITS = "[CASE WHEN x > 0 THEN 1 ELSE 0 END for x in embedding]"
_REFS = f"SELECT label, id, list(ref ORDER BY distance, ref) AS refs FROM (SELECT a.label, a.vec_id AS id, b.vec_id AS ref, list_sum([abs(x[1] - x[2]) for x in list_zip(a.e, b.e)])::INT AS distance FROM (SELECT *, {_BITS} AS e FROM embeddings) a JOIN (SELECT *, {_BITS} AS e FROM embeddings) b USING (label) WHERE a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY distance, b.vec_id) <= 5) GROUP BY 1, 2"


def _references(s, d):
    return kinship.references(_haplotypes(s, d).withColumnRenamed("chr", "cluster_id"), "hap_id", "words", 5)


@query(f"SELECT label AS cluster_id, id AS hap_id, refs FROM ({_REFS})")
def references_by_group(s, d):
    return _references(s, d)


@query()
def hmm_fit(s, d):
    """The log likelihood of each pair of a switch rate and a mutation rate; the largest is the fit."""
    h = _haplotypes(s, d)
    refs = _references(s, d).select(F.col("cluster_id").alias("chr"), "hap_id", "refs")
    n = h.agg(F.max("n")).first()[0]
    return knockoffs.tune(knockoffs.panels(h, refs), [float(i) for i in range(n)], [0.05, 0.2], [1e-3, 1e-2]).select("chr", "rho", "mutation", F.round("log_likelihood", 4).alias("log_likelihood"))


def _hmm_sql() -> str:
    """Forward recursion over the places of a haplotype, for each pair of rates; the vector of five states is a list."""
    return f"""WITH RECURSIVE b AS (SELECT label, vec_id, {_BITS} AS e FROM embeddings), f AS ({_REFS}),
      p AS (SELECT f.label, f.id, h.e, list(r.e ORDER BY k) AS panel FROM (SELECT label, id, unnest(refs) AS ref, unnest(range(0, len(refs))) AS k FROM f) f JOIN b h ON h.vec_id = f.id JOIN b r ON r.vec_id = f.ref GROUP BY ALL),
      q(label, id, rho, mu, j, n, v, ll) AS (SELECT label, id, rho, mu, 0, len(e), [1.0::DOUBLE / len(panel) for x in panel], 0.0::DOUBLE FROM p, (VALUES (0.05::DOUBLE), (0.2)) AS a(rho), (VALUES (0.001::DOUBLE), (0.01)) AS c(mu)
        UNION ALL SELECT label, id, rho, mu, j + 1, n, [x / list_sum(u) for x in u], ll + ln(list_sum(u)) FROM (
          SELECT q.*, [(CASE WHEN j = 0 THEN x[1] ELSE exp(-rho) * x[1] + (1 - exp(-rho)) * list_sum(v) / len(v) END) * CASE WHEN x[2][j + 1] = e[j + 1] THEN 1 - mu ELSE mu END for x in list_zip(v, panel)] AS u FROM q JOIN p USING (label, id) WHERE j < n))
      SELECT label AS chr, rho, mu AS mutation, round(sum(ll), 4) AS log_likelihood FROM q WHERE j = n GROUP BY 1, 2, 3"""


ORACLES["hmm_fit"] = _hmm_sql()


@query("SELECT 0 AS wrong_size, 0 AS self_reference, 0 AS doubled")
def reference_sanity(s, d):
    """How many haplotypes' references fail each check."""
    r = _references(s, d)
    return r.agg(F.count_if(F.size("refs") != 5).cast("int").alias("wrong_size"), F.count_if(F.array_contains("refs", F.col("hap_id"))).cast("int").alias("self_reference"), F.count_if(F.size(F.array_distinct("refs")) != F.size("refs")).cast("int").alias("doubled"))


@query(f"""WITH RECURSIVE b AS (SELECT label, vec_id, {_BITS} AS a, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings),
   k AS (SELECT label, vec_id AS x, nxt AS y, 8 * (vec_id % 4) + 3 AS lo, 8 * (vec_id % 4) + 29 AS hi FROM b WHERE vec_id % 3 <> 0 AND nxt IS NOT NULL),
   e AS (SELECT label, g, x, y FROM k, (SELECT unnest(range(0, 8)) AS g) WHERE g * 8 >= lo AND g * 8 + 7 <= hi), u AS (SELECT * FROM e UNION ALL SELECT label, g, y, x FROM e),
   r(label, g, v, w) AS (SELECT DISTINCT label, g, x, x FROM u UNION SELECT r.label, r.g, r.v, u.y FROM r JOIN u ON u.label = r.label AND u.g = r.g AND u.x = r.w), f AS (SELECT label, g, v, min(w) AS m FROM r GROUP BY 1, 2, 3),
   c AS (SELECT label, vec_id, g, list_reverse(a)[g * 8 + 1:g * 8 + 8] AS c FROM b, (SELECT unnest(range(0, 8)) AS g) WHERE g * 8 < len(a)),
   j AS (SELECT o.label, o.vec_id, o.g, coalesce(t.c, o.c) AS c FROM c o LEFT JOIN f ON f.label = o.label AND f.g = o.g AND f.v = o.vec_id LEFT JOIN c t ON t.label = f.label AND t.g = f.g AND t.vec_id = f.m)
   SELECT label AS chr, vec_id AS hap_id, flatten(list(c ORDER BY g)) AS controls FROM j GROUP BY 1, 2""")
def family_controls(s, d):
    """Relatives: some vectors share part of their places with the next of their label. Controls are alleles reversed."""
    a = F.transform("embedding", lambda x: (x > 0).cast("long"))
    e = T(s, d, "embeddings").select(F.col("label").alias("chr"), F.col("vec_id").alias("hap_id"), a.alias("alleles"), F.reverse(a).alias("controls"))
    nxt = F.lead("hap_id").over(W.partitionBy("chr").orderBy("hap_id"))
    k = e.select("chr", F.array(F.col("hap_id"), nxt).alias("indices"), (8 * (F.col("hap_id") % 4) + 3).alias("j_min"), (8 * (F.col("hap_id") % 4) + 29).alias("j_max"), nxt.alias("nxt")).filter("indices[0] % 3 <> 0 AND nxt IS NOT NULL")
    return knockoffs.shared_by_relatives(e, k.drop("nxt"), 8).select("chr", "hap_id", "controls")
