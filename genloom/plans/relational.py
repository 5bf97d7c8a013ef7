"""Queries of filters, sequences, aggregates, strings, dates and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from genloom.functions import dates, strings, values
from genloom.operators import filters, haplo, partition, seq, stats
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


# filters


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def keep_extract(s, d):
    return filters.keep(T(s, d, "orders").select("o_orderkey", "o_custkey"), T(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def exclude_samples(s, d):
    return filters.exclude(T(s, d, "orders").select("o_orderkey", "o_custkey"), T(s, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2))")
def include_exclude_check(s, d):
    nation = T(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return filters.check(T(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", nation.filter("n_regionkey = 1"), nation.filter("n_regionkey IN (1, 2)")).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey BETWEEN 50 AND 120")
def position_range(s, d):
    return filters.position_range(T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", 50, 120)


@query("SELECT 'original' AS side, l_partkey AS snp FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT 'control', l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def split_original_control(s, d):
    df = filters.rename(T(s, d, "lineitem").withColumn("control", F.col("l_returnflag") == "N"), {"l_partkey": "snp", "control": "Knockoff"})
    a, b = filters.split_control(df, columns=["snp"])
    return a.select(F.lit("original").alias("side"), "snp").unionByName(b.select(F.lit("control").alias("side"), "snp"))


@query("SELECT l_suppkey, min(l_partkey) AS min_bp, max(l_partkey) AS max_bp FROM lineitem GROUP BY l_suppkey")
def chr_boundaries(s, d):
    return filters.boundaries(T(s, d, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT l_suppkey, m, round(1e6 * greatest(0.0, 0.001 - 0.0005), 3) AS left_bp, round(1e6 * least(0.001 + 0.0005, m * 1e-6), 3) AS right_bp FROM (SELECT l_suppkey, max(l_partkey) AS m FROM lineitem GROUP BY 1)")
def viewport_clamp(s, d):
    last = T(s, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_partkey").alias("m"))
    a, b = filters.viewport(F.lit(0.001), F.lit(0.0005), F.col("m"))
    return last.select("l_suppkey", "m", F.round(a, 3).alias("left_bp"), F.round(b, 3).alias("right_bp"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 7 = 0")
def thin_variants(s, d):
    return filters.thin(T(s, d, "part").select("p_partkey"), "p_partkey", 7)


@query("SELECT c_custkey, first_value(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS z FROM customer")
def mask_by_family(s, d):
    return filters.mask_by_family(T(s, d, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("z")), "c_nationkey", "c_custkey", "z").select("c_custkey", "z")


@query("SELECT l_orderkey, l_linenumber, (l_partkey >> 3) & 1 AS bit3, l_partkey | 16 AS set4, l_partkey & ~2 AS clear1 FROM lineitem")
def bit_access(s, d):
    df = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_partkey").alias("w"))
    return df.select("l_orderkey", "l_linenumber", filters.get_bit(F.col("w"), F.lit(3)).alias("bit3"), filters.set_bit("w", 4, True)[0].alias("set4"), filters.set_bit("w", 1, False)[0].alias("clear1"))


@query("SELECT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part")
def column_pick(s, d):
    return filters.fields_at(T(s, d, "part"), "p_name", {1: "a", 2: "b"}).select("a", F.coalesce("b", F.lit("")).alias("b"))


@query("SELECT 0 AS part, o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 1, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def merge_chromosomes(s, d):
    o = T(s, d, "orders")
    return partition.merge([o.filter(F.col("o_orderstatus") == c).select("o_orderkey") for c in "OFP"])


@query("SELECT lang, count(*) AS n, least(avg(toxic), 1 - avg(toxic)) AS maf FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def maf_by_group(s, d):
    df = T(s, d, "labels").join(T(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), stats.minor_allele_frequency("toxic").alias("maf"))


@query("SELECT n_name, c.c_custkey FROM customer c JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE'")
def equi_join_map(s, d):
    return T(s, d, "customer").join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(T(s, d, "region").filter("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "c_custkey")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(user_id) AS lo, max(user_id) AS hi FROM events GROUP BY event_type")
def scan_summary(s, d):
    return T(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.min("user_id").alias("lo"), F.max("user_id").alias("hi"))


@query("SELECT count(*) AS n FROM conversations")
def line_count(s, d):
    return T(s, d, "conversations").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY 1")
def sql_passthrough(s, d):
    from genloom.sources.sql import run

    return run(s, "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > :least GROUP BY 1", {"customer": T(s, d, "customer")}, least=100)


# aggregates


@query("""SELECT l_suppkey, round(sum(l_quantity * l_extendedprice), 2) AS weighted_sum, sum(l_quantity) AS sum_of_weights, round(sum(l_tax), 6) AS sum_of_variates,
   round(sum(l_quantity * l_tax), 6) AS weighted_variates, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS weighted_mean,
   round(sum(l_quantity * l_discount ** 2) / sum(l_quantity), 8) AS weighted_moment2 FROM lineitem GROUP BY l_suppkey""")
def weighted_moments(s, d):
    q, p = "l_quantity", "l_extendedprice"
    return T(s, d, "lineitem").groupBy("l_suppkey").agg(
        F.round(stats.weighted_sum(p, q), 2).alias("weighted_sum"), F.sum(q).alias("sum_of_weights"), F.round(F.sum("l_tax"), 6).alias("sum_of_variates"),
        F.round(stats.weighted_sum("l_tax", q), 6).alias("weighted_variates"), F.round(stats.weighted_mean(p, q), 4).alias("weighted_mean"), F.round(stats.weighted_moment("l_discount", q, 2), 8).alias("weighted_moment2"))


@query("""SELECT l_returnflag, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 8) AS mean, round(var_pop(l_quantity), 6) AS variance,
   round(avg(l_quantity ** 3), 4) AS moment3, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 8) AS error_of_mean FROM lineitem GROUP BY l_returnflag""")
def moments(s, d):
    x = "l_quantity"
    return T(s, d, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.round(F.avg(x), 8).alias("mean"), F.round(stats.variance(x), 6).alias("variance"),
        F.round(stats.moment(x, 3), 4).alias("moment3"), F.round(stats.error_of_mean(x), 8).alias("error_of_mean"))


@query("""SELECT event_type, round(sqrt(count(*)) * 0 + (sum((value - m) ** 3) / count(*)) / power(sum((value - m) ** 2) / count(*), 1.5), 6) AS skewness
   FROM events JOIN (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) USING (event_type) GROUP BY event_type""")
def skewness(s, d):
    return T(s, d, "events").groupBy("event_type").agg(F.round(stats.skewness("value"), 6).alias("skewness"))


@query("SELECT event_type, [round(x, 6) for x in quantile_cont(value, [0.25, 0.5, 0.75, 0.99])] AS q, round(median(value), 6) AS median FROM events GROUP BY event_type")
def quantiles(s, d):
    q = F.transform(stats.quantiles("value", [0.25, 0.5, 0.75, 0.99], exact=True), lambda x: F.round(x, 6))
    return T(s, d, "events").groupBy("event_type").agg(q.alias("q"), F.round(F.median("value"), 6).alias("median"))


@query("SELECT l_returnflag, sum(round(l_tax, 2)::DECIMAL(38, 18))::DOUBLE AS total FROM lineitem GROUP BY 1")
def exact_sum(s, d):
    return T(s, d, "lineitem").groupBy("l_returnflag").agg(stats.exact_sum(F.round("l_tax", 2)).alias("total"))


@query("SELECT event_type, value, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 8) AS p FROM events")
def cumulative_distribution(s, d):
    from pyspark.sql import Window as W

    return T(s, d, "events").select("event_type", "value", F.round(F.cume_dist().over(W.partitionBy("event_type").orderBy("value")), 8).alias("p"))


# sequences

_E = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"SELECT event_id, count(value) OVER w3 AS n, round(sum(value) OVER w3, 4) AS total, round(avg(value) OVER ({_E} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS mean, round(sum(value) OVER ({_E} ROWS UNBOUNDED PRECEDING), 4) AS running FROM events WINDOW w3 AS ({_E} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling(s, d):
    k, o = ["user_id"], ["ts", "event_id"]
    return T(s, d, "events").select("event_id", seq.rolling_count("value", k, o).alias("n"), F.round(seq.rolling_sum("value", k, o), 4).alias("total"), F.round(seq.rolling_mean("value", k, o), 4).alias("mean"), F.round(seq.partial_sum("value", k, o), 4).alias("running"))


@query(f"SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER ({_E}) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def uniqued(s, d):
    return seq.uniqued(T(s, d, "events"), "event_type", ["user_id"], ["ts", "event_id"]).select("event_id", "event_type")


@query(f"SELECT event_id, i AS place FROM (SELECT event_id, row_number() OVER ({_E}) - 1 AS i FROM events) WHERE i >= 2 AND i < 6")
def sliced(s, d):
    df = seq.sliced(T(s, d, "events"), ["user_id"], ["ts", "event_id"], 2, 6)
    return df.withColumn("place", seq.index(["user_id"], ["ts", "event_id"]) + 2).select("event_id", "place")


@query(f"SELECT event_id FROM (SELECT event_id, row_number() OVER ({_E}) - 1 AS i FROM events) WHERE i % 3 = 0")
def strided(s, d):
    return seq.strided(T(s, d, "events"), ["user_id"], ["ts", "event_id"], 3).select("event_id")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS kind, CASE WHEN value > 50 THEN 50.0 ELSE value END AS value FROM events")
def replaced(s, d):
    return T(s, d, "events").select("event_id", seq.replaced(F.col("event_type"), "click", "tap").alias("kind"), seq.replaced_if(F.col("value"), F.col("value") > 50, 50.0).alias("value"))


@query(f"SELECT user_id, bool_and(coalesce(value >= b, true)) AS is_sorted FROM (SELECT *, lag(value) OVER ({_E}) AS b FROM events) GROUP BY user_id")
def is_sorted(s, d):
    return seq.is_sorted(T(s, d, "events"), "value", ["user_id"], ["ts", "event_id"])


@query(f"SELECT user_id, NOT bool_or(coalesce(value > 90 AND NOT b > 90, false)) AS is_partitioned FROM (SELECT *, lag(value) OVER ({_E}) AS b FROM events) GROUP BY user_id")
def is_partitioned(s, d):
    return seq.is_partitioned(T(s, d, "events"), F.col("value") > 90, ["user_id"], ["ts", "event_id"])


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY (NOT value > 50)::INT, ts, event_id) - 1 AS place FROM events")
def stable_partition(s, d):
    return T(s, d, "events").select("event_id", seq.stable_partition(["user_id"], ["ts", "event_id"], F.col("value") > 50).alias("place"))


@query(f"SELECT user_id, event_type, min(i) AS first, count(*) AS length FROM (SELECT user_id, event_type, row_number() OVER ({_E}) - 1 AS i, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS j FROM events) GROUP BY user_id, event_type, i - j HAVING count(*) >= 2")
def search_n(s, d):
    return seq.search_n(T(s, d, "events"), "event_type", ["user_id"], ["ts", "event_id"], 2)


@query(f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER ({_E}) - 1 AS i FROM events) WHERE i = 4")
def nth_element(s, d):
    return seq.nth_element(T(s, d, "events"), ["user_id"], ["ts", "event_id"], 4).select("user_id", "event_id")


@query("SELECT a.event_id AS a, b.event_id AS b FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) a JOIN (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS i FROM events) b USING (user_id, i)")
def combined(s, d):
    e = T(s, d, "events")
    return seq.combined(e.select("user_id", "ts", F.col("event_id").alias("a")), e.select("user_id", "value", F.col("event_id").alias("b")), ["user_id"], ["ts", "a"], ["value", "b"]).select("a", "b")


@query("SELECT event_type, least(min(value), 0.0) AS lo, greatest(max(value), 1.0) AS hi, count(*) FILTER (value > 50) AS above FROM events GROUP BY event_type")
def minmax_count_if(s, d):
    return T(s, d, "events").groupBy("event_type").agg(F.least(F.min("value"), F.lit(0.0)).alias("lo"), F.greatest(F.max("value"), F.lit(1.0)).alias("hi"), F.count_if(F.col("value") > 50).alias("above"))


@query("SELECT id AS i, id * id AS sq FROM (SELECT unnest(range(0, 100, 7)) AS id)")
def counting_range(s, d):
    return seq.irange(s, 0, 100, 7).select(F.col("id").alias("i"), (F.col("id") * F.col("id")).alias("sq"))


# strings


@query(r"SELECT doc_id, len(w) AS words, md5(array_to_string(w, ' ')) AS all_words FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS w FROM documents)")
def tokenize(s, d):
    w = strings.tokens(F.col("text"), "[A-Za-z0-9_]+")
    return T(s, d, "documents").select("doc_id", F.size(w).alias("words"), F.md5(F.array_join(w, " ").cast("binary")).alias("all_words"))


@query(r"SELECT c_custkey, string_split_regex(c_name, '[#0]+') AS compressed, string_split_regex(c_name, '[#0]') AS parts, array_to_string(list_filter(string_split_regex(c_name, '[#0]'), lambda x: x <> ''), '-') AS joined FROM customer")
def split_join(s, d):
    n = F.col("c_name")
    return T(s, d, "customer").select("c_custkey", strings.split(n, "#0", True).alias("compressed"), strings.split(n, "#0").alias("parts"), strings.join_if(strings.split(n, "#0"), "-", lambda x: x != "").alias("joined"))


@query(r"SELECT p_partkey, regexp_replace(p_name, '([a-z]+)', '<\1>', 'g') AS marked, regexp_replace(p_type, '[AEIOU]', '', 'g') AS bare, replace(p_brand, 'Brand', 'B') AS brand, regexp_matches(p_brand, '^[A-Za-z#0-9]*$') AS plain FROM part")
def regex_replace(s, d):
    return T(s, d, "part").select("p_partkey", F.regexp_replace("p_name", "([a-z]+)", "<$1>").alias("marked"), F.regexp_replace("p_type", "[AEIOU]", "").alias("bare"), F.replace("p_brand", F.lit("Brand"), F.lit("B")).alias("brand"), strings.all_of(F.col("p_brand"), "A-Za-z#0-9").alias("plain"))


@query(r"SELECT p_partkey, [p_brand[1:3], p_brand[4:5], p_brand[6:8]] AS pieces, list_filter(string_split_regex(p_type, '[ -]'), lambda x: x <> '') AS toks FROM part")
def tokenizers(s, d):
    return T(s, d, "part").select("p_partkey", strings.offsets(F.col("p_brand"), [3, 2, 3]).alias("pieces"), strings.separated(F.col("p_type"), " -").alias("toks"))


@query("SELECT a.p_partkey, b.n FROM part a JOIN (SELECT lower(p_brand) AS k, count(*) AS n FROM part GROUP BY 1) b ON lower(a.p_brand) = b.k")
def case_insensitive_join(s, d):
    p = T(s, d, "part")
    return p.join(p.groupBy(F.upper("p_brand").alias("k")).agg(F.count(F.lit(1)).alias("n")), strings.iequals(F.col("p_brand"), F.col("k"))).select("p_partkey", "n")


# dates and values


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofyear(o_orderdate) AS doy, dayofweek(o_orderdate) AS dow, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS later FROM orders")
def date_parts(s, d):
    x = F.col("o_orderdate")
    return T(s, d, "orders").select("o_orderkey", F.year(x).alias("y"), F.month(x).alias("m"), F.day(x).alias("d"), F.dayofyear(x).alias("doy"), dates.weekday(x).alias("dow"), dates.shift_months(x.cast("date"), 3).alias("later"))


@query("SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < l_shipdate + INTERVAL 10 DAY AND l_shipdate < o_orderdate + INTERVAL 60 DAY GROUP BY 1")
def period_overlap(s, d):
    df = T(s, d, "orders").join(T(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    o, l = F.col("o_orderdate"), F.col("l_shipdate")
    return df.filter(dates.periods_overlap(o, o + F.expr("INTERVAL 60 DAY"), l, l + F.expr("INTERVAL 10 DAY"))).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CAST(unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + INTERVAL 2 MONTH, INTERVAL 1 MONTH)) AS DATE) AS at FROM orders")
def time_iterator(s, d):
    first = F.trunc(F.to_date("o_orderdate"), "month")
    return T(s, d, "orders").select("o_orderkey", F.explode(dates.iterate(first, F.add_months(first, 2), "1 MONTH")).alias("at"))


@query("SELECT event_id, epoch_us(ts) * 1000 AS nanos, strftime(ts, '%Y-%m-%d') AS day FROM events")
def time_resolution(s, d):
    ts = F.col("ts")
    return T(s, d, "events").select("event_id", dates.to_nanos(ts).alias("nanos"), F.date_format(ts, "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_props(s, d):
    return T(s, d, "events").select("event_id", F.explode(values.json_tree(F.col("props"))).alias("k", "v"))


@query("SELECT vec_id, round(list_sum([abs(x) for x in e]), 4) AS l1, round(sqrt(list_sum([x * x for x in e])), 4) AS l2, round(list_max([abs(x) for x in e]), 4) AS linf, round(list_sum(e), 4) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def vector_norms(s, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return T(s, d, "embeddings").select("vec_id", F.round(values.norm(e, 1), 4).alias("l1"), F.round(values.norm(e, 2), 4).alias("l2"), F.round(values.norm(e, "inf"), 4).alias("linf"), F.round(values.total(e), 4).alias("total"))


@query("SELECT a.s AS i, b.n AS j, sum(a.v * b.v) AS v FROM (SELECT s_nationkey AS s, s_suppkey AS k, 1 AS v FROM supplier) a JOIN (SELECT l_suppkey AS k, l_linenumber AS n, count(*) AS v FROM lineitem GROUP BY 1, 2) b USING (k) GROUP BY 1, 2")
def matrix_product(s, d):
    a = T(s, d, "supplier").select(F.col("s_nationkey").alias("i"), F.col("s_suppkey").alias("k"), F.lit(1).alias("va"))
    b = T(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("j")).agg(F.count(F.lit(1)).alias("vb"))
    return a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


@query("SELECT event_type, bit_and(user_id) AS all_bits, bit_or(user_id) AS any_bits, bit_xor(user_id) AS odd_bits, sum(bit_count(user_id))::BIGINT AS ones FROM events GROUP BY event_type")
def bitset(s, d):
    u = F.col("user_id")
    return T(s, d, "events").groupBy("event_type").agg(F.bit_and(u).alias("all_bits"), F.bit_or(u).alias("any_bits"), F.bit_xor(u).alias("odd_bits"), F.sum(F.bit_count(u)).alias("ones"))


@query("SELECT user_id, map_keys(m) AS k, map_values(m) AS v FROM (SELECT user_id, map_from_entries(list({'k': event_type, 'v': n} ORDER BY event_type)) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id)")
def map_keys_values(s, d):
    n = T(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return m.select("user_id", F.map_keys("m").alias("k"), F.map_values("m").alias("v"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_k(s, d):
    return T(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def top_k_per_key(s, d):
    from pyspark.sql import Window as W

    o = T(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return o.withColumn("rank", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).filter("rank <= 3").drop("o_totalprice")


@query("SELECT 'shared' AS side, user_id FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase') UNION ALL SELECT 'only', user_id FROM (SELECT user_id FROM events WHERE event_type = 'click' AND value > 90 EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)")
def set_operations(s, d):
    e = T(s, d, "events")
    side = lambda t, v: e.filter((F.col("event_type") == t) & (F.col("value") > v)).select("user_id")
    both, only = side("click", -1e9).intersect(side("purchase", -1e9)), side("click", 90).subtract(side("purchase", 90))
    return both.select(F.lit("shared").alias("side"), "user_id").unionByName(only.select(F.lit("only").alias("side"), "user_id"))


@query("SELECT c_name, md5(c_name) AS md5, sha1(c_name) AS sha1, sha256(c_name) AS sha256 FROM customer")
def hashes(s, d):
    n = F.col("c_name").cast("binary")
    return T(s, d, "customer").select("c_name", F.md5(n).alias("md5"), F.sha1(n).alias("sha1"), F.sha2(n, 256).alias("sha256"))


# haplotypes

_BITS = "[CASE WHEN x > 0 THEN 1 ELSE 0 END for x in embedding]"


@query(f"SELECT a.label, a.vec_id AS id, b.vec_id AS ref, list_sum([abs(x[1] - x[2]) for x in list_zip(a.e, b.e)])::INT AS distance FROM (SELECT *, {_BITS} AS e FROM embeddings) a JOIN (SELECT *, {_BITS} AS e FROM embeddings) b USING (label) WHERE a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY distance, b.vec_id) <= 3")
def hamming_knn(s, d):
    df = T(s, d, "embeddings").withColumn("a", F.transform("embedding", lambda x: (x > 0).cast("int"))).withColumn("words", haplo.pack("a"))
    return haplo.nearest(df, ["label"], "vec_id", "words", 3).select("label", "id", "ref", "distance")


@query(f"SELECT vec_id, list_sum(e)::INT AS ones, list_sum(e[11:41])::INT AS inner_ones FROM (SELECT vec_id, {_BITS} AS e FROM embeddings)")
def hamming_distance(s, d):
    df = T(s, d, "embeddings").withColumn("a", F.transform("embedding", lambda x: (x > 0).cast("int"))).withColumn("words", haplo.pack("a")).withColumn("zero", F.transform("words", lambda x: x * 0))
    return df.select("vec_id", haplo.hamming("words", "zero").alias("ones"), haplo.hamming_range("words", "zero", 10, 40).alias("inner_ones"))


@query(f"SELECT label AS chr, i AS snp_idx, round(least(avg(b), 1 - avg(b)), 8) AS maf FROM (SELECT label, unnest({_BITS}) AS b, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2")
def packed_maf(s, d):
    df = T(s, d, "embeddings").withColumn("a", F.transform("embedding", lambda x: (x > 0).cast("int"))).select(F.col("label").alias("chr"), haplo.pack("a").alias("words"), F.size("a").alias("n"))
    return haplo.allele_frequencies(df).select("chr", "snp_idx", F.round("maf", 8).alias("maf"))
