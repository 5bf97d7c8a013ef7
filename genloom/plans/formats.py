"""Queries of sources and sinks: each writes a file format from the test tables to shared storage and reads it back.

Embeddings stand in for genotypes: a vector is a sample and a place of it a variant; the sign of a value is an allele.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genloom.operators import filters, haplo, knockoffs, partition
from genloom.runtime import small_batches, table
from genloom.sources import binary, sql, store, text

T = table
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql_text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql_text:
            ORACLES[f.__name__] = sql_text
        return f

    return add


def _cells(s, d):
    """(vec_id, i, x): the values of all vectors by place from 0."""
    return T(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))


_CELLS = "c AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings)"


def _by_variant(s, d, value):
    """(snp_idx, snp_id, a): an array of a value of each sample, in order of vec_id."""
    rows = _cells(s, d).groupBy(F.col("i").cast("long").alias("snp_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", value.alias("v")))), lambda x: x["v"]).alias("a"))
    return rows.select("snp_idx", F.concat(F.lit("rs"), "snp_idx").alias("snp_id"), "a")


def _samples(s, d):
    return T(s, d, "embeddings").select(F.lit("f").alias("fid"), F.concat(F.lit("s"), "vec_id").alias("iid"), "vec_id")


# haplotype files


def _haps(s, d):
    base = store.fresh(s, "x")
    v = _by_variant(s, d, (F.col("x") > 0).cast("int"))
    text.write_haps(v.withColumnRenamed("a", "alleles"), base + ".haps")
    text.write_table(v.select("snp_id", (F.col("snp_idx") + 1000).alias("position"), F.lit("A").alias("a0"), F.lit("C").alias("a1")).orderBy("position").coalesce(1), base + ".legend")
    first = s.createDataFrame([("0", "0", -1)], "fid string, iid string, vec_id long")
    text.write_samples(first.unionByName(_samples(s, d)).repartition(1).sortWithinPartitions("vec_id"), base + ".sample")
    return base


@query(f"WITH {_CELLS} SELECT i AS snp_idx, 'rs' || i AS snp_id, 1000 + i AS bp, 'A' AS a1, 'C' AS a2, count(*) AS n, string_agg((x > 0)::INT::VARCHAR, '' ORDER BY vec_id) AS alleles FROM c GROUP BY i")
def haps_scan(s, d):
    base = _haps(s, d)
    v = text.read_haps(s, base + ".haps", base + ".legend", base + ".sample")
    return v.select("snp_idx", "snp_id", "bp", "a1", "a2", F.size("alleles").cast("long").alias("n"), F.array_join(F.transform("alleles", lambda x: x.cast("string")), "").alias("alleles"))


@query(f"WITH {_CELLS}, n AS (SELECT *, dense_rank() OVER (ORDER BY vec_id) - 1 AS hap_id FROM c) SELECT 21 AS chr, hap_id, count(*)::INT AS n, string_agg((x > 0)::INT::VARCHAR, '' ORDER BY i) AS alleles FROM n GROUP BY hap_id")
def haplotypes_from_haps(s, d):
    base = _haps(s, d)
    h = text.to_haplotypes(text.read_haps(s, base + ".haps", base + ".legend", base + ".sample"), 21)
    return h.select("chr", "hap_id", "n", F.array_join(F.transform(haplo.unpack("words", "n"), lambda x: x.cast("string")), "").alias("alleles"))


@query("SELECT 'f' AS fid, 's' || vec_id AS iid, row_number() OVER (ORDER BY vec_id) - 1 AS sample_idx FROM embeddings")
def sample_scan(s, d):
    return text.read_samples(s, _haps(s, d) + ".sample")


# bed files

_DOSAGE_SQL = "CASE WHEN abs(x) < 0.01 THEN NULL ELSE (x > 0)::INT + (x > 0.1)::INT END"


def _bed(s, d):
    binary.register(s)
    base = store.fresh(s, "g")
    v = _by_variant(s, d, F.expr(_DOSAGE_SQL.replace("::INT", "::int"))).withColumnRenamed("a", "dosages")
    v.repartitionByRange(4, "snp_idx").sortWithinPartitions("snp_idx").write.format("genloom.bed").mode("append").option("path", base).save()
    ids = v.select(F.lit("1").alias("chr"), "snp_id", F.lit(0).alias("cm"), F.col("snp_idx").alias("bp"), F.lit("A").alias("a1"), F.lit("C").alias("a2"))
    text.write_table(ids.repartitionByRange(2, "bp").sortWithinPartitions("bp"), base + ".bim", "\t", False)
    fam = _samples(s, d).repartitionByRange(2, "vec_id").sortWithinPartitions("vec_id")
    text.write_table(fam.select("fid", "iid", F.lit(0).alias("pa"), F.lit(0).alias("ma"), F.lit(0).alias("sex"), F.lit(-9).alias("y")), base + ".fam", " ", False)
    return base


def _joined(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), "", ".")


@query(f"WITH {_CELLS} SELECT i AS snp_idx, 'rs' || i AS snp_id, string_agg(coalesce(({_DOSAGE_SQL})::VARCHAR, '.'), '' ORDER BY vec_id) AS dosages FROM c GROUP BY i")
def bed_round_trip(s, d):
    got = s.read.format("genloom.bed").option("path", _bed(s, d)).option("chunk", 16).load()
    return got.select("snp_idx", "snp_id", _joined("dosages").alias("dosages"))


@query(f"WITH {_CELLS}, p AS (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 3) SELECT i AS snp_idx, 'rs' || i AS snp_id, string_agg(coalesce(({_DOSAGE_SQL})::VARCHAR, '.'), '' ORDER BY vec_id) AS dosages FROM c JOIN p USING (vec_id) WHERE i IN (2, 17, 40) GROUP BY i")
def bed_pushdown(s, d):
    some = [r.iid for r in _samples(s, d).orderBy("vec_id").limit(3).collect()]
    got = s.read.format("genloom.bed").option("path", _bed(s, d)).option("chunk", 16).option("variants", "rs2,rs17,rs40").option("samples", ",".join(some)).load()
    return got.select("snp_idx", "snp_id", _joined("dosages").alias("dosages"))


@query(f"WITH {_CELLS} SELECT DISTINCT 'variant' AS kind, 'rs' || i AS id, i AS place FROM c UNION ALL SELECT 'sample', 's' || vec_id, 0 FROM embeddings")
def bim_fam_scan(s, d):
    base = _bed(s, d)
    v = text.read_bim(s, base + ".bim").select(F.lit("variant").alias("kind"), F.col("snp_id").alias("id"), F.col("bp").alias("place"))
    return v.unionByName(text.read_fam(s, base + ".fam").select(F.lit("sample").alias("kind"), F.col("iid").alias("id"), F.lit(0).cast("long").alias("place")))


@query("WITH b AS (SELECT label, vec_id, [CASE WHEN x > 0 THEN 1 ELSE 0 END for x in embedding] AS a FROM embeddings), p AS (SELECT label, vec_id, unnest(range(0, len(a))) AS i, unnest(a) AS o, unnest(list_reverse(a)) AS k FROM b) SELECT label AS chr, i AS snp_idx, false AS Knockoff, count(*) AS n, sum(o)::BIGINT AS ones FROM p GROUP BY 1, 2 UNION ALL SELECT label, i, true, count(*), sum(k)::BIGINT FROM p GROUP BY 1, 2")
def original_control_table(s, d):
    a = F.transform("embedding", lambda x: (x > 0).cast("long"))
    g = T(s, d, "embeddings").select(F.col("label").alias("chr"), F.col("vec_id").alias("hap_id"), a.alias("alleles"), F.reverse(a).alias("controls"))
    return knockoffs.pair_table(g).groupBy("chr", "snp_idx", "Knockoff").agg(F.count(F.lit(1)).alias("n"), F.sum("allele").alias("ones"))


# bgen files: two phased alleles a sample, by two cuts of a value

_PAIR_SQL = "(x > 0)::INT AS first, (x > 0.05)::INT AS second"


def _bgen(s, d, codec):
    binary.register(s)
    path = store.fresh(s, "x.bgen")
    a, b = (F.col("x") > 0).cast("double"), (F.col("x") > 0.05).cast("double")
    v = _by_variant(s, d, F.array(1 - a, a, 1 - b, b))
    rows = v.select("snp_idx", "snp_id", F.lit("21").alias("chrom"), (F.col("snp_idx") * 10 + 100).alias("bp"), F.array(F.lit("A"), F.lit("G")).alias("alleles"), F.lit(True).alias("phased"), F.col("a").alias("probs"))
    names = ",".join(r.iid for r in _samples(s, d).orderBy("vec_id").select("iid").collect())  # the head of a file holds its samples
    rows.repartitionByRange(4, "snp_idx").sortWithinPartitions("snp_idx").write.format("genloom.bgen").mode("append").option("path", path).option("codec", codec).option("samples", names).save()
    return path


def _pairs(df):
    p = F.transform("probs", lambda p: F.concat((p[1] > p[0]).cast("int").cast("string"), (p[3] > p[2]).cast("int").cast("string")))
    return df.select("snp_idx", "snp_id", "chrom", "bp", "phased", F.array_join(p, "").alias("pairs"))


@query(f"WITH {_CELLS} SELECT i AS snp_idx, 'rs' || i AS snp_id, '21' AS chrom, i * 10 + 100 AS bp, true AS phased, string_agg((x > 0)::INT::VARCHAR || (x > 0.05)::INT::VARCHAR, '' ORDER BY vec_id) AS pairs FROM c GROUP BY i")
def bgen_round_trip(s, d):
    return _pairs(s.read.format("genloom.bgen").option("path", _bgen(s, d, "zlib")).option("chunk", 8).load())


@query(f"WITH {_CELLS}, p AS (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 2) SELECT i AS snp_idx, vec_id, {_PAIR_SQL} FROM c JOIN p USING (vec_id) WHERE i IN (5, 33)")
def bgen_pushdown(s, d):
    two = _samples(s, d).orderBy("vec_id").limit(2)
    some = [r.iid for r in two.collect()]
    df = s.read.format("genloom.bgen").option("path", _bgen(s, d, "zstd")).option("variants", "rs5,rs33").option("samples", ",".join(some)).load()
    cell = df.select("snp_idx", F.posexplode("probs").alias("place", "p")).withColumn("h", haplo.phased("p"))
    places = two.withColumn("place", F.row_number().over(W.orderBy("vec_id")) - 1).select("place", "vec_id")  # two rows
    return cell.join(places, "place").select(F.col("snp_idx"), "vec_id", F.col("h.first").alias("first"), F.col("h.second").alias("second"))


@query(f"WITH {_CELLS} SELECT count(DISTINCT i) AS variants, min(i * 10 + 100) AS first_bp, max(i * 10 + 100) AS last_bp, count(DISTINCT vec_id) AS samples FROM c")
def bgen_summary(s, d):
    df = s.read.format("genloom.bgen").option("path", _bgen(s, d, "")).load()
    return df.agg(F.countDistinct("snp_id").alias("variants"), F.min("bp").alias("first_bp"), F.max("bp").alias("last_bp"), F.max(F.size("probs")).cast("long").alias("samples"))


# text tables

_MAP = "SELECT CASE WHEN p_partkey % 2 = 0 THEN 22 ELSE 21 END AS chr, p_partkey AS bp, p_retailprice AS rate, CASE WHEN p_size = 7 THEN NULL ELSE p_size / 4.0 END AS cm FROM part"


@query(_MAP)
def genetic_map_scan(s, d):
    base = store.fresh(s, "map")
    p = T(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("rate"), F.when(F.col("p_size") != 7, F.col("p_size") / 4.0).alias("cm"))
    for c in (21, 22):
        text.write_table(p.filter(F.col("p_partkey") % 2 == c % 2).select(F.col("p_partkey").alias("bp"), "rate", "cm"), f"{base}_chr{c}.txt")
    return text.read_map(s, base + "_chr{21:22}.txt").select("chr", "bp", "rate", "cm")


def _partitions(s, d):
    p = T(s, d, "part").select(F.lit(1).alias("chr"), F.concat(F.lit("rs"), "p_partkey").alias("snp_id"), "p_partkey")
    return partition.multi_resolution(p.withColumn("at", F.floor(F.col("p_partkey") * F.col("p_partkey") / 7)), ["chr"], "at", [0, 10, 50], "p_partkey").select("snp_id", "res", "group_id")


_PARTITION = """WITH p AS (SELECT p_partkey, p_partkey * p_partkey // 7 AS a FROM part), g AS (SELECT *, a - lag(a) OVER (ORDER BY a, p_partkey) AS gap FROM p)
   SELECT 'rs' || p_partkey AS snp_id, res::INT AS res, sum(coalesce((gap > cut)::INT, 0)) OVER (PARTITION BY res ORDER BY a, p_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS group_id FROM g, (VALUES (0, 0), (1, 10), (2, 50)) AS l(res, cut)"""


@query(_PARTITION)
def partition_file_scan(s, d):
    path = store.fresh(s, "partition.txt")
    text.write_partition_file(_partitions(s, d), path)
    return text.read_partition(s, path)


@query(f"SELECT snp_id, group_id FROM ({_PARTITION}) WHERE res = 1")
def resolution_select(s, d):
    path = store.fresh(s, "partition")
    text.write_partitioned(_partitions(s, d), path, ["res"])
    return s.read.parquet(path).filter("res = 1").select("snp_id", "group_id")


@query("SELECT o_orderkey AS seg_id, list_sort(list(DISTINCT l_suppkey)) AS indices, min(l_linenumber)::BIGINT AS j_min, max(l_linenumber)::BIGINT AS j_max, min(l_partkey) AS bp_min, max(l_partkey) AS bp_max FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def ibd_scan(s, d):
    path = store.fresh(s, "ibd.txt")
    l = T(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("seg_id")).agg(F.collect_list("l_suppkey").alias("indices"), F.min("l_linenumber").alias("j_min"), F.max("l_linenumber").alias("j_max"), F.min("l_partkey").alias("bp_min"), F.max("l_partkey").alias("bp_max"))
    text.write_ibd(l, path)
    return text.read_ibd(s, path)


@query("SELECT 's' || c_custkey AS iid, [c_nationkey::DOUBLE, c_acctbal] AS z FROM customer")
def covariates_scan(s, d):
    path = store.fresh(s, "pc.txt")
    c = T(s, d, "customer").select(F.concat(F.lit("s"), "c_custkey").alias("id"), F.col("c_nationkey").alias("PC1"), F.col("c_acctbal").alias("PC2"), F.col("c_custkey").alias("PC3"))
    text.write_table(c, path)
    return text.read_covariates(s, path, 2)


@query("SELECT (s_nationkey + 1)::INT AS CHR, 's' || s_suppkey AS SNP, s_suppkey AS BP, s_suppkey // 10 AS \"Group\", s_suppkey % 2 = 0 AS Knockoff FROM supplier")
def key_file_scan(s, d):
    base = store.fresh(s, "key")
    k = T(s, d, "supplier").select((F.col("s_nationkey") + 1).cast("int").alias("CHR"), F.concat(F.lit("s"), "s_suppkey").alias("SNP"), F.col("s_suppkey").alias("BP"), F.expr("s_suppkey DIV 10").alias("Group"), (F.col("s_suppkey") % 2 == 0).alias("Knockoff"))
    for half in (0, 1):
        text.write_keys(k.filter(F.col("BP") % 2 == half), f"{base}_{half}.key")
    return text.read_key(s, base + "_{0:1}.key")


@query("SELECT 'f' || c_nationkey AS fid, 's' || c_custkey AS iid FROM customer WHERE c_acctbal > 0")
def id_list_scan(s, d):
    path = store.fresh(s, "ids.txt")
    text.write_list(T(s, d, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("f"), "c_nationkey"), F.concat(F.lit("s"), "c_custkey")), path)
    return text.read_ids(s, path, ["fid", "iid"])


@query("SELECT o_orderkey, o_custkey FROM orders")
def header_dropped(s, d):
    path = store.fresh(s, "orders.txt")
    text.write_table(T(s, d, "orders").select("o_orderkey", "o_custkey"), path)
    rows = s.read.option("header", True).schema("value string").option("sep", "\x01").csv(path)
    return filters.fields_at(rows, "value", {1: "a", 2: "b"}).select(F.col("a").cast("long").alias("o_orderkey"), F.col("b").cast("long").alias("o_custkey"))


@query("SELECT l_suppkey AS CHR, l_partkey AS SNP, l_orderkey AS BP FROM lineitem WHERE l_returnflag = 'R'")
def rename_reorder(s, d):
    return filters.rename(T(s, d, "lineitem").filter("l_returnflag = 'R'"), {"l_suppkey": "CHR", "l_partkey": "SNP", "l_orderkey": "BP"})


@query("SELECT 'chr' || s_nationkey AS chrom, s_suppkey * 100 AS start, s_suppkey * 100 + 50 AS \"end\", s_name AS name FROM supplier")
def annotation_scan(s, d):
    path = store.fresh(s, "genes.txt")
    a = T(s, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("chr"), "s_nationkey").alias("chrom"), F.lit("+").alias("strand"), (F.col("s_suppkey") * 100).alias("start"), (F.col("s_suppkey") * 100 + 50).alias("end"))
    text.write_table(a, path, "\t", False, "gzip")
    return text.read_annotation(s, path, {"chrom": 1, "start": 3, "end": 4, "name": 0})


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey >= 2")
def sqlite_scan(s, d):
    import sqlite3

    path = store.located(store.fresh(s, "n.db"))
    path[0].create_dir(path[1].rpartition("/")[0], recursive=True)
    rows = [tuple(r) for r in T(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]  # a fixed list of 25
    with sqlite3.connect(path[1]) as con:
        con.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)")
        con.executemany("INSERT INTO nation VALUES (?, ?, ?)", rows)
    con.close()
    return sql.sqlite_table(s, path[1], "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey >= ?", "n_nationkey int, n_name string", (2,))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0")
def atomic_overwrite(s, d):
    path = store.fresh(s, "t")
    c = T(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    for part in (c, c.filter("c_acctbal > 0")):
        sql.replaced_at_once(part.drop("c_acctbal"), path)
    return s.read.schema("c_custkey long, c_mktsegment string").parquet(path)


@query("SELECT label AS chr, vec_id AS hap_id, list_sort([vec_id + 1, vec_id + 2])::BIGINT[] AS refs FROM embeddings WHERE label = 1")
def saved_references(s, d):
    path = store.fresh(s, "references")
    r = T(s, d, "embeddings").select(F.col("label").alias("chr"), F.col("vec_id").alias("hap_id"), F.array(F.col("vec_id") + 1, F.col("vec_id") + 2).alias("refs"))
    text.write_partitioned(r, path, ["chr"])
    return s.read.schema("hap_id long, refs array<long>, chr int").parquet(path).filter("chr = 1").select("chr", "hap_id", "refs")


@query("SELECT label AS chr, i AS snp_idx, 0.05::DOUBLE AS rho, (1 + i % 3) / 1000.0 AS mutation FROM (SELECT DISTINCT label, unnest(range(0, 8)) AS i FROM embeddings)")
def saved_model(s, d):
    path = store.fresh(s, "hmm")
    m = T(s, d, "embeddings").select(F.col("label").alias("chr"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("snp_idx")).distinct()
    knockoffs.write_model(m.select("chr", F.col("snp_idx").cast("long").alias("snp_idx"), F.lit(0.05).alias("rho"), ((1 + F.col("snp_idx") % 3) / 1000.0).alias("mutation")), path)
    return knockoffs.read_model(s, path)


@query("SELECT r_regionkey, n_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_regionkey = 2 GROUP BY 1, 2")
def partitioned_writer(s, d):
    path = store.fresh(s, "customers")
    c = T(s, d, "customer").join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r_regionkey"), "n_name", "c_custkey")
    text.write_partitioned(c, path, ["r_regionkey"])
    return s.read.schema("n_name string, c_custkey long, r_regionkey int").parquet(path).filter("r_regionkey = 2").groupBy("r_regionkey", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, md5(text) AS a, md5(text) AS b FROM documents WHERE text IS NOT NULL")
def block_compression(s, d):
    small_batches(s)
    t = T(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("t"))
    return t.select("doc_id", F.md5(binary.decompressed(binary.compressed(F.col("t"), "zlib", 6, 4), "zlib", 4)).alias("a"), F.md5(binary.decompressed(binary.compressed(F.col("t")))).alias("b"))


# graph files

_LINKS = "SELECT DISTINCT least(k, k % 17 + 1) AS src, greatest(k, k % 17 + 1) AS dst FROM (SELECT s_suppkey + 1 AS k FROM supplier) WHERE k <> k % 17 + 1"


def _links(s, d):
    k, o = F.col("s_suppkey") + 1, (F.col("s_suppkey") + 1) % 17 + 1
    return T(s, d, "supplier").filter(k != o).select(F.least(k, o).alias("src"), F.greatest(k, o).alias("dst")).distinct()


@query(_LINKS)
def dimacs_scan(s, d):
    path = store.fresh(s, "g.dimacs")
    text.write_dimacs(_links(s, d), path)
    return text.read_dimacs(s, path)


@query(f"WITH e AS ({_LINKS}) SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e")
def metis_scan(s, d):
    path = store.fresh(s, "g.metis")
    n = T(s, d, "supplier").agg(F.greatest(F.max("s_suppkey") + 1, F.lit(17)).alias("n")).first().n
    text.write_metis(_links(s, d), n, path)
    return text.read_metis(s, path)


@query(f"SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, false AS directed FROM ({_LINKS})")
def graphviz_scan(s, d):
    path = store.fresh(s, "g.dot")
    text.write_graphviz(_links(s, d), path, directed=False)
    return text.read_graphviz(s, path)
