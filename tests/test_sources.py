import struct
import zlib

from pyspark.sql import functions as F

from genloom.sources import binary, paths, sql, text
from genloom.streaming.sessions import gap_sessions


def test_expand():
    assert paths.expand("x_chr{21:22}_r{0:1}.txt") == ["x_chr21_r0.txt", "x_chr21_r1.txt", "x_chr22_r0.txt", "x_chr22_r1.txt"]


def test_text_readers(spark, tmp_path):
    for c in (21, 22):
        (tmp_path / f"map_chr{c}.txt").write_text("bp rate cm\n10 0.5 0.1\n20 NA 0.2\n")
        (tmp_path / f"key_chr{c}.key").write_text(f"Chr Variant Position Group Knockoff\n{c} rs{c} 100 7 FALSE\n{c} rs{c}.k 100 7 TRUE\n")
    m = text.read_map(spark, f"{tmp_path}/map_chr{{21:22}}.txt")
    assert {(r.chr, r.bp, r.rate) for r in m.collect()} == {(21, 10, 0.5), (21, 20, None), (22, 10, 0.5), (22, 20, None)}
    assert {(r.CHR, r.SNP, r.Knockoff) for r in text.read_key(spark, f"{tmp_path}/key_chr{{21:22}}.key").collect()} == {(21, "rs21", False), (21, "rs21.k", True), (22, "rs22", False), (22, "rs22.k", True)}
    (tmp_path / "ids.txt").write_text("a  b\n\nc d\n")
    assert [tuple(r) for r in text.read_ids(spark, f"{tmp_path}/ids.txt", ["fid", "iid"]).collect()] == [("a", "b"), ("c", "d")]
    (tmp_path / "pc.txt").write_text("id PC1 PC2 PC3\ns1 0.1 0.2 0.3\n")
    assert text.read_covariates(spark, f"{tmp_path}/pc.txt", 2).first().z == [0.1, 0.2]
    (tmp_path / "part.txt").write_text("SNP res0 res1\nrs1 0 0\nrs2 1 0\n")
    assert {(r.snp_id, r.res, r.group_id) for r in text.read_partition(spark, f"{tmp_path}/part.txt").collect()} == {("rs1", 0, 0), ("rs1", 1, 0), ("rs2", 0, 1), ("rs2", 1, 0)}
    (tmp_path / "ibd.txt").write_text("seg indices j_min j_max bp_min bp_max\n1 5,2,5 0 9 100 900\n")
    assert text.read_ibd(spark, f"{tmp_path}/ibd.txt").first().indices == [2, 5]


def test_haplotype_files(spark, tmp_path):
    (tmp_path / "x.haps").write_text("0 1 1 0\n1 1 0 0\n0 0 0 1\n")
    (tmp_path / "x.leg").write_text("id position a0 a1\nrs1 10 A C\nrs2 20 G T\nrs3 30 A G\n")
    (tmp_path / "x.sample").write_text("ID_1 ID_2\n0 0\ns1 s1\ns2 s2\n")
    v = text.read_haps(spark, f"{tmp_path}/x.haps", f"{tmp_path}/x.leg", f"{tmp_path}/x.sample")
    assert [r.snp_id for r in v.orderBy("snp_idx").collect()] == ["rs1", "rs2", "rs3"]
    h = {r.hap_id: (r.n, r.words) for r in text.to_haplotypes(v, 21).collect()}
    assert h == {0: (3, [2]), 1: (3, [3]), 2: (3, [1]), 3: (3, [4])}
    assert [r.iid for r in text.read_samples(spark, f"{tmp_path}/x.sample").orderBy("sample_idx").collect()] == ["s1", "s2"]
    text.write_haps(v, f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["0 0 0 1", "0 1 1 0", "1 1 0 0"]


def test_bed_round_trip(spark, tmp_path):
    binary.register(spark)
    rows = [(i, f"rs{i}", [(i * 3 + s) % 3 if (i + s) % 5 else None for s in range(6)]) for i in range(10)]
    p = f"{tmp_path}/g"
    (tmp_path / "g.bim").write_text("".join(f"1\trs{i}\t0\t{i}\tA\tC\n" for i in range(10)))
    (tmp_path / "g.fam").write_text("".join(f"f s{i} 0 0 0 -9\n" for i in range(6)))
    df = spark.createDataFrame(rows, "snp_idx long, snp_id string, dosages array<int>").repartitionByRange(3, "snp_idx").sortWithinPartitions("snp_idx")
    df.write.format("genloom.bed").mode("append").option("path", p).save()
    got = spark.read.format("genloom.bed").option("path", p).option("chunk", 3).load()
    assert sorted(tuple(r) for r in got.collect()) == rows
    some = spark.read.format("genloom.bed").option("path", p).option("variants", "rs2,rs7").option("samples", "s1,s4").load().collect()
    assert sorted((r.snp_id, r.dosages) for r in some) == [("rs2", [rows[2][2][1], rows[2][2][4]]), ("rs7", [rows[7][2][1], rows[7][2][4]])]
    assert text.read_bim(spark, p + ".bim").count() == 10 and text.read_fam(spark, p + ".fam").first().iid == "s0"


def bgen_file(path, packed):
    names = [b"s1", b"s2"]
    block = struct.pack("<I", 2) + b"".join(struct.pack("<H", len(n)) + n for n in names)
    block = struct.pack("<I", len(block) + 4) + block
    head = struct.pack("<III4sI", 20, 3, 2, b"bgen", packed | 2 << 2 | 1 << 31)
    out = struct.pack("<I", len(head) + len(block)) + head + block
    for i in range(3):
        text_ = lambda s, n=2: len(s).to_bytes(n, "little") + s
        out += text_(b"v") + text_(f"rs{i}".encode()) + text_(b"01") + struct.pack("<IH", 100 + i, 2) + text_(b"A", 4) + text_(b"G", 4)
        probs = bytes([255, 0, 0, 255]) if i else bytes([0, 255, 255, 0])
        data = struct.pack("<IHBB", 2, 2, 2, 2) + bytes([2, 2 | (128 if i == 2 else 0), 1, 8]) + probs
        body = zlib.compress(data) if packed == 1 else data
        out += struct.pack("<I", len(body) + 4) + struct.pack("<I", len(data)) + body if packed else struct.pack("<I", len(body)) + body
    path.write_bytes(out)


def test_bgen(spark, tmp_path):
    binary.register(spark)
    from genloom.operators.haplo import phased

    for packed in (0, 1):
        bgen_file(tmp_path / f"x{packed}.bgen", packed)
        rows = spark.read.format("genloom.bgen").option("path", f"{tmp_path}/x{packed}.bgen").option("chunk", 2).load().orderBy("snp_idx").collect()
        assert [(r.snp_id, r.bp, r.alleles, r.phased) for r in rows] == [(f"rs{i}", 100 + i, ["A", "G"], True) for i in range(3)]
        assert rows[0].probs == [[0, 1, 1, 0], [1, 0, 0, 1]] and rows[2].probs[1] is None
        one = spark.read.format("genloom.bgen").option("path", f"{tmp_path}/x{packed}.bgen").option("variants", "rs1").option("samples", "s2").load()
        assert tuple(one.select(F.col("probs")[0].alias("p")).select(phased("p").alias("h")).first().h) == (1, 0)


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.dimacs").write_text("p edge 3 2\ne 1 2\ne 2 3\n")
    assert {tuple(r) for r in text.read_dimacs(spark, f"{tmp_path}/g.dimacs").collect()} == {(1, 2), (2, 3)}
    (tmp_path / "g.metis").write_text("% c\n3 2\n2\n1 3\n2\n")
    assert {tuple(r) for r in text.read_metis(spark, f"{tmp_path}/g.metis").collect()} == {(1, 2), (2, 1), (2, 3), (3, 2)}
    (tmp_path / "g.dot").write_text('digraph G {\n a -> b;\n "b" -> "c";\n}\n')
    assert {(r.src, r.dst) for r in text.read_graphviz(spark, f"{tmp_path}/g.dot").collect()} == {("a", "b"), ("b", "c")}


def test_sqlite_and_blocks(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "x.db") as con:
        con.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(1, "x"), (2, "y")])
    assert [tuple(r) for r in sql.sqlite_table(spark, f"{tmp_path}/x.db", "SELECT a, b FROM t WHERE a > ?", "a long, b string", (1,)).collect()] == [(2, "y")]
    raw = spark.range(1).select(binary.compressed(F.encode(F.lit("abc" * 50), "UTF-8"), "zlib", 6, 4).alias("x")).first().x
    assert bytes(raw[:4]) == bytes(4) and zlib.decompress(bytes(raw[4:])) == b"abc" * 50


def test_sessions(spark):
    df = spark.createDataFrame([("u", f"2024-01-01 00:{m:02d}:00") for m in (0, 5, 30, 31)], "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in gap_sessions(df, "k", "t", "10 minutes", "1 hour").collect()) == [2, 2]


def test_lines_are_numbered_in_order_of_files(spark, tmp_path):
    """Spark deals larger files first; a part file that is larger than the ones before it took their numbers."""
    for i, n in enumerate([1, 40, 3]):
        (tmp_path / f"part-0000{i}.txt").write_text("".join(f"{i}-{j} {'x' * 50 * i}\n" for j in range(n)))
    got = sorted((r.i, r.value.split()[0]) for r in text.numbered(spark.read.text(str(tmp_path))).collect())
    assert [v for _, v in got] == ["0-0", *[f"1-{j}" for j in range(40)], "2-0", "2-1", "2-2"] and [i for i, _ in got] == list(range(44))


def test_bgen_blocks_stay_arrow_arrays():
    """A variant's samples are one array from block to batch: lists of Python floats took some hundred bytes a sample."""
    import pyarrow as pa

    for phased, bits, probs in ((True, 8, [[1.0, 0.0, 0.0, 1.0], None, [0.0, 1.0, 0.0, 1.0]]), (False, 16, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], None]), (False, 5, [[0.0, 0.0, 1.0]])):
        row = pa.RecordBatch.from_pydict({"snp_idx": [0], "snp_id": ["a"], "chrom": ["1"], "bp": [5], "alleles": [["A", "G"]], "phased": [phased], "probs": [probs]})
        writer = binary.BgenWriter({"path": "-", "codec": "", "bits": str(bits)})
        block = writer.pack(row)[2 + 2 + 1 + 2 + 1 + 4 + 2 + 5 + 5 + 4 :]
        got = binary.probabilities(block, list(range(len(probs))))
        assert isinstance(got[1], pa.Array) and (got[0], got[1].to_pylist()) == (phased, probs)
        assert binary.probabilities(block, [0])[1].to_pylist() == probs[:1]


def test_arrow_batches_are_small(spark, sf):
    from genloom.plans.catalogue import QUERIES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    QUERIES["block_compression"](spark, sf)
    assert spark.conf.get(key) == "4m"
