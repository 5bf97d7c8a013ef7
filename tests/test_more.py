"""Tests of what the catalogue's SQL doesn't reach: bounds, goldens, brute force, round trips of odd files."""

import itertools
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genloom import runtime
from genloom.functions import dates, strings
from genloom.operators import graph, haplo, intervals, kinship, seq, stats
from genloom.sources import binary, sql, store


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# runtime


def test_scratch_deletes_what_is_not_kept(spark):
    with runtime.scratch(spark) as outer:
        with runtime.scratch(spark) as inner:
            a, b = runtime.materialize(spark.range(3), "a"), runtime.materialize(spark.range(4), "b")
            inner.keep(b)
        c = runtime.materialize(b, "c")
        outer.keep(c)
    there = lambda df: os.path.isdir(df._genloom_path.removeprefix("file://"))
    assert (there(a), there(b), there(c)) == (False, False, True) and c.count() == 4


def test_scratch_deletes_after_an_error(spark):
    with pytest.raises(KeyError), runtime.scratch(spark):
        a = runtime.materialize(spark.range(3), "a")
        raise KeyError
    assert not os.path.isdir(a._genloom_path.removeprefix("file://"))


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    df = runtime.materialize(spark.range(1000), "side")
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(runtime.small_or_not(df)) and not hinted(runtime.small_or_not(df, rows=999)) and not hinted(runtime.small_or_not(df, size=100))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://h:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())


# kinship


def test_clusters_are_bounded_and_keep_neighbours(spark):
    rng = random.Random(3)
    centres = [[rng.random() * 20 for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 1) for x in centres[i % 12]]) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, f array<double>")
    got = {r.id: r.cluster_id for r in kinship.clusters(df, "id", "f", least=10, most=150).collect()}
    sizes = [len(list(g)) for _, g in itertools.groupby(sorted(got.values()))]
    assert len(got) == 1200 and max(sizes) <= 190
    kept = total = 0
    for i, f in rows[::10]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(f, g)), j) for j, g in rows if j != i)[:5]
        kept += sum(got[j] == got[i] for _, j in near)
        total += 5
    assert kept >= 0.9 * total


def test_a_cluster_of_equal_rows_is_cut_by_id(spark):
    df = spark.range(500).select(F.col("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("f"))
    got = [r.cluster_id for r in kinship.clusters(df, "id", "f", least=10, most=100).collect()]
    assert max(got.count(c) for c in set(got)) <= 160


# graphs


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_incremental_components_equal_those_of_all_edges(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    got = graph.connected_components(edges(spark, pairs[:15]))
    for part in (pairs[15:30], pairs[30:], [(5, 5), (200, 201)]):
        got = graph.incremental_components(got, edges(spark, part))
    want = graph.connected_components(edges(spark, [*pairs, (5, 5), (200, 201)]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_components_are_joined_without_a_broadcast(spark, monkeypatch):
    real, plans = graph.materialize, []
    see = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(graph, "materialize", lambda df, name: see(df) or real(df, name))
    known = graph.connected_components(edges(spark, [(n, n + 1) for n in range(20)]))
    see(graph.incremental_components(known, edges(spark, [(n, n + 5) for n in range(19, 40)])))
    see(graph.components_of(spark.range(50).withColumnRenamed("id", "vertex"), edges(spark, [(1, 2), (2, 9)])))
    assert sum("SortMergeJoin" in p for p in plans) > 4 and not any("Broadcast" in p for p in plans)


def test_blocks_of_a_chain_of_cycles(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (10, 11)]
    got = {(r.src, r.dst): (r.block_src, r.block_dst) for r in graph.biconnected(edges(spark, pairs)).collect()}
    assert got == {(1, 2): (1, 2), (2, 3): (1, 2), (1, 3): (1, 2), (3, 4): (3, 4), (4, 5): (4, 5), (5, 6): (4, 5), (4, 6): (4, 5), (10, 11): (10, 11)}


def test_spanning_forest_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 80), rng.randint(0, 80), rng.randint(1, 30)) for _ in range(300)]
    least = {}
    for a, b, w in rows:
        if a != b:
            e = (min(a, b), max(a, b))
            least[e] = min(w, least.get(e, w))
    label, total = {v: v for e in least for v in e}, 0
    for (a, b), w in sorted(least.items(), key=lambda x: (x[1], x[0])):
        if label[a] != label[b]:
            total += w
            old, new = label[a], label[b]
            label = {v: new if c == old else c for v, c in label.items()}
    got = graph.minimum_spanning_forest(spark.createDataFrame(rows, "src long, dst long, weight long")).collect()
    assert sum(r.weight for r in got) == total and len(got) == len(label) - len(set(label.values()))


def test_least_cost_flow(spark):
    rows = [(0, 1, 4, 2), (0, 2, 2, 2), (1, 2, 2, 1), (1, 3, 3, 3), (2, 3, 5, 1)]
    got = {(r.src, r.dst): r.flow for r in graph.min_cost_flow(spark.createDataFrame(rows, "src long, dst long, capacity long, weight long"), 0, 3).collect()}
    cost = sum(got[a, b] * w for a, b, _, w in rows)
    best = min(
        sum(f * w for f, (_, _, _, w) in zip(flow, rows))
        for flow in itertools.product(*[range(c + 1) for _, _, c, _ in rows])
        if flow[0] + flow[1] == 6 and flow[0] == flow[2] + flow[3] and flow[1] + flow[2] == flow[4]
    )
    assert got[0, 1] + got[0, 2] == 6 and cost == best


def test_cycles_by_enumeration(spark):
    rng = random.Random(6)
    pairs = {(rng.randint(0, 7), rng.randint(0, 7)) for _ in range(22)}
    want = set()
    for n in range(1, 5):
        for p in itertools.permutations(range(8), n):
            if p[0] == min(p) and all((a, b) in pairs for a, b in zip(p, (*p[1:], p[0]))):
                want.add(p)
    assert {tuple(r.cycle) for r in graph.simple_cycles(edges(spark, sorted(pairs)), 4).collect()} == want


# sequences and intervals

ints = st.lists(st.integers(0, 4), max_size=6)


@settings(max_examples=12, deadline=None)
@given(a=ints)
def test_next_permutation(spark, a):
    got = value(spark, seq.next_permutation(F.array(*map(F.lit, a)) if a else F.array().cast("array<int>")))
    later = sorted(set(p for p in itertools.permutations(a) if list(p) > a))
    assert got == (list(later[0]) if later else sorted(a))


def test_gathered_and_chained(spark):
    a = F.array(*map(F.lit, [1, 8, 2, 9, 3, 7]))
    assert value(spark, seq.gathered(a, 3, lambda x: x > 6)) == [1, 2, 8, 9, 7, 3]
    assert value(spark, seq.chained(a, 1, 6, 2, lambda x: x * 10)) == [80, 90, 70]


def test_clumps_do_not_cross_islands(spark):
    rows = [(0, 0, 5.0), (0, 4, 1.0), (0, 8, 2.0), (0, 30, 0.5), (0, 33, 0.7), (0, 60, 9.0)]
    got = {r.p: r.lead for r in intervals.clump(spark.createDataFrame(rows, "k int, p long, s double"), ["k"], "p", "s", 5).collect()}
    assert got == {0: 4, 4: 4, 8: 4, 30: 30, 33: 30, 60: 60}


# values


def test_sums_without_rounding(spark):
    df = spark.createDataFrame([(1e20, 0.5), (0.25, 2.0), (-1e20, 0.5)], "x double, w double")
    assert df.agg(stats.scaled_sum("x").alias("s")).first().s == 0.25
    small = spark.createDataFrame([(1e-6, 1.0)] * 1000, "x double, w double")
    assert small.agg(stats.exact_weighted_sum("x", "w").alias("s")).first().s == 0.001


def test_strings(spark):
    s = F.lit("a.b.c")
    assert [value(spark, strings.replace_nth(s, ".", "-", n)) for n in (0, 1, 2, -1, -2, -3)] == ["a-b.c", "a.b-c", "a.b.c", "a.b-c", "a-b.c", "a.b.c"]
    assert value(spark, strings.ireplace_all(F.lit("aXbx"), "x", "$1\\")) == "a$1\\b$1\\" and value(spark, strings.is_class(F.lit("0aF"), "xdigit"))


def test_times(spark):
    assert value(spark, dates.parse_duration(F.lit("01:02:03.5"))) == 3_723_500_000 and value(spark, dates.parse_duration(F.lit("-0:0:1"))) == -1_000_000
    assert value(spark, dates.parse_duration(F.lit("x"))) is None and value(spark, dates.parse_iso(F.lit("20020131T235959"))).isoformat() == "2002-01-31T23:59:59"
    assert value(spark, dates.is_special(dates.parse_special(F.lit("Not-a-date-time"))))


# files


def test_bgen_of_unphased_and_missing(spark, tmp_path):
    binary.register(spark)
    rows = [(i, f"rs{i}", "1", 10 + i, ["A", "G"], False, [[1.0, 0.0, 0.0], None if i % 2 else [0.0, 1.0, 0.0], [0.2, 0.2, 0.6]]) for i in range(7)]
    schema = "snp_idx long, snp_id string, chrom string, bp long, alleles array<string>, phased boolean, probs array<array<double>>"
    for codec in ("", "zlib", "zstd"):
        path = f"file://{tmp_path}/{codec}.bgen"
        df = spark.createDataFrame(rows, schema).repartitionByRange(3, "snp_idx").sortWithinPartitions("snp_idx")
        df.write.format("genloom.bgen").mode("append").option("path", path).option("codec", codec).option("bits", 16).save()
        got = spark.read.format("genloom.bgen").option("path", path).option("chunk", 3).load().orderBy("snp_idx").collect()
        assert [r.snp_id for r in got] == [f"rs{i}" for i in range(7)] and got[1].probs[1] is None
        assert all(abs(a - b) < 1e-4 for r, w in zip(got, rows) for p, q in zip(r.probs, w[6]) if q for a, b in zip(p, q))
        assert not os.path.exists(f"{tmp_path}/{codec}.bgen.parts")


def test_store(tmp_path):
    (tmp_path / "d").mkdir()
    for n, t in (("part-1", "c\nd"), ("part-0", "a\nb\n"), ("_SUCCESS", "x")):
        (tmp_path / "d" / n).write_text(t)
    for path in (f"{tmp_path}/d", f"file://{tmp_path}/d", f"file:{tmp_path}/d"):
        assert list(store.lines(path)) == ["a", "b", "c", "d"]


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sql.replaced_at_once(spark.range(3), path)
    with pytest.raises(Exception):
        sql.replaced_at_once(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    sql.replaced_at_once(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and len([n for n in os.listdir(tmp_path) if ".old" in n]) == 0


def test_views_are_gone_after_a_query(spark):
    assert sql.run(spark, "SELECT id FROM numbers WHERE id > :least", {"numbers": spark.range(5)}, least=2).count() == 2
    assert not spark.catalog.tableExists("numbers")


def test_references_stay_within_clusters(spark):
    rng = random.Random(8)
    rows = [(f"c{i % 3}", i, [rng.randint(0, 1) for _ in range(70)]) for i in range(60)]
    df = spark.createDataFrame(rows, "cluster_id string, hap_id long, a array<int>").withColumn("words", haplo.pack("a"))
    got = {r.hap_id: r.refs for r in kinship.references(df, "hap_id", "words", 4).collect()}
    for c, i, a in rows:
        near = sorted((sum(x != y for x, y in zip(a, b)), j) for d, j, b in rows if d == c and j != i)[:4]
        assert got[i] == [j for _, j in near]


@pytest.mark.parametrize("starts", [[0], [0, 1, 2, 3], [0, 2], [0, 1, 3]])
def test_swapping_groups_keeps_the_joint_law(starts):
    """Every cell of the joint law of states and control states, for every set of groups swapped."""
    import numpy as np

    from genloom.operators import knockoffs

    rng = np.random.default_rng(9)
    n, p, k = 400_000, 4, 2
    r = np.array([1, 0.5, 0.2, 0.7])
    z = np.empty((n, p), int)
    z[:, 0] = rng.integers(0, k, n)
    for j in range(1, p):
        z[:, j] = np.where(rng.random(n) < r[j], rng.integers(0, k, n), z[:, j - 1])
    zk = knockoffs.control_states(z, r, k, starts, rng.random((n, p)))
    code = lambda a, b: (np.hstack((a, b)) * k ** np.arange(2 * p)).sum(axis=1)
    plain = np.bincount(code(z, zk), minlength=k ** (2 * p))
    for chosen in itertools.product((False, True), repeat=len(starts)):
        on = np.zeros(p, bool)
        for s, e, c in zip(starts, [*starts[1:], p], chosen):
            on[s:e] = c
        other = np.bincount(code(np.where(on, zk, z), np.where(on, z, zk)), minlength=k ** (2 * p))
        assert (np.abs(plain - other) <= 5 * np.sqrt(plain + other + 1)).all()


def test_large_components_are_refused(spark):
    path = edges(spark, [(i, i + 1) for i in range(9)])
    with pytest.raises(ValueError, match="10 rows"):
        graph.co_membership(graph.connected_components(path), most=9)
    with pytest.raises(ValueError, match="9 rows"):
        graph.per_component(path, lambda rows: rows, "src long, dst long, component long", most=8)
    with pytest.raises(ValueError, match="max_rounds"):
        graph.transitive_closure(path, max_rounds=2)
    with pytest.raises(ValueError, match="max_rounds"):
        graph.minimum_spanning_forest(path.withColumn("weight", F.lit(1)), max_rounds=1)
    assert graph.transitive_closure(path).count() == 45 and graph.minimum_spanning_forest(path.withColumn("weight", F.lit(1))).count() == 9


def test_families_take_their_first_value(spark):
    from genloom.operators import filters

    rows = [(1, 1, 5.0), (1, 0, None), (2, 3, 7.0), (2, 9, 8.0), (None, 1, 1.0), (None, 2, 2.0)]
    got = filters.mask_by_family(spark.createDataFrame(rows, "f int, o int, z double"), "f", "o", "z").collect()
    assert sorted(((r.f or 0, r.o, r.z) for r in got), key=lambda r: r[:2]) == [(0, 1, 1.0), (0, 2, 1.0), (1, 0, None), (1, 1, None), (2, 3, 7.0), (2, 9, 7.0)]


def test_many_small_clumps_take_no_call_each(spark):
    """28,000 islands of two rows: a pandas call for each took minutes."""
    from time import monotonic

    df = spark.range(56_000).select((F.col("id") % 7).alias("k"), (F.floor(F.col("id") / 14) * 100 + F.floor(F.col("id") / 7) % 2).alias("p"), (-F.col("id")).cast("double").alias("s"))
    began = monotonic()
    out = intervals.clump(df, ["k"], "p", "s", 5)
    assert out.filter("lead = p + 1 - p % 100").count() == out.count() == 56_000
    assert monotonic() - began < 60


# rounding as SQL rounds


@pytest.fixture(scope="module")
def awkward_vectors(tmp_path_factory):
    """Vectors whose thousandths are a half in single precision and less in double, and whose sums are just below zero."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    x = ((np.arange(-1000, 1000) + 0.5) / 1000).astype(np.float32)
    part = x * np.float32(1000)
    half = x[(np.abs(part - np.trunc(part)) == 0.5) & (np.abs(x.astype(float) * 1000) < np.abs(part))][::8][:64]
    back = x[:32][::-1] * np.float32(-1) - np.float32(1e-7)
    d = tmp_path_factory.mktemp("awkward")
    rows = [half, np.concatenate([x[:32], back])]
    assert len(half) == 64
    pq.write_table(pa.table({"vec_id": pa.array([0, 1]), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0, 0], pa.int32())}), f"{d}/embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["whole_arrays", "adjacent_gathered_swapped", "vector_sums"])
def test_halves_and_negative_zeros_as_in_sql(spark, awkward_vectors, name):
    import duckdb

    from genloom.plans.catalogue import ORACLES, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{awkward_vectors}/embeddings.parquet'")
    want = con.sql(ORACLES[name])
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in QUERIES[name](spark, awkward_vectors).select(*want.columns).collect())


def test_rounded(spark):
    x = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.3, float("inf"), 1e300]
    got = [value(spark, nearest_whole(v)) for v in x]
    assert list(map(repr, got)) == ["1.0", "-1.0", "2.0", "3.0", "-3.0", "0.0", "-0.0", "inf", "1e+300"]


def nearest_whole(v):
    from genloom.functions import values

    return values.rounded(F.lit(v), 0)


def test_nearest_by_blocks(spark, monkeypatch):
    """Several blocks of queries and candidates, words of two lengths, an id twice, a null key: as all pairs ranked."""
    monkeypatch.setattr(haplo, "QUERIES", 7)
    monkeypatch.setattr(haplo, "CANDIDATES", 11)
    rng = random.Random(5)
    rows = [(i % 2, i, [rng.getrandbits(63) for _ in range(1 + i % 2)]) for i in range(60)]
    rows += [(0, 4, [rng.getrandbits(63)]), (None, 77, [1]), (5, 80, [-1])]
    df = spark.createDataFrame(rows, "k int, id long, w array<long>")
    got = sorted((r.k, r.id, r["rank"], r.ref, r.distance) for r in haplo.nearest(df, ["k"], "id", "w", 3).collect())
    bits = lambda x, y: sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in itertools.zip_longest(x, y, fillvalue=0))
    near = {}
    for k, i, x in rows:
        for m, j, y in rows:
            if k is not None and k == m and i != j:
                near.setdefault((k, i), []).append((bits(x, y), j))
    assert got == sorted((k, i, n + 1, j, d) for (k, i), all_ in near.items() for n, (d, j) in enumerate(sorted(all_)[:3]))


def test_nearest_makes_no_row_a_pair(spark):
    """6,000 rows of one key were 36,000,000 rows of pairs, which a window then sorted."""
    df = spark.range(6000).select(F.lit(0).alias("k"), "id", F.array(F.xxhash64("id")).alias("w"))
    plan = haplo.nearest(df, ["k"], "id", "w", 3)
    assert "applyInArrow" in str(plan._jdf.queryExecution().analyzed()) or "FlatMapGroupsInArrow" in str(plan._jdf.queryExecution().analyzed())
    assert plan.count() == 18_000


# shares of a task


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """lineitem and events of sf0.01 eight times, by shifted keys."""
    import duckdb

    out, con = tmp_path_factory.mktemp("copies"), duckdb.connect()
    for name, keys in (("lineitem", {"l_orderkey": 15_000, "l_suppkey": 100}), ("events", {"event_id": 10_000, "user_id": 150})):
        shifted = ", ".join(f"{k} + i * {by} AS {k}" for k, by in keys.items())
        con.sql(f"COPY (SELECT t.* REPLACE ({shifted}) FROM '/root/testdata/sf0.01/{name}.parquet' t, range(8) r(i)) TO '{out}/{name}.parquet'")
    return str(out)


@pytest.mark.parametrize("name", ["interval_set_algebra", "tidy_segments", "interval_map_sum", "gap_islands"])
def test_spans_are_dealt_by_the_size_of_their_files(spark, copies, monkeypatch, name):
    import duckdb

    from compare import plain, rows_of
    from genloom.plans.catalogue import ORACLES, QUERIES

    files = sum(os.path.getsize(f"{copies}/{t}.parquet") for t in ("lineitem" if name == "tidy_segments" else "events",))
    monkeypatch.setattr(runtime, "PIECE", files // 25, raising=False)
    got = QUERIES[name](spark, copies)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 16
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{copies}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    cols = sorted(want.columns)
    rows = want.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert rows_of(got) == (cols, sorted((tuple(plain(x) for x in z) for z in rows), key=repr))


def test_pieces_follow_what_is_read(spark, copies, monkeypatch):
    events = spark.read.parquet(f"{copies}/events.parquet")
    size = os.path.getsize(f"{copies}/events.parquet")
    monkeypatch.setattr(runtime, "PIECE", size // 40)
    assert 40 <= runtime.pieces(events) <= 41 and 80 <= runtime.pieces(events.filter("value > 1"), events.select("user_id")) <= 82
    assert runtime.pieces(spark.range(3)) == 0  # small
    assert runtime.pieces(spark.sparkContext.parallelize([(1,)]).toDF(["a"])) == 0  # of unknown size
    monkeypatch.setattr(runtime, "PIECE", size)
    assert runtime.pieces(events) == 0
