import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import rows_of, sql_rows
from genloom.llm import exact_dedup, line_dedup, ngram_join, quality
from genloom.llm import textkernel as tk

LOW = {i: i + 32 for i in range(65, 91)}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if both and 100 * both >= 75 * len(x | y):
                i, j = sorted((root(ids[a]), root(ids[b])))
                label[j] = i
    return {i: (len(sets[i]), root(i)) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_ngram_join_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(ngram_join.op1_ngram_jaccard(spark, sf)) == brute(docs)


def near(seed, families=12, noise=30):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    docs, n = [], 0
    for f in range(families):
        base = [f"f{f}w{i}" for i in range(rng.choice([6, 12, 30, 90, 400]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            at = rng.randint(0, len(w))
            docs.append((n, " ".join(w[:at] + (passage if rng.random() < 0.5 else []) + w[at:])))
            n += 1
    for _ in range(noise):
        docs.append((n, " ".join([f"n{n}w{i}" for i in range(rng.randint(1, 14))] + passage)))
        n += 1
    return docs


@pytest.mark.parametrize("sizes", [{}, {"FAMILY": 2, "STRONG": 1}, {"FAMILY": 2, "BLOCK": 3, "STRONG": 1, "LEAF": 2}, {"SPLIT": 2, "BLOCK": 4}])
def test_every_way_of_dealing_is_exact(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(ngram_join, k, v)
    docs = near(len(str(sizes)))
    assert got(ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == brute(docs)


@settings(max_examples=20, deadline=None)
@given(data=st.data())
def test_tree_search_loses_nothing(data):
    n, m = data.draw(st.integers(1, 120)), data.draw(st.integers(1, 20))
    rng = np.random.default_rng(data.draw(st.integers(0, 999)))
    base = rng.integers(0, 5, (4, 16))
    p, q = base[rng.integers(0, 4, n)] + rng.integers(0, 2, (n, 16)), base[rng.integers(0, 4, m)] + rng.integers(0, 2, (m, 16))
    i, j, bound = ngram_join.RTree(p.astype(np.int32), p.sum(1)).search(q.astype(np.int32), q.sum(1))
    want = {(a, b): np.minimum(q[a], p[b]).sum() for a in range(m) for b in range(n) if 175 * np.minimum(q[a], p[b]).sum() >= 75 * (q[a].sum() + p[b].sum())}
    assert dict(zip(zip(i.tolist(), j.tolist()), bound.tolist())) == want


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    for n in (1, 5, 70, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 2**63, n // 3, dtype=np.uint64))))
        va, vb = ngram_join._vector(a), ngram_join._vector(b)
        k = min(va[0], vb[0])
        assert np.minimum(ngram_join._point(va, k), ngram_join._point(vb, k)).sum() >= len(np.intersect1d(a, b))


def test_first_tree_round_tells_what_it_holds_back():
    """A chain y-x-z-w over a border of size classes: x's best partner is y and z's is w, which leaves x-z to the second round."""
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    x = draw(124)
    y = np.concatenate((x[10:], draw(10)))
    z = np.concatenate((x[:111], draw(23)))
    w = np.concatenate((z[:40], z[55:], draw(15)))
    vec = [ngram_join._vector(np.sort(u)) for u in (x, y, z, w)]
    assert [v[0] for v in vec] == [7, 7, 8, 8]
    cols = [pa.array(["t"] * 4), pa.array([0] * 4), pa.array([1, 2, 3, 4]), pa.array([1, 2, 3, 4]), pa.array([124, 124, 134, 134]), pa.array(vec)]
    rows = pa.RecordBatch.from_arrays(cols, ["g", "side", "doc", "comp", "n", "vec"])
    out = {best: [tuple(r.values()) for b in ngram_join._tree_pairs(best)([rows]) for r in b.to_pylist()] for best in (True, False)}
    assert {r[:2] for r in out[False]} == {(2, 1), (3, 1), (4, 3)}
    assert {r for r in out[True]} == {(2, 1, None), (4, 3, None), (None, None, "t")}


def windows(line, places):
    return [" ".join(line[a : a + n + 4]) for a, n in places]


def test_hub_with_a_chain_over_a_size_border(spark):
    """Documents 1-2-3-4 chain over the border at 128 shingles; document 0 links with none and is the hub of what they share."""
    line = [f"w{i}" for i in range(400)]
    chain = windows(line, [(40, 120), (51, 120), (60, 134), (72, 134)])
    docs = [(0, " ".join(line[:330] + [f"x{i}" for i in range(60)])), *enumerate(chain, 1)]
    want = brute(docs)
    assert {i: c for i, (_, c) in want.items()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}
    assert got(ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string"))) == want


def test_chains_over_all_size_borders(spark, monkeypatch):
    """Many chains at once, each with a hub of its own, around every border of size classes."""
    rng, docs = random.Random(11), []
    for c in range(60):
        line = [f"c{c}w{i}" for i in range(1400)]
        size, at, places = rng.choice([60, 120, 245, 500]), 40, []
        for _ in range(rng.randint(3, 7)):
            places.append((at, size + rng.randint(0, size // 8)))
            at += rng.randint(size // 14, size // 6)
        docs += [(len(docs) + i, t) for i, t in enumerate([" ".join(line[: 2 * size + at] + [f"c{c}x{i}" for i in range(size // 2)]), *windows(line, places)])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs)
    assert got(ngram_join.ngram_components(df)) == want
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "FAMILY", 2)
    assert got(ngram_join.ngram_components(df)) == want


def test_hot_key_of_one_component_stays_in_proportion(spark, monkeypatch):
    """Near copies and two outliers under one key: rows into block pairs grow with the rows, not with their square."""
    rows = [("k", i, 0, 20_003) for i in range(20_000)] + [("k", 20_000 + i, 20_000 + i, 20_003) for i in range(3)]
    df = spark.createDataFrame([(7, d, c, s) for _, d, c, s in rows], "key long, doc long, comp long, size long")
    out = ngram_join._block_pairs(df).collect()
    assert len(out) < 20_000 + 3 * 12 + 10
    groups = {}
    for r in out:
        groups.setdefault(r.g, []).append(r)
    met = set()
    for g in groups.values():
        one, two = [r.doc for r in g if r.side != 2], [r.doc for r in g if r.side != 1]
        few = [d for d in {*one, *two} if d >= 20_000]
        met |= {(f, d) for f in few for d in (two if f in one else one) if d != f} | {(f, d) for f in few if f in two for d in one if d != f}
    assert met >= {(f, d) for f in range(20_000, 20_003) for d in range(20_003) if d != f}


def test_no_table_is_left_but_those_of_the_result(spark, sf):
    import os

    from genloom import runtime

    folder = runtime.shared_dir(spark).removeprefix("file://") + "/genloom"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    ngram_join.op1_ngram_jaccard(spark, sf).count()
    assert sorted(n.rpartition("-")[0] for n in set(os.listdir(folder)) - before) == ["components", "copies", "signatures"]


def test_ngram_join_odd_rows(odd, none):
    out = ngram_join.ngram_components(odd)
    r = got(out.filter("doc_id IS NOT NULL"))
    assert r[1] == (3, 1) and r[2] == (3, 1) and r[3] == (0, 3) and r[4] == (0, 4) and r[6] == (1, 6) and r[8] == r[7] == (4, 7)
    assert out.count() == 12 and {x.component_id for x in out.filter("doc_id IS NULL").collect()} == {None}
    assert ngram_join.ngram_components(none).isEmpty() and ngram_join.drop_near_copies(none).isEmpty()
    kept = ngram_join.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(x.doc_id for x in kept.filter("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 6, 7, 9, 10]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\té", max_size=12)), max_size=6))
def test_kernel_words(texts):
    counts = []
    for _, data, off in tk.slices(pa.array(texts, pa.string())):
        w = tk.Words(data, off, lower=True)
        counts += w.count.tolist()
        assert [bytes(data[a:b]).decode() for a, b in zip(w.start, w.end)] == [x for t in texts for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert counts == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_exact_dedup(spark, sf, odd, none):
    assert rows_of(exact_dedup.op4_exact_dedup(spark, sf)) == sql_rows(exact_dedup.ORACLES["op4_exact_dedup"], sf)
    out = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).filter("doc_id IS NOT NULL").collect()}
    assert {(1, 1, 3, True), (2, 1, 3, False), (3, 3, 3, True), (4, 3, 3, False), (7, 7, 2, True), (8, 7, 2, False), (5, 5, 1, True)} <= out
    assert exact_dedup.exact_dedup(odd).count() == odd.count() and exact_dedup.exact_dedup(none).isEmpty()
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 8  # null counts as the empty text
    plan = exact_dedup.op4_exact_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_colliding_hashes_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "md5", lambda c: F.lit("same"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()} == {(1, 1, 2), (3, 1, 2), (2, 2, 1)}


def test_quality(spark, sf, odd, none):
    assert rows_of(quality.op5_quality_rules(spark, sf)) == sql_rows(quality.ORACLES["op5_quality_rules"], sf)
    out = {r.doc_id: r for r in quality.quality(odd).collect()}
    assert out[3].n_words == 0 and not out[3].kept and out[7].n_words == 160_000 and out[7].n_repeat_words == 160_000 and out[7].base_failed
    assert quality.quality(odd).count() == odd.count() and quality.quality(none).isEmpty() and quality.drop_rejected(none).isEmpty()
    assert quality.drop_rejected(odd).columns == odd.columns and {r.doc_id for r in quality.drop_rejected(odd).collect()} == {None}


def test_quality_counts_by_hand(spark):
    text = "a b c\nx y\n a b c\na b c\n\nq # $ é"
    r = quality.quality(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (15, 15, 2, 1, 9)


def test_boilerplate_depletes(spark):
    line = "subscribe to our newsletter and accept all cookies on this site today please"
    body = lambda i: "\n".join(f"w{i} " + " ".join(f"u{i}x{j}y{k}" for j in range(10)) for k in range(6))
    rows = [(i, f"{body(i)}\n{line}", "h") for i in range(10)] + [(99, "\n".join([line] * 5 + ["own words here " + str(i) for i in range(3)]), "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality.quality(df).collect()}
    assert all(out[i].kept and out[i].n_removed_words == 13 for i in range(10)) and not out[99].kept and out[99].n_removed_words == 65


def test_boilerplate_lines_go(spark, odd, none):
    line = "Subscribe to our  newsletter"
    body = lambda i: "\n".join(" ".join(f"u{i}x{j}y{k}é" for j in range(10)) for k in range(6))
    forms = ["{}\n{b}", "{}\n\n{b}\n{}", "{b}\n{}", "{b}\n{}\n{}", "{b}\n{}\n", "{b}\n\n {} ", "\n{b}"]
    rows = [(i, forms[i % 7].replace("{b}", body(i)).replace("{}", line if i % 2 else line.lower()), "h", i) for i in range(21)]
    rows += [(30, rows[0][1], "other", 30), (31, rows[0][1], None, 31), (None, None, "h", 32), (33, "\n".join([line] * 30), "h", 33), (None, f"{line}\n{line}", "h", 34)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    low = " ".join(line.lower().split())
    want = {}
    for i, t, s, n in rows:
        if i != 33:
            keep = [x for x in t.split("\n") if s != "h" or " ".join(x.lower().split()) != low] if t is not None else None
            want[n] = (i, "\n".join(keep) if t is not None else None, s)
    out = quality.cleaned(df)
    assert out.schema == df.schema and {r.n: tuple(r)[:3] for r in out.collect()} == want
    assert quality.cleaned(none).isEmpty() and quality.cleaned(odd).columns == odd.columns


def test_line_dedup(spark, sf):
    assert rows_of(line_dedup.op9_line_dedup(spark, sf)) == sql_rows(line_dedup.ORACLES["op9_line_dedup"], sf)
    from pyspark.sql import functions as F

    rows = [(1, "http://h/a", "<p>menu</p><p>one</p>"), (2, "http://h/b", "<P>menu<br>menu</p>two"), (3, "http://h/c", "<div>menu</div>"), (4, "http://h/d", None), (5, None, "menu"), (None, None, None), (5, None, "menu")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("common", F.lit(1)).withColumn("hashes", F.lit(2))
    out = line_dedup.drop_boilerplate(df, "page_id", line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html"))).collect()
    kept = {r.page_id: r.kept_lines for r in out}
    assert len(out) == 7 and kept[1] == ["one"] and kept[2] == ["two"] and kept[3] == [] and kept[4] == [] and kept[5] == ["menu"]
    assert line_dedup.drop_boilerplate(df.limit(0), "page_id", line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html"))).isEmpty()


def test_line_dedup_at_the_ratio_and_on_long_lines(spark):
    """A line on exactly RATIO of the pages stays, one page more and it goes; a line of megabytes is a line like others."""
    from pyspark.sql import functions as F

    long = "very long line " * 150_000
    at, above = 3, 4
    rows = [(i, "h", [f"own {i}"] + ["tie"] * (i < at) + ["over"] * (i < above) + [long] * (i < above)) for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, site string, l array<string>")
    out = {r.page_id: r.kept_lines for r in line_dedup.drop_boilerplate(df, "page_id", F.col("site"), F.col("l")).collect()}
    assert all(out[i] == [f"own {i}"] + ["tie"] * (i < at) for i in range(10))
    few = spark.createDataFrame(rows[:2], df.schema)  # fewer than LEAST pages hold a line: all stay
    assert all(len(r.kept_lines) == len(r.lines) for r in line_dedup.drop_boilerplate(few, "page_id", F.col("site"), F.col("l")).collect())


def test_quality_counts_documents(spark):
    """Copies under other ids count each, rows repeated in full once, texts of a null id once each."""
    line = "this line is on many pages of the host"
    body = lambda i: "\n".join(" ".join(f"u{i}x{j}y{k}" for j in range(10)) for k in range(6))
    plain = [(100 + i, body(i), "h") for i in range(40)]
    copies = [(i, f"{body(99)}\n{line}", "h") for i in range(6)]
    ddl = "doc_id long, text string, source string"
    out = {r.doc_id: r for r in quality.quality(spark.createDataFrame(plain + copies, ddl)).collect()}
    assert all(out[i].n_removed_words == 69 and not out[i].kept for i in range(6))  # six documents of 46 hold each of its lines
    again = {r.doc_id: r for r in quality.quality(spark.createDataFrame(plain + copies[:1] * 6, ddl)).collect()}
    assert again[0].n_removed_words == 0 and again[0].kept
    nameless = [(None, f"{body(50 + i)}\n{line}", "h") for i in range(5)]
    once = quality.quality(spark.createDataFrame(plain + nameless * 2, ddl)).filter("doc_id IS NULL").collect()
    assert {r.n_removed_words for r in once} == {9} and len(once) == 10
