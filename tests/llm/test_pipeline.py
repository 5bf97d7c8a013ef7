import duckdb
import pytest

import corpus_pipeline
from genloom.llm import bpe, mixing, quality
from test_dedup import brute


def test_stages_by_brute_force(spark, sf, tmp_path):
    """Each stage against what it should leave, worked out from its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    kept = {r.doc_id for r in quality.quality(docs).collect() if r.kept}
    one = corpus_pipeline.quality_rules(spark, docs, sf)
    rows = {r.doc_id: r for r in one.collect()}
    assert rows.keys() == kept and one.columns == cols
    two = corpus_pipeline.exact_copies(spark, one, sf)
    by_text = {}
    for i in sorted(rows):
        by_text.setdefault(rows[i].text, i)
    assert {r.doc_id for r in two.collect()} == set(by_text.values()) and two.columns == cols
    three = corpus_pipeline.near_copies(spark, two, sf)
    want = {i for i, (_, c) in brute([(i, rows[i].text) for i in by_text.values()]).items() if i == c}
    assert {r.doc_id for r in three.collect()} == want and three.columns == cols
    four = corpus_pipeline.mixed(spark, three, sf)
    some = [r.doc_id for r in four.collect()]
    assert len(some) == len(set(some)) and set(some) <= want and four.columns == cols
    three.write.mode("overwrite").parquet(f"{tmp_path}/three")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW kept AS SELECT row_number() OVER () AS r, * FROM '{tmp_path}/three/*.parquet'")
    mix = con.sql(f"WITH {mixing.mixing_sql('kept', corpus_pipeline.PERCENT, 1)} SELECT doc_id FROM taken").fetchall()
    assert sorted(some) == sorted(i for (i,) in mix)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert out.keys() == set(some) and all(r.round_trip for r in out.values())
    m = bpe.ForcedBoundaryBpe(bpe.vocabulary_path())
    assert all(out[i].ids == m.encode(rows[i].text) and out[i].n_tokens == len(out[i].ids) for i in some)


@pytest.mark.parametrize("which", ["odd", "none"])
def test_odd_rows_pass_all_stages(spark, request, which):
    docs = request.getfixturevalue(which)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == request.getfixturevalue(which).columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
