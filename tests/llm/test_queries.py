"""The registered queries against their DuckDB twins, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from quarrylight.llm import queries

from .conftest import DATA


def comparable(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = queries.QUERIES[name](spark, DATA)
    cursor = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted([tuple(comparable(v) for v in r) for r in cursor.fetchall()], key=str)
    assert sorted([tuple(comparable(r[c]) for c in names) for r in df.collect()], key=str) == want


def test_all_and_the_pipeline_are_registered():
    names = set(queries.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark, documents):
    docs = documents
    columns, before = documents.columns, documents.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        after = docs.count()
        assert 0.7 * before <= after <= before, name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()


def test_pipeline_edges(spark, edges):
    docs, kept = edges, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == edges.columns, name
        kept.append(sorted((r.doc_id for r in docs.collect()), key=str))
    # no letter: 1 to 3 go; the six words stay with 4, the first of their holders; a null id comes first
    assert kept[0] == [4, 4, 4, 5, 6, 7, None] and set(kept[1]) == {4, 6, 7, None}
    assert set(kept[3]) <= set(kept[2]) <= set(kept[1])
    assert corpus_pipeline.packing(spark, docs, DATA).count() >= docs.count() > 0


def test_empty_tables_pass_all_stages(spark, edges):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edges.limit(0), DATA)
        assert out.columns == edges.columns and out.count() == 0, name
    assert corpus_pipeline.packing(spark, edges.limit(0), DATA).count() == 0
