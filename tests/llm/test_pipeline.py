"""The registered queries and the stages on the smallest tables."""

import os

import pytest

import corpus_pipeline
from bindery.llm import registry, vptrees

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
if not os.path.isdir(SF_DIR):
    pytest.skip("no test tables", allow_module_level=True)


#: Queries whose rows are not documents.
OTHERS = {"op11_whitening", "op13_filter_audit"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - OTHERS))
def test_query_covers_every_document(spark, name):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = registry.QUERIES[name](spark, SF_DIR)
    assert rows.select("doc_id").distinct().count() == docs.count()
    if name != "op1_packing":
        assert rows.count() == docs.count()


def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    for table in ("documents", "labels", "embeddings"):
        duckdb.execute(f"create or replace view {table} as select * from '{SF_DIR}/{table}.parquet'")
    for name, sql in registry.ORACLES.items():
        rows = registry.QUERIES[name](spark, SF_DIR)
        expected = duckdb.sql(sql)
        assert sorted(rows.columns) == sorted(expected.columns)
        assert sorted(rows.select(*expected.columns).collect()) == sorted(expected.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "12 !", None, None, 4)], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns
        assert 0 < docs.count() <= before, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.select("doc_id").distinct().count() == docs.count()


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id is null")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0


def test_near_dedup_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    prints = {r.doc_id: vptrees.fingerprint(r.text) for r in docs.collect()}
    group = {d: {d} for d in prints}
    for a, x in prints.items():
        for b, y in prints.items():
            if (x ^ y).bit_count() <= 3 and group[a] is not group[b]:
                group[a] |= group[b]
                for d in group[b]:
                    group[d] = group[a]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    kept = [r.doc_id for r in stage(spark, docs, SF_DIR).collect()]
    assert sorted(kept) == sorted({min(g) for g in group.values()})
    assert len(kept) < len(prints)
