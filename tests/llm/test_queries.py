"""Registered queries over whole small tables, against their SQL, and the pipeline's stages."""

import duckdb
import pytest

from mirrorloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == sorted(repr(tuple(r)) for r in want.select(*order).fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_pipeline_on_odd_and_empty_tables(spark, odd, none):
    import corpus_pipeline

    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), odd.schema)
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
