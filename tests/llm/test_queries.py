"""Registered queries and the pipeline on the given tables."""

import re

import pytest

import corpus_pipeline
from panelcast.llm.queries import ORACLE, QUERIES
from tests.compare import TYPES, cell


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, sf_dir, name):
    df, rel = QUERIES[name](spark, sf_dir), con.sql(ORACLE[name])
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    order = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in order) for r in df.collect())
    assert got == sorted(tuple(cell(r[rel.columns.index(c)]) for c in order) for r in rel.fetchall())


def test_every_operator_has_a_query():
    assert {re.match(r"op(\d+)_", q)[1] for q in QUERIES} == {str(n) for n in range(1, 14)}


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        if name in ("toxicity", "near_duplicates"):
            assert 0.7 * before < docs.count() <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {
        r["doc_id"] for r in docs.select("doc_id").distinct().collect()}


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name


