"""Registered queries against DuckDB, and the pipeline against its parts."""

import math
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tempora.llm import queries as Q
from tempora.llm.common import materialize

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = Q.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted((tuple(r) for r in found.select(*columns).collect()), key=repr)
    result = con.execute(Q.ORACLE_SQL[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9)) for x, y in zip(a, b, strict=True)), (a, b)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, docs, SF))
        assert kept.dtypes == docs.dtypes, name
        sizes.append(kept.count())
        docs = kept
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[4] < sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
