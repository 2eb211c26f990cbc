"""Every registered query with a SQL counterpart gives the same rows in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from modlens.plans import catalog
from modlens.streaming import scoring

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(table):
    names = sorted(table.column_names)
    rows = []
    for r in table.select(names).to_pylist():
        rows.append(tuple("~" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v) for v in r.values()))
    return names, sorted(rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, duck, name):
    assert canonical(QUERIES[name](spark, sf_dir).toArrow()) == canonical(duck.sql(ORACLE[name]).to_arrow_table())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_stream_equals_batch(spark, sf_dir):
    from modlens.operators import models

    streamed = {r["doc_id"]: round(r["p"], 9) for r in catalog.stream_scoring(spark, sf_dir).collect()}
    model = models.logistic(catalog.feature_rows(spark, sf_dir), max_iter=50)
    batch = scoring.score_documents(catalog.documents(spark, sf_dir), model)
    assert streamed == {r["doc_id"]: round(r["p"], 9) for r in batch.collect()}
