from __future__ import annotations

import glob
import os

import duckdb
import pytest

from strandline.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([v[i] for i in order]) for v in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got or name == "metadata_filter"
    if name in ORACLES:
        cursor = db.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert rows(df.columns, got) == rows(names, cursor.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_document_gets_a_language(spark):
    ids = [r["doc_id"] for r in QUERIES["language_id_nb_all"](spark, SF).collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
