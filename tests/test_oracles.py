import glob
import os

import duckdb
import pytest

from ctxlake.plans import more  # noqa: F401
from ctxlake.plans.catalog import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, db, name):
    got = QUERIES[name](spark, DIR)
    cur = db.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == want
    assert want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DIR).count()


def test_paragraphs_stay_whole(spark):
    from ctxlake.operators.search import paragraphs

    rows = [(1, "a\n\nb\n\nc"), (2, "x" * 5000), (3, "a" * 10 + "\n\n" + "b" * 15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.body for r in paragraphs(df.where("doc_id = 1")).collect()] == ["a\n\nb\n\nc"]
    assert [len(r.body) for r in paragraphs(df.where("doc_id = 2")).orderBy("idx").collect()] == [2000, 2000, 1000]
    assert [r.body for r in paragraphs(df.where("doc_id = 3"), 20).orderBy("idx").collect()] == ["a" * 10, "b" * 15]
