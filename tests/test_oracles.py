"""Every plan that has SQL is held against DuckDB on the same tables, as sorted rows."""

import math

import duckdb
import pytest

import sparkloom.plans as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_plan(spark, small, duck, name):
    found = plans.queries()[name](spark, small)
    columns = sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    if name not in plans.oracle_sql():
        assert rows
        return
    said = duck.execute(plans.oracle_sql()[name])
    names = [x[0] for x in said.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in said.fetchall())


def test_whole_documents_keep_long_texts(spark, small):
    rows = plans.queries()["document_normalisation_whole"](spark, small).where("type = 'text'")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert docs.where("length(text) > 200").count() > 0
    assert rows.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0 and rows.count() == docs.count()
