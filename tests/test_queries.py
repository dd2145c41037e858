"""Every query with SQL against DuckDB on the smallest driver tables, the others for rows."""

import os

import pytest

import __spark_entry__ as entry
from quarry.plans.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x != x:
        return "null"
    return repr(float(x)) if isinstance(x, float) else str(x)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, name):
    made = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(made.columns) == sorted(want.columns)
    assert table(made.columns, made.collect()) == table(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10 and set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark):
    """Filters reach the scan, only needed columns are read, top-k needs no global sort."""
    plan = lambda n: QUERIES[n](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "TakeOrderedAndProject" in plan("semantic_topk") and "Exchange SinglePartition" not in plan("semantic_topk")
    assert "EqualTo(o_orderstatus,F)" in plan("bool_query") and "GreaterThanOrEqual(o_totalprice,1000.0)" in plan("bool_query")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan("content_hash")
    assert "WindowGroupLimit" in plan("keywords_topk")
