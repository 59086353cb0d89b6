"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from vicinity.plans import catalogue

HOME = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("customer", "orders", "lineitem", "events", "documents", "embeddings", "labels")


@pytest.fixture(scope="module")
def sql():
    if not os.path.exists(HOME):
        pytest.skip("no tables")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{HOME}/{name}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 9) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    found = catalogue.queries()[name](spark, HOME)
    wanted = sql.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, HOME).count() > 0


def test_streamed_decisions_equal_batch(spark):
    stream, batch = (sorted(map(tuple, catalogue.queries()[n](spark, HOME).select("id", "fraud_score", "approved").collect())) for n in ("stream_score", "generated_labels"))
    assert stream == batch


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "fraud_score", "approved"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
