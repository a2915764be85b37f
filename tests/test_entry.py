"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, _rows


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def test_contract(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        rel = db.execute(sql)
        assert got == _rows([d[0] for d in rel.description], rel.fetchall())


def test_a_queue_takes_a_fraction_of_its_text(spark, sf_dir):
    path = entry._queued(spark, sf_dir, times_sent=3)
    sent = spark.read.text(path).groupBy("value").count().collect()
    assert len(sent) == spark.read.parquet(f"{sf_dir}/events.parquet").count() and {r["count"] for r in sent} == {3}
    files = spark.read.format("binaryFile").load(path).selectExpr("count(*) AS n", "sum(length) AS bytes").first()
    assert files.n == 12 and files.bytes < sum(3 * len(r.value.encode()) for r in sent) / 3
