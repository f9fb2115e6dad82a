"""Every registered query of the engine against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())


def test_commit_log_query(spark):
    row = catalog.queries()["commitlog_cas"](spark, SF).first()
    assert (row["version"], row["second_writer"], row["records"], row["head"]) == (1, "Stale", 1000, 1000)


def test_range_reaches_the_scan(spark):
    from tidemark.bindings import event_records

    plan = event_records(spark, SF).between(100, 200)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(event_id,100)" in plan or "GreaterThan(event_id,99)" in plan


def test_queries_see_the_whole_stream(spark, tmp_path):
    """A gap and a doubled record beyond event 1000."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "sf")
    k = spark.range(5000).filter("id <> 3000").withColumnRenamed("id", "event_id")
    rows = k.select("event_id", (F.col("event_id") % 7).alias("user_id"), F.lit("view").alias("event_type"), F.lit("{}").alias("props"))
    rows.unionByName(rows.filter("event_id = 4000")).write.parquet(f"{path}/events.parquet")
    row = catalog.queries()["record_page_density"](spark, path).first()
    assert (row["expected"], row["found"], row["distinct_positions"], row["gaps"]) == (5000, 5000, 4999, 1)
    assert catalog.queries()["replica_conflict_ids"](spark, path).agg(F.max("position")).first()[0] > 3300


def test_short_artifacts_are_staged_whole(spark, tmp_path):
    """Texts of 0 to 6 bytes at every remainder of the ids that counts."""
    path, name = str(tmp_path / "sf"), "artifact_transfer_batch"
    k = spark.range(1002).withColumnRenamed("id", "doc_id")
    k.selectExpr("doc_id", "substring('abcdef', 1, cast(doc_id div 7 % 7 as int)) AS text").write.parquet(f"{path}/documents.parquet")
    got = catalog.queries()[name](spark, path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())
