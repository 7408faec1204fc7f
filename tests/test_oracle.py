"""A sample of the queries against DuckDB on the smallest tables, and the shape of the catalogue."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["bfs_depth3_out", "fan_in_out", "coupling_package", "latency_rollup", "bm25_scores", "knn_top5", "session_counts", "pagerank_5", "suppress_text", "dsl_traverse", "shingle_docfreq", "stream_tumbling"]


def rounded(rows):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, SF)
    found = con.sql(entry.oracle_sql()[name])
    order = [found.columns.index(c) for c in df.columns]
    assert rounded(tuple(r) for r in df.collect()) == rounded(tuple(r[i] for i in order) for r in found.fetchall())


@pytest.mark.parametrize("name", ["orphan_tables", "risk_levels", "override_dispatch", "architecture_rollup", "file_editing_context", "dataflow_paths_len3", "knn_parents"])
def test_same_rows_after_sums_and_spreads(spark, con, name):
    test_same_rows(spark, con, name)


def test_partitions_follow_the_rows(spark):
    from graphloom.plans.durable import spread

    assert spread(spark.range(1000), "id", each=50).rdd.getNumPartitions() == 20
    assert spread(spark.range(1000), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_each_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
