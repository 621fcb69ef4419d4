"""Every registered query with SQL gives the rows of that SQL; the traffic ones also on a second size."""

import duckdb
import pytest

from tideguard.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def compare(spark, sf_dir, name, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir)
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    assert a == b, name


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_traffic_query_equals_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", name, queries.QUERIES[name], queries.ORACLES[name])


def test_queries_without_sql_give_rows(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLES)):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_approximate_counts_are_near(spark):
    exact = {(r.win, r.dst): r.peers for r in queries.o15_distinct_peers(spark, "/root/testdata/sf0.01").collect()}
    near = {(r.win, r.dst): r.peers for r in queries.o15_distinct_peers_approx(spark, "/root/testdata/sf0.01").collect()}
    assert exact.keys() == near.keys() and all(abs(near[k] - v) <= max(2, 0.1 * v) for k, v in exact.items())
