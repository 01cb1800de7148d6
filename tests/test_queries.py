"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from foliate.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.sql(SQL[name])
    names = result.columns
    theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(names) == columns
    assert ours == theirs


WHOLE = ["cg_nodes_all", "cg_module", "cg_module_edges", "cg_bfs_both", "cg_render_mermaid"]


@pytest.fixture(scope="module")
def long_modules(tmp_path_factory):
    """Modules S3 and S4 of over 5,000 lines beside short ones; the short S13 calls procedures that only S3 has."""
    folder, con = tmp_path_factory.mktemp("long"), duckdb.connect()
    con.execute("""CREATE TABLE lineitem AS SELECT i AS l_orderkey, (i * 7) % 640 AS l_partkey, CAST(s AS BIGINT) AS l_suppkey, CAST(i % 7 AS INT) AS l_linenumber, 'A' AS l_returnflag, 'O' AS l_linestatus
      FROM (VALUES (3, 4200), (4, 4200), (13, 40), (5, 40)) v(s, n), range(n) t(i)""")
    con.execute(f"COPY lineitem TO '{folder}/lineitem.parquet'")
    return con, str(folder)


@pytest.mark.parametrize("name", WHOLE)
def test_graphs_hold_modules_of_any_length(spark, long_modules, name):
    con, folder = long_modules
    df, result = QUERIES[name](spark, folder), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(result.columns)
    ours = sorted((tuple(r) for r in df.select(*result.columns).collect()), key=repr)
    assert ours == sorted(result.fetchall(), key=repr)
    assert any("S3.P" in str(v).replace("_", ".") for row in ours for v in row)
