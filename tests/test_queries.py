"""Every registered query that has SQL, held against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from docquery.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = con.execute(SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in r) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr) == want


def test_every_query_has_a_stable_schema(spark):
    for name, q in QUERIES.items():
        assert q(spark, SF).schema == q(spark, SF).schema, name


def test_entry_points_work_without_the_optional_subpackage():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


def test_a_missing_package_leaves_the_other_queries():
    """In a process of its own, where a package that only the optional subpackage needs can't be imported."""
    import subprocess
    import sys

    code = "import sys; sys.modules['public_tokenizers'] = sys.modules['xxhash'] = sys.modules['sentencepiece'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.stdout.split() == [str(len(registry.queries())), str(len(registry.oracle_sql()))], out.stderr
