"""Every query with SQL gives what DuckDB gives on the smallest data folder."""

import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SQL = {k: v for k, v in entry.oracle_sql().items() if not re.match(r"p\d+_", k)}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in sorted(os.listdir(DATA)):
        con.execute(f"create view {name.removesuffix('.parquet')} as from '{DATA}/{name}'")
    return con


def plain(value):
    return None if value is None else round(value, 6) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = duck.execute(SQL[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    place = [theirs.index(c) for c in names]
    assert mine == sorted((tuple(plain(r[k]) for k in place) for r in cursor.fetchall()), key=repr)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:3] == ["path", "rule_id", "severity"]


def test_names_and_sql_belong_together():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_engine_queries_stand_without_optional_libraries():
    """Only the queries that need a library go with it; with the whole subpackage gone the rest stays."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in ("duckdb", "regex") or name.startswith(HIDDEN):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), sorted(k for k in e.queries() if k[0] == "p" and k[1].isdigit())[:1])
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for hidden in ("no.such", "sieveline.llm"):
        out = subprocess.run([sys.executable, "-c", code.replace("HIDDEN", repr(hidden))], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout
        assert int(out.split()[0]) >= len(entry.catalog.queries())
