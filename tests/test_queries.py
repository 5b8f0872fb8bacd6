"""Every registered query of the library against its SQL on the smallest data."""

import subprocess
import sys
from importlib import import_module
from pathlib import Path

import pytest
from compare import compare

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
MODULES = [import_module(f"legnet.checks.{name}") for name in entry._FAMILIES]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, sf, name):
    ok, message = compare(spark, duck, QUERIES[name], SQL[name], sf)
    assert ok, message


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_need_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
