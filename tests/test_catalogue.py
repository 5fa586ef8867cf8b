"""Registered queries against DuckDB. TIDEMARK_FULL=1 runs all of them, else one in eight."""

import os

import pytest

from compare import connect, difference
from tidemark.plans import load

SF = os.environ.get("TIDEMARK_TEST_SF", "/root/testdata/sf0.001")
ALL = sorted(load())
NAMES = ALL if os.environ.get("TIDEMARK_FULL") else ALL[::8]


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_catalogue_loads_without_a_session():
    """The driver asks for queries and statements before it starts Spark."""
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 250"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_statement(spark, db, name):
    problem = difference(name, load()[name], spark, SF, db)
    assert problem is None or problem == f"{name}: no rows"
