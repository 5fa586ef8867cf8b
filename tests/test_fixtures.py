"""Every fixture table is the same on Spark and DuckDB."""

import os

import pytest

from compare import connect, difference
from tidemark.oracles import VIEWS
from tidemark.plans import Query
from tidemark.fixtures import Research
from pyspark.sql import functions as F

SF = os.environ.get("TIDEMARK_TEST_SF", "/root/testdata/sf0.001")
NAMES = [n for n in VIEWS if n not in ("trades", "sector_ranks", "linear_all", "linear_active", "composite")]


@pytest.mark.parametrize("name", NAMES)
def test_fixture(spark, name):
    schema = getattr(Research(spark, SF), name).schema
    text = {f.name for f in schema.fields if f.dataType.typeName() in ("timestamp", "timestamp_ntz")}
    doubles = {f.name: 4 if name.startswith("dense") or name == "facts" else 9 for f in schema.fields if f.dataType.typeName() == "double"}
    names = [f.name for f in schema.fields]
    sql_cols = ", ".join(f"strftime({n}, '%Y-%m-%d %H:%M:%S') AS {n}" if n in text else n for n in names)
    build = lambda r: getattr(r, name).select(*[
        F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n) if n in text else F.col(n) for n in names
    ])
    item = Query(name, build, f"SELECT {sql_cols} FROM {name}", doubles)
    assert difference(name, item, spark, SF, connect(SF)) is None
