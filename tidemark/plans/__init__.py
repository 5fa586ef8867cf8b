"""The query catalogue: one entry per operator, each with its DuckDB statement."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import oracles
from ..fixtures import Research

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Research], DataFrame]
    sql: str | None
    digits: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        result = self.build(Research(spark, sf_dir))
        columns = [
            (F.round(F.col(f"`{f.name}`").cast("double"), self.digits.get(f.name, DIGITS)) + 0.0).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
            for f in result.schema.fields
        ]
        return result.select(*columns)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return oracles.rounded(oracles.with_views(self.sql), self.digits)


CATALOGUE: dict[str, Query] = {}
MODULES: tuple[str, ...] = (
    "quality", "joins", "windows", "ranking", "labels", "fundamentals", "monthly", "modelling", "selection",
    "evaluation", "monitoring", "portfolio", "serving", "score_run", "ingest", "storage", "streams",
)


def query(name: str, sql: str | None = None, digits: str = ""):
    """Register a query. ``digits`` names its double columns, optionally ``column:places``."""
    places = {}
    for item in digits.split():
        column, _, count = item.partition(":")
        places[column] = int(count or DIGITS)

    def register(build):
        if name in CATALOGUE:
            raise ValueError(f"duplicate query {name}")
        CATALOGUE[name] = Query(name, build, sql, places)
        return build

    return register


def load() -> dict[str, Query]:
    import importlib.util
    for module in MODULES:
        if importlib.util.find_spec(f"{__name__}.{module}"):
            importlib.import_module(f"{__name__}.{module}")
    return CATALOGUE
