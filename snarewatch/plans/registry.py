"""All queries of the risk engine by name, with the SQL that states each of them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from snarewatch.sources.fixtures import Tables, text_of

MODULES = ("links", "files", "usage", "pages", "verdicts", "streams")


def _plans() -> list:
    return [importlib.import_module(f"snarewatch.plans.{name}") for name in MODULES]


def _over(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Tables(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict:
    return {name: _over(f) for plan in _plans() for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text_of(sql) for plan in _plans() for name, sql in plan.SQL.items()}
