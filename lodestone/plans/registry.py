"""The named queries: each a function of (spark, folder) and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.tables import read_table

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    def add(fn: Plan) -> Plan:
        PLANS[name] = fn
        if sql is not None:
            ORACLES[name] = dedent(sql).strip()
        return fn

    return add


class Tables:
    """The test tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self._spark, self._folder, name)


TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
