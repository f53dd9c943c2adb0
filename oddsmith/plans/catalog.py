"""All registered queries of the analytics engine and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oddsmith.functions.dialect import DUCK, SPARK
from oddsmith.plans import candles, core, custom, extra, fixtures, markets, news, relational, rules, sports, streams, text

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
PACKS = [relational, core, candles, sports, markets, text, extra]
#: Plans that need Python on the executors, by name; their oracles, where SQL can express them, are in their modules.
CUSTOM = [custom, fixtures, news, rules, streams]


def register(spark: SparkSession, sf_dir: str, text: str | None = None) -> None:
    """The tables of a folder that a plan's text names (all without a text) as temporary views."""
    for name in TABLES:
        if text is None or re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, text)
        return spark.sql(text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for pack in PACKS:
        found |= {name: _sql(text) for name, text in pack.plans(SPARK).items()}
    for module in CUSTOM:
        found |= module.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for pack in PACKS:
        found |= pack.plans(DUCK)
    for module in CUSTOM:
        found |= module.oracle_sql()
    return found
