"""Where queries register themselves with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from evalkiln.session import spread
from evalkiln.sources.testdata import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @wraps(f)
        def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
            # five fold rows an order are the longest table of most queries, about 1.25 of the line items
            spread(spark, 5 * table(spark, sf_dir, "lineitem").count() // 4)
            return f(spark, sf_dir)

        QUERIES[name] = sized
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
