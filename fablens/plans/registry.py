"""Registry of named queries: a function (spark, sf_dir) -> DataFrame and, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")

        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # All times are UTC; a session in another zone would shift them at every cast.
            if spark.conf.get("spark.sql.session.timeZone") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, sf_dir)

        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return function

    return register
