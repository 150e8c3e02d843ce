"""Registry of the queries the driver runs, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its check in SQL where there is one."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


@query(
    """SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, sum(value) AS total
       FROM events GROUP BY 1, 2"""
)
def downsample_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bucket = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")
    return events.groupBy(bucket, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def _load() -> None:
    from importlib import import_module

    for suite in ("timeseries", "relational", "analytics", "promql", "dialect", "administration"):
        import_module(f"tempora.suites.{suite}")


_load()
