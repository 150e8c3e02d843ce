"""Models as rows: a versioned registry, comparison of two models, accuracy over time, feedback."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.operators.drift import accuracy, challenger

_SCHEMA = "name string, version bigint, created timestamp, tags map<string,string>, parameters string"


class Registry:
    """Versions of models with parameters and tags in a Parquet folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(_SCHEMA).parquet(self.path)
        except Exception as missing:  # nothing saved yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], _SCHEMA)

    def save(self, name: str, parameters: dict, tags: dict[str, str] | None = None) -> int:
        last = self._rows().where(F.col("name") == name).agg(F.max("version")).first()[0]
        version = (last or 0) + 1
        row = self.spark.createDataFrame([(name, version, json.dumps(parameters, default=str), tags or {})], "name string, version bigint, parameters string, tags map<string,string>")
        row.select("name", "version", F.current_timestamp().alias("created"), "tags", "parameters").write.mode("append").parquet(self.path)
        return version

    def load(self, name: str, version: int | None = None, tags: dict[str, str] | None = None) -> dict:
        rows = self._rows().where(F.col("name") == name)
        if version is not None:
            rows = rows.where(F.col("version") == version)
        for k, v in (tags or {}).items():
            rows = rows.where(F.col("tags")[k] == v)
        found = rows.orderBy(F.desc("version")).first()
        if found is None:
            raise KeyError(f"no model {name!r}")
        return json.loads(found.parameters)

    def versions(self, name: str) -> DataFrame:
        return self._rows().where(F.col("name") == name)


def compare(requests: DataFrame, request: str, actual: str, champion: str, contender: str, percent: int = 10) -> DataFrame:
    """(arm, n, rmse, mae): each request is judged by the model that its hash sends it to."""
    arm = F.when(challenger(F.col(request), percent), "challenger").otherwise("champion")
    routed = requests.withColumn("arm", arm).withColumn("__f", F.when(F.col("arm") == "challenger", F.col(contender)).otherwise(F.col(champion)))
    made = accuracy(F.col(actual), F.col("__f"))
    return routed.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), made["rmse"].alias("rmse"), made["mae"].alias("mae"))


def tracked_accuracy(rows: DataFrame, keys: list[str], order: list[str], actual: str, forecast: str, window: int, growth: float = 1.5) -> DataFrame:
    """Add mae (over the last ``window`` rows) and stale: it is over ``growth`` times that of the first full window."""
    over = Window.partitionBy(*keys).orderBy(*order)
    n = F.row_number().over(over)
    error = F.abs(F.col(actual) - F.col(forecast))
    rows = rows.withColumn("mae", F.when(n >= window, F.avg(error).over(over.rowsBetween(-(window - 1), 0))))
    first = F.first("mae", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("stale", F.coalesce(F.col("mae") > growth * first, F.lit(False)))


def feedback_precision(verdicts: DataFrame, keys: list[str], anomaly: str, confirmed: str) -> DataFrame:
    """(keys, true_positives, false_positives, precision) of flagged rows that were judged."""
    judged = verdicts.where(F.col(anomaly) & F.col(confirmed).isNotNull())
    hit = F.col(confirmed).cast("long")
    return judged.groupBy(*keys).agg(F.sum(hit).alias("true_positives"), F.sum(1 - hit).alias("false_positives"), F.avg(hit).alias("precision"))
