"""Read-only functions over one set of measurements, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempora.operators import anomaly, measurements, series
from tempora.plans.sql import SqlSession
from tempora.promql import Engine


class Database:
    """Measurements under names, for every front end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.session, self.engine, self.meta = spark, SqlSession(spark), Engine(spark), {}

    def add(self, name: str, frame: DataFrame, time: str, tags: list[str], fields: list[str]) -> None:
        self.session.register(name, frame)
        self.engine.add(name, frame, time, tags, fields)
        self.meta[name] = (frame, time, tags, fields)

    def list_metrics(self) -> list[str]:
        return self.engine.names()

    def label_values(self, label: str) -> DataFrame:
        return self.engine.label_values(label)

    def query_promql(self, text: str, start: int, end: int | None = None, step: int | None = None) -> DataFrame:
        return self.engine.instant(text, start) if end is None else self.engine.range(text, start, end, step)

    def query_sql(self, text: str) -> DataFrame:
        return self.session.sql(text)

    def explain(self, text: str) -> str:
        return self.session.sql(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def cardinality(self, name: str) -> DataFrame:
        frame, _, tags, _ = self.meta[name]
        return measurements.cardinality(frame, tags)

    def forecast(self, name: str, field: str, horizon: int, model: str = "auto", **options) -> DataFrame:
        frame, time, tags, _ = self.meta[name]
        return series.forecast(frame, tags, time, field, horizon, model, **options)

    def detect_anomalies(self, name: str, field: str, method: str = "zscore", **options) -> DataFrame:
        frame, time, tags, _ = self.meta[name]
        return anomaly.detect(frame, method, tags, field, [time], **options)
