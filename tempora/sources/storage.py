"""Cold archives and exports as partitioned Parquet."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.buckets import time_bucket


def archive(points: DataFrame, path: str, measurement: str, time: str, older_than: datetime, shard: str = "1d") -> DataFrame:
    """Write whole shards older than a time under measurement=/shard=, and return what stays."""
    start = time_bucket(shard, F.col(time))
    cold = start < time_bucket(shard, F.lit(older_than).cast("timestamp_ntz"))
    named = points.where(cold).withColumns({"measurement": F.lit(measurement), "shard": F.date_format(start, "yyyy-MM-dd-HH")})
    named.write.mode("append").partitionBy("measurement", "shard").parquet(path)
    return points.where(~cold)


def cold_tier(spark: SparkSession, path: str, measurement: str) -> DataFrame:
    """An archived measurement; a filter on ``shard`` prunes folders."""
    return spark.read.parquet(path).where(F.col("measurement") == measurement).drop("measurement")


def export(points: DataFrame, path: str, rows_per_file: int = 1_000_000, codec: str = "zstd") -> None:
    points.write.option("maxRecordsPerFile", rows_per_file).option("compression", codec).parquet(path)
