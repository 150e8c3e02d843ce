"""Distribution drift, forecast accuracy and model comparison as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def psi(reference: DataFrame, current: DataFrame, value: str, bins: int = 10, epsilon: float = 1e-4) -> DataFrame:
    """One row: the population stability index over equal-frequency bins of the reference, and its verdict.

    A value equal to an inner edge belongs to the bin below it.
    """
    edges = reference.agg(F.percentile(value, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("e"))

    def shares(rows: DataFrame, name: str) -> DataFrame:
        binned = rows.where(F.col(value).isNotNull()).join(F.broadcast(edges)).select(F.size(F.filter("e", lambda x: x < F.col(value))).alias("bin"))  # one row of edges
        counted = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
        return counted.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n")

    both = shares(reference, "p").join(shares(current, "q"), "bin", "full")
    p, q = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(epsilon)), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(epsilon))
    total = both.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))
    return total.withColumn("verdict", F.when(F.col("psi") >= 0.25, "refit").when(F.col("psi") >= 0.1, "alert").otherwise("stable"))


def kolmogorov_smirnov(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row: the two-sample statistic and its asymptotic p-value. Values are counted before they are ordered."""
    counted = a.select(F.col(value).alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(F.col(value).alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    counted = counted.where("v IS NOT NULL").groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    up = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = counted.agg(F.sum("x").alias("n"), F.sum("y").alias("m"))
    gaps = counted.select(F.sum("x").over(up).alias("cx"), F.sum("y").over(up).alias("cy")).join(F.broadcast(whole))  # one row
    d = gaps.agg(F.max(F.abs(F.col("cx") / F.col("n") - F.col("cy") / F.col("m"))).alias("d"), F.first("n").alias("n"), F.first("m").alias("m"))
    scale = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    lam = (scale + 0.12 + 0.11 / scale) * F.col("d")
    terms = sum((2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 21)), F.lit(0.0))
    return d.select("d", F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)).alias("p_value"))


def accuracy(actual: Column, forecast: Column) -> dict[str, Column]:
    """rmse, mae, mape and smape as aggregates; rows without an actual of size are left out of mape."""
    e = actual - forecast
    return {
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "mape": 100 * F.avg(F.when(F.abs(actual) > 1e-12, F.abs(e / actual))),
        "smape": 100 * F.avg(F.when(F.abs(actual) + F.abs(forecast) > 1e-12, 2 * F.abs(e) / (F.abs(actual) + F.abs(forecast)))),
    }


def challenger(request: Column, percent: int = 10) -> Column:
    """True for the share of requests that go to the challenger, by a hash of their ids."""
    return F.pmod(F.xxhash64(request), F.lit(100)) < percent
