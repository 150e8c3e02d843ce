"""Native histograms as structs: merging, moments, quantiles and fractions.

A histogram is struct(schema int, zero_threshold, zero_count, count, sum double, buckets array of
(index int, count double)) of positive values; bucket i of schema s spans (b^(i-1), b^i] with b = 2^(2^-s).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "struct<schema:int,zero_threshold:double,zero_count:double,count:double,sum:double,buckets:array<struct<index:int,count:double>>>"


def observe(rows: DataFrame, keys: list[str], value: str, schema: int = 3, zero_threshold: float = 1e-9) -> DataFrame:
    """(keys, histogram) of values at or above zero."""
    v = F.col(value)
    index = F.when(v > zero_threshold, F.ceil(F.log2(v) * 2**schema).cast("int"))
    counted = rows.where(v >= 0).groupBy(*keys, index.alias("__i")).agg(F.count(F.lit(1)).cast("double").alias("__n"), F.sum(v).alias("__s"))
    return _collected(counted, keys, F.lit(schema), F.lit(zero_threshold))


def _collected(counted: DataFrame, keys: list[str], schema: Column, zero: Column) -> DataFrame:
    made = counted.groupBy(*keys).agg(
        F.max(schema).cast("int").alias("schema"),
        F.max(zero).cast("double").alias("zero_threshold"),
        F.coalesce(F.sum(F.when(F.col("__i").isNull(), F.col("__n"))), F.lit(0.0)).alias("zero_count"),
        F.sum("__n").alias("count"),
        F.sum("__s").alias("sum"),
        F.array_sort(F.collect_list(F.when(F.col("__i").isNotNull(), F.struct(F.col("__i").alias("index"), F.col("__n").alias("count"))))).alias("buckets"),
    )
    return made.select(*keys, F.struct("schema", "zero_threshold", "zero_count", "count", "sum", "buckets").cast(KIND).alias("histogram"))


def merge(rows: DataFrame, keys: list[str], histogram: str = "histogram") -> DataFrame:
    """Sum of the histograms of each group; groups of several schemas are refused."""
    h = F.col(histogram)
    zero = F.struct(F.lit(None).cast("int").alias("index"), h["zero_count"].alias("count"))
    parts = F.explode(F.concat(F.array(zero), h["buckets"]))
    each = rows.select(*keys, h["schema"].alias("__schema"), h["zero_threshold"].alias("__zero"), h["sum"].alias("__sum"), parts.alias("p"))
    total = each.where("p.index is null").groupBy(*keys).agg(F.sum("__sum").alias("__total"), F.count_distinct("__schema").alias("__kinds"))
    counted = each.groupBy(*keys, F.col("p.index").alias("__i")).agg(F.sum("p.count").alias("__n"), F.max("__schema").alias("__schema"), F.max("__zero").alias("__zero"), F.lit(0.0).alias("__s"))
    merged = _collected(counted, keys, F.col("__schema"), F.col("__zero"))
    merged = merged.join(total, keys) if keys else merged.join(F.broadcast(total))  # one row
    checked = F.when(F.col("__kinds") == 1, F.col("__total")).otherwise(F.raise_error(F.lit("histograms of several schemas")).cast("double"))
    return merged.select(*keys, F.col("histogram").withField("sum", checked).alias("histogram"))


def histogram_count(h: Column) -> Column:
    return h["count"]


def histogram_avg(h: Column) -> Column:
    return F.when(h["count"] > 0, h["sum"] / h["count"])


def _bound(h: Column, index: Column) -> Column:
    return F.pow(F.lit(2.0), index * F.pow(F.lit(2.0), -h["schema"].cast("double")))


def histogram_stdvar(h: Column) -> Column:
    """Variance with each bucket at the geometric mean of its bounds."""
    mean = histogram_avg(h)
    far = lambda x, n: n * (x - mean) * (x - mean)
    total = F.aggregate(h["buckets"], far(F.lit(0.0), h["zero_count"]), lambda a, b: a + far(F.sqrt(_bound(h, b["index"] - 1) * _bound(h, b["index"])), b["count"]))
    return F.when(h["count"] > 0, total / h["count"])


def histogram_fraction(low: float, high: float, h: Column) -> Column:
    """The share of observations in (low, high], spread inside buckets by logarithm."""
    if low >= high:
        return F.when(h["count"] > 0, F.lit(0.0))

    def inside(b):
        a, z = _bound(h, b["index"] - 1), _bound(h, b["index"])
        lo, hi = F.greatest(a, F.lit(max(low, 1e-300))), F.least(z, F.lit(high))
        return F.when(hi > lo, b["count"] * (F.log(hi) - F.log(lo)) / (F.log(z) - F.log(a))).otherwise(0.0)

    zero = h["zero_count"] if low < 0 <= high else F.lit(0.0)
    return F.when(h["count"] > 0, F.aggregate(h["buckets"], zero, lambda s, b: s + inside(b)) / h["count"])


def histogram_quantile(q: float, h: Column) -> Column:
    """The value below which a share q lies, between bounds by logarithm."""
    if not 0 <= q <= 1:
        return F.lit(float("-inf") if q < 0 else float("inf"))
    rank = h["count"] * q
    start = F.struct(h["zero_count"].alias("seen"), F.when(rank <= h["zero_count"], 0.0).alias("out"))

    def step(s, b):
        a, z = _bound(h, b["index"] - 1), _bound(h, b["index"])
        here = F.exp(F.log(a) + (F.log(z) - F.log(a)) * (rank - s["seen"]) / b["count"])
        return F.struct((s["seen"] + b["count"]).alias("seen"), F.coalesce(s["out"], F.when(s["seen"] + b["count"] >= rank, here)).alias("out"))

    return F.when(h["count"] > 0, F.aggregate(h["buckets"], start, step, lambda s: s["out"])).otherwise(F.lit(float("nan")))
