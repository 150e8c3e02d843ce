"""Series made of other series, and composite signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.buckets import time_bucket
from tempora.operators.walks import walk
from tempora.streaming.triggers import cooling


def arithmetic(operator: str, a: Column, b: Column) -> Column:
    """Division by zero gives 0.0."""
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(b == 0, 0.0).otherwise(F.try_divide(a, b))}[operator]()


def log_return(v: Column, over) -> Column:
    """ln of the ratio to the row before; 0.0 for the first row and where there is no usable ratio."""
    p = F.lag(v).over(over)
    return F.when((p > 0) & (v > 0), F.log(F.try_divide(v, p))).otherwise(0.0)


def rolling(name: str, v: Column, over, w: int) -> Column:
    frame = over.rowsBetween(-(w - 1), 0)
    return {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[name](v).over(frame)


def align(rows: DataFrame, key: str, names: list[str], time: str, value: str, width: str) -> DataFrame:
    """One row per bucket, one column per named series: its mean there, or null."""
    bucketed = rows.where(F.col(key).isin(*names)).groupBy(time_bucket(width, F.col(time)).alias(time)).pivot(key, names)
    return bucketed.agg(F.avg(value))


def composite(rows: DataFrame, time: str, rules: dict[str, str], need: int, cooldown_us: int = 0) -> DataFrame:
    """Rows on which at least ``need`` of the rules (SQL conditions) hold: time, the rules' names, severity.

    Within the cooldown of the last row let through a row is dropped. The hits of all series form one order, which one task walks in bounded memory.
    """
    hits = F.array_compact(F.array(*(F.when(F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules.items())))
    found = rows.select(time, hits.alias("rules")).where(F.size("rules") >= need)
    if cooldown_us:
        found = found.withColumn("__at", F.unix_micros(F.col(time).cast("timestamp")))
        found = walk(found, [], ["__at"], ["__at"], "__kept", T.BooleanType(), None, cooling(cooldown_us)).where("__kept").drop("__at", "__kept")
    share = F.size("rules") / len(rules)
    return found.withColumn("severity", F.when(share >= 1, "critical").when(share >= 0.5, "warning").otherwise("info"))


def correlation_matrix(wide: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    once = wide.agg(*(F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    return once.select(F.explode(rows).alias("p")).select("p.*")
