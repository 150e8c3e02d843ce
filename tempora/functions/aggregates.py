"""Time-ordered aggregates as column expressions for groupBy().agg()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.buckets import micros, parse_width


def no_nan(value: Column) -> Column:
    """NaN as null, so that minima and maxima pass over it."""
    return F.when(~F.isnan(value.cast("double")), value)


#: The builder's aggregates by name: (value, time) -> aggregate. Nulls are passed over; counts are doubles.
NATIVE = {
    "count": lambda v, t: F.count(v).cast("double"),
    "sum": lambda v, t: F.try_sum(v),
    "min": lambda v, t: F.min(no_nan(v)),
    "max": lambda v, t: F.max(no_nan(v)),
    "avg": lambda v, t: F.avg(v),
    "first": lambda v, t: F.min_by(v, F.when(v.isNotNull(), t)),
    "last": lambda v, t: F.max_by(v, F.when(v.isNotNull(), t)),
}


def first(value: Column, ts: Column) -> Column:
    """The value at the earliest time, null or not."""
    return F.min_by(value, ts)


def last(value: Column, ts: Column) -> Column:
    """The value at the latest time, null or not."""
    return F.max_by(value, ts)


def samples(value: Column, ts: Column, order: Column | None = None) -> Column:
    """The group's (t, v) by time, one for each time; nulls left out. Of repeated times the last by ``order`` counts, else the largest value, as rows have no order.

    A group is one series in one bucket; its samples are sorted in place of a window over the series.
    """
    parts = [micros(ts).alias("t"), *([order.alias("o")] if order is not None else []), value.cast("double").alias("v")]
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull() & ts.isNotNull(), F.struct(*parts))))

    def last_of_each(rows):
        n = F.size(rows)
        kept = F.filter(rows, lambda x, i: F.when(i < n - 1, F.get(rows, i + 1)["t"] != x["t"]).otherwise(True))
        return F.transform(kept, lambda x: F.struct(x["t"].alias("t"), x["v"].alias("v")))

    return F.transform(F.array(rows), last_of_each)[0]


def counter_rates(rows: DataFrame, keys: list[str], value: str, ts: str, order: str | None = None, chunk: str = "1d") -> DataFrame:
    """(keys, rate, irate) of counters; a drop is a reset. Samples are put in order by chunks of time, whose sums are joined, so that a long series is many tasks' work."""
    width = parse_width(chunk)
    at = F.floor(micros(F.col(ts)) / (width.micros or width.days * 86400 * 10**6))
    own = rows.groupBy(*keys, at.alias("__chunk")).agg(samples(F.col(value), F.col(ts), F.col(order) if order else None).alias("s")).where(F.size("s") > 0)
    s = F.col("s")
    parts = F.struct(F.element_at(s, 1)["t"].alias("t"), F.element_at(s, 1)["v"].alias("first"), F.element_at(s, -1)["v"].alias("last"), increase_of(s).alias("rise"), F.slice(s, -F.least(F.size(s), F.lit(2)), 2).alias("tail"))
    own = own.groupBy(*keys).agg(F.array_sort(F.collect_list(parts)).alias("p"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum"))

    def step(state, x):
        between = F.when(state["last"].isNull(), 0.0).when(x["first"] < state["last"], x["first"]).otherwise(x["first"] - state["last"])
        return F.struct(x["last"].alias("last"), (state["sum"] + between + x["rise"]).alias("sum"))

    tails = F.flatten(F.transform(F.slice("p", -F.least(F.size("p"), F.lit(2)), 2), lambda x: x["tail"]))
    own = own.withColumns({"__rise": F.aggregate("p", start, step, lambda x: x["sum"]), "__tail": tails})
    span = (F.element_at("__tail", -1)["t"] - F.get("p", 0)["t"]) / 1e6
    return own.select(*keys, F.when(span > 0, F.col("__rise") / span).alias("rate"), irate_of(F.col("__tail")).alias("irate"))


def increase_of(rows: Column) -> Column:
    """Sum of increases of samples; a drop is a reset, after which the whole value counts."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum"))

    def step(state, x):
        grown = F.when(state["last"].isNull(), 0.0).when(x["v"] < state["last"], x["v"]).otherwise(x["v"] - state["last"])
        return F.struct(x["v"].alias("last"), (state["sum"] + grown).alias("sum"))

    return F.aggregate(rows, start, step, lambda s: s["sum"])


def rate_of(rows: Column) -> Column:
    """Increase per second between the first and the last sample; null under two samples."""
    span = (F.element_at(rows, -1)["t"] - F.element_at(rows, 1)["t"]) / 1e6
    return F.when(F.size(rows) >= 2, F.when(span > 0, increase_of(rows) / span))


def irate_of(rows: Column) -> Column:
    """Rate of the last two samples; after a reset the last value counts."""
    b, a = F.try_element_at(rows, F.lit(-1)), F.try_element_at(rows, F.lit(-2))
    grown = F.when(b["v"] < a["v"], b["v"]).otherwise(b["v"] - a["v"])
    return F.when(F.size(rows) >= 2, grown / ((b["t"] - a["t"]) / 1e6))


def decimal_avg(value: Column, scale: int) -> Column:
    """Exact mean of a decimal with six more digits, half away from zero."""
    return F.round(F.sum(value) / F.count(value), scale + 6).cast(f"decimal(38,{min(scale + 6, 37)})")


def multivariate_forecast(target: Column, predictor: Column, ts: Column, horizon: int) -> Column:
    """The regression of target on predictor, continued with the predictor's last value."""
    value = F.regr_intercept(target, predictor) + F.regr_slope(target, predictor) * F.max_by(predictor, ts)
    return F.when(F.count(F.when(target.isNotNull() & predictor.isNotNull(), 1)) >= 4, F.array_repeat(value, horizon))
