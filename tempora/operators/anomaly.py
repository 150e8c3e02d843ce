"""Anomaly detectors as column expressions over series.

A result has the input's columns and score (0 to 1), is_anomaly and threshold. Statistics of a series
are aggregated and joined back, so a long series is never one task's window unless its order matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions import kernels
from tempora.functions.windows import scale_floor, sigmoid
from tempora.operators import series
from tempora.operators.walks import walk

METHODS = ("zscore", "modified_zscore", "iqr", "moving_average", "dynamic_threshold", "forecast_residual", "cusum")


def with_statistics(rows: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Rows with aggregates of their series, null keys equal."""
    return _joined(rows, rows.groupBy(*keys).agg(*(a.alias(n) for n, a in aggregates.items())), keys)


def _joined(rows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return rows.join(F.broadcast(stats))  # one row
    renamed = stats.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    same = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"__key_{k}"))
        same = equal if same is None else same & equal
    return rows.join(renamed, same).drop(*(f"__key_{k}" for k in keys))


def _scored(rows: DataFrame, score: Column, anomaly: Column, threshold: float) -> DataFrame:
    made = {"score": score, "is_anomaly": anomaly, "threshold": F.lit(float(threshold))}
    out = rows.withColumns(made)
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def zscore(rows: DataFrame, keys: list[str], value: str, threshold: float = 3.0) -> DataFrame:
    v = F.col(value)
    rows = with_statistics(rows, keys, __mean=F.avg(v), __std=F.stddev_samp(v), __n=F.count(v)).where("__n >= 3")
    raw = F.abs(v - F.col("__mean")) / scale_floor(F.col("__std"), F.col("__mean"))
    return _scored(rows, sigmoid(raw - threshold), raw > threshold, threshold)


def modified_zscore(rows: DataFrame, keys: list[str], value: str, threshold: float = 3.5) -> DataFrame:
    """By the median and the median absolute deviation; the mean deviation where the latter is 0."""
    v = F.col(value)
    rows = with_statistics(rows, keys, __median=F.percentile(v, 0.5), __n=F.count(v)).where("__n >= 3")
    dev = F.abs(v - F.col("__median"))
    rows = with_statistics(rows.withColumn("__dev", dev), keys, __mad=F.percentile("__dev", 0.5), __mean_dev=F.avg("__dev"))
    floor = scale_floor(F.lit(0.0), F.col("__median"))
    by_mean = F.when(F.col("__mean_dev") > floor, F.col("__dev") / (1.253314 * F.col("__mean_dev"))).otherwise(F.col("__dev") / floor)
    raw = F.when(F.col("__mad") > floor, 0.6745 * F.col("__dev") / F.col("__mad")).otherwise(by_mean)
    return _scored(rows, sigmoid(raw - threshold), raw > threshold, threshold)


def iqr(rows: DataFrame, keys: list[str], value: str, k: float = 1.5) -> DataFrame:
    """Outside the quartiles by more than k times their distance; the score grows with the excess in such distances."""
    v = F.col(value)
    rows = with_statistics(rows, keys, __q=F.percentile(v, F.array(F.lit(0.25), F.lit(0.75))), __n=F.count(v)).where("__n >= 4")
    low, high = F.col("__q")[0], F.col("__q")[1]
    rows = rows.withColumn("__iqr", scale_floor(high - low, (low + high) / 2)).withColumns({"__low": low, "__high": high})
    under, over = F.col("__low") - k * F.col("__iqr") - v, v - F.col("__high") - k * F.col("__iqr")
    raw = F.greatest(under, over, F.lit(0.0)) / F.col("__iqr")
    return _scored(rows, 1 - 1 / (1 + raw), (under > 0) | (over > 0), k)


def _ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def moving_average(rows: DataFrame, keys: list[str], value: str, order: list[str], window: int = 24, threshold: float = 3.0) -> DataFrame:
    """Residuals from the mean of the ``window`` rows before; the first ``window`` rows are never anomalous."""
    over = _ordered(keys, order)
    full = F.row_number().over(over) > window
    residual = F.when(full, F.col(value) - F.avg(value).over(over.rowsBetween(-window, -1)))
    whole = Window.partitionBy(*keys)  # dealt as the rows already are
    rows = rows.withColumn("__res", residual).withColumns({"__std": F.stddev_samp("__res").over(whole), "__mean": F.avg("__res").over(whole)})
    raw = F.coalesce(F.abs(F.col("__res") - F.col("__mean")) / scale_floor(F.col("__std"), F.col("__mean")), F.lit(0.0))
    return _scored(rows, F.when(F.col("__res").isNotNull(), sigmoid(raw - threshold)).otherwise(0.0), raw > threshold, threshold)


def dynamic_threshold(rows: DataFrame, keys: list[str], value: str, order: list[str], lookback: int = 100, k: float = 3.0, period: int | None = None) -> DataFrame:
    """Against the previous ``lookback`` rows (population deviation), the whole series until there are as many; or against rows of the same phase."""
    v, over = F.col(value), _ordered(keys, order)
    rows = rows.withColumn("__at", F.row_number().over(over) - 1)
    if period:
        rows = rows.withColumn("__phase", F.col("__at") % period)
        rows = with_statistics(rows, [*keys, "__phase"], __mean=F.avg(v), __std=F.stddev_samp(v))
    else:
        frame = over.rowsBetween(-lookback, -1)
        rows = rows.withColumns({"__m": F.avg(v).over(frame), "__s": F.stddev_pop(v).over(frame)})
        whole = Window.partitionBy(*keys)
        rows = rows.withColumns({"__base": F.avg(v).over(whole), "__base_std": F.stddev_pop(v).over(whole)})
        full = F.col("__at") >= lookback
        rows = rows.withColumns({"__mean": F.when(full, F.col("__m")).otherwise(F.col("__base")), "__std": F.when(full, F.col("__s")).otherwise(F.col("__base_std"))})
    dev = F.abs(v - F.col("__mean"))
    raw = F.when(F.col("__std") < 1e-15, F.when(dev < 1e-15, 0.0).otherwise(float("inf"))).otherwise(dev / F.col("__std"))
    return _scored(rows, sigmoid(raw - k), raw > k, k)


def forecast_residual(rows: DataFrame, keys: list[str], value: str, order: list[str], threshold: float = 3.0, alpha: float | None = None) -> DataFrame:
    """Residuals of walking one-step forecasts by exponential smoothing; without ``alpha`` it is fitted to each series, whose values must fit in a task."""
    if alpha is None:

        def fit(pdf):
            y = pdf.sort_values(order, kind="stable")[value].dropna().to_numpy(float)
            fitted = kernels.ses(y, 1).parameters["alpha"] if len(y) > 1 else None
            return pdf.head(1)[keys].assign(__alpha=fitted).astype({"__alpha": float})

        rows = _joined(rows, series._apply(rows, keys, [*order, value], fit, [T.StructField("__alpha", T.DoubleType())]), keys)
    else:
        rows = rows.withColumn("__alpha", F.lit(float(alpha)))
    rows = rows.withColumn("__x", F.col(value).cast("double"))

    def step(level, v, a):
        if v is None:
            return level, None
        return (v, None) if level is None else (level + a * (v - level), v - level)

    walked = walk(rows, keys, order, ["__x", "__alpha"], "__made", T.DoubleType(), None, step)
    whole = Window.partitionBy(*keys)
    walked = walked.withColumns({"__std": F.stddev_samp("__made").over(whole), "__mean": F.avg("__made").over(whole), "__n": F.count("__made").over(whole)}).where("__n >= 4")
    raw = F.coalesce(F.abs(F.col("__made") - F.col("__mean")) / scale_floor(F.col("__std"), F.col("__mean")), F.lit(0.0))
    return _scored(walked, F.when(F.col("__made").isNotNull(), sigmoid(raw - threshold)).otherwise(0.0), raw > threshold, threshold)


def cusum(rows: DataFrame, keys: list[str], value: str, order: list[str], h: float = 4.0, k: float = 0.5, reset: bool = True) -> DataFrame:
    """Cumulative sums above and below the mean, in standard deviations; an alarm above h starts them anew if wanted. A null adds nothing."""
    rows = with_statistics(rows, keys, __mean=F.avg(value), __std=F.stddev_samp(value))
    rows = rows.withColumns({"__h": F.greatest(h * F.col("__std"), F.lit(1e-3)), "__k": F.greatest(k * F.col("__std"), F.lit(1e-4)), "__d": (F.col(value) - F.col("__mean")).cast("double")})

    def step(state, d, limit, slack):
        up, down = state
        if d is not None:
            up, down = max(up + d - slack, 0.0), max(down - d - slack, 0.0)
        raw = max(up, down)
        return ((0.0, 0.0) if reset and raw > limit else (up, down)), raw

    walked = walk(rows, keys, order, ["__d", "__h", "__k"], "__made", T.DoubleType(), (0.0, 0.0), step)
    raw, limit = F.col("__made"), F.col("__h")
    return _scored(walked, sigmoid(raw / limit - 1, 4.0), raw > limit, h)


def detect(rows: DataFrame, method: str, keys: list[str], value: str, order: list[str], **options) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown detector {method!r}; known: {', '.join(METHODS)}")
    if method in ("zscore", "modified_zscore", "iqr"):
        return globals()[method](rows, keys, value, **options)
    return globals()[method](rows, keys, value, order, **options)
