"""Window functions of the builder and of SQL as column expressions over a series window.

``over`` is a window partitioned by series and ordered by time (and a unique column).
Whole-series kernels turn non-finite results into null.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tempora.functions.buckets import micros

EPSILON = 2.220446049250313e-16


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def lead_or(v: Column, over: WindowSpec, n: int = 1, default=None) -> Column:
    return F.coalesce(F.lead(v, n).over(over), F.lit(default))


def lag_or(v: Column, over: WindowSpec, n: int = 1, default=None) -> Column:
    return F.coalesce(F.lag(v, n).over(over), F.lit(default))


def delta(v: Column, over: WindowSpec) -> Column:
    return v - F.lag(v).over(over)


def rate(v: Column, ts: Column, over: WindowSpec) -> Column:
    """Change per second; a time that does not advance gives null. Resets are not treated."""
    dt = (micros(ts) - F.lag(micros(ts)).over(over)) / 1e6
    return F.when(dt > 0, delta(v, over) / dt)


def moving_average(v: Column, over: WindowSpec, n: int) -> Column:
    return F.when(F.row_number().over(over) >= n, F.avg(v).over(over.rowsBetween(-(n - 1), 0)))


def cumulative_sum(v: Column, over: WindowSpec) -> Column:
    return F.when(v.isNotNull(), F.sum(v).over(over.rowsBetween(Window.unboundedPreceding, 0)))


def positive_step(v: Column, over: WindowSpec) -> Column:
    """What ``increase`` sums: the rise since the row before, 0.0 for a fall and for the first row."""
    return F.when(F.row_number().over(over) == 1, 0.0).otherwise(F.greatest(delta(v, over), F.lit(0.0)))


def range_frame(partition: list[str], ts: str, micros_back: int) -> WindowSpec:
    """The frame [t - range, t]; rows of equal time are peers."""
    return Window.partitionBy(*partition).orderBy(micros(F.col(ts))).rangeBetween(-micros_back, 0)


def diff(v: Column, over: WindowSpec, n: int = 1) -> Column:
    """n-fold difference; null in the first n rows."""
    terms = [(-1) ** k * comb(n, k) * (F.lag(v, k).over(over) if k else v) for k in range(n + 1)]
    return sum(terms[1:], terms[0])


def pct_change(v: Column, over: WindowSpec) -> Column:
    p = F.lag(v).over(over)
    return F.when(F.abs(p) >= EPSILON, (v - p) / p)


def rolling_mean(v: Column, over: WindowSpec, w: int) -> Column:
    return moving_average(v, over, w)


def rolling_std(v: Column, over: WindowSpec, w: int) -> Column:
    return F.when(F.row_number().over(over) >= w, _finite(F.stddev_samp(v).over(over.rowsBetween(-(w - 1), 0))))


def pearson(a: Column, b: Column, over: WindowSpec) -> Column:
    """Pearson's r of the complete pairs; null without spread, where Spark's corr divides by zero."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_samp(x, y).over(over), F.stddev_samp(x).over(over) * F.stddev_samp(y).over(over))


def rolling_corr(a: Column, b: Column, over: WindowSpec, w: int) -> Column:
    return F.when(F.row_number().over(over) >= w, _finite(pearson(a, b, over.rowsBetween(-(w - 1), 0))))


def zscore(v: Column, series: WindowSpec) -> Column:
    sigma = F.stddev_samp(v).over(series)
    return F.when(sigma >= EPSILON, (v - F.avg(v).over(series)) / sigma)


def scale_floor(scale: Column, level: Column) -> Column:
    return F.greatest(scale, F.abs(level) * 1e-9, F.lit(1e-12))


def sigmoid(x: Column, steepness: float = 2.0) -> Column:
    return 1.0 / (1.0 + F.exp(-steepness * x))


def anomaly_score(v: Column, series: WindowSpec, threshold: float = 3.0) -> Column:
    mean, sigma = F.avg(v).over(series), F.stddev_samp(v).over(series)
    score = sigmoid(F.abs(v - mean) / scale_floor(sigma, mean) - threshold)
    return F.when(F.count(v).over(series) >= 3, score).otherwise(F.when(F.lit(True), F.raise_error(F.lit("anomaly_score needs three values"))).cast("double"))


def correlation(a: Column, b: Column, series: WindowSpec) -> Column:
    return _finite(pearson(a, b, series))


def cross_correlation_pairs(b: Column, over: WindowSpec, lag: int) -> Column:
    """The partner of a row's ``a``: b of ``lag`` rows before."""
    return F.lag(b, lag).over(over) if lag >= 0 else F.lead(b, -lag).over(over)


def mahalanobis(a: Column, b: Column, series: WindowSpec, ridge: float = 1e-6) -> Column:
    """Distance of (a, b) from the series' mean by its covariance, with a ridge; incomplete rows give null."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    dx, dy = x - F.avg(x).over(series), y - F.avg(y).over(series)
    sxx, syy, sxy = F.var_samp(x).over(series) + ridge, F.var_samp(y).over(series) + ridge, F.covar_samp(x, y).over(series)
    det = sxx * syy - sxy * sxy
    squared = (syy * dx * dx - 2 * sxy * dx * dy + sxx * dy * dy) / det
    return F.when(both & (F.count(x).over(series) >= 3), F.sqrt(F.greatest(squared, F.lit(0.0))))


def groups_frame(partition: list[str], order: str, before: int, frame_rank: str = "__group"):
    """(rank column, frame) that stand for a GROUPS frame of ``before`` groups back to the current one."""
    rank = F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)).alias(frame_rank)
    return rank, Window.partitionBy(*partition).orderBy(frame_rank).rangeBetween(-before, 0)
