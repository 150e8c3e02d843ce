"""Gaps, interpolation, resampling, smoothing and feature columns of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.buckets import from_micros, micros
from tempora.operators.walks import walk

MAX_STEPS = 100_000


def gaps(points: DataFrame, keys: list[str], time: str, interval: int, tolerance: float = 1.5) -> DataFrame:
    """(keys, start, end, missing): neighbours further apart than tolerance times the interval (microseconds)."""
    over = Window.partitionBy(*keys).orderBy(time)
    spans = points.select(*keys, F.col(time).alias("start"), F.lead(time).over(over).alias("end"))
    span = micros(F.col("end")) - micros(F.col("start"))
    return spans.where(span > interval * tolerance).withColumn("missing", (F.round(span / interval) - 1).cast("long"))


def interpolate(points: DataFrame, keys: list[str], time: str, value: str, interval: int, method: str = "linear") -> DataFrame:
    """(keys, time, value, filled): points at the interval between neighbours; gaps of over MAX_STEPS stay.

    linear, nearest, catmull_rom, zero, forward (last value) or nocb (next value).
    """
    over = Window.partitionBy(*keys).orderBy("__t")
    p = points.where(F.col(value).isNotNull()).select(*keys, micros(F.col(time)).alias("__t"), F.col(value).cast("double").alias("__v"))
    p = p.withColumns({"__t2": F.lead("__t").over(over), "__v2": F.lead("__v").over(over), "__v0": F.lag("__v").over(over), "__v3": F.lead("__v", 2).over(over)})
    steps = F.when(F.col("__t2").isNotNull(), F.ceil((F.col("__t2") - F.col("__t")) / interval).cast("int") - 1).otherwise(0)
    steps = F.when((steps > 0) & (steps <= MAX_STEPS), steps).otherwise(0)
    p = p.withColumn("__k", F.explode(F.sequence(F.lit(0), steps)))
    at = F.col("__t") + F.col("__k") * interval
    u = (at - F.col("__t")) / (F.col("__t2") - F.col("__t"))
    a, b = F.col("__v"), F.col("__v2")
    before, after = F.coalesce("__v0", "__v"), F.coalesce("__v3", "__v2")
    curve = 0.5 * (2 * a + (b - before) * u + (2 * before - 5 * a + 4 * b - after) * u * u + (3 * a - before - 3 * b + after) * u * u * u)
    made = {"linear": a + (b - a) * u, "nearest": F.when(u < 0.5, a).otherwise(b), "catmull_rom": curve, "zero": F.lit(0.0), "forward": a, "nocb": b}
    if method not in made:
        raise ValueError(f"unknown interpolation {method!r}")
    return p.select(*keys, from_micros(at).alias(time), F.when(F.col("__k") == 0, a).otherwise(made[method]).alias(value), (F.col("__k") > 0).alias("filled"))


def resample_down(points: DataFrame, keys: list[str], time: str, value: str, interval: int, how: str = "mean") -> DataFrame:
    """Aggregates over spans of the interval counted from each series' first time."""
    from tempora.operators.anomaly import with_statistics

    t, v = micros(F.col(time)), F.col(value)
    p = with_statistics(points, keys, __start=F.min(t))
    p = p.withColumn("__b", F.col("__start") + F.floor((t - F.col("__start")) / interval) * interval)
    made = {"mean": F.avg(v), "min": F.min(v), "max": F.max(v), "sum": F.sum(v), "first": F.min_by(v, time), "last": F.max_by(v, time)}[how]
    return p.groupBy(*keys, "__b").agg(made.alias(value)).select(*keys, from_micros(F.col("__b")).alias(time), value)


def resample_up(points: DataFrame, keys: list[str], time: str, value: str, interval: int, method: str = "linear") -> DataFrame:
    """(keys, time, value): points at every multiple of the interval from each series' first time to its last, between its own points by the method."""
    filled = interpolate_at(points, keys, time, value, interval, method)
    return filled.select(*keys, time, value)


def interpolate_at(points: DataFrame, keys: list[str], time: str, value: str, interval: int, method: str) -> DataFrame:
    """As ``interpolate``, on a grid of the interval that begins at each series' first time."""
    over = Window.partitionBy(*keys).orderBy("__t")
    p = points.where(F.col(value).isNotNull()).select(*keys, micros(F.col(time)).alias("__t"), F.col(value).cast("double").alias("__v"))
    p = p.withColumns({"__t2": F.lead("__t").over(over), "__v2": F.lead("__v").over(over), "__start": F.first("__t").over(over)})
    k = lambda t: F.ceil((t - F.col("__start")) / interval)
    last = F.coalesce(k(F.col("__t2")) - 1, k(F.col("__t")))
    at_point = F.col("__t2").isNull() & ((F.col("__t") - F.col("__start")) % interval != 0)
    p = p.where(~at_point & (k(F.col("__t")) <= last)).withColumn("__k", F.explode(F.sequence(k(F.col("__t")), last)))
    at = F.col("__start") + F.col("__k") * interval
    u = F.coalesce((at - F.col("__t")) / (F.col("__t2") - F.col("__t")), F.lit(0.0))
    a, b = F.col("__v"), F.coalesce("__v2", "__v")
    made = {"linear": a + (b - a) * u, "nearest": F.when(u < 0.5, a).otherwise(b), "forward": a, "nocb": F.when(u == 0, a).otherwise(b)}
    if method not in made:
        raise ValueError(f"unknown interpolation {method!r}")
    return p.select(*keys, from_micros(at).alias(time), made[method].alias(value))


class Pipeline:
    """Steps from DataFrame to DataFrame, applied in order: Pipeline().then(interpolate, keys=[...], ...).run(points)."""

    def __init__(self, steps: tuple = ()):
        self.steps = steps

    def then(self, function, **options) -> Pipeline:
        return Pipeline((*self.steps, (function, options)))

    def run(self, points: DataFrame) -> DataFrame:
        for function, options in self.steps:
            points = function(points, **options)
        return points


def smooth_moving(value: Column, over, w: int) -> Column:
    return F.avg(value).over(over.rowsBetween(-(w - 1), 0))


def smooth_weighted(value: Column, over, weights: list[float]) -> Column:
    """Weights from the oldest to the current row; missing rows and their weights are left out."""
    n = len(weights)
    past = [F.lag(value, n - 1 - i).over(over) for i in range(n)]
    top = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in zip(past, weights, strict=True)), F.lit(0.0))
    return top / sum((F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for p, w in zip(past, weights, strict=True)), F.lit(0.0))


def ewm(points: DataFrame, keys: list[str], order: list[str], value: str, alpha: float, out: str = "ewm") -> DataFrame:
    """Exponentially weighted mean; a null row repeats the state."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")

    def step(state, v):
        state = state if v is None else v if state is None else state + alpha * (v - state)
        return state, state

    rows = points.withColumn("__x", F.col(value).cast("double"))
    return walk(rows, keys, order, ["__x"], out, T.DoubleType(), None, step).drop("__x")


def calendar_features(ts: Column) -> dict[str, Column]:
    return {"hour": F.hour(ts), "day_of_week": F.weekday(ts), "day_of_month": F.dayofmonth(ts), "month": F.month(ts), "is_weekend": (F.weekday(ts) >= 5).cast("int")}


def auto_features(points: DataFrame, keys: list[str], time: str, value: str, windows: tuple[int, ...] = (60, 360, 1440, 10080), period: int | None = None) -> DataFrame:
    over = Window.partitionBy(*keys).orderBy(time)
    made = calendar_features(F.col(time))
    for w in windows:
        made |= {f"rolling_mean_{w}": F.avg(value).over(over.rowsBetween(-(w - 1), 0)), f"rolling_std_{w}": F.stddev_samp(value).over(over.rowsBetween(-(w - 1), 0))}
    for k in {1, 2, *([period] if period else [])}:
        made[f"lag_{k}"] = F.lag(value, k).over(over)
    return points.withColumns(made)


def monotonic_times(points: DataFrame, keys: list[str], sequence: str, time: str) -> DataFrame:
    """Times that never go back: a time not after all before it becomes one microsecond more than the last."""
    over = Window.partitionBy(*keys).orderBy(sequence)
    rank = F.row_number().over(over)
    # t_i' = max(t_i, t_{i-1}' + 1) is a running maximum of t_i - i
    p = points.withColumns({"__r": rank, "__d": micros(F.col(time)) - rank})
    raised = F.max("__d").over(over.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__r")
    return p.withColumn(time, from_micros(raised)).drop("__r", "__d")
