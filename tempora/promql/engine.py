"""Evaluation: expressions become DataFrames over all steps at once.

A vector is (key, labels, step, v): ``key`` is the labels in canonical text, ``step`` and ``t`` are
microseconds. A scalar is a column expression over ``step``. A range vector is the samples of the windows
that end on steps a to z, sorted, or a summary of them: (key, labels, a, z, s).
"""

from __future__ import annotations

import difflib
import math
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions import histograms as H
from tempora.functions.buckets import from_micros, micros
from tempora.promql.syntax import Aggregate, Binary, Call, Matching, Negative, Number, Selector, Subquery, SyntaxProblem, Text, parse

LOOKBACK_MS = 300_000
SUBQUERY_STEP_MS = 60_000
MAX_POINTS = 11_000
NAN = float("nan")


class MetricError(ValueError):
    pass


@dataclass(frozen=True)
class Grid:
    """Steps start, start + step, ... end, in microseconds."""

    start: int
    end: int
    step: int

    @property
    def count(self) -> int:
        return (self.end - self.start) // self.step + 1


@dataclass(frozen=True)
class Samples:
    """Points of series (sid, t, v); ``named`` gives key and labels in place of sid."""

    frame: DataFrame
    named: Callable[[DataFrame], DataFrame]


def key_of(labels: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("\u0001"), e["value"])), "\u0002")


def _labelled(frame: DataFrame, labels: Column, *others: str) -> DataFrame:
    return frame.withColumn("labels", labels).withColumn("key", key_of(F.col("labels"))).select("key", "labels", *others)


def _without(labels: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(labels, lambda k, v: ~k.isin(*names)) if names else labels


def _only(labels: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(labels, lambda k, v: k.isin(*names) if names else F.lit(False))


def _nan_as_null(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def _quantile(q: Column, values: Column) -> Column:
    """Linear interpolation of a sorted array without NaN; infinite outside [0, 1]."""
    n = F.size(values)
    at = q * (n - 1)
    low = F.greatest(F.floor(at), F.lit(0))
    high = F.least(low + 1, n - 1)
    pick = lambda i: F.get(values, i.cast("int"))
    inside = pick(low) + (pick(high) - pick(low)) * (at - low)
    return F.when((n == 0) | F.isnan(q), NAN).when(q < 0, float("-inf")).when(q > 1, float("inf")).otherwise(inside)


def _pairs(s: Column, made) -> Column:
    """Sum of made(before, after) over neighbours."""
    both = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), made)
    return F.when(F.size(s) > 1, F.aggregate(both, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def _v(s: Column) -> Column:
    return F.transform(s, lambda x: x["v"])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


#: What a window's value is made of: of samples (t, v), and of parts of the window. These are plain aggregates.
PLAIN = {
    "t0": (lambda: F.min("t"), lambda: F.min("t0")), "t1": (lambda: F.max("t"), lambda: F.max("t1")),
    "v0": (lambda: F.min_by("v", "t"), lambda: F.min_by("v0", "t0")), "v1": (lambda: F.max_by("v", "t"), lambda: F.max_by("v1", "t1")),
    "n": (lambda: F.count(F.lit(1)), lambda: F.sum("n")), "sum": (lambda: F.sum("v"), lambda: F.sum("sum")),
    "low": (lambda: F.min(_nan_as_null(F.col("v"))), lambda: F.min("low")), "high": (lambda: F.max(_nan_as_null(F.col("v"))), lambda: F.max("high")),
}
#: Sums over neighbours, of two values; they need the samples in order.
NEIGHBOURS = {
    "drop": lambda a, b: F.when(b < a, a).otherwise(0.0),
    "changes": lambda a, b: F.when((a == b) | (F.isnan(a) & F.isnan(b)), 0.0).otherwise(1.0),
    "resets": lambda a, b: F.when(b < a, 1.0).otherwise(0.0),
}


def _neighbours(s: Column, name: str, before: str, after: str) -> Column:
    made = NEIGHBOURS[name]
    return _pairs(s, lambda a, b: made(a[before], b[after]))


def _summary(s: Column, need: tuple[str, ...]) -> Column:
    """The ends and number of sorted samples, and the wanted sums over neighbours."""
    first, last = F.element_at(s, 1), F.element_at(s, -1)
    sums = [_neighbours(s, n, "v", "v").alias(n) for n in need if n in NEIGHBOURS]
    return F.struct(first["t"].alias("t0"), first["v"].alias("v0"), last["t"].alias("t1"), last["v"].alias("v1"), F.size(s).alias("n"), *sums)


def _joined_summaries(p: Column, need: tuple[str, ...]) -> Column:
    """The summary of a window from those of its parts, in order of time."""
    first, last = F.element_at(p, 1), F.element_at(p, -1)
    total = lambda name: F.aggregate(p, F.lit(0.0), lambda a, x: a + x[name])
    sums = [(total(n) + _neighbours(p, n, "v1", "v0")).alias(n) for n in need if n in NEIGHBOURS]
    return F.struct(first["t0"].alias("t0"), first["v0"].alias("v0"), last["t1"].alias("t1"), last["v1"].alias("v1"), F.aggregate(p, F.lit(0), lambda a, x: a + x["n"]).alias("n"), *sums)


def _extrapolated(q: Column, step: Column, range_us: int, counter: bool, per_second: bool) -> Column:
    """Change over the window, stretched towards its edges as far as samples suggest."""
    n = q["n"]
    change = q["v1"] - q["v0"]
    if counter:
        change = change + q["drop"]
    sampled = (q["t1"] - q["t0"]) / 1e6
    average = sampled / (n - 1)
    before, after = (q["t0"] - (step - range_us)) / 1e6, (step - q["t1"]) / 1e6
    limit = average * 1.1
    far = (lambda gap: gap >= limit) if counter else (lambda gap: gap > limit)
    before = F.when(far(before), average / 2).otherwise(before)
    if counter:
        zero = sampled * (q["v0"] / change)
        before = F.when((change > 0) & (q["v0"] >= 0) & (zero < before), zero).otherwise(before)
    after = F.when(far(after), average / 2).otherwise(after)
    whole = change * ((sampled + before + after) / sampled)
    whole = whole / (range_us / 1e6) if per_second else whole
    return F.when((n >= 2) & (sampled > 0), whole)


def _between(a: Column, b: Column, t: Column, counter: bool) -> Column:
    """Linear between two samples; a counter that fell in between began anew at 0."""
    low = F.when(b["v"] < a["v"], 0.0).otherwise(a["v"]) if counter else a["v"]
    return low + (b["v"] - low) * (t - a["t"]) / (b["t"] - a["t"])


def _edge_to_edge(s: Column, start: Column, end: Column, smooth: bool, counter: bool) -> Column:
    """The change from the window's left edge to its right one; null where no sample lies behind the left edge."""
    at = lambda i: F.get(s, i)
    n = F.size(s)
    head = F.slice(s, 1, n - 1)
    first = F.greatest(F.size(F.filter(head, lambda x: x["t"] <= start)) - 1, F.lit(0))
    last = F.size(F.filter(head, lambda x: x["t"] < end)) if smooth else n - 1
    left = F.when(at(first)["t"] >= start, at(first)["v"]).otherwise(_between(at(first), at(first + 1), start, counter) if smooth else at(first)["v"])
    right = F.when((at(last)["t"] <= end) | (last == 0), at(last)["v"]).otherwise(_between(at(last - 1), at(last), end, counter) if smooth else at(last)["v"])
    change = right - left
    if counter:
        a = F.when(at(first)["t"] <= start, first + 1).otherwise(first)
        z = F.when(at(last)["t"] >= end, last - 1).otherwise(last)
        values = F.concat(F.array(left), _v(F.slice(s, a + 1, F.greatest(z - a + 1, F.lit(0)))), F.array(right))
        both = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda x, y: F.when(y < x, x).otherwise(0.0))
        change = change + _sum(both)
    ok = at(last)["t"] > start
    return F.when(ok & (at(first)["t"] <= end) if smooth else ok, change)


def _regression(s: Column) -> tuple[Column, Column, Column]:
    """Slope per second, and mean time (seconds behind the first sample) and value."""
    n = F.size(s)
    first = F.element_at(s, 1)["t"]
    x = F.transform(s, lambda p: (p["t"] - first) / 1e6)
    y = _v(s)
    mx, my = _sum(x) / n, _sum(y) / n
    sxy = _sum(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my)))
    sxx = _sum(F.transform(x, lambda a: (a - mx) * (a - mx)))
    return F.when(n >= 2, F.when(sxx != 0, sxy / sxx).otherwise(NAN)), mx, my


def _smoothed(s: Column, sf: Column, tf: Column) -> Column:
    v = _v(s)
    start = F.struct(F.get(v, 0).alias("a"), (F.get(v, 1) - F.get(v, 0)).alias("b"))
    rest = F.slice(v, 2, F.size(v) - 1)

    def step(z, x):
        a = sf * x + (1 - sf) * (z["a"] + z["b"])
        return F.struct(a.alias("a"), (tf * (a - z["a"]) + (1 - tf) * z["b"]).alias("b"))

    return F.when(F.size(s) >= 2, F.aggregate(rest, start, step, lambda z: z["a"]))


def _moments(s: Column) -> Column:
    v, n = _v(s), F.size(s)
    mean = _sum(v) / n
    return _sum(F.transform(v, lambda x: (x - mean) * (x - mean))) / n


def _sorted_values(s: Column) -> Column:
    return F.array_sort(_v(s))


def _has_nan(s: Column) -> Column:
    return F.exists(s, lambda x: F.isnan(x["v"]))


#: Window functions that a summary is enough for, and those that need all samples; null means no result.
FROM_SUMMARY = {
    "avg_over_time": (("sum", "n"), lambda q: q["sum"] / q["n"]),
    "sum_over_time": (("sum",), lambda q: q["sum"]),
    "count_over_time": (("n",), lambda q: q["n"].cast("double")),
    "last_over_time": (("v1",), lambda q: q["v1"]),
    "first_over_time": (("v0",), lambda q: q["v0"]),
    "present_over_time": (("n",), lambda q: F.lit(1.0)),
    "min_over_time": (("low",), lambda q: F.coalesce(q["low"], F.lit(NAN))),
    "max_over_time": (("high",), lambda q: F.coalesce(q["high"], F.lit(NAN))),
    "changes": (("changes",), lambda q: q["changes"]),
    "resets": (("resets",), lambda q: q["resets"]),
}
_ENDS = ("t0", "v0", "t1", "v1", "n")
FROM_SAMPLES = {
    "stddev_over_time": lambda s: F.sqrt(_moments(s)),
    "stdvar_over_time": lambda s: _moments(s),
    "mad_over_time": lambda s: F.when(_has_nan(s), NAN).otherwise(
        _quantile(F.lit(0.5), F.array_sort(F.transform(_v(s), lambda x: F.abs(x - _quantile(F.lit(0.5), _sorted_values(s))))))
    ),
    "irate": lambda s: F.when(
        F.size(s) >= 2,
        F.when(F.element_at(s, -1)["v"] < F.element_at(s, -2)["v"], F.element_at(s, -1)["v"]).otherwise(F.element_at(s, -1)["v"] - F.element_at(s, -2)["v"])
        / ((F.element_at(s, -1)["t"] - F.element_at(s, -2)["t"]) / 1e6),
    ),
    "idelta": lambda s: F.when(F.size(s) >= 2, F.element_at(s, -1)["v"] - F.element_at(s, -2)["v"]),
    "deriv": lambda s: _regression(s)[0],
}

_log = lambda f: lambda v: F.when(v > 0, f(v)).when(v == 0, float("-inf")).otherwise(NAN)
_inside = lambda f, ok: lambda v: F.when(ok(v), f(v)).otherwise(NAN)
#: Functions of one value.
ELEMENT = {
    "abs": F.abs, "ceil": lambda v: _whole(v, F.ceil), "floor": lambda v: _whole(v, F.floor), "exp": F.exp, "sqrt": _inside(F.sqrt, lambda v: v >= 0),
    "ln": _log(F.log), "log2": _log(F.log2), "log10": _log(F.log10), "sgn": F.signum,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": _inside(F.asin, lambda v: F.abs(v) <= 1), "acos": _inside(F.acos, lambda v: F.abs(v) <= 1), "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": _inside(F.acosh, lambda v: v >= 1), "atanh": _inside(F.atanh, lambda v: F.abs(v) < 1),
    "deg": F.degrees, "rad": F.radians,
}


def _whole(v: Column, f) -> Column:
    """Rounding that leaves NaN, infinities and numbers beyond 2**53 as they are."""
    return F.when(F.isnan(v) | (F.abs(v) >= 2.0**53), v).otherwise(f(v).cast("double"))


def _clock(v: Column, part) -> Column:
    ok = ~F.isnan(v) & (F.abs(v) < 1e11)
    at = F.timestamp_micros((F.floor(F.when(ok, v).otherwise(0.0)) * 10**6).cast("long")).cast("timestamp_ntz")
    return F.when(ok, part(at).cast("double")).otherwise(NAN)


CLOCK = {
    "year": F.year, "month": F.month, "day_of_month": F.dayofmonth, "day_of_week": lambda t: F.dayofweek(t) - 1, "day_of_year": F.dayofyear,
    "days_in_month": lambda t: F.dayofmonth(F.last_day(t)), "hour": F.hour, "minute": F.minute,
}


#: Fewest and most arguments of the other functions; those of a window or a value take one.
ARGUMENTS = {
    "rate": (1, 1), "increase": (1, 1), "delta": (1, 1), "predict_linear": (2, 2), "quantile_over_time": (2, 2), "double_exponential_smoothing": (3, 3), "holt_winters": (3, 3),
    "absent": (1, 1), "absent_over_time": (1, 1), "time": (0, 0), "pi": (0, 0), "vector": (1, 1), "scalar": (1, 1), "timestamp": (1, 1), "round": (1, 2), "clamp": (3, 3), "clamp_min": (2, 2),
    "clamp_max": (2, 2), "label_replace": (5, 5), "label_join": (3, 99), "sort": (1, 1), "sort_desc": (1, 1), "sort_by_label": (1, 99), "sort_by_label_desc": (1, 99), "histogram_quantile": (2, 2),
    "histogram_count": (1, 1), "histogram_sum": (1, 1), "histogram_avg": (1, 1), "histogram_stddev": (1, 1), "histogram_stdvar": (1, 1), "histogram_fraction": (3, 3),
}
#: The samples of windows of at most FEWEST_STEPS are copied to each of these; those of longer ones are put into panes, which are copied
#: to each step up to FEW_STEPS, and beyond only to the steps on which some window changes.
FEWEST_STEPS, FEW_STEPS = 8, 64


class Engine:
    """Metrics of measurements: ``<measurement>_<field>``, or the measurement's name for the field ``value``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.metrics, self.histograms, self._scalars = spark, {}, set(), {}

    def add(self, measurement: str, frame: DataFrame, time: str, tags: list[str], fields: list[str]) -> None:
        for f in fields:
            name = measurement if f == "value" else f"{measurement}_{f}"
            self.metrics[name] = (frame.where(F.col(f).isNotNull() & F.col(time).isNotNull()), time, F.col(f).cast("double"), tags)

    def add_histograms(self, measurement: str, frame: DataFrame, time: str, tags: list[str], field: str) -> None:
        """A metric of native histograms (structs of tempora.functions.histograms) for the histogram functions, with its classic view: _count, _sum and cumulative _bucket series."""
        name = measurement if field == "value" else f"{measurement}_{field}"
        h = F.col(field)
        rows = frame.where(h.isNotNull() & F.col(time).isNotNull())
        self.metrics[f"{name}_count"] = (rows, time, h["count"], tags)
        self.metrics[f"{name}_sum"] = (rows, time, h["sum"], tags)
        bound = lambda b: F.pow(F.lit(2.0), b["index"] * F.pow(F.lit(2.0), -h["schema"].cast("double")))
        cells = F.concat(F.array(F.struct(F.lit("").alias("i"), h["zero_threshold"].alias("le"), h["zero_count"].alias("n"))), F.transform(h["buckets"], lambda b: F.struct(b["index"].cast("string").alias("i"), bound(b).alias("le"), b["count"].alias("n"))))
        upto = lambda k: F.aggregate(F.slice(F.col("__cells"), 1, k + 1), F.lit(0.0), lambda a, c: a + c["n"])
        all_cells = F.concat(F.transform("__cells", lambda c, k: F.struct(c["le"].cast("string").alias("le"), upto(k).alias("n"))), F.array(F.struct(F.lit("+Inf").alias("le"), h["count"].alias("n"))))
        classic = rows.withColumn("__cells", cells).withColumn("__cell", F.explode(all_cells)).withColumns({"le": F.col("__cell.le"), "__n": F.col("__cell.n")})
        self.metrics[f"{name}_bucket"] = (classic, time, F.col("__n"), [*tags, "le"])
        native = rows.withColumn("__cell", F.explode(cells)).withColumns({"__index": F.coalesce(F.nullif("__cell.i", F.lit("")), F.lit("zero")), "__schema": h["schema"].cast("string"), "__zero": h["zero_threshold"].cast("string"), "__n": F.col("__cell.n")})
        self.metrics[f"{name}:native"] = (native, time, F.col("__n"), [*tags, "__index", "__schema", "__zero"])
        self.histograms.add(name)

    # -- queries --

    def instant(self, text: str, at: int) -> DataFrame:
        """(labels, ts, value) at a time in microseconds."""
        return self._query(text, Grid(at, at, 1))

    def range(self, text: str, start: int, end: int, step: int) -> DataFrame:
        """(labels, ts, value) on every step; times in microseconds."""
        if step <= 0 or end < start:
            raise MetricError("the range needs a positive step and an end after its start")
        grid = Grid(start, end, step)
        if grid.count > MAX_POINTS:
            raise MetricError(f"{grid.count} points are more than {MAX_POINTS}")
        return self._query(text, grid)

    def _query(self, text: str, grid: Grid) -> DataFrame:
        found = self.eval(parse(text, grid.step / 1e6 if grid.count > 1 else 0.0, (grid.end - grid.start) / 1e6), grid)
        if isinstance(found, Column):
            found = self._bound(self._steps(grid), found).select(F.create_map().cast("map<string,string>").alias("labels"), "step", found.alias("v"))
        return found.select("labels", from_micros(F.col("step")).alias("ts"), F.col("v").alias("value"))

    def explain(self, text: str) -> list[str]:
        """The expression as an indented tree, and why a selector's name matches nothing: names like it."""
        out: list[str] = []

        def show(node, depth):
            kind, fields = type(node).__name__, getattr(node, "__dict__", {})
            inner = {k: v for k, v in fields.items() if isinstance(v, tuple) and v and hasattr(v[0], "__dataclass_fields__") or hasattr(v, "__dataclass_fields__") and k != "matching"}
            plain = ", ".join(f"{k}={v!r}" for k, v in fields.items() if k not in inner and v not in (None, (), 0, False) and k != "matching")
            out.append("  " * depth + f"{kind}({plain})")
            if isinstance(node, Selector) and node.name and node.name not in self.metrics and node.name not in self.histograms:
                close = difflib.get_close_matches(node.name, self.names())
                out.append("  " * (depth + 1) + f"no metric {node.name}" + (f"; did you mean {', '.join(close)}?" if close else ""))
            for v in inner.values():
                for x in v if isinstance(v, tuple) else (v,):
                    show(x, depth + 1)

        show(parse(text), 0)
        return out

    def metadata(self) -> DataFrame:
        """(metric, labels): the label names of each metric."""
        return self.spark.createDataFrame([(n, list(self.metrics[n][3])) for n in self.names()], "metric string, labels array<string>")

    def status(self) -> DataFrame:
        """(metric, series, samples, first, last) of each metric, in one aggregation per metric."""
        parts = []
        for name in self.names():
            rows, time, _, tags = self.metrics[name]
            parts.append(rows.agg(F.lit(name).alias("metric"), F.count_distinct(F.array(*map(_tag, tags)) if tags else F.lit(1)).alias("series"), F.count(F.lit(1)).alias("samples"), F.min(time).cast("timestamp").alias("first"), F.max(time).cast("timestamp").alias("last")))
        return _union(parts)

    def label_values(self, label: str) -> DataFrame:
        if label == "__name__":
            return self.spark.createDataFrame([(n,) for n in self.names()], "value string")
        parts = [rows.select(_tag(label).alias("value")) for rows, _, _, tags in self.metrics.values() if label in tags and not label.startswith("__")]
        return _union(parts).where("value <> ''").distinct() if parts else self.spark.createDataFrame([], "value string")

    def series(self, text: str) -> DataFrame:
        found = self._samples(parse(text))
        return found.named(found.frame.select("sid").distinct()).select("labels")

    def names(self) -> list[str]:
        return sorted(n for n in self.metrics if not n.endswith(":native"))

    # -- pieces --

    def _steps(self, grid: Grid) -> DataFrame:
        return self.spark.range(grid.count).select((F.lit(grid.start) + F.col("id") * grid.step).alias("step"))

    def _samples(self, selector: Selector, low: int | None = None, high: int | None = None) -> Samples:
        """The matching series' samples of (low, high] in microseconds; times and tags are tested on their own columns, so that scans can prune."""
        matchers = [*selector.matchers, *([("__name__", "=", selector.name)] if selector.name else [])]
        if not any(o in ("=", "=~") and v not in ("", ".*") for _, o, v in matchers):
            raise MetricError("a selector needs a matcher that does not match the empty string")
        chosen, names = [], []
        for name, (rows, time, v, tags) in self.metrics.items():
            if name.endswith(":native") and selector.name != name:
                continue
            named = [(o, value) for label, o, value in matchers if label == "__name__"]
            if not all((name == value if o in ("=", "!=") else bool(re.fullmatch(value, name, re.S))) == (o in ("=", "=~")) for o, value in named):
                continue
            kind = dict(rows.dtypes)[time]
            if kind in ("timestamp", "timestamp_ntz"):
                moment = lambda us: F.lit(datetime(1970, 1, 1) + timedelta(microseconds=us)) if kind == "timestamp_ntz" else F.lit(datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us))  # noqa: E731, B023
                rows = rows if low is None else rows.where(F.col(time) > moment(low))
                rows = rows if high is None else rows.where(F.col(time) <= moment(high))
            else:
                rows = rows if low is None else rows.where((micros(F.col(time)) > low) & (micros(F.col(time)) <= high))
            for label, operator, value in matchers:
                if label != "__name__":
                    rows = rows.where(_matches(label, operator, value, dict(rows.dtypes)[label]) if label in tags else F.lit(_matches_empty(operator, value)))
            chosen.append(rows.select(F.array(F.lit(name), *map(_tag, tags)).alias("sid"), micros(F.col(time)).alias("t"), v.alias("v")))
            names.append((name, tags))

        def named(frame: DataFrame) -> DataFrame:
            labels = F.lit(None).cast("map<string,string>")
            for name, tags in names:
                pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col("sid")[i].alias("value")) for i, k in enumerate(["__name__", *tags])))
                labels = F.when(F.col("sid")[0] == name, F.map_from_entries(F.filter(pairs, lambda p: p["value"] != ""))).otherwise(labels)
            return frame.withColumn("labels", labels).withColumn("key", key_of(F.col("labels"))).drop("sid")

        if not chosen:
            return Samples(self.spark.createDataFrame([], "sid array<string>, t long, v double"), named)
        return Samples(_union(chosen), named)

    def _reached(self, samples: Samples, grid: Grid, reach_us: int, offset_us: int) -> DataFrame:
        """(sid, t, v, a, z): the first and last of the steps whose window (step - reach, step] holds the sample; t is moved by the offset."""
        t = F.col("t") + offset_us - grid.start
        a = F.greatest(F.ceil(t / grid.step), F.lit(0)).cast("int")
        z = F.least(F.ceil((t + reach_us) / grid.step) - 1, F.lit(grid.count - 1)).cast("int")
        return samples.frame.select("sid", (F.col("t") + offset_us).alias("t"), "v", a.alias("a"), z.alias("z")).where("a <= z")

    def _expanded(self, rows: DataFrame, grid: Grid) -> DataFrame:
        """Rows of steps a to z as one row per step."""
        return rows.withColumn("__k", F.explode(F.sequence("a", "z"))).withColumn("step", F.lit(grid.start) + F.col("__k").cast("long") * grid.step).drop("a", "z", "__k")

    def _pinned(self, node, grid: Grid, evaluate) -> DataFrame:
        """Evaluate at the time given by @ and repeat the result on every step."""
        if node.at is None:
            return evaluate(replace(node, at=None), grid)
        at = {"start": grid.start, "end": grid.end}.get(node.at) if isinstance(node.at, str) else round(node.at * 1e6)
        once = evaluate(replace(node, at=None), Grid(at, at, 1)).drop("step")
        return once.withColumn("step", F.explode(F.sequence(F.lit(grid.start), F.lit(grid.end), F.lit(grid.step))))

    def _instant_vector(self, node: Selector, grid: Grid, value: str = "v") -> DataFrame:
        """The newest sample of each step's lookback: of those that arrive at one step the newest, until the next arrives."""
        if node.extended:
            return self._smoothed_vector(node, grid)
        offset, reach = node.offset * 1000, LOOKBACK_MS * 1000
        samples = self._samples(node, grid.start - offset - reach, grid.end - offset)
        newest = self._reached(samples, grid, reach, offset).groupBy("sid", "a").agg(F.max(F.struct("t", "v")).alias("x"), F.max("z").alias("z"))
        following = F.lead("a").over(Window.partitionBy("sid").orderBy("a"))
        held = newest.withColumn("z", F.least("z", following - 1))
        v = F.col("x.v") if value == "v" else F.col("x.t") / 1e6
        found = self._expanded(samples.named(held.select("sid", "a", "z", v.alias("v"))), grid)
        return found.select("key", "labels", "step", "v")

    def _smoothed_vector(self, node: Selector, grid: Grid) -> DataFrame:
        rows, _ = self._extended_windows(node, grid, LOOKBACK_MS * 1000, LOOKBACK_MS * 1000)
        s, t = F.col("s"), F.col("step")
        i = F.size(F.filter(s, lambda x: x["t"] < t))
        here, before = F.get(s, i), F.get(s, F.when(i > 0, i - 1))
        made = F.when(here["t"] == t, here["v"]).when(before.isNotNull() & here.isNotNull(), _between(before, here, t, False)).otherwise(before["v"])
        return rows.withColumn("v", made).where("v is not null").select("key", "labels", "step", "v")

    def _extended_windows(self, node: Selector, grid: Grid, before_us: int, after_us: int) -> tuple[DataFrame, int]:
        """(key, labels, step, s): the samples of (step - before, step + after]."""
        offset = node.offset * 1000
        samples = self._samples(node, grid.start - offset - before_us, grid.end - offset + after_us)
        # a window that ends later is one whose samples come earlier
        reached = self._reached(samples, grid, before_us + after_us, offset - after_us).withColumn("t", F.col("t") + after_us)
        rows = self._expanded(reached, grid).groupBy("sid", "step").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s"))
        return samples.named(rows), after_us

    def _windows(self, node, grid: Grid, need: tuple[str, ...] | None = None) -> tuple[DataFrame, int]:
        """(key, labels, a, z, s) and the length of the windows in microseconds: sorted samples (or their summary) of the windows that end on steps a to z."""
        if isinstance(node, Selector) and node.range is not None:
            if node.extended:
                raise MetricError(f"{node.extended} is for rate, increase and delta" + (", changes and resets" if node.extended == "anchored" else ""))

            def evaluate(n, g):
                offset, reach = n.offset * 1000, n.range * 1000
                return self._gathered(self._samples(n, g.start - offset - reach, g.end - offset), g, reach, offset, need)

        elif isinstance(node, Subquery):

            def evaluate(n, g):
                res = (n.step or SUBQUERY_STEP_MS) * 1000
                low = g.start - n.offset * 1000 - n.range * 1000
                first = (low // res + 1) * res
                last = (g.end - n.offset * 1000) // res * res
                inner_grid = Grid(first, max(first, last), res)
                inner = self.eval(n.inner, inner_grid)
                if isinstance(inner, Column):
                    inner = self._bound(self._steps(inner_grid), inner).select(F.lit("").alias("key"), F.create_map().cast("map<string,string>").alias("labels"), "step", inner.alias("v"))
                frame = inner.select(F.struct("key", F.map_entries("labels").alias("labels")).alias("sid"), F.col("step").alias("t"), "v")
                named = lambda rows: rows.withColumns({"key": F.col("sid.key"), "labels": F.map_from_entries("sid.labels")}).drop("sid")
                return self._gathered(Samples(frame, named), g, n.range * 1000, n.offset * 1000, need)

        else:
            raise MetricError("a range vector is needed")
        if node.at is not None:
            pinned = self._pinned(node, grid, lambda n, g: self._expanded(evaluate(n, g), g))
            return pinned.withColumn("a", ((F.col("step") - grid.start) / grid.step).cast("int")).withColumn("z", F.col("a")).drop("step"), node.range * 1000
        return evaluate(node, grid), node.range * 1000

    def _gathered(self, samples: Samples, grid: Grid, reach_us: int, offset_us: int, need: tuple[str, ...] | None) -> DataFrame:
        """(key, labels, a, z, s): sorted samples of the windows, or a struct of what is needed of them."""
        reached = self._reached(samples, grid, reach_us, offset_us)
        copies = min(reach_us // grid.step, grid.count)
        plain = need is not None and set(need) <= set(PLAIN)
        kept = tuple(dict.fromkeys([*(need or ()), "t0", "t1"]))

        def part(first: bool) -> Column:  # of samples, or of what was made of them
            if plain:
                return F.struct(*(PLAIN[n][0 if first else 1]().alias(n) for n in (kept if first else need)))
            if first:
                return F.array_sort(F.collect_list(F.struct("t", "v")))
            at = F.col("s.t0") if need else F.get("s", 0)["t"]
            return F.array_sort(F.collect_list(F.struct(at.alias("t"), "s")))

        def whole(rows: DataFrame, first: bool) -> DataFrame:
            if plain:
                return rows
            if first:
                return rows.withColumn("s", _summary(F.col("s"), need)) if need else rows
            parts = F.transform("s", lambda x: x["s"])
            return rows.withColumn("s", F.transform(F.array(parts), lambda p: _joined_summaries(p, need))[0] if need else F.flatten(parts))

        def to_steps(rows: DataFrame, first: bool) -> DataFrame:
            spread = rows.withColumn("__c", F.explode(F.sequence("a", "z"))).drop("a", "z")
            done = whole(spread.groupBy("sid", "__c").agg(part(first).alias("s")), first)
            return done.select("sid", F.col("__c").alias("a"), F.col("__c").alias("z"), "s")

        if copies <= FEWEST_STEPS:
            return samples.named(to_steps(reached, True))
        # samples that come and go on the same steps make a pane
        panes = whole(reached.groupBy("sid", "a", "z").agg(part(True).alias("s")), True)
        if plain:
            panes = panes.select("sid", "a", "z", "s.*")
        if copies <= FEW_STEPS:
            return samples.named(to_steps(panes, False))
        # numbered steps on which some pane comes or goes
        cuts = panes.select("sid", F.explode(F.array(F.col("a"), F.col("z") + 1)).alias("c")).distinct()
        in_order = Window.partitionBy("sid").orderBy("c")
        cuts = cuts.withColumns({"i": F.row_number().over(in_order), "next": F.lead("c").over(in_order)})
        number = lambda c, i: cuts.select("sid", F.col("c").alias(c), F.col("i").alias(i))
        spread = panes.withColumn("__z", F.col("z") + 1).join(number("a", "__i"), ["sid", "a"]).join(number("__z", "__j"), ["sid", "__z"])
        spread = spread.withColumn("i", F.explode(F.sequence(F.col("__i"), F.col("__j") - 1))).drop("a", "z", "__z", "__i", "__j")
        rows = whole(spread.groupBy("sid", "i").agg(part(False).alias("s")), False)
        return samples.named(rows.join(cuts, ["sid", "i"]).select("sid", F.col("c").alias("a"), (F.col("next") - 1).alias("z"), "s"))

    # -- evaluation --

    def eval(self, node, grid: Grid):
        if isinstance(node, Number):
            return F.lit(node.value)
        if isinstance(node, Text):
            return node.value
        if isinstance(node, Selector):
            if node.range is not None:
                raise MetricError("a range vector stands where a value is needed")
            return self._pinned(node, grid, self._instant_vector).select("key", "labels", "step", "v")
        if isinstance(node, Subquery):
            raise MetricError("a subquery stands where a value is needed")
        if isinstance(node, Negative):
            inner = self.eval(node.inner, grid)
            return -inner if isinstance(inner, Column) else self._plain(inner.withColumn("v", -F.col("v")))
        if isinstance(node, Aggregate):
            return self._aggregate(node, grid)
        if isinstance(node, Binary):
            return self._binary(node, grid)
        return self._call(node, grid)

    def _plain(self, vector: DataFrame) -> DataFrame:
        """Without the metric's name; two series that become one are an error."""
        named = _labelled(vector, _without(F.col("labels"), ("__name__",)), "step", "v")
        merged = named.groupBy("key", "step").agg(F.first("labels").alias("labels"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
        ok = F.when(F.col("n") == 1, F.col("v")).otherwise(F.raise_error(F.lit("several series have the same labels")).cast("double"))
        return merged.select("key", "labels", "step", ok.alias("v"))

    def _mapped(self, vector: DataFrame, value: Column) -> DataFrame:
        return self._plain(self._bound(vector, value).withColumn("v", value).where("v is not null"))

    def _bound(self, frame: DataFrame, value: Column) -> DataFrame:
        """The frame with the scalars that a column reads, joined by step; each has at most a row per step of the grid."""
        for name in sorted(set(re.findall(r"__scalar_[0-9a-f]+", str(value)))):
            if name not in frame.columns:
                frame = frame.join(F.broadcast(self._scalars[name]), "step", "left").withColumn(name, F.coalesce(name, F.lit(NAN)))
        return frame

    def _scalar(self, node, grid: Grid) -> Column:
        found = self.eval(node, grid)
        if not isinstance(found, Column):
            raise MetricError("a scalar is needed")
        return found

    def _vector(self, node, grid: Grid) -> DataFrame:
        found = self.eval(node, grid)
        if not isinstance(found, DataFrame):
            raise MetricError("a vector is needed")
        return found

    def _aggregate(self, node: Aggregate, grid: Grid) -> DataFrame:
        vector = self._vector(node.inner, grid)
        labels = _without(F.col("labels"), (*node.labels, "__name__")) if node.without else _only(F.col("labels"), node.labels)
        v = F.col("v")
        if node.name in ("topk", "bottomk"):
            ordered = [F.isnan(v), v.desc() if node.name == "topk" else v.asc(), "key"]
            k = self._scalar(node.parameter, grid)
            ranked = self._bound(vector, k).withColumn("__group", key_of(labels)).withColumn("__r", F.row_number().over(Window.partitionBy("__group", "step").orderBy(*ordered)))
            return ranked.where(F.col("__r") <= k).select("key", "labels", "step", "v")
        grouped = vector.withColumn("__labels", labels)
        if node.name == "count_values":
            shown = F.when(v == F.floor(v), v.cast("decimal(38,0)").cast("string")).otherwise(v.cast("string"))
            grouped = grouped.withColumn("__labels", F.map_concat(_without(F.col("__labels"), (node.parameter.value,)), F.create_map(F.lit(node.parameter.value), shown)))
        grouped = _labelled(grouped, F.col("__labels"), "step", "v").groupBy("key", "step")
        seen = _nan_as_null(v)
        made = {
            "sum": lambda: F.sum(v),
            "avg": lambda: F.avg(v),
            "count": lambda: F.count(F.lit(1)).cast("double"),
            "count_values": lambda: F.count(F.lit(1)).cast("double"),
            "group": lambda: F.max(F.lit(1.0)),
            "min": lambda: F.coalesce(F.min(seen), F.lit(NAN)),
            "max": lambda: F.coalesce(F.max(seen), F.lit(NAN)),
            "stddev": lambda: F.stddev_pop(v),
            "stdvar": lambda: F.var_pop(v),
            "quantile": lambda: F.array_sort(F.collect_list(v)),
        }[node.name]()
        out = grouped.agg(F.first("labels").alias("labels"), made.alias("v"))
        if node.name == "quantile":
            q = self._scalar(node.parameter, grid)
            out = self._bound(out, q).withColumn("v", F.when(F.exists("v", F.isnan), NAN).otherwise(_quantile(q, F.col("v"))))
        return out.select("key", "labels", "step", "v")

    def _binary(self, node: Binary, grid: Grid):
        left, right = self.eval(node.left, grid), self.eval(node.right, grid)
        if isinstance(left, str) or isinstance(right, str):
            raise MetricError("operators take no strings")
        compares = node.operator in ("==", "!=", "<", "<=", ">", ">=")
        if node.operator in ("and", "or", "unless"):
            return self._set(node, left, right)
        a_scalar, b_scalar = isinstance(left, Column), isinstance(right, Column)
        if a_scalar and b_scalar:
            if compares and not node.bool_result:
                raise MetricError("scalars are compared with bool")
            made = _operate(node.operator, left, right)
            return made.cast("double") if compares else made
        if a_scalar or b_scalar:
            vector = right if a_scalar else left
            v = F.col("v")
            made = _operate(node.operator, left, v) if a_scalar else _operate(node.operator, v, right)
            if compares and not node.bool_result:
                return self._bound(vector, made).where(made).select("key", "labels", "step", "v")
            return self._mapped(vector, made.cast("double"))
        return self._matched(node, left, right, compares)

    def _match_key(self, matching: Matching) -> Column:
        labels = F.col("labels")
        return key_of(_only(labels, matching.labels) if matching.on else _without(labels, (*matching.labels, "__name__")))

    def _set(self, node: Binary, left, right) -> DataFrame:
        if isinstance(left, Column) or isinstance(right, Column):
            raise MetricError("set operators take vectors")
        m = self._match_key(node.matching)
        a, b = left.withColumn("__m", m), right.withColumn("__m", m)
        columns = ["key", "labels", "step", "v"]
        if node.operator == "or":
            rest = b.join(a.select("__m", "step").distinct(), ["__m", "step"], "left_anti")
            return a.select(*columns).unionByName(rest.select(*columns))
        return a.join(b.select("__m", "step").distinct(), ["__m", "step"], "left_semi" if node.operator == "and" else "left_anti").select(*columns)

    def _matched(self, node: Binary, left: DataFrame, right: DataFrame, compares: bool) -> DataFrame:
        m, matching = self._match_key(node.matching), node.matching
        many_left = matching.group != "group_right"
        many, one = (left, right) if many_left else (right, left)
        one = one.withColumn("__m", m).groupBy("__m", "step").agg(F.first("labels").alias("__labels"), F.first("v").alias("__v"), F.count(F.lit(1)).alias("__n"))
        checked = F.when(F.col("__n") == 1, F.col("__v")).otherwise(F.raise_error(F.lit("several series match on the one side")).cast("double"))
        both = many.withColumn("__m", m).join(one.withColumn("__v", checked), ["__m", "step"])
        if not matching.group:
            counted = Window.partitionBy("__m", "step")
            both = both.withColumn("v", F.when(F.count(F.lit(1)).over(counted) == 1, F.col("v")).otherwise(F.raise_error(F.lit("several series match: use group_left or group_right")).cast("double")))
        a, b = (F.col("v"), F.col("__v")) if many_left else (F.col("__v"), F.col("v"))
        made = _operate(node.operator, a, b)
        if compares and not node.bool_result:
            both = both.where(made).withColumn("v", a)
        else:
            both = both.withColumn("v", made.cast("double"))
        if matching.group:
            labels = F.col("labels") if compares and not node.bool_result else _without(F.col("labels"), ("__name__",))
            if matching.include:
                given = F.map_filter(F.col("__labels"), lambda k, v: k.isin(*matching.include))
                labels = F.map_concat(_without(labels, matching.include), given)
        elif matching.on:
            labels = _only(F.col("labels"), matching.labels)
        else:
            labels = _without(F.col("labels"), (*matching.labels, *(() if compares and not node.bool_result and not matching.labels else ("__name__",))))
        return _labelled(both, labels, "step", "v")

    def _call(self, node: Call, grid: Grid):
        name, arguments = node.name, node.arguments
        fewest, most = (1, 1) if name in FROM_SUMMARY or name in FROM_SAMPLES or name in ELEMENT else (0, 1) if name in CLOCK else ARGUMENTS.get(name, (None, None))
        if fewest is None:
            raise MetricError(f"unknown function {name!r}")
        if not fewest <= len(arguments) <= most:
            raise MetricError(f"{name} takes {fewest if fewest == most else f'{fewest} to {most}'} arguments, not {len(arguments)}")
        if name in ("rate", "increase", "delta", "changes", "resets") and isinstance(arguments[0], Selector) and arguments[0].extended and arguments[0].range is not None:
            return self._extended_call(name, arguments[0], grid)
        if name in ("rate", "increase", "delta"):
            rows, length = self._windows(arguments[0], grid, (*_ENDS, "drop") if name != "delta" else _ENDS)
            made = _extrapolated(F.col("s"), F.col("step"), length, name != "delta", name == "rate")
            return self._mapped(self._expanded(rows, grid), made)
        if name in FROM_SUMMARY or name in FROM_SAMPLES:
            need, made = FROM_SUMMARY.get(name) or (None, FROM_SAMPLES[name])
            rows, _ = self._windows(arguments[0], grid, need)
            rows = rows.withColumn("v", made(F.col("s"))).where("v is not null").drop("s")
            rows = self._expanded(rows, grid).select("key", "labels", "step", "v")
            return rows if name in ("last_over_time", "first_over_time") else self._plain(rows)
        if name == "predict_linear":
            rows, _ = self._windows(arguments[0], grid)
            slope, mx, my = _regression(F.col("s"))
            rows = self._expanded(rows.withColumn("__r", F.struct(F.element_at("s", 1)["t"].alias("t"), slope.alias("b"), mx.alias("x"), my.alias("y"))).drop("s"), grid)
            r = F.col("__r")
            return self._mapped(rows, r["y"] + r["b"] * ((F.col("step") - r["t"]) / 1e6 - r["x"] + self._scalar(arguments[1], grid)))
        if name == "quantile_over_time":
            rows, _ = self._windows(arguments[1], grid)
            sorted_rows = rows.withColumn("s", F.when(~_has_nan(F.col("s")), _sorted_values(F.col("s"))))
            made = F.when(F.col("s").isNull(), NAN).otherwise(_quantile(self._scalar(arguments[0], grid), F.col("s")))
            if isinstance(arguments[0], Number):  # one value for all steps of a window
                return self._plain(self._expanded(sorted_rows.withColumn("v", made).drop("s"), grid).select("key", "labels", "step", "v"))
            return self._mapped(self._expanded(sorted_rows, grid), made)
        if name in ("double_exponential_smoothing", "holt_winters"):
            rows, _ = self._windows(arguments[0], grid)
            return self._mapped(self._expanded(rows, grid), _smoothed(F.col("s"), *(self._scalar(a, grid) for a in arguments[1:])))
        if name in ("absent", "absent_over_time"):
            rows = self._expanded(self._windows(arguments[0], grid, ("n",))[0].select("a", "z").distinct(), grid) if name == "absent_over_time" else self._vector(arguments[0], grid)
            selector = arguments[0]
            known = [x for label, o, value in getattr(selector, "matchers", ()) if o == "=" for x in (F.lit(label), F.lit(value))]
            labels = F.create_map(*known) if known else F.create_map().cast("map<string,string>")
            return _labelled(self._steps(grid).join(rows.select("step").distinct(), "step", "left_anti").withColumn("v", F.lit(1.0)), labels, "step", "v")
        if name == "time":
            return F.col("step") / 1e6
        if name == "pi":
            return F.lit(math.pi)
        if name == "vector":
            value = self._scalar(arguments[0], grid)
            return _labelled(self._bound(self._steps(grid), value).withColumn("v", value), F.create_map().cast("map<string,string>"), "step", "v")
        if name in CLOCK:
            vector = self._vector(arguments[0], grid) if arguments else self._call(Call("vector", (Call("time"),)), grid)
            return self._mapped(vector, _clock(F.col("v"), CLOCK[name]))
        if name in ELEMENT:
            return self._mapped(self._vector(arguments[0], grid), ELEMENT[name](F.col("v")).cast("double"))
        if name == "timestamp":
            if isinstance(arguments[0], Selector):
                # offset moves a sample's time, which is told as it was stored
                found = self._pinned(arguments[0], grid, lambda n, g: self._instant_vector(n, g, "t").withColumn("v", F.col("v") - n.offset / 1000))
                return self._plain(found.select("key", "labels", "step", "v"))
            return self._mapped(self._vector(arguments[0], grid), F.col("step") / 1e6)
        if name == "round":
            to = self._scalar(arguments[1], grid) if len(arguments) > 1 else F.lit(1.0)
            return self._mapped(self._vector(arguments[0], grid), F.when(to == 0, NAN).otherwise(F.floor(F.col("v") / to + 0.5) * to))
        if name in ("clamp", "clamp_min", "clamp_max"):
            low = self._scalar(arguments[1], grid) if name != "clamp_max" else F.lit(float("-inf"))
            high = self._scalar(arguments[-1], grid) if name != "clamp_min" else F.lit(float("inf"))
            v = F.col("v")
            return self._mapped(self._vector(arguments[0], grid), F.when(low <= high, F.when(F.isnan(v), v).otherwise(F.greatest(low, F.least(high, v)))))
        if name == "label_replace":
            return self._label_replace(node, grid)
        if name == "label_join":
            target, separator, *sources = (a.value for a in arguments[1:])
            made = F.concat_ws(separator, *(F.coalesce(F.element_at("labels", s), F.lit("")) for s in sources))
            return self._relabelled(self._vector(arguments[0], grid), target, made)
        if name in ("sort", "sort_desc"):
            v = F.col("v")
            return self._vector(arguments[0], grid).orderBy("step", F.isnan(v), v.desc() if name == "sort_desc" else v.asc(), "key")
        if name in ("sort_by_label", "sort_by_label_desc"):
            parts = []
            for a in arguments[1:]:
                natural = F.array_join(F.transform(F.regexp_extract_all(F.coalesce(F.element_at("labels", a.value), F.lit("")), F.lit(r"(\d+|\D+)")), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")
                parts.append(natural.desc() if name.endswith("desc") else natural.asc())
            return self._vector(arguments[0], grid).orderBy("step", *parts, "key")
        if name.startswith("histogram_"):
            if any(self._is_native(a) for a in arguments):
                return self._native(name, arguments, grid)
            if name == "histogram_quantile":
                return self._histogram_quantile(node, grid)
            return self._vector(arguments[-1], grid).where(F.lit(False))  # floats are no histograms
        if name == "scalar":
            return self._as_scalar(self._vector(arguments[0], grid), grid)
        raise MetricError(f"unknown function {name!r}")

    def _extended_call(self, name: str, node: Selector, grid: Grid) -> DataFrame:
        smooth = node.extended == "smoothed"
        if smooth and name in ("changes", "resets"):
            raise MetricError("smoothed is for rate, increase and delta")
        look, length = LOOKBACK_MS * 1000, node.range * 1000
        rows = self._pinned(node, grid, lambda n, g: self._extended_windows(n, g, length + look, look if smooth else 0)[0])
        s, end = F.col("s"), F.col("step")
        if name in ("changes", "resets"):
            after = F.size(F.filter(s, lambda x: x["t"] <= end - length))
            kept = F.slice(s, F.greatest(after, F.lit(1)), F.size(s))
            return self._mapped(rows, F.when(F.element_at(s, -1)["t"] > end - length, _neighbours(kept, name, "v", "v")))
        made = _edge_to_edge(s, end - length, end, smooth, name != "delta")
        return self._mapped(rows, made / (length / 1e6) if name == "rate" else made)

    # -- native histograms: their cells are series of their own, on which sums and averages work as on others --

    def _is_native(self, node) -> bool:
        inner = node.inner if isinstance(node, Aggregate) else node
        return isinstance(inner, Selector) and inner.name in self.histograms and inner.range is None

    def _native(self, name: str, arguments: tuple, grid: Grid) -> DataFrame:
        node = arguments[-1]
        if isinstance(node, Aggregate) and node.name not in ("sum", "avg"):
            raise MetricError("histograms are aggregated by sum and avg")
        cell = ("__index", "__schema", "__zero")
        selector = node.inner if isinstance(node, Aggregate) else node
        over = lambda view: replace(node, inner=replace(selector, name=selector.name + view)) if isinstance(node, Aggregate) else replace(selector, name=selector.name + view)
        own = over(":native")
        if isinstance(own, Aggregate) and not own.without:
            own = replace(own, labels=(*own.labels, *cell))
        cells = self._vector(own, grid)
        part = F.struct(F.element_at("labels", "__index").try_cast("int").alias("index"), F.col("v").alias("count"))
        cells = cells.withColumns({"__p": part, "__s": F.element_at("labels", "__schema").cast("int"), "__z": F.element_at("labels", "__zero").cast("double")})
        cells = _labelled(cells, _without(F.col("labels"), (*cell, "__name__")), "step", "__p", "__s", "__z")
        sums = _labelled(self._vector(over("_sum"), grid), _without(F.col("labels"), ("__name__",)), "step", "v").select("key", "step", F.col("v").alias("__sum"))
        zero, rest = F.when(F.col("__p.index").isNull(), F.col("__p.count")), F.when(F.col("__p.index").isNotNull(), F.col("__p"))
        schema = F.when(F.count_distinct("__s") == 1, F.max("__s")).otherwise(F.raise_error(F.lit("histograms of several schemas")).cast("int"))
        rows = cells.groupBy("key", "step").agg(F.first("labels").alias("labels"), schema.alias("schema"), F.max("__z").alias("zero_threshold"), F.coalesce(F.sum(zero), F.lit(0.0)).alias("zero_count"), F.sum("__p.count").alias("count"), F.array_sort(F.collect_list(rest)).alias("buckets"))
        rows = rows.join(sums, ["key", "step"]).withColumn("h", F.struct("schema", "zero_threshold", "zero_count", "count", F.col("__sum").alias("sum"), "buckets"))
        h = F.col("h")

        def number(i: int) -> float:
            inner = arguments[i].inner if isinstance(arguments[i], Negative) else arguments[i]
            if not isinstance(inner, Number):
                raise MetricError(f"{name} takes its parameters as numbers")
            return -inner.value if isinstance(arguments[i], Negative) else inner.value

        made = {
            "histogram_count": lambda: h["count"], "histogram_sum": lambda: h["sum"], "histogram_avg": lambda: H.histogram_avg(h), "histogram_stdvar": lambda: H.histogram_stdvar(h), "histogram_stddev": lambda: F.sqrt(H.histogram_stdvar(h)),
            "histogram_fraction": lambda: H.histogram_fraction(number(0), number(1), h), "histogram_quantile": lambda: H.histogram_quantile(number(0), h),
        }[name]()
        return rows.select("key", "labels", "step", made.alias("v")).where("v is not null")

    def _as_scalar(self, vector: DataFrame, grid: Grid) -> Column:
        """The value of the only series at each step, NaN where there is none or more: a column that is joined by step where it is used."""
        single = vector.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v")).where("n = 1")
        name = f"__scalar_{uuid.uuid4().hex}"
        self._scalars[name] = single.select("step", F.col("v").alias(name))
        return F.col(name)

    def _relabelled(self, vector: DataFrame, target: str, value: Column) -> DataFrame:
        if not target.isidentifier():
            raise MetricError(f"{target!r} is not a label name")
        kept = _without(F.col("labels"), (target,))
        labels = F.when(value == "", kept).otherwise(F.map_concat(kept, F.create_map(F.lit(target), value)))
        return _labelled(vector, labels, "step", "v")

    def _label_replace(self, node: Call, grid: Grid) -> DataFrame:
        target, replacement, source, pattern = (a.value for a in node.arguments[1:])
        own = F.coalesce(F.element_at("labels", source), F.lit(""))
        whole = f"^(?s:{pattern})$"
        old = F.coalesce(F.element_at("labels", target), F.lit(""))
        return self._relabelled(self._vector(node.arguments[0], grid), target, F.when(own.rlike(whole), F.regexp_replace(own, whole, replacement)).otherwise(old))

    def _histogram_quantile(self, node: Call, grid: Grid) -> DataFrame:
        """From cumulative buckets by ``le``; needs the one at infinity."""
        q = self._scalar(node.arguments[0], grid)
        vector = self._vector(node.arguments[1], grid)
        le = F.element_at("labels", "le")
        bound = F.when(le.isin("+Inf", "Inf"), float("inf")).otherwise(F.try_cast(le, "double") if hasattr(F, "try_cast") else le.try_cast("double"))
        rows = _labelled(vector.withColumn("__le", bound).where("__le is not null"), _without(F.col("labels"), ("le", "__name__")), "step", "v", "__le")
        rows = rows.groupBy("key", "step", "__le").agg(F.first("labels").alias("labels"), F.sum("v").alias("v"))
        rows = rows.groupBy("key", "step").agg(F.first("labels").alias("labels"), F.array_sort(F.collect_list(F.struct(F.col("__le").alias("le"), "v"))).alias("b"))
        raised = F.aggregate("b", F.array().cast("array<struct<le:double,v:double>>"), lambda a, x: F.concat(a, F.array(F.struct(x["le"].alias("le"), F.greatest(x["v"], F.coalesce(F.try_element_at(a, F.lit(-1))["v"], x["v"])).alias("v")))))
        rows = rows.withColumn("b", raised)
        b, n = F.col("b"), F.size("b")
        total = F.element_at(b, -1)["v"]
        rank = q * total
        i = F.coalesce(F.array_position(F.transform(b, lambda x: x["v"] >= rank), F.lit(True)), n.cast("long")).cast("int")
        here, before = F.element_at(b, i), F.try_element_at(b, F.when(i > 1, i - 1))
        low = F.when(i > 1, before["le"]).otherwise(0.0)
        under = F.when(i > 1, before["v"]).otherwise(0.0)
        inside = low + (here["le"] - low) * F.when(here["v"] > under, (rank - under) / (here["v"] - under)).otherwise(0.0)
        value = (
            F.when((n < 2) | (F.element_at(b, -1)["le"] != float("inf")) | (total == 0) | F.isnan(q), NAN)
            .when(q < 0, float("-inf"))
            .when(q > 1, float("inf"))
            .when(i == n, F.element_at(b, n - 1)["le"])
            .when((i == 1) & (here["le"] <= 0), here["le"])
            .otherwise(inside)
        )
        return self._bound(rows, value).select("key", "labels", "step", value.alias("v"))


def _tag(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _matches_empty(operator: str, value: str) -> bool:
    """Whether a series without the label matches."""
    hit = value == "" if operator in ("=", "!=") else bool(re.fullmatch(value, "", re.S))
    return hit == (operator in ("=", "=~"))


def _matches(label: str, operator: str, value: str, kind: str) -> Column:
    """A test on the tag's own column where that says the same; a null or empty tag is no label."""
    own = F.col(label)
    if kind == "string":
        if operator == "=":
            return own == value if value else own.isNull() | (own == "")
        if operator == "!=":
            return own.isNull() | (own != value) if value else own.isNotNull() & (own != "")
        if not _matches_empty("=~", value):
            hit = own.isNotNull() & own.rlike(f"^(?s:{value})$")
            return hit if operator == "=~" else ~hit
    if kind in ("tinyint", "smallint", "int", "bigint") and operator == "=" and re.fullmatch(r"-?[1-9]\d{0,17}|0", value):
        return own == F.lit(int(value))
    test = _tag(label) == value if operator in ("=", "!=") else _tag(label).rlike(f"^(?s:{value})$")
    return test if operator in ("=", "=~") else ~test


def _operate(operator: str, a: Column, b: Column) -> Column:
    inf = float("inf")
    same = (a == b) & ~F.isnan(a) & ~F.isnan(b)
    ordered = ~F.isnan(a) & ~F.isnan(b)
    return {
        "+": lambda: a + b,
        "-": lambda: a - b,
        "*": lambda: a * b,
        "/": lambda: F.when(b == 0, F.when((a == 0) | F.isnan(a), NAN).when(a > 0, inf).otherwise(-inf)).otherwise(F.try_divide(a, b)),
        "%": lambda: F.when(b == 0, NAN).otherwise(F.try_mod(a, b)),
        "^": lambda: F.pow(a, b),
        "==": lambda: same,
        "!=": lambda: ~same,
        "<": lambda: ordered & (a < b),
        "<=": lambda: ordered & (a <= b),
        ">": lambda: ordered & (a > b),
        ">=": lambda: ordered & (a >= b),
    }[operator]()


__all__ = ["Engine", "Grid", "MetricError", "SyntaxProblem"]
