"""Fluent query builder: scan, then downsample or aggregate, then window, then limit."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions import windows as W
from tempora.functions.aggregates import NATIVE
from tempora.functions.buckets import time_bucket

_COMPARE = {"=": "__eq__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}


@dataclass(frozen=True)
class Query:
    """An immutable plan over a DataFrame or table name; every step returns a new one."""

    source: DataFrame | str
    time: str = "_time"
    tags: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    filters: tuple[Column, ...] = ()
    start: datetime | None = None
    end: datetime | None = None
    back: timedelta | None = None
    groups: tuple[str, ...] = ()
    aggregates: tuple[str, ...] = ()
    bucket: tuple[str, str, str | None] | None = None
    window: tuple | None = None
    count: int | None = None
    skip: int | None = None
    only_presence: str | None = None

    def tag(self, name: str, value: str) -> Query:
        return replace(self, filters=(*self.filters, F.col(name) == F.lit(value)))

    def where_field(self, name: str, operator: str, value) -> Query:
        return replace(self, filters=(*self.filters, getattr(F.col(name), _COMPARE[operator])(F.lit(value))))

    def since(self, start: datetime) -> Query:
        return replace(self, start=start)

    def between(self, start: datetime, end: datetime) -> Query:
        """Both ends are included."""
        return replace(self, start=start, end=end)

    def last(self, back: timedelta) -> Query:
        return replace(self, back=back)

    def select(self, *fields: str) -> Query:
        return replace(self, fields=list(fields))

    def group_by(self, *tags: str) -> Query:
        return replace(self, groups=tags)

    def aggregate(self, *functions: str) -> Query:
        return replace(self, aggregates=functions)

    def downsample(self, width: str, function: str, tz: str | None = None) -> Query:
        return replace(self, bucket=(width, function, tz))

    def over(self, function: str, value: str = "value", **options) -> Query:
        """A window function by time. ``rank`` and ``dense_rank`` number the runs of equal values (or of equal ``order``) that follow each other in time; nulls equal nulls."""
        return replace(self, window=(function, value, options))

    def limit(self, n: int) -> Query:
        return replace(self, count=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def present(self, field_name: str) -> Query:
        """Only where the field has a value; values are not read."""
        return replace(self, only_presence=field_name)

    def _check(self) -> None:
        if self.skip is not None and self.count is None:
            raise ValueError("an offset needs a limit")
        if self.bucket and self.aggregates:
            raise ValueError("downsample and aggregate exclude each other")
        if self.start and self.end and self.start > self.end:
            raise ValueError("the range starts after its end")
        for name in (*self.aggregates, *((self.bucket[1],) if self.bucket else ())):
            if name not in NATIVE:
                raise ValueError(f"unknown aggregate {name!r}")

    def run(self, spark: SparkSession) -> DataFrame:
        self._check()
        rows = spark.table(self.source) if isinstance(self.source, str) else self.source
        at = F.col(self.time)
        for condition in self.filters:
            rows = rows.where(condition)
        if self.start:
            rows = rows.where(at >= F.lit(self.start).cast("timestamp_ntz"))
        if self.end:
            rows = rows.where(at <= F.lit(self.end).cast("timestamp_ntz"))
        if self.back:
            rows = rows.where(at >= F.localtimestamp() - F.lit(self.back))
        if self.only_presence:
            return rows.where(F.col(self.only_presence).isNotNull()).select(*self.tags, self.time)
        if self.bucket:
            width, function, tz = self.bucket
            bucket = time_bucket(width, at, tz).alias(self.time)
            outputs = [NATIVE[function](F.col(f), at).cast("double").alias(f if len(self.fields) == 1 else f"{f}_{function}") for f in self.fields]
            rows = rows.groupBy(*self.groups, bucket).agg(*outputs)
        elif self.aggregates:
            outputs = [NATIVE[a](F.col(f), at).alias(f"{f}_{a}") for f in self.fields for a in self.aggregates]
            rows = rows.groupBy(*self.groups).agg(*outputs)
        elif self.fields:
            rows = rows.select(*dict.fromkeys([*self.tags, self.time, *self.fields]))
        if self.window:
            rows = self._windowed(rows)
        if self.count is not None:
            keys = [self.time] if self.time in rows.columns else rows.columns
            rows = rows.orderBy(*keys)
            rows = rows.offset(self.skip).limit(self.count) if self.skip else rows.limit(self.count)
        return rows

    def _windowed(self, rows: DataFrame) -> DataFrame:
        function, value, options = self.window
        tags = [t for t in (self.groups or self.tags) if t in rows.columns]
        over, v = Window.partitionBy(*tags).orderBy(self.time), F.col(value)
        at = F.col(self.time)
        if function == "increase":
            stepped = rows.withColumn("__step", W.positive_step(v, over))
            return stepped.withColumn("increase", F.sum("__step").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")
        if function.startswith("range_"):
            frame = W.range_frame(tags, self.time, options["micros"])
            made = {"range_moving_average": F.avg(v), "range_sum": F.sum(v), "range_count": F.count(v)}[function]
            made = F.when(F.count(v).over(frame) > 0, made.over(frame))
            return rows.withColumn(function, made.cast("double"))
        if function in ("rank", "dense_rank"):
            ranked = F.col(options.get("order", value))
            begins = (F.row_number().over(over) == 1) | ~ranked.eqNullSafe(F.lag(ranked).over(over))
            so_far = over.rowsBetween(Window.unboundedPreceding, 0)
            begun = rows.withColumns({"__row": F.row_number().over(over), "__begins": begins})
            made = F.max(F.when(F.col("__begins"), F.col("__row"))) if function == "rank" else F.count_if("__begins")
            return begun.withColumn(function, made.over(so_far).cast("double")).drop("__row", "__begins")
        made = {
            "row_number": lambda: F.row_number().over(over),
            "lead": lambda: W.lead_or(v, over, options.get("offset", 1), options.get("default")),
            "lag": lambda: W.lag_or(v, over, options.get("offset", 1), options.get("default")),
            "delta": lambda: W.delta(v, over),
            "rate": lambda: W.rate(v, at, over),
            "irate": lambda: F.last(F.col("__rate")).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            "moving_average": lambda: W.moving_average(v, over, options["n"]),
            "cumulative_sum": lambda: W.cumulative_sum(v, over),
        }.get(function)
        if made is None:
            raise ValueError(f"unknown window function {function!r}")
        if function == "irate":
            rows = rows.withColumn("__rate", W.rate(v, at, over))
        return rows.withColumn(function, made().cast("double")).drop("__rate")
