"""Measurements: last write wins, last values, retention, cardinality, roll-ups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.aggregates import NATIVE
from tempora.functions.buckets import time_bucket


def last_write_wins(points: DataFrame, tags: list[str], time: str, sequence: str) -> DataFrame:
    """One row per series and time: the latest written. A maximum, combined before the shuffle."""
    others = [c for c in points.columns if c not in (*tags, time)]
    latest = points.groupBy(*tags, time).agg(F.max_by(F.struct(*others), F.col(sequence)).alias("__row"))
    return latest.select(*tags, time, "__row.*").select(*points.columns)


def last_value(points: DataFrame, tags: list[str], time: str, fields: list[str]) -> DataFrame:
    return points.groupBy(*tags).agg(F.max_by(F.struct(time, *fields), F.col(time)).alias("__row")).select(*tags, "__row.*")


def retain(points: DataFrame, time: str, keep: str) -> DataFrame:
    """Rows younger than ``keep`` (an interval), counted from the newest row or now, whichever is earlier."""
    newest = points.agg(F.least(F.max(time), F.localtimestamp()).alias("__newest"))
    cut = newest.first()[0]
    return points if cut is None else points.where(F.col(time) >= F.lit(cut).cast("timestamp_ntz") - F.expr(f"INTERVAL {keep}"))


def cardinality(points: DataFrame, tags: list[str]) -> DataFrame:
    """Series, and distinct values by tag."""
    series = points.select(*tags).distinct()
    counts = series.agg(F.count(F.lit(1)).alias("series"), *(F.countDistinct(t).alias(t) for t in tags))
    return counts.selectExpr("'series' AS name", "series AS n").unionByName(counts.selectExpr(f"stack({len(tags)}, {', '.join(f'{t!r}, {t}' for t in tags)}) AS (name, n)"))


@dataclass
class Rollup:
    """A declared roll-up: the fields' aggregates by tags and bucket, as ``<field>_<aggregate>``."""

    name: str
    width: str
    fields: list[str]
    aggregates: list[str]
    tags: list[str] = field(default_factory=list)
    time: str = "ts"
    tz: str | None = None

    def of(self, points: DataFrame) -> DataFrame:
        bucket = time_bucket(self.width, F.col(self.time), self.tz).alias(self.time)
        outputs = [NATIVE[a](F.col(f), F.col(self.time)).alias(f"{f}_{a}") for f in self.fields for a in self.aggregates]
        return points.groupBy(*self.tags, bucket).agg(*outputs)

    def view(self, materialised: DataFrame, points: DataFrame, watermark) -> DataFrame:
        """Stored buckets below the watermark, live ones from there on."""
        stored = materialised.where(F.col(self.time) < F.lit(watermark))
        return stored.unionByName(self.of(points.where(F.col(self.time) >= F.lit(watermark))))

    def repair(self, materialised: DataFrame, points: DataFrame, start, end) -> DataFrame:
        """Stored buckets with those that touch [start, end] worked out again."""
        low, high = time_bucket(self.width, F.lit(start).cast("timestamp_ntz"), self.tz), time_bucket(self.width, F.lit(end).cast("timestamp_ntz"), self.tz)
        touched = time_bucket(self.width, F.col(self.time), self.tz).between(low, high)
        return materialised.where(~F.col(self.time).between(low, high)).unionByName(self.of(points.where(touched)))


def cascade_order(rollups: dict[str, str]) -> list[str]:
    """Targets by source, sources first; cycles are refused. ``rollups``: target to source."""
    done: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError("roll-ups form a cycle: " + " -> ".join((*path, name)))
        if name in rollups and name not in done:
            visit(rollups[name], (*path, name))
            done.append(name)

    for name in rollups:
        visit(name, ())
    return done


def positions(points: DataFrame, tags: list[str], time: str, unique: str):
    """The window of a series by time."""
    return Window.partitionBy(*tags).orderBy(time, unique)
