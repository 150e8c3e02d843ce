"""Deletes as requests over points, and measurements dropped and brought back."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Delete:
    """Points whose tags all equal the given ones and whose time lies in [start, end]; an end left out is open.

    A null tag equals nothing but None. ``written``: points written later (a higher sequence) stay.
    """

    tags: dict = field(default_factory=dict)
    start: datetime | None = None
    end: datetime | None = None
    written: int | None = None

    def covers(self, time: str, sequence: str | None = None) -> Column:
        hit = F.lit(True)
        for tag, value in self.tags.items():
            hit &= F.col(tag).eqNullSafe(F.lit(value))
        if self.start is not None:
            hit &= F.col(time) >= F.lit(self.start).cast("timestamp_ntz")
        if self.end is not None:
            hit &= F.col(time) <= F.lit(self.end).cast("timestamp_ntz")
        if self.written is not None:
            if sequence is None:
                raise ValueError("a delete up to a sequence needs the points' sequence column")
            hit &= F.col(sequence) <= self.written
        return F.coalesce(hit, F.lit(False))


def apply(points: DataFrame, deletes: list[Delete], time: str, sequence: str | None = None) -> DataFrame:
    """The points that no delete covers: one filter, which the scan can push down."""
    for d in deletes:
        points = points.where(~d.covers(time, sequence))
    return points


def report(points: DataFrame, delete: Delete, tags: list[str], time: str, sequence: str | None = None) -> DataFrame:
    """(tags, deleted, remaining, partial) of each series that a delete touches; partial: some of its points stay."""
    hit = delete.covers(time, sequence)
    counted = points.groupBy(*tags).agg(F.count_if(hit).alias("deleted"), F.count_if(~hit).alias("remaining"))
    return counted.where("deleted > 0").withColumn("partial", F.col("remaining") > 0)


class Shelf:
    """Measurements by name; a dropped one is out of sight until it is restored or purged."""

    def __init__(self):
        self._live: dict[str, DataFrame] = {}
        self._dropped: dict[str, DataFrame] = {}

    def add(self, name: str, points: DataFrame) -> None:
        if name in self._dropped:
            raise ValueError(f"{name} was dropped: restore or purge it first")
        self._live[name] = points

    def get(self, name: str) -> DataFrame:
        if name not in self._live:
            raise KeyError(f"no measurement {name!r}" + (": it was dropped" if name in self._dropped else ""))
        return self._live[name]

    def names(self) -> list[str]:
        return sorted(self._live)

    def drop(self, name: str) -> None:
        self._dropped[name] = self.get(name)
        del self._live[name]

    def restore(self, name: str) -> DataFrame:
        if name not in self._dropped:
            raise KeyError(f"{name!r} was not dropped")
        self._live[name] = self._dropped.pop(name)
        return self._live[name]

    def purge(self, name: str) -> None:
        if self._dropped.pop(name, None) is None:
            raise KeyError(f"{name!r} was not dropped")
