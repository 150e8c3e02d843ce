"""Conditions with a history, detectors and forecasts over streams, with their state kept by series.

Every function takes change events as a stream (``triggers.change_events``). Within a micro-batch a series is taken in
the order of ``seq``; a series' state is a few numbers or a buffer of stated length, so that state grows with series only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tempora.functions.buckets import time_bucket
from tempora.functions.kernels import MODELS
from tempora.session import ship
from tempora.streaming import triggers

_FIELDS, _TAGS = "map<string,double>", "map<string,string>"


def _by_series(events: DataFrame, columns: dict[str, Column], out: str, state: str, start: Callable[[], tuple], step: Callable) -> DataFrame:
    """(series, out) of step(state, *values of the columns), which gives the next state and a list of rows, for each event."""
    ship(events.sparkSession)
    names, given = [n.split()[0] for n in out.split(", ")], ["seq", *columns]
    rows = events.select(triggers.series_key().alias("series"), "seq", *(c.alias(n) for n, c in columns.items()))

    def run(key, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        now, made = tuple(held.get) if held.exists else start(), []
        for row in pd.concat(list(batches)).sort_values("seq", kind="stable")[given].itertuples(index=False, name=None):
            now, more = step(now, *row)
            made += [(*key, *r) for r in more]
        held.update(now)
        yield pd.DataFrame(made, columns=["series", *names])

    return rows.groupBy("series").applyInPandasWithState(run, f"series string, {out}", state, "append", "NoTimeout")


def with_history(events: DataFrame, wanted: list[tuple[str, int]]) -> DataFrame:
    """Events with ``__history``: the last n values (nulls and NaN left out) of each wanted (field, n) in the series, oldest first, under ``field:n``."""
    longest = max(n for _, n in wanted)
    fields = sorted({f for f, _ in wanted})
    payload = {"event_timestamp": F.col("event_timestamp"), "event": F.to_json(F.struct("event_type", "measurement")), "tags": F.to_json("tags"), "fields": F.to_json("fields")}
    values = {f"v{i}": F.col("fields")[f] for i, f in enumerate(fields)}

    def step(state, seq, at, event, tags, own, *now):
        kept = [[*held, math.nan if v is None else v][-longest:] for held, v in zip(state, now, strict=True)]
        return tuple(kept), [(seq, at, event, tags, own, *kept)]

    out = "seq long, event_timestamp timestamp, event string, tags string, fields string, " + ", ".join(f"h{i} array<double>" for i in range(len(fields)))
    state = ", ".join(f"h{i} array<double>" for i in range(len(fields)))
    made = _by_series(events, payload | values, out, state, lambda: tuple([] for _ in fields), step)
    last = lambda f, n: F.filter(F.slice(h := F.col(f"h{fields.index(f)}"), -F.least(F.size(h), F.lit(n)), n), lambda x: x.isNotNull() & ~F.isnan(x))
    pairs = [x for f, n in wanted for x in (F.lit(f"{f}:{n}"), last(f, n))]
    event = F.from_json("event", "event_type string, measurement string")
    return made.select("seq", event["event_type"].alias("event_type"), event["measurement"].alias("measurement"), "event_timestamp", F.from_json("tags", _TAGS).alias("tags"), F.from_json("fields", _FIELDS).alias("fields"), F.col("series").alias("__series"), F.create_map(*pairs).alias("__history"))


def anomalies(events: DataFrame, field: str, threshold: float = 3.0, min_fit_points: int = 30, max_buffer: int = 1000, refit_every: int = 100) -> DataFrame:
    """(series, seq, event_timestamp, value, z, score, is_anomaly) of each value behind a series' first ``min_fit_points``.

    Mean and deviation are those of the buffer, the last ``max_buffer`` values before the fit; a fit is renewed every
    ``refit_every`` values (0: never). Events without the field are left out.
    """

    def step(state, seq, at, value):
        held, mean, deviation, since = state
        made = []
        if mean is not None:
            z = abs(value - mean) / max(deviation, abs(mean) * 1e-9, 1e-12)
            made = [(seq, at, value, z, 1 / (1 + math.exp(min(700.0, -2 * (z - threshold)))), z > threshold)]
        held, since = [*held, value][-max_buffer:], since + 1
        if (mean is None and len(held) >= min_fit_points) or (mean is not None and refit_every and since >= refit_every):
            mean, deviation, since = float(np.mean(held)), float(np.std(held, ddof=1)) if len(held) > 1 else 0.0, 0
        return (held, mean, deviation, since), made

    rows = events.where(F.col("fields")[field].isNotNull())
    out = "seq long, event_timestamp timestamp, value double, z double, score double, is_anomaly boolean"
    return _by_series(rows, {"event_timestamp": F.col("event_timestamp"), "value": F.col("fields")[field]}, out, "held array<double>, mean double, deviation double, since long", lambda: ([], None, None, 0), step)


def forecasts(events: DataFrame, field: str, horizon: int, model: str = "ses", min_fit_points: int = 30, max_buffer: int = 1000, refit_every: int = 10) -> DataFrame:
    """(series, seq, event_timestamp, step, value, lower, upper): the next ``horizon`` values, made anew every ``refit_every`` values from the last ``max_buffer``."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; known: {', '.join(MODELS)}")

    def step(state, seq, at, value):
        held, since = state
        held, since = [*held, value][-max_buffer:], since + 1
        if len(held) < min_fit_points or since < refit_every:
            return (held, since), []
        found = MODELS[model](np.array(held), horizon)
        return (held, 0), [(seq, at, i + 1, float(found.mean[i]), float(found.lower[i]), float(found.upper[i])) for i in range(horizon)]

    rows = events.where(F.col("fields")[field].isNotNull())
    out = "seq long, event_timestamp timestamp, step long, value double, lower double, upper double"
    return _by_series(rows, {"event_timestamp": F.col("event_timestamp"), "value": F.col("fields")[field]}, out, "held array<double>, since long", lambda: ([], refit_every), step)


def alerts(scored: DataFrame, name: str, threshold: float, cooldown_s: float = 0.0) -> DataFrame:
    """(trigger, series, event_timestamp) of scores over a threshold, with a cooldown by series."""
    hits = scored.where(F.col("score") > threshold).select(F.lit(name).alias("trigger"), "series", "event_timestamp")
    return triggers.stream_cooldown(hits, cooldown_s) if cooldown_s else hits


def calendar_rollup(events: DataFrame, field: str, width: str, late: str, tz: str | None = None) -> DataFrame:
    """(start, series, n, sum, min, max) by calendar buckets, such as months in a zone.

    The watermark is on the buckets' starts: a bucket is given out once one that starts more than ``late`` after it has been seen.
    """
    start = time_bucket(width, F.col("event_timestamp").cast("timestamp_ntz"), tz).cast("timestamp")
    rows = events.withColumn("start", start).withWatermark("start", late)
    v = F.col("fields")[field]
    return rows.groupBy("start", triggers.series_key().alias("series")).agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came later than the watermark, of the progress reports that the query still holds."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def store(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to Parquet under ``path``, a folder for each micro-batch: one that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
