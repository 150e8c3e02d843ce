"""Change events, trigger definitions and their evaluation over streams or batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.operators.walks import walk
from tempora.session import ship

#: The schema of change events.
EVENT = "seq bigint, event_type string, measurement string, event_timestamp timestamp, tags map<string,string>, fields map<string,double>"


def change_events(points: DataFrame, measurement: str, time: str, tags: list[str], fields: list[str], seq: str) -> DataFrame:
    """Written points as change events."""
    pairs = lambda names, kind: F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast(kind)))), lambda k, v: v.isNotNull())
    return points.select(F.col(seq).cast("long").alias("seq"), F.lit("point_written").alias("event_type"), F.lit(measurement).alias("measurement"), F.col(time).cast("timestamp").alias("event_timestamp"), pairs(tags, "string").alias("tags"), pairs(fields, "double").alias("fields"))


def subscribe(events: DataFrame, measurements: list[str] | None = None, tags: dict[str, str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    if measurements:
        events = events.where(F.col("measurement").isin(*measurements))
    if kinds:
        events = events.where(F.col("event_type").isin(*kinds))
    for k, v in (tags or {}).items():
        events = events.where(F.col("tags")[k] == v)
    return events


def series_key() -> Column:
    entries = F.array_sort(F.map_entries("tags"))
    return F.concat_ws("\u0002", F.col("measurement"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("\u0001"), e["value"])), "\u0002"))


@dataclass(frozen=True)
class Trigger:
    name: str
    measurement: str
    condition: str
    cooldown_s: float = 0.0
    deliver: str = "log"
    enabled: bool = True
    severity: tuple[float, float] | None = None


class TriggerProblem(ValueError):
    pass


_CREATE = re.compile(r"(?is)^\s*create\s+trigger\s+(\w+)\s+on\s+(\w+)\s+when\s+(.+?)(?:\s+deliver\s+(\w+))?(?:\s+cooldown\s+interval\s+'([^']+)')?\s*;?\s*$")
_SPAN = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400}
_TERM = re.compile(
    r"""(?ix)\s*(?:
    (?P<not>not\s+)?tag\s+(?P<tag>\w+)\s*(?P<tagop>=|!=)\s*'(?P<text>[^']*)'
    |rate_of_change\(\s*(?P<rfield>\w+)\s*,\s*(?P<pct>[\d.]+)\s*,\s*(?P<window>\d+)\s*\)
    |crossover\(\s*(?P<cfield>\w+)\s*,\s*(?P<short>\d+)\s*,\s*(?P<long>\d+)\s*,\s*(?P<way>above|below)\s*\)
    |anomaly_score\s*>\s*(?P<score>[\d.]+)
    |forecast_deviation\s*>\s*(?P<dev>[\d.]+)
    |(?P<field>\w+)\s*(?P<op>>=|<=|==|=|>|<)\s*(?P<value>-?[\d.]+(?:e-?\d+)?)
    )\s*"""
)


def _seconds(text: str) -> float:
    found = re.fullmatch(r"\s*([\d.]+)\s*(\w+?)s?\s*", text)
    if not found or found[2].lower() not in _SPAN:
        raise TriggerProblem(f"not an interval: {text!r}")
    return float(found[1]) * _SPAN[found[2].lower()]


@dataclass
class Registry:
    """Triggers by name, kept by statements: CREATE TRIGGER, DROP TRIGGER, ALTER TRIGGER ... ENABLE or DISABLE, SHOW TRIGGERS."""

    triggers: dict[str, Trigger] = field(default_factory=dict)

    def execute(self, statement: str) -> list[Trigger]:
        if found := _CREATE.match(statement):
            name, measurement, condition, deliver, cooldown = found.groups()
            if name in self.triggers:
                raise TriggerProblem(f"trigger {name} exists")
            made = Trigger(name, measurement, condition.strip(), _seconds(cooldown) if cooldown else 0.0, deliver or "log")
            condition_of(made.condition)
            self.triggers[name] = made
            return [made]
        if found := re.match(r"(?is)^\s*drop\s+trigger\s+(\w+)\s*;?\s*$", statement):
            return [self._known(found[1]) and self.triggers.pop(found[1])]
        if found := re.match(r"(?is)^\s*alter\s+trigger\s+(\w+)\s+(enable|disable)\s*;?\s*$", statement):
            self.triggers[found[1]] = replace(self._known(found[1]), enabled=found[2].lower() == "enable")
            return [self.triggers[found[1]]]
        if re.match(r"(?is)^\s*show\s+triggers\s*;?\s*$", statement):
            return [self.triggers[n] for n in sorted(self.triggers)]
        raise TriggerProblem(f"not a trigger statement: {statement!r}")

    def _known(self, name: str) -> Trigger:
        if name not in self.triggers:
            raise TriggerProblem(f"unknown trigger {name}")
        return self.triggers[name]


def _kept_history(name: str, n: int) -> Column:
    """What ``stateful.with_history`` keeps of a stream."""
    return F.col("__history")[f"{name}:{n}"]


def histories(text: str) -> list[tuple[str, int]]:
    """The (field, n) whose last n values a condition reads."""
    found = [m.groupdict() for part in _split(text.strip(), "or") for term in _split(part, "and") if (m := _TERM.fullmatch(term))]
    return sorted({(g["rfield"], int(g["window"])) for g in found if g["rfield"]} | {(g["cfield"], int(g["long"])) for g in found if g["cfield"]})


def _history(name: str, n: int) -> Column:
    """The last n values of a field in its series, oldest first."""
    over = Window.partitionBy("__series").orderBy("seq").rowsBetween(-(n - 1), 0)
    return F.collect_list(F.col("fields")[name]).over(over)


def _term(found: re.Match, history) -> Column:
    g = found.groupdict()
    value = lambda name: F.col("fields")[name]
    if g["tag"]:
        hit = F.coalesce(F.col("tags")[g["tag"]] == g["text"], F.lit(False))
        return ~hit if bool(g["not"]) != (g["tagop"] == "!=") else hit
    if g["rfield"]:
        s = history(g["rfield"], int(g["window"]))
        old, new = F.get(s, 0), F.try_element_at(s, F.lit(-1))
        return F.coalesce((F.size(s) > 1) & (old != 0) & (F.abs(new - old) / F.abs(old) * 100 > float(g["pct"])), F.lit(False))
    if g["cfield"]:
        s = history(g["cfield"], int(g["long"]))
        mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)
        short, long = mean(F.slice(s, -F.least(F.size(s), F.lit(int(g["short"]))), int(g["short"]))), mean(s)
        return (F.size(s) >= int(g["long"])) & ((short > long) if g["way"].lower() == "above" else (short < long))
    if g["score"]:
        return F.coalesce(value("anomaly_score") > float(g["score"]), F.lit(False))
    if g["dev"]:
        off = F.abs(value("value") - value("forecast"))
        own = F.when(F.abs(value("forecast")) < 1e-12, off).otherwise(off / F.abs(value("forecast")))
        return F.coalesce(F.coalesce(value("forecast_deviation"), own) > float(g["dev"]), F.lit(False))
    a, b = value(g["field"]), float(g["value"])
    test = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "=": a == b, "==": a == b}[g["op"]]
    return F.coalesce(test, F.lit(False))


def condition_of(text: str, history=_history) -> Column:
    """A condition of terms joined by AND and OR (AND binds tighter); a missing field is false."""
    ors = []
    for part in _split(text.strip(), "or"):
        ands = None
        for term in _split(part, "and"):
            found = _TERM.fullmatch(term)
            if not found:
                raise TriggerProblem(f"not a condition: {term!r}")
            made = _term(found, history)
            ands = made if ands is None else ands & made
        ors.append(ands)
    out = ors[0]
    for o in ors[1:]:
        out = out | o
    return out


def _split(text: str, word: str) -> list[str]:
    """The parts between a word, but not inside quotes."""
    bare = re.sub(r"'[^']*'", lambda m: "x" * len(m[0]), text)
    cuts = [m.span() for m in re.finditer(rf"(?i)\s+{word}\s+", bare)]
    return [text[a:b] for a, b in zip([0, *(end for _, end in cuts)], [*(begin for begin, _ in cuts), len(text)], strict=True)]


def severity(value: Column, low: float, high: float) -> Column:
    return F.when(value >= high, "critical").when(value >= low, "warning").otherwise("info")


def evaluate(events: DataFrame, trigger: Trigger) -> DataFrame:
    """Firings before the cooldown, of a batch or a stream: trigger, series, seq, event_timestamp, fields."""
    from tempora.streaming.stateful import with_history

    own = subscribe(events, [trigger.measurement], kinds=["point_written"]).withColumn("__series", series_key())
    if not trigger.enabled:
        own = own.where(F.lit(False))
    wanted = histories(trigger.condition) if own.isStreaming else []
    if wanted:
        own = with_history(own, wanted)
    fired = own.withColumn("__hit", condition_of(trigger.condition, _kept_history if wanted else _history)).where("__hit")
    return fired.select(F.lit(trigger.name).alias("trigger"), F.col("__series").alias("series"), "seq", "event_timestamp", "fields")


def with_cooldown(firings: DataFrame, cooldown_s: float) -> DataFrame:
    """Of a batch: a firing within [0, cooldown) of the last one let through, in data time, is dropped."""
    rows = firings.withColumn("__at", F.unix_micros("event_timestamp"))
    return walk(rows, ["trigger", "series"], ["seq"], ["__at"], "__kept", T.BooleanType(), None, cooling(int(cooldown_s * 1e6))).where("__kept").drop("__at", "__kept")


def cooling(cooldown_us: int):
    """A walk's step over times: whether a firing is let through."""

    def step(last, at):
        kept = last is None or not 0 <= at - last < cooldown_us
        return (at if kept else last), kept

    return step


def stream_cooldown(firings: DataFrame, cooldown_s: float) -> DataFrame:
    """Of a stream: (trigger, series, event_timestamp); suppressed only while data time and wall clock are both inside."""
    ship(firings.sparkSession)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        data, wall = state.get if state.exists else (None, None)
        now, out = state.getCurrentProcessingTimeMs() / 1000, []
        for pdf in batches:
            for at in pdf.sort_values("event_timestamp")["event_timestamp"]:
                seconds = at.timestamp()
                if data is not None and 0 <= seconds - data < cooldown_s and now - wall < cooldown_s:
                    continue
                data, wall = seconds, now
                out.append((*key, at))
        state.update((data, wall))
        state.setTimeoutDuration(max(1000, int(cooldown_s * 1000) + 1000))
        yield pd.DataFrame(out, columns=["trigger", "series", "event_timestamp"])

    def expire(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return iter(())
        return step(key, batches, state)

    used = firings.select("trigger", "series", "event_timestamp")
    return used.groupBy("trigger", "series").applyInPandasWithState(expire, "trigger string, series string, event_timestamp timestamp", "data double, wall double", "append", "ProcessingTimeTimeout")


def stream_rollup(events: DataFrame, field_name: str, window: str, late: str) -> DataFrame:
    """Tumbling aggregates of a field by series; rows later than the watermark are left to repair."""
    rows = events.withWatermark("event_timestamp", late)
    grouped = rows.groupBy(F.window("event_timestamp", window), series_key().alias("series"))
    v = F.col("fields")[field_name]
    made = grouped.agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"))
    return made.select(F.col("window.start").alias("start"), "series", "n", "sum", "min", "max")
