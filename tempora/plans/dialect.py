"""The time-series dialect of SQL, rewritten to Spark SQL outside of literals and comments."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from math import comb

from tempora.functions.buckets import _standard_offset, parse_width, zone
from tempora.functions.windows import EPSILON

_QUOTED = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_DAY = 86400 * 10**6


class DialectError(ValueError):
    pass


def masked(text: str) -> str:
    """The text with literals, quoted names and comments blanked out, of the same length."""
    return _QUOTED.sub(lambda m: " " * len(m[0]) if m[0][0] in "-/" else "'" * len(m[0]), text)


def closing(bare: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(bare)):
        depth += (bare[i] == "(") - (bare[i] == ")")
        if not depth:
            return i
    raise DialectError("a bracket is not closed")


def arguments(text: str, bare: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose bracket opens at ``at``, and the place behind it."""
    end, depth, begin, out = closing(bare, at), 0, at + 1, []
    for i in range(at, end):
        depth += (bare[i] == "(") - (bare[i] == ")")
        if bare[i] == "," and depth == 1:
            out.append(text[begin:i].strip())
            begin = i + 1
    last = text[begin:end].strip()
    return [*out, last] if out or last else [], end + 1


# ---- time buckets --------------------------------------------------------------------------------


def _text_of(argument: str, what: str) -> str:
    found = re.fullmatch(r"(?is)(?:timestamp|date)?\s*'((?:[^']|'')*)'", argument.strip())
    if not found:
        raise DialectError(f"time_bucket takes its {what} as a literal, not {argument}")
    return found[1].replace("''", "'")


def bucket_sql(args: list[str]) -> str:
    """time_bucket(width, ts [, zone [, origin]]): the start of the bucket of a UTC time, as UTC; an empty or null zone is UTC."""
    if not 2 <= len(args) <= 4:
        raise DialectError("time_bucket takes 2 to 4 arguments")
    span, ts = parse_width(_text_of(args[0], "width")), args[1]
    tz = None if len(args) < 3 or args[2].lower() == "null" else _text_of(args[2], "zone") or None
    tz = zone(tz) if tz else None
    origin = datetime.fromisoformat(_text_of(args[3], "origin")) if len(args) == 4 and args[3].lower() != "null" else None
    from_epoch = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 10**6)
    micros = lambda t: f"unix_micros(CAST({t} AS TIMESTAMP))"
    plain = lambda us: f"CAST(timestamp_micros({us}) AS TIMESTAMP_NTZ)"
    if span.micros:
        anchor = from_epoch(origin) if origin else -(_standard_offset(tz) if tz else 0)
        return plain(f"{micros(ts)} - pmod({micros(ts)} - ({anchor}), {span.micros})")
    local = f"convert_timezone('UTC', '{tz}', CAST({ts} AS TIMESTAMP_NTZ))" if tz else f"CAST({ts} AS TIMESTAMP_NTZ)"
    if span.days:
        anchor = from_epoch(origin) if origin else 4 * _DAY
        start = plain(f"{micros(local)} - pmod({micros(local)} - ({anchor}), {span.days * _DAY})")
    else:
        if origin and origin.day > 28:
            raise DialectError("an origin after the 28th does not exist in every month")
        into = from_epoch(origin) - from_epoch(datetime(origin.year, origin.month, 1)) if origin else 0
        first = (origin.year - 1970) * 12 + origin.month - 1 if origin else 0
        moved = plain(f"{micros(local)} - {into}")
        month = f"((year({moved}) - 1970) * 12 + month({moved}) - 1)"
        month = f"({month} - pmod({month} - ({first}), {span.months}))"
        day = f"CAST(make_date(CAST(floor({month} / 12) AS INT) + 1970, CAST(pmod({month}, 12) AS INT) + 1, 1) AS TIMESTAMP_NTZ)"
        start = plain(f"{micros(day)} + {into}")
    return f"convert_timezone('{tz}', 'UTC', {start})" if tz else start


# ---- aggregates over (value, time) ------------------------------------------------------------------


def _samples_sql(v: str, ts: str, order: str | None, body: str) -> str:
    """body over ``s``, the (t, v) of a group by time; of equal times the last by the order, else the largest value."""
    by = f"'o', {order}, " if order else ""
    rows = f"array_sort(collect_list(CASE WHEN ({v}) IS NOT NULL AND ({ts}) IS NOT NULL THEN named_struct('t', unix_micros(CAST({ts} AS TIMESTAMP)), {by}'v', CAST({v} AS DOUBLE)) END))"
    return f"transform(transform(array({rows}), r -> filter(r, (x, i) -> coalesce(get(r, i + 1).t <> x.t, true))), s -> {body})[0]"


def rate_sql(v: str, ts: str, order: str | None = None) -> str:
    rise = "aggregate(s, named_struct('p', CAST(NULL AS DOUBLE), 'a', 0D), (a, x) -> named_struct('p', x.v, 'a', a.a + CASE WHEN a.p IS NULL THEN 0D WHEN x.v < a.p THEN x.v ELSE x.v - a.p END), a -> a.a)"
    return _samples_sql(v, ts, order, f"CASE WHEN size(s) >= 2 THEN {rise} / ((element_at(s, -1).t - element_at(s, 1).t) / 1e6D) END")


def irate_sql(v: str, ts: str, order: str | None = None) -> str:
    b, a = "try_element_at(s, -1)", "try_element_at(s, -2)"
    return _samples_sql(v, ts, order, f"CASE WHEN size(s) >= 2 THEN (CASE WHEN {b}.v < {a}.v THEN {b}.v ELSE {b}.v - {a}.v END) / (({b}.t - {a}.t) / 1e6D) END")


def multivariate_forecast_sql(y: str, x: str, ts: str, n: str) -> str:
    """n values of the regression of y on x, continued with x's last value; under four complete rows null."""
    _whole(n, "multivariate_forecast", "horizon")
    value = f"regr_intercept({y}, {x}) + regr_slope({y}, {x}) * max_by({x}, {ts})"
    return f"CASE WHEN count(CASE WHEN ({y}) IS NOT NULL AND ({x}) IS NOT NULL THEN 1 END) >= 4 THEN array_repeat({value}, {n}) END"


# ---- window functions ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    """PARTITION BY and ORDER BY of a window."""

    partition: str
    order: str

    def over(self, frame: str = "") -> str:
        return f"OVER ({' '.join(x for x in (self.partition, self.order, frame) if x)})"

    @property
    def whole(self) -> str:
        return f"OVER ({self.partition})"


def _whole(text: str, name: str, what: str, least: int = 1) -> int:
    if not re.fullmatch(r"[+-]?\d+", text.strip()) or int(text) < least:
        raise DialectError(f"{name}: the {what} must be a whole number of at least {least}, not {text}")
    return int(text)


def _number(text: str, name: str, what: str) -> float:
    try:
        return float(text)
    except ValueError:
        raise DialectError(f"{name}: the {what} must be a number, not {text}") from None


def _finite(x: str) -> str:
    return f"transform(array({x}), x -> CASE WHEN NOT isnan(x) AND abs(x) <> double('inf') THEN x END)[0]"


def _diff(s: Spec, v: str, n: str = "1") -> str:
    k = _whole(n, "diff", "order")
    return " + ".join(f"({(-1) ** i * comb(k, i)}) * " + (f"lag({v}, {i}) {s.over()}" if i else f"({v})") for i in range(k + 1))


def _pct_change(s: Spec, v: str) -> str:
    p = f"lag({v}) {s.over()}"
    return f"CASE WHEN abs({p}) >= {EPSILON}D THEN (({v}) - {p}) / {p} END"


def _rolling(s: Spec, made: str, w: int) -> str:
    return f"CASE WHEN row_number() {s.over()} >= {w} THEN {_finite(made + ' ' + _frame(s, w))} END"


def _frame(s: Spec, w: int) -> str:
    return s.over(f"ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW")


def _corr(a: str, b: str, over: str) -> str:
    """Pearson's r of the complete pairs; null without spread, where Spark's corr divides by zero."""
    both = f"({a}) IS NOT NULL AND ({b}) IS NOT NULL"
    x, y = f"CASE WHEN {both} THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({b} AS DOUBLE) END"
    return f"try_divide(covar_samp({x}, {y}) {over}, stddev_samp({x}) {over} * stddev_samp({y}) {over})"


def _rolling_corr(s: Spec, a: str, b: str, w: str) -> str:
    n = _whole(w, "rolling_corr", "window")
    return f"CASE WHEN row_number() {s.over()} >= {n} THEN {_finite(_corr(a, b, _frame(s, n)))} END"


def _zscore(s: Spec, v: str) -> str:
    return f"CASE WHEN stddev_samp({v}) {s.whole} >= {EPSILON}D THEN (({v}) - avg({v}) {s.whole}) / stddev_samp({v}) {s.whole} END"


def _anomaly_score(s: Spec, v: str, threshold: str = "3.0") -> str:
    t = _number(threshold, "anomaly_score", "threshold")
    mean, sigma = f"avg({v}) {s.whole}", f"stddev_samp({v}) {s.whole}"
    score = f"1 / (1 + exp(-2 * (abs(({v}) - {mean}) / greatest({sigma}, abs({mean}) * 1e-9D, 1e-12D) - {t})))"
    return f"CASE WHEN count({v}) {s.whole} >= 3 THEN {score} ELSE CAST(raise_error('anomaly_score needs three values') AS DOUBLE) END"


def _correlation(s: Spec, a: str, b: str) -> str:
    return _finite(_corr(a, b, s.whole))


def _multivariate_anomaly(s: Spec, a: str, b: str, threshold: str = "3.0") -> str:
    _number(threshold, "multivariate_anomaly", "threshold")
    both = f"({a}) IS NOT NULL AND ({b}) IS NOT NULL"
    x, y = f"CASE WHEN {both} THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({b} AS DOUBLE) END"
    dx, dy = f"({x} - avg({x}) {s.whole})", f"({y} - avg({y}) {s.whole})"
    sxx, syy, sxy = f"(var_samp({x}) {s.whole} + 1e-6D)", f"(var_samp({y}) {s.whole} + 1e-6D)", f"covar_samp({x}, {y}) {s.whole}"
    squared = f"({syy} * {dx} * {dx} - 2 * {sxy} * {dx} * {dy} + {sxx} * {dy} * {dy}) / ({sxx} * {syy} - {sxy} * {sxy})"
    return f"CASE WHEN {both} AND count({x}) {s.whole} >= 3 THEN sqrt(greatest({squared}, 0D)) END"


#: Window functions that are expressions: name -> (fewest, most arguments, SQL).
WINDOWS: dict[str, tuple[int, int, Callable[..., str]]] = {
    "diff": (1, 2, _diff),
    "pct_change": (1, 1, _pct_change),
    "rolling_mean": (2, 2, lambda s, v, w: _rolling(s, f"avg({v})", _whole(w, "rolling_mean", "window"))),
    "rolling_std": (2, 2, lambda s, v, w: _rolling(s, f"stddev_samp({v})", _whole(w, "rolling_std", "window"))),
    "rolling_corr": (3, 3, _rolling_corr),
    "zscore": (1, 1, _zscore),
    "anomaly_score": (1, 2, _anomaly_score),
    "correlation": (2, 2, _correlation),
    "multivariate_anomaly": (2, 3, _multivariate_anomaly),
}
#: Window functions that need the rows of their FROM first: name -> (fewest, most arguments).
KERNELS = {"ewm": (2, 2), "stl_trend": (2, 3), "stl_seasonal": (2, 3), "stl_residual": (2, 3), "stl_decompose": (2, 3), "cross_correlation": (3, 3)}
_AGGREGATES = {"first": lambda v, t: f"min_by({v}, {t})", "last": lambda v, t: f"max_by({v}, {t})", "rate": rate_sql, "irate": irate_sql}


def spec_of(text: str, bare: str, at: int, name: str) -> tuple[Spec, int]:
    """The window behind a call (OVER (...) or OVER name), and the place behind it."""
    found = re.compile(r"\s*OVER\s*(\(|[A-Za-z_]\w*)", re.I).match(bare, at)
    if not found:
        raise DialectError(f"{name} needs OVER (...)")
    if found[1] == "(":
        begin = found.end() - 1
        end = closing(bare, begin)
        after = end + 1
    else:
        defined = re.compile(rf"\b{found[1]}\s+AS\s*(\()", re.I).search(bare)
        if not defined:
            raise DialectError(f"the window {found[1]} is not defined")
        begin, after = defined.start(1), found.end()
        end = closing(bare, begin)
    inner, plain = text[begin + 1 : end], bare[begin + 1 : end]
    if re.search(r"\b(rows|range|groups)\b", plain, re.I):
        raise DialectError(f"{name} takes no frame")
    cut = re.search(r"\border\s+by\b", plain, re.I)
    return Spec(inner[: cut.start()].strip() if cut else inner.strip(), inner[cut.start() :].strip() if cut else ""), after


def find_calls(bare: str, names) -> list[re.Match]:
    return list(re.compile(rf"(?<![.\w])({'|'.join(names)})\s*\(", re.I).finditer(bare))


def rewrite(text: str, time_columns: tuple[str, ...] = ("_time",)) -> str:
    """Calls of the dialect and integer epochs (nanoseconds) beside time columns, as Spark SQL; innermost calls first."""
    names = ("time_bucket", "multivariate_forecast", *_AGGREGATES, *WINDOWS)
    for found in reversed(find_calls(masked(text), names)):
        bare, name = masked(text), found[1].lower()
        args, end = arguments(text, bare, found.end() - 1)
        if name == "time_bucket":
            made = bucket_sql(args)
        elif name == "multivariate_forecast":
            if len(args) != 4:
                raise DialectError("multivariate_forecast takes 4 arguments")
            made = multivariate_forecast_sql(*args)
        elif name in _AGGREGATES:
            few = name in ("first", "last")
            if len(args) < 2 or (few and args[1].lower() in ("true", "false")):
                continue  # Spark's own functions of these names
            if len(args) > (2 if few else 3):
                raise DialectError(f"{name} takes {'2' if few else '2 or 3'} arguments")
            made = _AGGREGATES[name](*args)
        else:
            fewest, most, function = WINDOWS[name]
            if not fewest <= len(args) <= most:
                raise DialectError(f"{name} takes {fewest} to {most} arguments")
            spec, end = spec_of(text, bare, end, name)
            made = f"({function(spec, *args)})"
        text = text[: found.start()] + made + text[end:]
    return _epochs(text, time_columns)


def _epochs(text: str, time_columns: tuple[str, ...]) -> str:
    as_time = lambda ns: f"CAST(timestamp_micros({int(ns) // 1000}) AS TIMESTAMP_NTZ)"
    number = r"(-?\d{10,19})(?![\d.eE])"
    for column in time_columns:
        name = rf"(?<![\w]){re.escape(column)}\b"
        patterns = (
            rf"{name}\s*(?:=|<>|!=|<=|>=|<|>)\s*{number}",
            rf"(?<![\w.]){number}\s*(?:=|<>|!=|<=|>=|<|>)\s*(?:\w+\.)?{name}",
            rf"{name}\s+(?:not\s+)?between\s+{number}\s+and\s+{number}",
            rf"{name}\s+(?:not\s+)?in\s*\([\d\s,-]+\)",
        )
        for pattern in patterns:
            bare = masked(text)
            for found in reversed(list(re.compile(pattern, re.I).finditer(bare))):
                part = re.sub(r"(?<![\w.])-?\d{10,19}(?![\d.eE])", lambda m: as_time(m[0]), found[0])
                text = text[: found.start()] + part + text[found.end() :]
    return text
