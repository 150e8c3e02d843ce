"""The metric language: edges of windows, durations, long windows, pruning, histograms and scalars, against plain values."""

import math
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.functions import histograms as H
from tempora.promql import Engine, MetricError, engine as engine_module
from tempora.promql.syntax import SyntaxProblem, parse

S = 10**6
EPOCH = datetime(1970, 1, 1)


def _frame(spark, series, label="job"):
    rows = [(name, EPOCH + timedelta(seconds=t), float(v)) for name, points in series.items() for t, v in points]
    return spark.createDataFrame(rows, f"{label} string, ts timestamp_ntz, value double")


def _engine(spark, **metrics):
    made = Engine(spark)
    for name, series in metrics.items():
        made.add(name, _frame(spark, series), "ts", ["job"], ["value"])
    return made


def _one(engine, text, at):
    found = engine.instant(text, at * S).collect()
    assert len(found) < 2
    return found[0].value if found else None


def test_edges_of_windows(spark):
    """The published values of the language's own tests."""
    e = _engine(spark, metric={"": [(15 * i, v) for i, v in enumerate([1, 2, 3, 4, 5, 9, 10, 11, 12, 13])]})
    want = {
        "increase(metric[1m])": [None, 1.833333333, 2.833333333, 4, 4, 8, 8, 8, 4],
        "increase(metric[1m] anchored)": [0, 1, 2, 3, 4, 7, 7, 7, 7],
        "increase(metric[1m] smoothed)": [0.333333333, 1.333333333, 2.333333333, 3.333333333, 5, 7, 7, 7, 6],
    }
    for text, values in want.items():
        got = {int((r.ts - EPOCH).total_seconds()): r.value for r in e.range(text, 5 * S, 125 * S, 15 * S).collect()}
        for at, value in zip(range(5, 126, 15), values, strict=True):
            assert got.get(at) == (value if value is None else pytest.approx(value, abs=1e-6)), (text, at)
    e = _engine(spark, c={"": [(0, 5), (30, 10), (60, 3)]}, m={"": [(0, 1), (60, 2), (180, 4), (240, 5)]}, g={"": [(0, 1), (10, 2)]})
    assert _one(e, "increase(c[1m] anchored)", 60) == 8 and _one(e, "resets(c[1m] anchored)", 60) == 1 and _one(e, "changes(c[1m] anchored)", 60) == 2
    assert _one(e, "increase(m[1m] smoothed)", 120) == 1 and _one(e, "delta(c[1m] anchored)", 60) == -2 and _one(e, "rate(c[1m] anchored)", 60) == 8 / 60
    assert _one(e, "g smoothed", 5) == 1.5 and _one(e, "g smoothed", 10) == 2 and _one(e, "g smoothed", 20) == 2
    for wrong in ("rate(c[1m:1s] smoothed)", "c anchored", "rate(c[1m smoothed])"):
        with pytest.raises(SyntaxProblem):
            parse(wrong)
    for wrong in ("avg_over_time(c[1m] anchored)", "changes(c[1m] smoothed)", "rate(c[1m], 2)", "rate()", "abs(c, c)", "nonsense(c)", "clamp(c, 1)"):
        with pytest.raises(MetricError):
            e.instant(wrong, 0)


def test_durations(spark):
    e = _engine(spark, m={"": [(i, i) for i in range(101)]})
    for text, want in (
        ("count_over_time(m[step()+1])", [6, 6, 6]), ("count_over_time(m[max_of(min_of(step()+1,1h),1ms)])", [6, 6, 6]), ("m offset STEP()", [45, 50, 55]), ("m offset step()*0", [0, 0, 0]),
        ("m offset (-step()*2)", [60, 65, 70]), ("m offset -step()*2", [110, 120, 130]), ("m offset step()^0", [1, 1, 1]), ("m offset (STEP()/10)", [49, 54, 59]), ("m offset min_of(step(), 1s)+8000", [8049, 8054, 8059]),
        ("m offset -(min_of(step(), 2s)-5)+8000", [8047, 8052, 8057]), ("count_over_time(m[range()])", [10, 10, 10]), ("m offset min_of(range(), 8s)", [42, 47, 52]), ("count_over_time(m[7 % 4])", [3, 3, 3]), ("count_over_time(m[2 ^ 3])", [8, 8, 8]),
    ):
        assert [r.value for r in e.range(text, 50 * S, 60 * S, 5 * S).orderBy("ts").collect()] == want, text
    assert _one(e, "m offset range()", 50) == 50


FUNCTIONS = ("avg_over_time", "min_over_time", "last_over_time", "changes", "resets", "stddev_over_time", "irate", "deriv", "rate", "delta")


def test_long_windows_equal_short_ones(spark, monkeypatch):
    """Windows copied to every step, and to the steps on which they change, give the same."""
    rng = np.random.default_rng(2)
    series = {name: sorted({int(t): float(rng.integers(0, 9)) for t in rng.integers(0, 2000, n)}.items()) for name, n in (("a", 60), ("b", 5), ("c", 1))}
    series["a"][7] = (series["a"][7][0], math.nan)
    e = _engine(spark, m=series)
    texts = [f"{f}(m[10m])" for f in FUNCTIONS] + ["quantile_over_time(0.3, m[10m])", "predict_linear(m[10m], 60)", "absent_over_time(m[10m])", "max_over_time(sum(m)[10m:20s])", "sum_over_time(m[5m] @ 900)"]

    def run(text):
        return {(r.labels.get("job"), r.ts): r.value for r in e.range(text, 100 * S, 2300 * S, 10 * S).collect()}

    for text in texts:
        found = []
        for fewest, few in ((10**6, 10**6), (0, 10**6), (0, 0)) if "avg" in text or "rate" in text or "stddev" in text else ((10**6, 10**6), (0, 0)):
            monkeypatch.setattr(engine_module, "FEWEST_STEPS", fewest)
            monkeypatch.setattr(engine_module, "FEW_STEPS", few)
            found.append(run(text))
        for other in found[1:]:
            assert other.keys() == found[0].keys(), text
            assert all(a == pytest.approx(other[k], nan_ok=True, abs=1e-9) for k, a in found[0].items()), text
    plain = {}
    for name, points in series.items():
        for at in range(100, 2301, 10):
            own = [v for t, v in points if at - 600 < t <= at]
            if own:
                plain[name, EPOCH + timedelta(seconds=at)] = sum(own)
    got = run("sum_over_time(m[10m])")
    assert got.keys() == plain.keys() and all(got[k] == pytest.approx(v, nan_ok=True) for k, v in plain.items())


def test_scans_are_pruned(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 7).cast("string").alias("job"), (F.col("id") % 3).alias("zone"), F.timestamp_micros(F.col("id") * 60 * S).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "m"))
    e = Engine(spark)
    e.add("m", spark.read.parquet(str(tmp_path / "m")), "ts", ["job", "zone"], ["value"])
    for text in ('rate(m{job="3", zone="1"}[1h])', 'm{job="3", zone="1"}', 'm{job="3", zone="1"} offset 1h'):
        plan = spark._jvm.PythonSQLUtils.explainString(e.range(text, 6 * 3600 * S, 8 * 3600 * S, 600 * S)._jdf.queryExecution(), "formatted")
        pushed = re.search(r"PushedFilters: \[(.*)\]", plan)[1]
        for part in ("GreaterThan(ts,", "LessThanOrEqual(ts,", "EqualTo(job,3)", "EqualTo(zone,1)"):
            assert part in pushed, (text, part, pushed)
    found = e.range('m{job="3", zone="1"}', 6 * 3600 * S, 8 * 3600 * S, 600 * S).collect()
    assert found and all(r.labels == {"__name__": "m", "job": "3", "zone": "1"} for r in found)
    assert _one(e, 'count(m{job!="3", zone=~"1|2", nothing=""})', 36000) == 2 and _one(e, 'count(m{nothing="x", job="1"})', 36000) is None


def test_scalars_are_joined(spark):
    e = _engine(spark, m={"a": [(i * 10, i) for i in range(20)]}, n={"a": [(i * 10, 1) for i in range(20)], "b": [(100, 5)]})
    got = [r.value for r in e.range("n{job='a'} + scalar(m) * 2", 0, 190 * S, 10 * S).orderBy("ts").collect()]
    assert got == [1 + 2 * i for i in range(20)]
    assert all(math.isnan(r.value) for r in e.range("scalar(n)", 100 * S, 110 * S, 10 * S).collect())
    assert [r.value for r in e.range("vector(scalar(m))", 0, 20 * S, 10 * S).orderBy("ts").collect()] == [0, 1, 2]
    assert e.range("m > scalar(m) - 1", 0, 20 * S, 10 * S).count() == 3 and e.range("topk(scalar(n{job='a'}), n)", 100 * S, 100 * S, S).count() == 1
    assert "sid" not in e.range("timestamp(m offset 10s)", 50 * S, 50 * S, S).columns and _one(e, "timestamp(m offset 10s)", 55) == 40


def test_native_histograms(spark):
    values = [("a", 0, float(i)) for i in range(1, 101)] + [("b", 0, float(i)) for i in range(1, 51)] + [("b", 0, 0.0)]
    frame = H.observe(spark.createDataFrame(values, "route string, t int, v double"), ["route", "t"], "v").withColumn("ts", F.timestamp_micros(F.col("t") * S).cast("timestamp_ntz"))
    e = Engine(spark)
    e.add_histograms("http", frame.withColumnRenamed("histogram", "latency"), "ts", ["route"], "latency")
    by = lambda text: {r.labels.get("route"): r.value for r in e.instant(text, 10 * S).collect()}
    assert by("histogram_count(http_latency)") == {"a": 100, "b": 51} and by("histogram_sum(http_latency)") == {"a": 5050, "b": 1275}
    assert by("histogram_avg(http_latency)") == {"a": 50.5, "b": 25} and by("histogram_count(sum(http_latency))") == {None: 151}
    quantiles, whole = by("histogram_quantile(0.5, http_latency)"), by("histogram_quantile(0.5, sum(http_latency))")
    assert abs(quantiles["a"] - 50) < 3 and abs(quantiles["b"] - 25) < 2 and abs(whole[None] - 37) < 3
    assert abs(by("histogram_fraction(0, 25, http_latency)")["a"] - 0.25) < 0.03 and abs(by("histogram_stddev(http_latency)")["a"] - 28.9) < 1 and abs(by("histogram_stdvar(http_latency)")["a"] - 833) < 60
    classic = by("histogram_quantile(0.5, http_latency_bucket)")
    assert abs(classic["a"] - 50) < 3 and by("http_latency_count") == {"a": 100, "b": 51}
    cumulative = [r.value for r in e.instant('http_latency_bucket{route="a"}', 0).orderBy(F.element_at("labels", "le").try_cast("double")).collect()]
    assert cumulative == sorted(cumulative) and cumulative[-1] == 100
    with pytest.raises(MetricError):
        e.instant("histogram_quantile(0.5, max(http_latency))", 0)
    assert "http_latency:native" not in e.names() and e.instant("histogram_count(http_latency_sum)", 0).count() == 0


def test_views_of_the_metrics(spark):
    e = _engine(spark, requests={"a": [(0, 1), (10, 2)], "b": [(5, 1)]})
    assert [r.value for r in e.label_values("job").orderBy("value").collect()] == ["a", "b"] and e.label_values("none").count() == 0
    assert e.series("requests").count() == 2 and e.metadata().first().labels == ["job"]
    row = e.status().first()
    assert (row.metric, row.series, row.samples) == ("requests", 2, 3)
    tree = e.explain("sum by (job) (rate(request[5m])) * 2")
    assert tree[0].startswith("Binary(") and any("did you mean requests" in line for line in tree)
