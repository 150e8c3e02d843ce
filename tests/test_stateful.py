"""Stateful streams give what a batch or a plain loop gives, over several micro-batches."""

import math
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.functions.plugins import Plugins, digest
from tempora.operators import deletion
from tempora.sources import topics
from tempora.streaming import stateful, triggers

T0 = datetime(2024, 1, 1)


def _events(n=60):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        value = float(round(rng.normal(10, 2), 3)) if i % 11 else 60.0
        rows.append((i, "point_written", "cpu", T0 + timedelta(minutes=i), {"host": "ab"[i % 2]}, {} if i % 13 == 5 else {"v": value}))
    return rows


@pytest.fixture()
def stream(spark, tmp_path):
    rows = _events()
    for k in range(3):  # a folder of three files, one for each micro-batch
        spark.createDataFrame(rows[20 * k : 20 * k + 20], triggers.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        time.sleep(1.1)
    schema = spark.read.parquet(str(tmp_path / "events")).schema
    return spark.read.parquet(str(tmp_path / "events")), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))


def _stored(spark, rows, tmp_path, name):
    query = stateful.store(rows, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
    assert query.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / name))


@pytest.mark.parametrize("condition", ["rate_of_change(v, 100, 4)", "crossover(v, 2, 5, above) AND tag host = 'a'"])
def test_conditions_with_a_history(spark, stream, tmp_path, condition):
    batch, live = stream
    trigger = triggers.Trigger("t", "cpu", condition)
    want = sorted(r.seq for r in triggers.evaluate(batch, trigger).collect())
    found = _stored(spark, triggers.evaluate(live, trigger), tmp_path, "fired")
    assert want and sorted(r.seq for r in found.collect()) == want


def test_streaming_anomalies(spark, stream, tmp_path):
    _, live = stream
    found = _stored(spark, stateful.anomalies(live, "v", 2.0, min_fit_points=8, max_buffer=12, refit_every=5), tmp_path, "scored")
    want = {}
    for host in "ab":
        held, fit, since = [], None, 0
        for seq, _, _, _, tags, fields in _events():
            if tags["host"] != host or "v" not in fields:
                continue
            if fit:
                want[seq] = abs(fields["v"] - fit[0]) / fit[1]
            held, since = [*held, fields["v"]][-12:], since + 1
            if (not fit and len(held) >= 8) or (fit and since >= 5):
                fit, since = (np.mean(held), np.std(held, ddof=1)), 0
    got = {r.seq: r for r in found.collect()}
    assert sorted(got) == sorted(want) and all(math.isclose(got[s].z, z) and got[s].is_anomaly == (z > 2) for s, z in want.items())


def test_continuous_forecasts(spark, stream, tmp_path):
    _, live = stream
    found = _stored(spark, stateful.forecasts(live, "v", 3, min_fit_points=10, refit_every=6), tmp_path, "ahead").collect()
    first = {}
    for host in "ab":
        seen = [seq for seq, _, _, _, tags, fields in _events() if tags["host"] == host and "v" in fields]
        first[host] = seen[9::6]
    assert sorted({r.seq for r in found}) == sorted(first["a"] + first["b"])
    assert all(r.lower <= r.value <= r.upper for r in found) and {r.step for r in found} == {1, 2, 3}


def test_alerts_without_a_cooldown(spark, stream, tmp_path):
    _, live = stream
    scored = stateful.anomalies(live, "v", 2.0, min_fit_points=8)
    found = _stored(spark, stateful.alerts(scored, "loud", 0.5), tmp_path, "alerts").collect()
    assert {r.trigger for r in found} == {"loud"}


def test_calendar_rollups_and_late_rows(spark, tmp_path):
    at = [datetime(2024, 1, 5), datetime(2024, 1, 31, 23, 30), datetime(2024, 2, 3), datetime(2024, 4, 2), datetime(2024, 1, 6)]
    for i, t in enumerate(at):
        spark.createDataFrame([(i, "point_written", "m", t, {}, {"v": 1.0 + i})], triggers.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    live = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stateful.store(stateful.calendar_rollup(live, "v", "1mo", "10 days", "Europe/Berlin"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert query.awaitTermination(120)
    found = {r.start.month: (r.n, r.sum) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # in Berlin the second row is of February; the last came after its month was closed
    assert found[12 if 12 in found else 1] == (1, 1.0) and sum(n for n, _ in found.values()) == 3 and stateful.late_rows(query) >= 1


def test_deletes(spark):
    rows = [(i, "a" if i < 6 else None if i < 8 else "b", datetime(2024, 1, 1 + i)) for i in range(10)]
    points = spark.createDataFrame(rows, "seq long, host string, ts timestamp_ntz")
    left = lambda *d: [r.seq for r in deletion.apply(points, list(d), "ts", "seq").orderBy("seq").collect()]
    assert left(deletion.Delete({"host": "a"}, datetime(2024, 1, 2), datetime(2024, 1, 4))) == [0, 4, 5, 6, 7, 8, 9]
    assert left(deletion.Delete({"host": None})) == [0, 1, 2, 3, 4, 5, 8, 9] and left(deletion.Delete()) == []
    assert left(deletion.Delete(written=3), deletion.Delete({"host": "b"})) == [4, 5, 6, 7]
    with pytest.raises(ValueError):
        deletion.apply(points, [deletion.Delete(written=3)], "ts")
    found = deletion.report(points, deletion.Delete(end=datetime(2024, 1, 9)), ["host"], "ts").collect()
    assert sorted((r.host or "", r.deleted, r.remaining, r.partial) for r in found) == [("", 2, 0, False), ("a", 6, 0, False), ("b", 1, 1, True)]


def test_drop_and_restore(spark):
    shelf = deletion.Shelf()
    shelf.add("m", spark.range(3))
    shelf.drop("m")
    for wrong in (lambda: shelf.get("m"), lambda: shelf.drop("m"), lambda: shelf.restore("n"), lambda: shelf.purge("n")):
        with pytest.raises(KeyError):
            wrong()
    with pytest.raises(ValueError):
        shelf.add("m", spark.range(1))
    assert shelf.restore("m").count() == 3 and shelf.names() == ["m"]
    shelf.drop("m")
    shelf.purge("m")
    shelf.add("m", spark.range(1))


def test_topics(spark):
    rows = [("lines", "cpu,host=a v=1.5,n=2i,s=\"x\" 1000\ncpu,host=b v=2 2000\nbroken"), ("json", '[{"measurement":"mem","tags":{"h":"a"},"fields":{"u":3.5},"timestamp":3000}]'), ("other", "cpu v=1 1"), ("lines", None)]
    messages = spark.createDataFrame(rows, "topic string, value string").withColumn("value", F.encode("value", "UTF-8"))
    found = topics.points(messages, {"lines": "line", "json": "json"}).orderBy("_time_ns").collect()
    assert [(r.topic, r.measurement, r.tags, r.fields, r._time_ns) for r in found] == [("lines", "cpu", {"host": "a"}, {"v": 1.5, "n": 2.0}, 1000), ("lines", "cpu", {"host": "b"}, {"v": 2.0}, 2000), ("json", "mem", {"h": "a"}, {"u": 3.5}, 3000)]
    with pytest.raises(ValueError):
        topics.points(messages, {"lines": "xml"})


def _twice(y, horizon):
    return None


def test_plugins():
    plugins = Plugins()
    plugins.add("twice", "forecast", _twice, sha256=digest(_twice))
    assert plugins.get("twice", "forecast") is _twice and plugins.names("forecast") == ["twice"] and plugins.names("detector") == []
    for wrong in (("twice", "forecast", _twice), ("ses", "forecast", _twice), ("x", "shape", _twice), ("x", "detector", _twice, "1", "00")):
        with pytest.raises(ValueError):
            plugins.add(*wrong)
    plugins.remove("twice", "forecast")
    with pytest.raises(KeyError):
        plugins.get("twice", "forecast")
