import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.functions import kernels as K
from tempora.functions.buckets import Width, parse_width, time_bucket, zone
from tempora.operators import anomaly, joins, measurements, preprocess
from tempora.plans.builder import Query
from tempora.plans.sql import ReadOnlyError, SqlSession, guard, rewrite
from tempora.promql import Engine, MetricError
from tempora.promql.syntax import Binary, Number, Selector, SyntaxProblem, duration, parse
from tempora.sources import ingest
from tempora.streaming import triggers


def test_widths():
    assert parse_width("15m") == Width(micros=900 * 10**6) and parse_width("2w") == Width(days=14) and parse_width("1 year") == Width(months=12)
    for wrong in ("1M", "0s", "5 lightyears", "x"):
        with pytest.raises(ValueError):
            parse_width(wrong)
    assert zone("europe/BERLIN") == "Europe/Berlin"
    with pytest.raises(ValueError):
        zone("Mars/Base")


def test_local_days_over_clock_changes(spark):
    times = [(datetime(2024, 3, 30, 23, 30),), (datetime(2024, 3, 31, 21, 59),), (datetime(2024, 3, 31, 22, 0),)]
    rows = spark.createDataFrame(times, "ts timestamp_ntz").select(time_bucket("1d", F.col("ts"), tz="Europe/Berlin").alias("b")).collect()
    assert [r.b for r in rows] == [datetime(2024, 3, 30, 23), datetime(2024, 3, 30, 23), datetime(2024, 3, 31, 22)]


def test_asof_ties_nulls_and_tolerance(spark):
    left = spark.createDataFrame([("a", datetime(2024, 1, 1, 10), 1), (None, datetime(2024, 1, 1, 10), 2), ("a", datetime(2024, 1, 1, 12), 3), ("b", None, 4)], "k string, ts timestamp_ntz, x int")
    right = spark.createDataFrame([("a", datetime(2024, 1, 1, 10), 10), ("a", datetime(2024, 1, 1, 10, 30), 11), (None, datetime(2024, 1, 1, 9), 12)], "k string, ts timestamp_ntz, x int")
    got = {r.x: r.right_x for r in joins.asof_join(left, right, ["k"], "ts", "ts", 3600 * 10**6).collect()}
    assert got == {1: 10, 2: 12, 3: None, 4: None}
    with pytest.raises(ValueError):
        joins.asof_join(left, right, ["k"], "ts", "ts", -1)


def test_last_write_wins(spark):
    rows = spark.createDataFrame([("a", 1, 5.0, 1), ("a", 1, None, 2), ("a", 2, 7.0, 3)], "tag string, t int, v double, seq int")
    assert {(r.t, r.v) for r in measurements.last_write_wins(rows, ["tag"], "t", "seq").collect()} == {(1, None), (2, 7.0)}


def test_rollup_cycles():
    assert measurements.cascade_order({"day": "hour", "hour": "raw"}) == ["hour", "day"]
    with pytest.raises(ValueError):
        measurements.cascade_order({"a": "b", "b": "a"})


def test_builder_refusals(spark):
    frame = spark.createDataFrame([("a", datetime(2024, 1, 1), 1.0)], "tag string, ts timestamp_ntz, value double")
    q = Query(frame, time="ts", tags=["tag"], fields=["value"])
    for wrong in (q.offset(2), q.aggregate("sum").downsample("1h", "avg"), q.between(datetime(2024, 2, 1), datetime(2024, 1, 1)), q.aggregate("mode")):
        with pytest.raises(ValueError):
            wrong.run(spark)
    for function, options in (("row_number", {}), ("irate", {}), ("increase", {}), ("range_sum", {"micros": 10**6}), ("moving_average", {"n": 1})):
        assert q.over(function, **options).run(spark).count() == 1
    assert q.limit(1).run(spark).count() == 1 and q.present("value").run(spark).columns == ["tag", "ts"]


def test_read_only_guard(spark):
    for text in ("DROP TABLE x", "INSERT INTO x VALUES (1)", "SET a=b", "SELECT 1; DROP TABLE x", "EXPLAIN DELETE FROM x", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "FROM x INSERT INTO y SELECT *", "WITH a AS (SELECT 1) FROM a INSERT INTO x SELECT *", "CREATE TABLE t AS SELECT 1", "EXPLAIN INSERT INTO x SELECT 1", "CACHE TABLE x", "", "TRUNCATE TABLE x"):
        with pytest.raises(ReadOnlyError):
            guard(text)
    for text in ("SELECT 'drop; table x'", "DESCRIBE TABLE x", "FROM x SELECT *", "(SELECT 1) UNION (SELECT 2)", "WITH a AS (SELECT 1) SELECT * FROM a", "EXPLAIN SELECT 1", "SHOW TABLES", "-- hi\nSELECT 1"):
        guard(text.split("\n")[-1])
    session = SqlSession(spark, {"cpu": spark.createDataFrame([(datetime(2024, 1, 1),)], "_time timestamp_ntz")})
    assert session.sql("SELECT * FROM cpu WHERE _time BETWEEN 1704067200000000000 AND 1704067200000000000").count() == 1
    assert session.suggest("cpi") == ["cpu"] and "timestamp_micros" in rewrite("_time > 1704067200000000000")


def test_detectors_find_a_spike(spark):
    rows = spark.createDataFrame([("a", i, 10.0 + i % 5 + (200.0 if i == 70 else 0.0)) for i in range(100)], "k string, t int, v double")
    for method, options in (("zscore", {}), ("modified_zscore", {}), ("iqr", {}), ("moving_average", {"window": 10}), ("dynamic_threshold", {"lookback": 20}), ("forecast_residual", {}), ("cusum", {})):
        found = anomaly.detect(rows, method, ["k"], "v", ["t"], **options)
        assert found.count() == 100 and found.where("is_anomaly and t = 70").count() == 1, method
        assert found.where("score < 0 or score > 1").count() == 0
    with pytest.raises(ValueError):
        anomaly.detect(rows, "guess", ["k"], "v", ["t"])


def test_interpolation_and_clocks(spark):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 0), 0.0), ("a", datetime(2024, 1, 1, 4), 8.0)], "k string, ts timestamp_ntz, v double")
    got = [r.v for r in preprocess.interpolate(rows, ["k"], "ts", "v", 3600 * 10**6).orderBy("ts").collect()]
    assert got == [0.0, 2.0, 4.0, 6.0, 8.0]
    back = spark.createDataFrame([("a", 1, datetime(2024, 1, 1, 0, 0, 5)), ("a", 2, datetime(2024, 1, 1, 0, 0, 4))], "k string, n int, ts timestamp_ntz")
    fixed = preprocess.monotonic_times(back, ["k"], "n", "ts").orderBy("n").collect()
    assert fixed[1].ts > fixed[0].ts


def test_kernels():
    t = np.arange(96, dtype=float)
    y = 50 + 0.1 * t + 10 * np.sin(2 * np.pi * t / 12)
    assert K.detect_period(y) == 12
    ahead = 50 + 0.1 * np.arange(96, 108) + 10 * np.sin(2 * np.pi * np.arange(96, 108) / 12)
    assert np.abs(K.holt_winters(y, 12, 12).mean - ahead).max() < 2
    trend, seasonal, residual = K.stl(y, 12)
    assert np.allclose(trend + seasonal + residual, y) and np.abs(residual).max() < 1.5
    line = 3 + 2 * t
    assert np.allclose(K.linear(line, 3).mean, 3 + 2 * np.arange(96, 99)) and np.allclose(K.holt(line, 3).mean, 3 + 2 * np.arange(96, 99), atol=0.5)
    rng = np.random.default_rng(1)
    ar = np.zeros(400)
    for i in range(1, 400):
        ar[i] = 0.7 * ar[i - 1] + rng.normal()
    x = ar - ar.mean()
    assert abs(K.arima(ar, 2, (1, 0, 0)).parameters["ar"][0] - (x[1:] @ x[:-1]) / (x[:-1] @ x[:-1])) < 0.01
    assert K.auto_forecast(y, 6).parameters["selected"] in K.MODELS
    a = rng.integers(0, 9, 60).astype(float)
    b = a + rng.integers(0, 5, 60)
    pairs = [(i, j) for i in range(60) for j in range(i)]
    s = sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i, j in pairs)
    na, nb = sum(a[i] != a[j] for i, j in pairs), sum(b[i] != b[j] for i, j in pairs)
    assert abs(K.kendall(a, b) - s / np.sqrt(na * nb)) < 1e-12
    x = rng.normal(size=(300, 2))
    x[7] = (9, -9)
    assert int(np.argmax(K.isolation_scores(x))) == 7 and int(np.argmax(K.mahalanobis(x))) == 7
    cause = rng.normal(size=300)
    effect = np.roll(cause, 1) + 0.1 * rng.normal(size=300)
    assert K.granger(cause, effect, 2)[1] < 1e-6 < K.granger(effect[::-1].copy(), rng.normal(size=300), 2)[1]
    assert abs(K._beta_tail(2, 3, 0.4) - 0.5248) < 1e-4
    assert K.adwin(np.concatenate([np.zeros(200), np.ones(200)])) and not K.adwin(np.zeros(200))


def test_metric_syntax():
    assert duration("1h30m") == 5_400_000
    assert parse("a + b * 2 ^ 3") == Binary("+", Selector("a"), Binary("*", Selector("b"), Binary("^", Number(2), Number(3))))
    assert parse('x{a=~"b.*"}[5m] offset 1h').range == 300_000 and parse("max_over_time(x[1h:5m])").arguments[0].step == 300_000
    for wrong in ("a +", "sum(", "x[5m", "topk(3)", "a{b}", "1 offset 5m"):
        with pytest.raises(SyntaxProblem):
            parse(wrong)


def test_metric_rates_and_histograms(spark):
    second = lambda s: datetime.fromtimestamp(s, tz=None) if False else datetime(1970, 1, 1, 0, s // 60, s % 60)
    counter = spark.createDataFrame([("api", second(15 * i), 100.0 + 10 * i) for i in range(1, 5)], "job string, ts timestamp_ntz, value double")
    engine = Engine(spark)
    engine.add("http_requests_total", counter, "ts", ["job"], ["value"])
    at = 60 * 10**6
    assert abs(engine.instant("increase(http_requests_total[1m])", at).first().value - 40.0) < 1e-9
    assert engine.instant("http_requests_total", at).first().value == 140.0
    buckets = spark.createDataFrame([(le, second(60), v) for le, v in (("0.1", 10.0), ("0.5", 30.0), ("1", 40.0), ("+Inf", 40.0))], "le string, ts timestamp_ntz, value double")
    engine.add("lat_bucket", buckets, "ts", ["le"], ["value"])
    assert abs(engine.instant("histogram_quantile(0.5, lat_bucket)", at).first().value - 0.3) < 1e-9
    assert engine.instant("vector(1) + 2", at).first().value == 3.0
    with pytest.raises(MetricError):
        engine.instant("http_requests_total[5m]", at)
    with pytest.raises(MetricError):
        engine.range("http_requests_total", 0, 10**12, 1)


def test_formats(spark):
    lines = ['cpu,host=a\\ b,dc=x usage=0.5,n=3i,u=7u,d=1.25d,s="x, \\"y",ok=t 1700000000000000000', "# note", "", "broken"]
    got = {r.measurement: r for r in ingest.line_protocol(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    point = got["cpu"]
    assert point.tags == {"host": "a b", "dc": "x"} and point.fields["usage"].double == 0.5 and point.fields["n"].long == 3
    assert point.fields["s"].string == 'x, "y' and point.fields["ok"].boolean and float(point.fields["d"].decimal) == 1.25 and point._time_ns == 1700000000000000000
    assert got[""].error == "not a point"
    points = ingest.json_points(spark.createDataFrame([('{"measurement":"m","tags":{"a":"b"},"fields":{"v":1.5},"timestamp":1000}',)], "value string")).collect()
    assert points[0].fields == {"v": 1.5} and points[0]._time_ns == 1000
    otlp = '{"resourceMetrics":[{"resource":{"attributes":[{"key":"svc","value":{"stringValue":"a"}}]},"scopeMetrics":[{"metrics":[{"name":"q","gauge":{"dataPoints":[{"timeUnixNano":"5","asDouble":2.5}]}}]}]}]}'
    row = ingest.otlp_json(spark.createDataFrame([(otlp,)], "value string")).first()
    assert (row.measurement, row.field, row.value, row.tags) == ("q", "gauge", 2.5, {"svc": "a"})
    topic = ingest.topic_tags(spark.createDataFrame([("site/7/power",), ("x",)], "topic string"), "site/{site}/{measurement}").collect()
    assert len(topic) == 1 and topic[0].measurement == "power" and topic[0].tags == {"site": "7"}
    assert ingest.demo(spark, 1, 600).count() == 4 * 144


def test_triggers(spark, tmp_path):
    registry = triggers.Registry()
    registry.execute("CREATE TRIGGER hot ON cpu WHEN v > 5 AND tag host != 'b' OR v > 90 DELIVER webhook COOLDOWN INTERVAL '1 minute'")
    rows = [(i, "point_written", "cpu", datetime(2024, 1, 1, 0, 0, 30 * i % 60, 0).replace(minute=30 * i // 60), {"host": h}, {"v": v}) for i, (h, v) in enumerate([("a", 6.0), ("a", 7.0), ("b", 8.0), ("b", 95.0), ("a", 9.0)])]
    rows.append((9, "point_written", "cpu", datetime(2024, 1, 1), {}, {"v": 6.0}))
    events = spark.createDataFrame(rows, triggers.EVENT)
    fired = triggers.evaluate(events, registry.triggers["hot"])
    assert sorted(r.seq for r in fired.collect()) == [0, 1, 3, 4, 9]
    assert sorted(r.seq for r in triggers.with_cooldown(fired, 60).collect()) == [0, 3, 4, 9]
    registry.execute("ALTER TRIGGER hot DISABLE")
    assert triggers.evaluate(events, registry.triggers["hot"]).count() == 0 and len(registry.execute("SHOW TRIGGERS")) == 1
    registry.execute("DROP TRIGGER hot")
    registry.execute("CREATE TRIGGER quoted ON cpu WHEN tag host = 'this and that or both' OR v > 90")
    assert [r.seq for r in triggers.evaluate(events, registry.triggers["quoted"]).collect()] == [3]
    for wrong in ("DROP TRIGGER hot", "CREATE TRIGGER x ON m WHEN nonsense here", "MAKE"):
        with pytest.raises(triggers.TriggerProblem):
            registry.execute(wrong)


def test_streams(spark, tmp_path):
    rows = [(i, "point_written", "cpu", datetime(2024, 1, 1, 0, i), {"host": "a"}, {"v": float(i)}) for i in range(6)]
    spark.createDataFrame(rows, triggers.EVENT).coalesce(1).write.parquet(str(tmp_path / "events"))
    schema = spark.read.parquet(str(tmp_path / "events")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "events"))
    query = triggers.stream_rollup(stream, "v", "2 minutes", "1 minute").writeStream.format("memory").queryName("rolled").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert spark.table("rolled").count() >= 1
    fired = triggers.evaluate(spark.readStream.schema(schema).parquet(str(tmp_path / "events")), triggers.Trigger("t", "cpu", "v >= 0"))
    query = triggers.stream_cooldown(fired, 600.0).writeStream.format("memory").queryName("cooled").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(processingTime="1 second").start()
    for _ in range(60):  # a query with timeouts never runs out of batches
        if spark.table("cooled").count():
            break
        time.sleep(1)
    query.stop()
    assert spark.table("cooled").count() == 1


def test_detector_walks_seasons(spark):
    from tempora.operators.detectors import Detector

    rows = [("a", datetime(2024, 1, 1 + i // 24, i % 24), (10.0 if i % 24 < 12 else 50.0) + i % 3) for i in range(240)]
    rows[200] = ("a", rows[200][1], 500.0)
    frame = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    found = Detector("d", "v", "ts", ["k"], season="1d", slot="12h").verdicts(frame)
    assert found.count() == 240 and [r.value for r in found.where("anomaly").collect()] == [500.0]
    shifted = frame.withColumn("v", F.when(F.col("ts") > F.lit(datetime(2024, 1, 6)), F.col("v") + 3).otherwise(F.col("v")))
    assert Detector("d", "v", "ts", ["k"], method="cusum", season="1d", slot="12h").verdicts(shifted).where("anomaly").count() > 0


def test_histograms(spark):
    from tempora.functions import histograms as H

    values = [(i % 2, float(i)) for i in range(1, 1001)] + [(0, 0.0)]
    one = H.observe(spark.createDataFrame(values, "k int, v double"), ["k"], "v")
    h = F.col("histogram")
    row = H.merge(one, []).select(H.histogram_count(h).alias("n"), H.histogram_avg(h).alias("m"), H.histogram_quantile(0.5, h).alias("q"), H.histogram_fraction(0, 250, h).alias("f"), H.histogram_stdvar(h).alias("v")).first()
    assert row.n == 1001 and abs(row.m - 500.5 * 1000 / 1001) < 1e-6 and abs(row.q - 500) < 25 and abs(row.f - 0.25) < 0.02 and abs(row.v / 83333 - 1) < 0.1


def test_composites_and_scalars(spark):
    from tempora.api import Database
    from tempora.operators import derived

    rows = [(datetime(2024, 1, 1, 0, i), float(i), float(10 - i)) for i in range(10)]
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, a double, b double")
    found = derived.composite(frame, "ts", {"high": "a > 5", "low": "b < 3"}, 2).collect()
    assert [r.ts.minute for r in found] == [8, 9] and found[0].severity == "critical"
    assert derived.composite(frame, "ts", {"high": "a > 5"}, 1, 3600 * 10**6).count() == 1
    half = [(datetime(2024, 1, 1, 0, i // 2, 30 * (i % 2)), 9.0) for i in range(10)]
    assert derived.composite(spark.createDataFrame(half, "ts timestamp_ntz, a double"), "ts", {"high": "a > 5"}, 1, 60 * 10**6).count() == 5
    db = Database(spark)
    db.add("m", frame.withColumn("tag", F.lit("x")), "ts", ["tag"], ["a"])
    at = 1704067200 * 10**6 + 9 * 60 * 10**6
    assert db.query_promql("scalar(m_a) * 2", at).first().value == 18.0 and db.list_metrics() == ["m_a"]
    assert db.query_sql("SELECT count(*) AS n FROM m").first().n == 10 and "Scan" in db.explain("SELECT * FROM m")
    assert {r.name: r.n for r in db.cardinality("m").collect()} == {"series": 1, "tag": 1}
    assert db.detect_anomalies("m", "a").count() == 10 and db.forecast("m", "a", 2, "linear").count() == 2


def test_models_as_rows(spark, tmp_path):
    from tempora.operators import lifecycle

    registry = lifecycle.Registry(spark, str(tmp_path / "models"))
    with pytest.raises(KeyError):
        registry.load("m")
    assert registry.save("m", {"alpha": 0.1}) == 1 and registry.save("m", {"alpha": 0.2}, {"stage": "live"}) == 2
    assert registry.load("m") == {"alpha": 0.2} and registry.load("m", 1) == {"alpha": 0.1} and registry.load("m", tags={"stage": "live"})["alpha"] == 0.2
    rows = spark.createDataFrame([(i, 1.0 * i, 1.0 * i, i + 1.0 if i < 50 else i + 9.0) for i in range(100)], "id long, y double, a double, b double")
    arms = {r.arm: r for r in lifecycle.compare(rows, "id", "y", "a", "b", 30).collect()}
    assert arms["champion"].mae == 0 and arms["challenger"].mae > 1 and arms["champion"].n + arms["challenger"].n == 100
    tracked = lifecycle.tracked_accuracy(rows, [], ["id"], "y", "b", 10)
    assert tracked.where("stale").count() > 0 and tracked.where("stale and id < 50").count() == 0
    flags = spark.createDataFrame([("d", True, True), ("d", True, False), ("d", False, True), ("d", True, None)], "k string, anomaly boolean, ok boolean")
    assert lifecycle.feedback_precision(flags, ["k"], "anomaly", "ok").first().precision == 0.5


def test_archives(spark, tmp_path):
    from tempora.sources import storage

    rows = spark.createDataFrame([(datetime(2024, 1, d), float(d)) for d in range(1, 11)], "ts timestamp_ntz, v double")
    stays = storage.archive(rows, str(tmp_path / "cold"), "m", "ts", datetime(2024, 1, 6))
    assert stays.count() == 5 and storage.cold_tier(spark, str(tmp_path / "cold"), "m").count() == 5
    storage.export(rows, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_forecasts_in_sql(spark):
    rows = [("a", datetime(2024, 1, 1, 0, i), 5.0 + i) for i in range(20)] + [("b", datetime(2024, 1, 1), 1.0)]
    session = SqlSession(spark, {"m": spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")})
    session.register_forecasts()
    got = {r.k: (r.f, r.a) for r in session.sql("SELECT k, forecast(v, ts, 2) AS f, auto_forecast(v, ts, 3) AS a FROM m GROUP BY k").collect()}
    assert len(got["a"][0]) == 2 and abs(got["a"][1][2] - 27.0) < 1.0 and got["b"] == (None, None)


def test_rates_of_long_series_and_repeated_times(spark):
    from tempora.functions import aggregates as A

    rows = [("a", datetime(2024, 1, 1 + i // 24, i % 24), float(i % 30), i) for i in range(100)] + [("a", datetime(2024, 1, 1), 7.0, 1000), ("b", datetime(2024, 1, 1), 1.0, 0), ("c", datetime(2024, 1, 1), None, 0)]
    frame = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double, n int")
    values = [7.0] + [float(i % 30) for i in range(1, 100)]
    rise = sum(b if b < a else b - a for a, b in zip(values[:-1], values[1:], strict=True))
    for chunk in ("1h", "1d", "52w"):
        got = {r.k: (r.rate, r.irate) for r in A.counter_rates(frame, ["k"], "v", "ts", "n", chunk).collect()}
        assert got["a"] == (pytest.approx(rise / (99 * 3600)), pytest.approx(1 / 3600)) and got["b"] == (None, None) and set(got) == {"a", "b"}
    whole = frame.groupBy("k").agg(A.samples(F.col("v"), F.col("ts"), F.col("n")).alias("s")).select("k", A.rate_of(F.col("s")).alias("r"))
    assert {r.k: r.r for r in whole.where("k <> 'c'").collect()}["a"] == pytest.approx(rise / (99 * 3600))


def test_walks_against_plain_loops(spark):
    rng = np.random.default_rng(4)
    series = {k: [None if rng.random() < 0.1 else float(x) for x in rng.normal(size=300).cumsum()] for k in ("a", None)}
    rows = [(k, i, v, {"x": 1}) for k, vs in series.items() for i, v in enumerate(vs)]
    frame = spark.createDataFrame(rows, "k string, t int, v double, m map<string,int>").repartition(3)
    smoothed = {(r.k, r.t): r.ewm for r in preprocess.ewm(frame, ["k"], ["t"], "v", 0.3).collect()}
    alarms = {(r.k, r.t): r.is_anomaly for r in anomaly.cusum(frame, ["k"], "v", ["t"]).collect()}
    fixed = {(r.k, r.t): r.score for r in anomaly.forecast_residual(frame, ["k"], "v", ["t"], alpha=0.3).collect()}
    fitted = anomaly.forecast_residual(frame, ["k"], "v", ["t"])
    assert fitted.count() == 600
    for k, vs in series.items():
        own = np.array([v for v in vs if v is not None])
        mean, std = own.mean(), own.std(ddof=1)
        h, slack = max(4 * std, 1e-3), max(0.5 * std, 1e-4)
        level, up, down, residuals = None, 0.0, 0.0, []
        state = None
        for t, v in enumerate(vs):
            if v is not None:
                state = v if state is None else state + 0.3 * (v - state)
                residuals.append((t, None if level is None else v - level))
                level = v if level is None else level + 0.3 * (v - level)
                up, down = max(up + v - mean - slack, 0), max(down - (v - mean) - slack, 0)
            assert smoothed[k, t] == (None if state is None else pytest.approx(state))
            assert alarms[k, t] == (max(up, down) > h)
            if max(up, down) > h:
                up = down = 0.0
        seen = np.array([x for _, x in residuals if x is not None])
        for t, x in residuals:
            want = 0.0 if x is None else 1 / (1 + np.exp(-2 * (abs(x - seen.mean()) / seen.std(ddof=1) - 3)))
            assert fixed[k, t] == pytest.approx(want, abs=1e-9)


def test_upsampling_and_pipelines(spark):
    rows = [("a", datetime(2024, 1, 1, 0, 0), 0.0), ("a", datetime(2024, 1, 1, 0, 25), 25.0), ("a", datetime(2024, 1, 1, 0, 30), 10.0), ("b", datetime(2024, 1, 1), 5.0)]
    frame = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    got = [(r.k, r.ts.minute, r.v) for r in preprocess.resample_up(frame, ["k"], "ts", "v", 600 * 10**6).orderBy("k", "ts").collect()]
    assert got == [("a", 0, 0.0), ("a", 10, 10.0), ("a", 20, 20.0), ("a", 30, 10.0), ("b", 0, 5.0)]
    made = preprocess.Pipeline().then(preprocess.resample_up, keys=["k"], time="ts", value="v", interval=600 * 10**6).then(preprocess.ewm, keys=["k"], order=["ts"], value="v", alpha=0.5).run(frame)
    assert [r.ewm for r in made.where("k = 'a'").orderBy("ts").collect()] == [0.0, 5.0, 12.5, 11.25]


def _plain_functions(values, name):
    """Window functions over one series, plainly; null rows stay where the engine's rules keep them."""
    v = [None if x is None else float(x) for x in values]
    n = len(v)
    seen = np.array([x for x in v if x is not None])
    if name == "diff":
        return [None if i < 1 or v[i] is None or v[i - 1] is None else v[i] - v[i - 1] for i in range(n)]
    if name == "pct":
        return [None if i < 1 or v[i] is None or v[i - 1] in (None, 0.0) else (v[i] - v[i - 1]) / v[i - 1] for i in range(n)]
    if name in ("mean", "std"):
        out = []
        for i in range(n):
            own = np.array([x for x in v[max(0, i - 2) : i + 1] if x is not None])
            out.append(None if i < 2 or len(own) < (1 if name == "mean" else 2) else float(own.mean() if name == "mean" else own.std(ddof=1)))
        return out
    if name == "z":
        return [None if x is None or seen.std(ddof=1) == 0 else (x - seen.mean()) / seen.std(ddof=1) for x in v]
    out, state = [], None
    for x in v:
        state = state if x is None else x if state is None else state + 0.5 * (x - state)
        out.append(state)
    return out


def test_analytics_by_sql_name(spark):
    from tempora.plans.dialect import DialectError

    rng = np.random.default_rng(11)
    data = {k: [None if rng.random() < 0.15 else round(float(x), 3) for x in 5 + rng.normal(size=60)] for k in ("a", "b")} | {"c": [1.0, 1.0, 1.0]}
    rows = [(k, datetime(2024, 1, 1 + i // 24, i % 24), v, float(i % 7)) for k, vs in data.items() for i, v in enumerate(vs)]
    session = SqlSession(spark, {"m": spark.createDataFrame(rows, "host string, _time timestamp_ntz, v double, b double").repartition(3)})
    over = "OVER (PARTITION BY host ORDER BY _time)"
    found = session.sql(f"""SELECT host, _time, v, diff(v) {over} AS diff, pct_change(v) {over} AS pct, rolling_mean(v, 3) OVER w AS mean, rolling_std(v, 3) {over} AS std,
        zscore(v) OVER (PARTITION BY host) AS z, ewm(v, 0.5) {over} AS ewm, anomaly_score(v, 2.0) {over} AS score, 'diff(v) OVER' AS text
        FROM m x WHERE host <> 'none' WINDOW w AS (PARTITION BY host ORDER BY _time) ORDER BY host, _time""").collect()
    assert len(found) == len(rows) and found[0].text == "diff(v) OVER"
    for k, vs in data.items():
        own = [r for r in found if r.host == k]
        for name in ("diff", "pct", "mean", "std", "z", "ewm"):
            for r, want in zip(own, _plain_functions(vs, name), strict=True):
                assert r[name] == (want if want is None else pytest.approx(want, abs=1e-9)), (k, name)
    pairs = session.sql(f"SELECT host, correlation(v, b) {over} AS r, cross_correlation(v, b, 2) {over} AS c, rolling_corr(v, b, 10) {over} AS w, multivariate_anomaly(v, b, 3.0) {over} AS d FROM m").collect()
    v, b = (np.array(x, float) for x in zip(*[(r[2], r[3]) for r in rows if r[0] == "a" and r[2] is not None], strict=True))
    assert next(r.r for r in pairs if r.host == "a") == pytest.approx(np.corrcoef(v, b)[0, 1])
    shifted = np.array([(y, float((i - 2) % 7)) for i, y in enumerate(data["a"]) if i >= 2 and y is not None])
    assert next(r.c for r in pairs if r.host == "a") == pytest.approx(np.corrcoef(shifted.T)[0, 1])
    cov = np.cov(v, b) + 1e-6 * np.eye(2)
    far = np.sqrt(np.einsum("ij,jk,ik->i", np.c_[v - v.mean(), b - b.mean()], np.linalg.inv(cov), np.c_[v - v.mean(), b - b.mean()]))
    assert sorted(r.d for r in pairs if r.host == "a" and r.d is not None) == pytest.approx(sorted(far))
    parts = session.sql(f"SELECT v, d.trend + d.seasonal + d.residual - v AS off FROM (SELECT v, stl_decompose(v, 12) {over} AS d FROM m WHERE host = 'a')").collect()
    assert all((r.off is None) if r.v is None else abs(r.off) < 1e-9 for r in parts)
    every = session.sql(f"SELECT *, stl_trend(v, 12) {over} AS t FROM m WHERE host = 'b'")
    assert every.columns == ["host", "_time", "v", "b", "t"] and every.where("v is not null and t is null").count() == 0
    ahead = session.sql("SELECT host, multivariate_forecast(v, b, _time, 2) AS f FROM m GROUP BY host ORDER BY host").collect()
    slope, intercept = np.polyfit(b, v, 1)
    assert ahead[0].f == pytest.approx([intercept + slope * rows[59][3]] * 2) and ahead[2].f is None
    for wrong in ("diff(v, 1)", f"rolling_mean(v, 0) {over}", f"rolling_mean(v) {over}", f"ewm(v, 2.0) {over}", f"stl_trend(v, 1) {over}", "time_bucket('1d')", "rate(v, _time, v, v)", f"ewm(v, 0.5) {over}, count(*)"):
        with pytest.raises(ValueError):
            session.sql(f"SELECT {wrong} FROM m" + (" GROUP BY v" if "count" in wrong else "")).collect()
    session.register_aggregate("spread", lambda v: float(v.max() - v.min()), "double")
    assert session.sql("SELECT host, spread(v) AS s FROM m WHERE v IS NOT NULL GROUP BY host ORDER BY host").first().s == pytest.approx(max(v) - min(v))


def test_bucket_arguments_in_sql(spark):
    times = [(datetime(2024, 3, 30, 22, 59) ,), (datetime(2024, 3, 30, 23, 30),), (datetime(2024, 3, 31, 21, 59),), (datetime(2024, 10, 27, 0, 30),), (datetime(2024, 2, 14, 12),)]
    frame = spark.createDataFrame(times, "ts timestamp_ntz")
    session = SqlSession(spark, {"m": frame})
    origin = datetime(2024, 1, 15)
    for width in ("1d", "1w", "1mo", "1y", "6h", "15m"):
        for tz, sql_tz in ((None, "NULL"), ("Europe/Berlin", "'europe/berlin'"), ("Asia/Kolkata", "'Asia/Kolkata'")):
            for start, sql_start in ((None, ""), (origin, ", '2024-01-15'"), (origin, ", TIMESTAMP '2024-01-15 00:00:00'")):
                want = [r.b for r in frame.select("ts", time_bucket(width, F.col("ts"), tz, start).alias("b")).orderBy("ts").collect()]
                got = [r.b for r in session.sql(f"SELECT ts, time_bucket('{width}', ts, {sql_tz}{sql_start}) AS b FROM m ORDER BY ts").collect()]
                assert got == want, (width, tz, start)
    with pytest.raises(ValueError):
        session.sql("SELECT time_bucket('1d', ts, 'Mars/Base') FROM m")
    assert session.sql("SELECT 'time_bucket(''1d'', ts)' AS t, 'ts > 1704067200000000000' AS u FROM m").first().u == "ts > 1704067200000000000"


def test_auto_forecast_candidates():
    rng = np.random.default_rng(3)
    t = np.arange(240.0)
    growing = (50 + 0.5 * t) * (1 + 0.3 * np.sin(2 * np.pi * t / 12)) + rng.normal(0, 0.3, 240)
    found = K.auto_forecast(growing, 12)
    assert found.parameters["label"] == "multiplicative holt_winters[12]" and found.parameters["selected"] == "holt_winters"
    seasonal = np.zeros(300)
    noise = rng.normal(size=300)
    for i in range(12, 300):
        seasonal[i] = 0.9 * seasonal[i - 12] + noise[i]
    found = K.auto_forecast(seasonal, 12).parameters
    assert {k.split("(")[0] for k in found["scores"]} == {"ses", "holt", "damped_holt", "linear", "arima", "holt_winters[12]"}
    assert sum(k.endswith("[12]") and k.startswith("arima") for k in found["scores"]) == 2 and found["label"].endswith("[12]")
    # too short for a seasonal order, a window of thirty, two seasons, ten values
    assert set(K.candidates(growing[:20], 12, None)) == {"ses", "holt", "damped_holt", "linear"}
    assert set(K.candidates(growing[:9], 5, None)) == {"ses"}
    assert K.seasonal_difference(growing, 12) == 1 and K.seasonal_difference(rng.normal(size=120), 12) == 0
    # the order is searched in the first window only
    changed = np.concatenate([growing[:204], rng.normal(size=36)])
    assert [k for k in K.candidates(changed, 204, None) if "arima" in k] == [k for k in K.candidates(growing, 204, None) if "arima" in k]


def test_arima_residuals_match_a_plain_recursion():
    y = np.cumsum(np.random.default_rng(5).normal(size=120))
    found = K.arima(y, 1, (2, 1, 1)).parameters
    x, e = np.diff(y), np.zeros(119)
    for i in range(2, 119):
        e[i] = x[i] - found["ar"][0] * x[i - 1] - found["ar"][1] * x[i - 2] - found["ma"][0] * e[i - 1]
    assert abs(np.mean(e[2:] ** 2) - found["sigma2"]) < 1e-9


def test_ranks_number_runs_in_time_order(spark):
    at = lambda i: datetime(2024, 1, 1, 0, i)
    values = [10.0, 20.0, 20.0, 25.0, 20.0, None, None]
    frame = spark.createDataFrame([(k, at(i), v) for k in ("a", "b") for i, v in enumerate(values)], "k string, ts timestamp_ntz, value double").repartition(3)
    want = {"rank": [1, 2, 2, 4, 5, 6, 6], "dense_rank": [1, 2, 2, 3, 4, 5, 5]}
    for function, numbers in want.items():
        got = Query(frame, "ts", ["k"], ["value"]).over(function).run(spark).orderBy("k", "ts").collect()
        assert [r[function] for r in got] == [*map(float, numbers)] * 2
