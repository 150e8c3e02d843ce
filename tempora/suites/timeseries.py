"""Buckets, ordered aggregates, windows, as-of joins and dataset operators over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.catalog import ORACLE_SQL, QUERIES, query
from tempora.functions import aggregates as A
from tempora.functions import windows as W
from tempora.functions.buckets import time_bucket
from tempora.operators import joins, measurements
from tempora.plans.builder import Query
from tempora.session import table


def _r(column, digits: int = 6):
    return F.round(column, digits)


def _bucket(name: str, width: str, sql_width: str):
    def run(spark, sf_dir):
        return table(spark, sf_dir, "events").groupBy(time_bucket(width, F.col("ts")).alias("bucket"), "event_type").agg(_r(F.avg("value")).alias("avg_value"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"""
        SELECT time_bucket(INTERVAL '{sql_width}', ts) AS bucket, event_type, round(avg(value), 6) AS avg_value, arg_max(value, (ts, event_id)) AS last_value
        FROM events GROUP BY 1, 2"""


for _name, _width, _sql in (("bucket_15min_avg", "15m", "15 minutes"), ("bucket_1h_avg", "1h", "1 hour"), ("bucket_1d", "1d", "1 day"), ("bucket_1w", "1w", "7 days"), ("bucket_1mo", "1mo", "1 month"), ("bucket_3mo", "3mo", "3 months"), ("bucket_1y", "1y", "1 year")):
    _bucket(_name, _width, _sql)


@query(
    """SELECT (date_trunc('month', ts - INTERVAL 14 DAY) + INTERVAL 14 DAY) AS bucket, count(*) AS n FROM events GROUP BY 1"""
)
def bucket_origin_15th(spark, sf_dir):
    bucket = time_bucket("1mo", F.col("ts"), origin=datetime(1970, 1, 15))
    return table(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT timezone('UTC', timezone('Europe/Berlin', date_trunc('day', timezone('Europe/Berlin', timezone('UTC', ts))))) AS bucket, count(*) AS n FROM events GROUP BY 1"""
)
def bucket_zoned_day(spark, sf_dir):
    bucket = time_bucket("1d", F.col("ts"), tz="europe/berlin")
    return table(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id"""
)
def first_last(spark, sf_dir):
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))


_SAMPLES = """samples AS (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id, ts),
    steps AS (SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pt, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS back FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts))"""


@query(
    f"""WITH {_SAMPLES}
    SELECT user_id, round(CASE WHEN count(*) >= 2 THEN sum(CASE WHEN pv IS NULL THEN 0.0 WHEN value < pv THEN value ELSE value - pv END)
           / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) END, 6) AS rate FROM steps GROUP BY user_id"""
)
def rate_by_user(spark, sf_dir):
    return A.counter_rates(table(spark, sf_dir, "events"), ["user_id"], "value", "ts", "event_id").select("user_id", _r(F.col("rate")).alias("rate"))


@query(
    f"""WITH {_SAMPLES}
    SELECT user_id, round(max(CASE WHEN back = 1 AND pv IS NOT NULL THEN (CASE WHEN value < pv THEN value ELSE value - pv END) / ((epoch_us(ts) - epoch_us(pt)) / 1e6) END), 6) AS irate
    FROM steps GROUP BY user_id"""
)
def irate_by_user(spark, sf_dir):
    return A.counter_rates(table(spark, sf_dir, "events"), ["user_id"], "value", "ts", "event_id").select("user_id", _r(F.col("irate")).alias("irate"))


def _downsample(fn: str, sql: str):
    def run(spark, sf_dir):
        return Query(table(spark, sf_dir, "events"), time="ts", tags=["event_type"], fields=["value"]).group_by("event_type").downsample("6h", fn).run(spark).withColumn("value", _r(F.col("value")))

    QUERIES[f"downsample_{fn}"] = run
    ORACLE_SQL[f"downsample_{fn}"] = f"SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS ts, round(CAST({sql} AS DOUBLE), 6) AS value FROM events GROUP BY 1, 2"


for _fn, _sql in (("avg", "avg(value)"), ("sum", "sum(value)"), ("min", "min(value)"), ("max", "max(value)"), ("count", "count(value)"), ("first", "arg_min(value, ts)"), ("last", "arg_max(value, ts)")):
    _downsample(_fn, _sql)


@query("SELECT event_type, CAST(count(value) AS DOUBLE) AS value_count, round(sum(value), 4) AS value_sum, min(value) AS value_min, max(value) AS value_max FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1")
def native_aggregate(spark, sf_dir):
    q = Query(table(spark, sf_dir, "events"), time="ts", tags=["event_type"], fields=["value"]).since(datetime(2024, 1, 5)).group_by("event_type").aggregate("count", "sum", "min", "max")
    return q.run(spark).withColumn("value_sum", F.round("value_sum", 4))


_OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def _windowed(name: str, expression, sql: str):
    def run(spark, sf_dir):
        over = Window.partitionBy("user_id").orderBy("ts", "event_id")
        value = expression(F.col("value"), over)
        return table(spark, sf_dir, "events").select("event_id", value.alias("result"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT event_id, {sql} AS result FROM (SELECT *, row_number() {_OVER} AS rn FROM events) e"


def _lag(n: int = 1, column: str = "value") -> str:
    return f"lag({column}, {n}) {_OVER}"


_ROWS = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_ALL = "OVER (PARTITION BY user_id)"
for _name, _expression, _sql in (
    ("native_row_number", lambda v, o: F.row_number().over(o).cast("double"), "CAST(rn AS DOUBLE)"),
    ("native_lead", lambda v, o: W.lead_or(v, o, 2, -1.0), f"coalesce(lead(value, 2) {_OVER}, -1.0)"),
    ("native_lag", lambda v, o: W.lag_or(v, o, 1, 0.0), f"coalesce({_lag()}, 0.0)"),
    ("native_delta", lambda v, o: _r(W.delta(v, o)), f"round(value - {_lag()}, 6)"),
    ("native_rate", lambda v, o: _r(W.rate(v, F.col("ts"), o)), f"round(CASE WHEN epoch_us(ts) > {_lag(column='epoch_us(ts)')} THEN (value - {_lag()}) / ((epoch_us(ts) - {_lag(column='epoch_us(ts)')}) / 1e6) END, 6)"),
    ("native_moving_average", lambda v, o: _r(W.moving_average(v, o, 5)), f"round(CASE WHEN rn >= 5 THEN avg(value) {_ROWS.format(4)} END, 6)"),
    ("native_cumulative_sum", lambda v, o: _r(W.cumulative_sum(v, o), 4), f"round(sum(value) {_ROWS.format('UNBOUNDED')}, 4)"),
    ("diff1", lambda v, o: _r(W.diff(v, o, 1)), f"round(value - {_lag()}, 6)"),
    ("diff2", lambda v, o: _r(W.diff(v, o, 2)), f"round(value - 2 * {_lag()} + {_lag(2)}, 6)"),
    ("pct_change", lambda v, o: _r(W.pct_change(v, o)), f"round(CASE WHEN abs({_lag()}) >= 2.220446049250313e-16 THEN (value - {_lag()}) / {_lag()} END, 6)"),
    ("rolling_mean", lambda v, o: _r(W.rolling_mean(v, o, 4)), f"round(CASE WHEN rn >= 4 THEN avg(value) {_ROWS.format(3)} END, 6)"),
    ("rolling_std", lambda v, o: _r(W.rolling_std(v, o, 4), 5), f"round(CASE WHEN rn >= 4 THEN stddev_samp(value) {_ROWS.format(3)} END, 5)"),
    ("rolling_corr", lambda v, o: _r(W.rolling_corr(v, F.sqrt(v + 1), o, 6), 4), f"round(CASE WHEN rn >= 6 THEN corr(value, sqrt(value + 1)) {_ROWS.format(5)} END, 4)"),
    ("zscore", lambda v, o: _r(W.zscore(v, Window.partitionBy("user_id"))), f"round(CASE WHEN stddev_samp(value) {_ALL} >= 2.220446049250313e-16 THEN (value - avg(value) {_ALL}) / stddev_samp(value) {_ALL} END, 6)"),
    (
        "anomaly_score",
        lambda v, o: _r(W.anomaly_score(v, Window.partitionBy("event_type"))),
        "round(1 / (1 + exp(-2 * (abs(value - avg(value) OVER t) / greatest(stddev_samp(value) OVER t, abs(avg(value) OVER t) * 1e-9, 1e-12) - 3.0))), 6)",
    ),
    ("correlation", lambda v, o: _r(W.correlation(v, F.pow(v, 2.0), Window.partitionBy("event_type"))), "round(corr(value, value * value) OVER t, 6)"),
    ("multivariate_anomaly", lambda v, o: _r(W.mahalanobis(v, F.sqrt(v + 1), Window.partitionBy("event_type")), 4), "round(d, 4)"),
):
    _windowed(_name, _expression, _sql)
for _name in ("anomaly_score", "correlation"):
    ORACLE_SQL[_name] += " WINDOW t AS (PARTITION BY event_type)"
ORACLE_SQL["multivariate_anomaly"] = """
    WITH m AS (SELECT event_type, avg(value) AS mx, avg(sqrt(value + 1)) AS my, var_samp(value) + 1e-6 AS sxx, var_samp(sqrt(value + 1)) + 1e-6 AS syy, covar_samp(value, sqrt(value + 1)) AS sxy FROM events GROUP BY 1)
    SELECT event_id, round(sqrt(greatest((syy * (value - mx) * (value - mx) - 2 * sxy * (value - mx) * (sqrt(value + 1) - my) + sxx * (sqrt(value + 1) - my) * (sqrt(value + 1) - my)) / (sxx * syy - sxy * sxy), 0)), 4) AS result
    FROM events JOIN m USING (event_type)"""


@query(
    f"""SELECT event_id, round(sum(up) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS result
    FROM (SELECT *, CASE WHEN row_number() {_OVER} = 1 THEN 0.0 ELSE greatest(value - {_lag()}, 0.0) END AS up FROM events)"""
)
def native_increase(spark, sf_dir):
    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rises = table(spark, sf_dir, "events").withColumn("up", W.positive_step(F.col("value"), over))
    return rises.select("event_id", F.round(F.sum("up").over(over.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("result"))


@query(
    """SELECT event_id, round(avg(value) OVER r, 6) AS mean, round(sum(value) OVER r, 4) AS total, count(value) OVER r AS n
    FROM events WINDOW r AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)"""
)
def native_range_frames(spark, sf_dir):
    frame = W.range_frame(["user_id"], "ts", 86400 * 10**6)
    return table(spark, sf_dir, "events").select("event_id", _r(F.avg("value").over(frame)).alias("mean"), F.round(F.sum("value").over(frame), 4).alias("total"), F.count("value").over(frame).alias("n"))


def _ranked(function: str, sql: str):
    def run(spark, sf_dir):
        q = Query(table(spark, sf_dir, "events"), time="event_id", tags=["user_id"], fields=["event_type"]).over(function, "event_type")
        return q.run(spark).select("event_id", F.col(function).alias("result"))

    QUERIES[f"native_{function}"] = run
    ORACLE_SQL[f"native_{function}"] = f"""
        WITH steps AS (SELECT user_id, event_id, event_type, row_number() OVER w AS rn, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        runs AS (SELECT *, CASE WHEN rn = 1 OR event_type IS DISTINCT FROM before THEN 1 ELSE 0 END AS begins FROM steps)
        SELECT event_id, CAST({sql} OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS result FROM runs"""


for _fn, _sql in (("rank", "max(CASE WHEN begins = 1 THEN rn END)"), ("dense_rank", "sum(begins)")):
    _ranked(_fn, _sql)


@query(
    f"""SELECT event_type, round(corr(value, partner), 5) AS r FROM (SELECT event_type, value, lag(value, 3) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS partner FROM events) GROUP BY 1"""
)
def cross_correlation(spark, sf_dir):
    over = Window.partitionBy("event_type").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").withColumn("partner", W.cross_correlation_pairs(F.col("value"), over, 3))
    return pairs.groupBy("event_type").agg(F.round(F.corr("value", "partner"), 5).alias("r"))


@query(
    """SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber)), 3) AS next_value
    FROM lineitem GROUP BY 1"""
)
def multivariate_forecast(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    values = A.multivariate_forecast(F.col("l_extendedprice"), F.col("l_quantity"), F.struct("l_shipdate", "l_orderkey", "l_linenumber"), 3)
    return rows.groupBy("l_returnflag").agg(values.alias("v")).select("l_returnflag", F.round(F.element_at("v", 1), 3).alias("next_value"))


@query(
    """WITH clicks AS (SELECT user_id, ts, max_by(value, event_id) AS click_value FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1, 2),
    asked AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = (SELECT max(event_type) FROM events))
    SELECT a.event_id, CASE WHEN epoch_us(a.ts) - epoch_us(c.ts) <= 86400000000 THEN c.click_value END AS click_value
    FROM asked a ASOF LEFT JOIN clicks c ON a.user_id = c.user_id AND a.ts >= c.ts"""
)
def asof_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kinds = events.agg(F.min("event_type"), F.max("event_type")).first()
    clicks = events.where(F.col("event_type") == kinds[0]).groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("click_value"))
    asked = events.where(F.col("event_type") == kinds[1]).select("event_id", "user_id", "ts", "value")
    return joins.asof_join(asked, clicks, ["user_id"], "ts", "ts", 86400 * 10**6).select("event_id", "click_value")


@query("""SELECT user_id, date_trunc('hour', ts) AS ts, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2""")
def lww_dedup(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("user_id", time_bucket("1h", F.col("ts")).alias("ts"), "value", "event_id", F.col("event_id").alias("sequence"))
    return measurements.last_write_wins(points, ["user_id"], "ts", "sequence").select("user_id", "ts", "value", "event_id")


@query(
    """WITH t AS (SELECT user_id, min(ts) AS a, min(ts) + INTERVAL 2 DAY AS b FROM events WHERE user_id % 7 = 0 GROUP BY 1)
    SELECT event_id, value FROM events e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = e.user_id AND e.ts BETWEEN a AND b)"""
)
def tombstone_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    dead = events.where("user_id % 7 = 0").groupBy("user_id").agg(F.min("ts").alias("min_ts")).withColumn("max_ts", F.expr("min_ts + INTERVAL 2 DAY"))
    return joins.mask_tombstones(events, dead, ["user_id"]).select("event_id", "value")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def retention(spark, sf_dir):
    return measurements.retain(table(spark, sf_dir, "events"), "ts", "3 DAY").select("event_id")


@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY 1, 2")
def last_value(spark, sf_dir):
    return measurements.last_value(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", ["value"])


@query(
    """SELECT 'series' AS name, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM events
    UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM events"""
)
def cardinality(spark, sf_dir):
    return measurements.cardinality(table(spark, sf_dir, "events"), ["user_id", "event_type"])


_HOURLY = measurements.Rollup("hourly", "1h", ["value"], ["avg", "min", "max", "sum", "count"], ["event_type"])


@query(
    """SELECT event_type, date_trunc('hour', ts) AS ts, round(avg(value), 6) AS value_avg, min(value) AS value_min, max(value) AS value_max, round(sum(value), 4) AS value_sum, CAST(count(value) AS DOUBLE) AS value_count
    FROM events GROUP BY 1, 2"""
)
def rollup_hourly(spark, sf_dir):
    return _HOURLY.of(table(spark, sf_dir, "events")).withColumns({"value_avg": _r(F.col("value_avg")), "value_sum": F.round("value_sum", 4)})


@query("SELECT event_type, date_trunc('day', ts) AS ts, round(sum(value), 4) AS value_sum_sum FROM events GROUP BY 1, 2")
def rollup_cascade(spark, sf_dir):
    daily = measurements.Rollup("daily", "1d", ["value_sum"], ["sum"], ["event_type"])
    return daily.of(_HOURLY.of(table(spark, sf_dir, "events"))).withColumn("value_sum_sum", F.round("value_sum_sum", 4))


@query("SELECT event_type, date_trunc('hour', ts) AS ts, round(sum(value), 4) AS value_sum FROM events GROUP BY 1, 2")
def rollup_view(spark, sf_dir):
    events, mark = table(spark, sf_dir, "events"), datetime(2024, 1, 10)
    return _HOURLY.view(_HOURLY.of(events.where(F.col("ts") < F.lit(mark))), events, mark).select("event_type", "ts", F.round("value_sum", 4).alias("value_sum"))


@query("SELECT event_type, date_trunc('hour', ts) AS ts, round(sum(value), 4) AS value_sum FROM events GROUP BY 1, 2")
def rollup_repair(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    low, high = events.agg(F.min("ts"), F.expr("min(ts) + INTERVAL 1 DAY")).first()
    stale = _HOURLY.of(events.where(~F.col("ts").between(F.lit(low), F.lit(high))))
    return _HOURLY.repair(stale, events, low, high).select("event_type", "ts", F.round("value_sum", 4).alias("value_sum"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts) GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM events")
def frame_groups(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", time_bucket("1d", F.col("ts")))
    rank, frame = W.groups_frame(["event_type"], "day", 1)
    return events.select("*", rank).select("event_id", F.count(F.lit(1)).over(frame).alias("n"))


@query("SELECT event_id AS seq, value FROM events WHERE value > 90 AND event_type <> (SELECT min(event_type) FROM events)")
def trigger_threshold(spark, sf_dir):
    from tempora.streaming import triggers

    events = table(spark, sf_dir, "events")
    least = events.agg(F.min("event_type")).first()[0]
    changes = triggers.change_events(events, "events", "ts", ["event_type"], ["value"], "event_id")
    registry = triggers.Registry()
    made = registry.execute(f"CREATE TRIGGER high ON events WHEN value > 90 AND NOT tag event_type = '{least}' COOLDOWN INTERVAL '1 hour'")[0]
    return triggers.evaluate(changes, made).select("seq", F.col("fields")["value"].alias("value"))


@query()
def trigger_cooldown(spark, sf_dir):
    from tempora.streaming import triggers

    changes = triggers.change_events(table(spark, sf_dir, "events"), "events", "ts", ["event_type"], ["value"], "event_id")
    return triggers.with_cooldown(triggers.evaluate(changes, triggers.Trigger("high", "events", "value > 90")), 3600).select("series", "seq", "event_timestamp")


@query(
    """WITH t AS (SELECT *, lag(value, 4) OVER w AS old, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
    o AS (SELECT event_id, value, coalesce(old, first_value(value) OVER (PARTITION BY event_type ORDER BY event_id)) AS old, n FROM t) SELECT event_id AS seq FROM o WHERE n > 1 AND old <> 0 AND abs(value - old) / abs(old) * 100 > 150"""
)
def trigger_rate_of_change(spark, sf_dir):
    from tempora.streaming import triggers

    changes = triggers.change_events(table(spark, sf_dir, "events"), "events", "ts", ["event_type"], ["value"], "event_id")
    return triggers.evaluate(changes, triggers.Trigger("jump", "events", "rate_of_change(value, 150, 5)")).select("seq")


@query("SELECT CAST(user_id AS VARCHAR) AS user, event_type, value, epoch_us(ts) * 1000 AS _time_ns FROM events WHERE value IS NOT NULL")
def line_protocol(spark, sf_dir):
    from tempora.sources import ingest

    events = table(spark, sf_dir, "events").where("value is not null")
    text = F.concat(F.lit("events,user="), F.col("user_id").cast("string"), F.lit(",event_type="), "event_type", F.lit(" value="), F.col("value").cast("string"), F.lit(",n=3i "), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string"))
    read = ingest.line_protocol(events.select(text.alias("value")))
    return read.select(F.col("tags")["user"].alias("user"), F.col("tags")["event_type"].alias("event_type"), F.col("fields")["value"]["double"].alias("value"), "_time_ns")
