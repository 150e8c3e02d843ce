"""Anomaly, preprocessing, multivariate, forecasting and drift queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.catalog import query
from tempora.functions.buckets import time_bucket
from tempora.operators import anomaly, drift, preprocess, series
from tempora.session import table

_HOUR = 3600 * 10**6


def _flags(rows):
    return rows.select("event_id", F.round("score", 6).alias("score"), "is_anomaly")


def _hourly(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type", time_bucket("1h", F.col("ts")).alias("ts")).agg(F.avg("value").alias("value"), F.count("value").cast("double").alias("n"))


@query(
    """WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1), r AS (SELECT event_id, abs(value - m) / greatest(s, abs(m) * 1e-9, 1e-12) AS raw FROM events JOIN s USING (event_type))
    SELECT event_id, round(1 / (1 + exp(-2 * (raw - 2.0))), 6) AS score, raw > 2.0 AS is_anomaly FROM r"""
)
def detect_zscore(spark, sf_dir):
    return _flags(anomaly.detect(table(spark, sf_dir, "events"), "zscore", ["event_type"], "value", ["ts"], threshold=2.0))


@query(
    """WITH a AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), d AS (SELECT event_id, event_type, med, abs(value - med) AS dev FROM events JOIN a USING (event_type)),
    s AS (SELECT event_type, median(dev) AS mad FROM d GROUP BY 1)
    SELECT event_id, round(1 / (1 + exp(-2 * (0.6745 * dev / mad - 3.5))), 6) AS score, 0.6745 * dev / mad > 3.5 AS is_anomaly FROM d JOIN s USING (event_type)"""
)
def detect_modified_zscore(spark, sf_dir):
    return _flags(anomaly.detect(table(spark, sf_dir, "events"), "modified_zscore", ["event_type"], "value", ["ts"]))


@query(
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1),
    r AS (SELECT event_id, greatest(a - 1.5 * (b - a) - value, value - b - 1.5 * (b - a), 0.0) / (b - a) AS raw FROM events JOIN q USING (event_type))
    SELECT event_id, round(1 - 1 / (1 + raw), 6) AS score, raw > 0 AS is_anomaly FROM r"""
)
def detect_iqr(spark, sf_dir):
    return _flags(anomaly.detect(table(spark, sf_dir, "events"), "iqr", ["event_type"], "value", ["ts"]))


@query(
    """WITH r AS (SELECT event_id, event_type, CASE WHEN row_number() OVER w > 24 THEN value - avg(value) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) END AS res FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    s AS (SELECT event_type, avg(res) AS m, stddev_samp(res) AS s FROM r GROUP BY 1), x AS (SELECT event_id, res, coalesce(abs(res - m) / s, 0) AS raw FROM r JOIN s USING (event_type))
    SELECT event_id, round(CASE WHEN res IS NULL THEN 0 ELSE 1 / (1 + exp(-2 * (raw - 3.0))) END, 6) AS score, raw > 3.0 AS is_anomaly FROM x"""
)
def detect_moving_average(spark, sf_dir):
    return _flags(anomaly.detect(table(spark, sf_dir, "events"), "moving_average", ["event_type"], "value", ["ts", "event_id"]))


@query(
    """WITH r AS (SELECT event_id, event_type, value, row_number() OVER w - 1 AS k, avg(value) OVER f AS m, stddev_pop(value) OVER f AS s, avg(value) OVER (PARTITION BY event_type) AS bm, stddev_pop(value) OVER (PARTITION BY event_type) AS bs
      FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id), f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
    x AS (SELECT event_id, abs(value - CASE WHEN k >= 50 THEN m ELSE bm END) / CASE WHEN k >= 50 THEN s ELSE bs END AS raw FROM r)
    SELECT event_id, round(1 / (1 + exp(-2 * (raw - 3.0))), 5) AS score, raw > 3.0 AS is_anomaly FROM x"""
)
def detect_dynamic_threshold(spark, sf_dir):
    found = anomaly.detect(table(spark, sf_dir, "events"), "dynamic_threshold", ["event_type"], "value", ["ts", "event_id"], lookback=50)
    return found.select("event_id", F.round("score", 5).alias("score"), "is_anomaly")


@query()
def detect_forecast_residual(spark, sf_dir):
    return anomaly.detect(_hourly(spark, sf_dir), "forecast_residual", ["event_type"], "value", ["ts"])


@query()
def detect_cusum(spark, sf_dir):
    return anomaly.detect(_hourly(spark, sf_dir), "cusum", ["event_type"], "value", ["ts"])


@query(
    """SELECT user_id, ts AS start, nxt AS "end", CAST(round((epoch_us(nxt) - epoch_us(ts)) / 3600000000.0) - 1 AS BIGINT) AS missing FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events)
    WHERE epoch_us(nxt) - epoch_us(ts) > 3600000000 * 1.5"""
)
def gap_detection(spark, sf_dir):
    return preprocess.gaps(table(spark, sf_dir, "events"), ["user_id"], "ts", _HOUR)


@query(
    """WITH h AS (SELECT user_id, date_trunc('day', ts) AS d, avg(value) AS v FROM events GROUP BY 1, 2), p AS (SELECT *, lead(d) OVER w AS d2, lead(v) OVER w AS v2 FROM h WINDOW w AS (PARTITION BY user_id ORDER BY d)),
    x AS (SELECT *, unnest(generate_series(0, CAST(greatest(ceil(coalesce(date_diff('hour', d, d2), 0) / 24.0) - 1, 0) AS BIGINT))) AS k FROM p)
    SELECT user_id, d + to_days(CAST(k AS INTEGER)) AS ts, round(CASE WHEN k = 0 THEN v ELSE v + (v2 - v) * (k * 24.0 / date_diff('hour', d, d2)) END, 6) AS value, k > 0 AS filled FROM x"""
)
def interpolate_linear(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("user_id", time_bucket("1d", F.col("ts")).alias("ts")).agg(F.avg("value").alias("value"))
    return preprocess.interpolate(daily, ["user_id"], "ts", "value", 24 * _HOUR).withColumn("value", F.round("value", 6))


@query(
    """WITH f AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY 1)
    SELECT user_id, make_timestamp(epoch_us(t0) + CAST(floor((epoch_us(ts) - epoch_us(t0)) / 86400000000.0) AS BIGINT) * 86400000000) AS ts, round(avg(value), 6) AS value FROM events JOIN f USING (user_id) GROUP BY 1, 2"""
)
def resample_down(spark, sf_dir):
    return preprocess.resample_down(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", 24 * _HOUR).withColumn("value", F.round("value", 6))


@query()
def ewm(spark, sf_dir):
    return preprocess.ewm(_hourly(spark, sf_dir), ["event_type"], ["ts"], "value", 0.3)


@query("SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(day(ts) AS INTEGER) AS day_of_month, CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend FROM events")
def calendar_features(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in preprocess.calendar_features(F.col("ts")).items()))


@query()
def stl_decompose(spark, sf_dir):
    return series.stl(_hourly(spark, sf_dir), ["event_type"], ["ts"], "value", 24)


@query()
def detect_period(spark, sf_dir):
    return series.period(_hourly(spark, sf_dir), ["event_type"], ["ts"], "value")


@query()
def isolation_forest(spark, sf_dir):
    return series.multivariate_scores(_hourly(spark, sf_dir), ["event_type"], ["ts"], ["value", "n"], "isolation_forest")


@query()
def pca_reconstruction(spark, sf_dir):
    return series.multivariate_scores(_hourly(spark, sf_dir), ["event_type"], ["ts"], ["value", "n"], "pca", share=0.6)


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM (SELECT *, (rank() OVER a + rank() OVER a + count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS ra, (2 * rank() OVER b + count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS rb FROM lineitem WINDOW a AS (PARTITION BY l_returnflag ORDER BY l_quantity), b AS (PARTITION BY l_returnflag ORDER BY l_extendedprice)) GROUP BY 1")
def rank_correlations(spark, sf_dir):
    found = series.rank_correlations(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return found.select("l_returnflag", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


def _forecast(model: str):
    def run(spark, sf_dir):
        return series.forecast(_hourly(spark, sf_dir), ["event_type"], "ts", "value", 12, model)

    run.__name__ = f"forecast_{model}"
    query()(run)


for _model in ("ses", "holt", "damped_holt", "holt_winters", "linear", "arima", "auto", "conformal"):
    _forecast(_model)


@query(
    """WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS v FROM events GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i FROM d),
    f AS (SELECT event_type, regr_slope(v, i) AS b, regr_intercept(v, i) AS a, count(*) AS n FROM x GROUP BY 1)
    SELECT event_type, h AS step, round(a + b * (n - 1 + h), 5) AS value FROM f, generate_series(1, 3) g(h)"""
)
def forecast_linear_daily(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", time_bucket("1d", F.col("ts")).alias("ts")).agg(F.avg("value").alias("value"))
    return series.forecast(daily, ["event_type"], "ts", "value", 3, "linear").select("event_type", "step", F.round("value", 5).alias("value"))


@query(
    """WITH o AS (SELECT o_totalprice AS v, o_orderdate < (SELECT median(o_orderdate) FROM orders) AS old FROM orders), e AS (SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM o WHERE old),
    b AS (SELECT old, len(list_filter(q, lambda x: x < v)) AS bin FROM o, e), c AS (SELECT bin, count(*) FILTER (WHERE old) / (SELECT count(*) FROM o WHERE old) AS p, count(*) FILTER (WHERE NOT old) / (SELECT count(*) FROM o WHERE NOT old) AS q FROM b GROUP BY 1)
    SELECT round(sum((greatest(q, 1e-4) - greatest(p, 1e-4)) * ln(greatest(q, 1e-4) / greatest(p, 1e-4))), 6) AS psi FROM c"""
)
def drift_psi(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("at", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    middle = orders.agg(F.percentile("at", 0.5)).first()[0]
    found = drift.psi(orders.where(F.col("at") < middle), orders.where(F.col("at") >= middle), "o_totalprice")
    return found.select(F.round("psi", 6).alias("psi"))


@query(
    """WITH u AS (SELECT l_quantity AS v, CAST(l_returnflag = 'A' AS INTEGER) AS x, CAST(l_returnflag = 'N' AS INTEGER) AS y FROM lineitem WHERE l_returnflag IN ('A', 'N')), c AS (SELECT v, sum(x) AS x, sum(y) AS y FROM u GROUP BY 1),
    g AS (SELECT abs(sum(x) OVER w / (SELECT sum(x) FROM c) - sum(y) OVER w / (SELECT sum(y) FROM c)) AS d FROM c WINDOW w AS (ORDER BY v)) SELECT round(max(d), 8) AS d FROM g"""
)
def drift_ks(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return drift.kolmogorov_smirnov(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'N'"), "l_quantity").select(F.round("d", 8).alias("d"))


@query(
    """WITH p AS (SELECT event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS f FROM events), q AS (SELECT * FROM p WHERE f IS NOT NULL)
    SELECT event_type, round(sqrt(avg((value - f) * (value - f))), 6) AS rmse, round(avg(abs(value - f)), 6) AS mae, round(100 * avg(CASE WHEN abs(value) + abs(f) > 1e-12 THEN 2 * abs(value - f) / (abs(value) + abs(f)) END), 5) AS smape FROM q GROUP BY 1"""
)
def forecast_accuracy(spark, sf_dir):
    over = Window.partitionBy("event_type").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").withColumn("f", F.lag("value").over(over)).where("f IS NOT NULL")
    made = drift.accuracy(F.col("value"), F.col("f"))
    return pairs.groupBy("event_type").agg(F.round(made["rmse"], 6).alias("rmse"), F.round(made["mae"], 6).alias("mae"), F.round(made["smape"], 5).alias("smape"))


@query()
def declared_detector(spark, sf_dir):
    from tempora.operators.detectors import Detector

    return Detector("odd", "value", "ts", ["event_type"], season="1d", slot="6h").verdicts(_hourly(spark, sf_dir))


@query(
    """WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS v FROM events GROUP BY 1, 2)
    SELECT event_type, day AS ts, round(CASE WHEN p > 0 AND v > 0 THEN ln(v / p) ELSE 0 END, 6) AS log_return FROM (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY day) AS p FROM d)"""
)
def derived_log_return(spark, sf_dir):
    from tempora.operators import derived

    daily = table(spark, sf_dir, "events").groupBy("event_type", time_bucket("1d", F.col("ts")).alias("ts")).agg(F.avg("value").alias("v"))
    over = Window.partitionBy("event_type").orderBy("ts")
    return daily.select("event_type", "ts", F.round(derived.log_return(F.col("v"), over), 6).alias("log_return"))


@query("SELECT event_type, CAST(count(*) AS DOUBLE) AS n, round(avg(value), 6) AS mean FROM events WHERE value >= 0 GROUP BY 1")
def histogram_moments(spark, sf_dir):
    from tempora.functions import histograms

    by_user = histograms.observe(table(spark, sf_dir, "events"), ["event_type", "user_id"], "value")
    merged = histograms.merge(by_user, ["event_type"])
    h = F.col("histogram")
    return merged.select("event_type", histograms.histogram_count(h).alias("n"), F.round(histograms.histogram_avg(h), 6).alias("mean"))


@query()
def histogram_quantiles(spark, sf_dir):
    from tempora.functions import histograms

    h = F.col("histogram")
    found = histograms.observe(table(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", *(histograms.histogram_quantile(q, h).alias(f"q{round(q * 100)}") for q in (0.5, 0.9, 0.99)), histograms.histogram_fraction(0.0, 50.0, h).alias("below_50"), histograms.histogram_stdvar(h).alias("variance"))


@query(
    """WITH h AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS t, event_type, avg(value) AS v FROM events GROUP BY 1, 2), w AS (SELECT a.t, a.v AS x, b.v AS y FROM h a JOIN h b ON a.t = b.t AND a.event_type = 'click' AND b.event_type = 'view')
    SELECT 'click' AS a, 'view' AS b, round(corr(x, y), 6) AS r FROM w"""
)
def correlation_matrix(spark, sf_dir):
    from tempora.operators import derived

    wide = derived.align(table(spark, sf_dir, "events"), "event_type", ["click", "view"], "ts", "value", "1d")
    return derived.correlation_matrix(wide, ["click", "view"]).where("a <> b").select("a", "b", F.round("r", 6).alias("r"))


def _wide(spark, sf_dir):
    from tempora.operators import derived

    return derived.align(table(spark, sf_dir, "events"), "event_type", ["click", "view", "purchase"], "ts", "value", "6h").fillna(0.0).withColumn("site", F.lit("all"))


@query()
def var_forecast(spark, sf_dir):
    return series.var_forecast(_wide(spark, sf_dir), ["site"], ["ts"], ["click", "view"], 2, 4)


@query()
def granger_causality(spark, sf_dir):
    return series.granger(_wide(spark, sf_dir), ["site"], ["ts"], ["click", "view"], 2)
