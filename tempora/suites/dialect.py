"""The SQL front end by its own function names."""

from __future__ import annotations

from tempora.catalog import ORACLE_SQL, QUERIES
from tempora.plans.sql import SqlSession
from tempora.session import table


def _sql(name: str, text: str, oracle: str, *tables: str) -> None:
    def run(spark, sf_dir):
        return SqlSession(spark, {t: table(spark, sf_dir, t) for t in tables or ("events",)}).sql(text)

    QUERIES[name], ORACLE_SQL[name] = run, oracle


_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_sql(
    "sql_bucket_zone",
    "SELECT time_bucket('1mo', ts, 'Europe/Berlin') AS bucket, count(*) AS n, 'time_bucket(''1d'', ts)' AS text FROM events GROUP BY 1",
    "SELECT timezone('UTC', timezone('Europe/Berlin', date_trunc('month', timezone('Europe/Berlin', timezone('UTC', ts))))) AS bucket, count(*) AS n, 'time_bucket(''1d'', ts)' AS text FROM events GROUP BY 1",
)
_sql(
    "sql_bucket_origin",
    "SELECT time_bucket('1mo', ts, NULL, '1970-01-15') AS bucket, count(*) AS n FROM events GROUP BY 1",
    "SELECT (date_trunc('month', ts - INTERVAL 14 DAY) + INTERVAL 14 DAY) AS bucket, count(*) AS n FROM events GROUP BY 1",
)
_sql(
    "sql_differences",
    f"SELECT event_id, diff(value) OVER w AS d1, round(diff(value, 2) OVER w, 6) AS d2, round(pct_change(value) OVER w, 6) AS pct FROM events {_W}",
    f"SELECT event_id, value - lag(value) OVER w AS d1, round(value - 2 * lag(value) OVER w + lag(value, 2) OVER w, 6) AS d2, round(CASE WHEN abs(lag(value) OVER w) >= 2.220446049250313e-16 THEN (value - lag(value) OVER w) / lag(value) OVER w END, 6) AS pct FROM events {_W}",
)
_sql(
    "sql_rolling",
    f"SELECT event_id, round(rolling_mean(value, 5) OVER w, 6) AS mean, round(rolling_std(value, 5) OVER w, 6) AS std, round(zscore(value) OVER w, 6) AS z FROM events {_W}",
    f"""SELECT event_id, round(CASE WHEN row_number() OVER w >= 5 THEN avg(value) OVER (w ROWS 4 PRECEDING) END, 6) AS mean, round(CASE WHEN row_number() OVER w >= 5 THEN stddev_samp(value) OVER (w ROWS 4 PRECEDING) END, 6) AS std,
        round(CASE WHEN stddev_samp(value) OVER p >= 2.220446049250313e-16 THEN (value - avg(value) OVER p) / stddev_samp(value) OVER p END, 6) AS z FROM events {_W}, p AS (PARTITION BY user_id)""",
)
_sql(
    "sql_anomaly_score",
    "SELECT event_id, round(anomaly_score(value, 2.0) OVER (PARTITION BY event_type ORDER BY ts), 6) AS score FROM events",
    "SELECT event_id, round(1 / (1 + exp(-2 * (abs(value - avg(value) OVER p) / greatest(stddev_samp(value) OVER p, abs(avg(value) OVER p) * 1e-9, 1e-12) - 2.0))), 6) AS score FROM events WINDOW p AS (PARTITION BY event_type)",
)
_sql(
    "sql_correlations",
    "SELECT DISTINCT l_returnflag, round(correlation(l_quantity, l_extendedprice) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey), 6) AS r FROM lineitem",
    "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1",
    "lineitem",
)
_sql(
    "sql_cross_correlation",
    "SELECT DISTINCT user_id, round(cross_correlation(value, event_id, 1) OVER (PARTITION BY user_id ORDER BY event_id), 5) AS r FROM events",
    "SELECT user_id, round(CASE WHEN count(p) > 1 THEN corr(value, p) END, 5) AS r FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY 1",
)
_sql(
    "sql_multivariate_anomaly",
    "SELECT l_orderkey, l_linenumber, round(multivariate_anomaly(l_quantity, l_discount, 3.0) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey), 5) AS d FROM lineitem",
    """WITH s AS (SELECT l_returnflag, avg(l_quantity) AS ma, avg(l_discount) AS mb, var_samp(l_quantity) + 1e-6 AS a, var_samp(l_discount) + 1e-6 AS b, covar_samp(l_quantity, l_discount) AS c FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_linenumber, round(sqrt((b * (l_quantity - ma) ** 2 - 2 * c * (l_quantity - ma) * (l_discount - mb) + a * (l_discount - mb) ** 2) / (a * b - c * c)), 5) AS d FROM lineitem JOIN s USING (l_returnflag)""",
    "lineitem",
)
_sql(
    "sql_multivariate_forecast",
    "SELECT user_id, transform(multivariate_forecast(value, event_id, ts, 2), x -> round(x, 4)) AS ahead FROM events GROUP BY user_id",
    "SELECT user_id, CASE WHEN count(value) >= 4 THEN [round(regr_intercept(value, event_id) + regr_slope(value, event_id) * arg_max(event_id, ts), 4), round(regr_intercept(value, event_id) + regr_slope(value, event_id) * arg_max(event_id, ts), 4)] END AS ahead FROM events GROUP BY user_id",
)
_SAMPLES = """samples AS (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id, ts),
    steps AS (SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pt, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS back FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts))"""
_sql(
    "sql_rates",
    "SELECT user_id, round(rate(value, ts, event_id), 6) AS rate, round(irate(value, ts, event_id), 6) AS irate FROM events GROUP BY user_id",
    f"""WITH {_SAMPLES} SELECT user_id, round(CASE WHEN count(*) >= 2 THEN sum(CASE WHEN pv IS NULL THEN 0.0 WHEN value < pv THEN value ELSE value - pv END) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) END, 6) AS rate,
        round(max(CASE WHEN back = 1 AND pv IS NOT NULL THEN (CASE WHEN value < pv THEN value ELSE value - pv END) / ((epoch_us(ts) - epoch_us(pt)) / 1e6) END), 6) AS irate FROM steps GROUP BY user_id""",
)
_sql(
    "sql_ewm",
    "SELECT user_id, round(max_by(e, event_id), 5) AS e FROM (SELECT *, ewm(value, 0.3) OVER (PARTITION BY user_id ORDER BY event_id) AS e FROM events) GROUP BY user_id",
    "SELECT user_id, round(list_reduce(list(value ORDER BY event_id) FILTER (WHERE value IS NOT NULL), lambda s, v: s + 0.3 * (v - s)), 5) AS e FROM events GROUP BY user_id",
)
