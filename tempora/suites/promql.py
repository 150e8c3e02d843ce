"""Queries in the metric query language over the table events, on a daily grid of January 2024."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.catalog import ORACLE_SQL, QUERIES, query
from tempora.promql import Engine
from tempora.session import table

_DAY = 86400 * 10**6
_START, _STEPS = 1704153600 * 10**6, 6  # 2024-01-02
#: Samples in every window (step - length, step], for the check in SQL.
_WINDOW = """g AS (SELECT make_timestamp(1704153600000000 + i * 86400000000) AS step FROM generate_series(0, 5) t(i)),
    p AS (SELECT user_id, event_type, ts, max(value) AS value FROM events GROUP BY 1, 2, 3),
    w AS (SELECT p.*, g.step FROM p JOIN g ON p.ts <= g.step AND p.ts > g.step - INTERVAL {})"""


def _prom(name: str, text: str, labels: list[str], oracle: str | None = None, digits: int = 6) -> None:
    def run(spark, sf_dir):
        events = table(spark, sf_dir, "events").groupBy("user_id", "event_type", "ts").agg(F.max("value").alias("value"))
        engine = Engine(spark)
        engine.add("events", events, "ts", ["user_id", "event_type"], ["value"])
        found = engine.range(text, _START, _START + (_STEPS - 1) * _DAY, _DAY)
        return found.select(*(F.element_at("labels", label).alias(label) for label in labels), "ts", F.round("value", digits).alias("value"))

    QUERIES[name] = run
    if oracle:
        ORACLE_SQL[name] = oracle


def _over(name: str, function: str, sql: str, length: str = "2 DAY", range_: str = "2d") -> None:
    _prom(name, f"{function}(events[{range_}])", ["event_type", "user_id"], f"WITH {_WINDOW.format(length)} SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, step AS ts, round({sql}, 6) AS value FROM w GROUP BY 1, 2, 3")


_over("promql_avg_over_time", "avg_over_time", "avg(value)")
_over("promql_sum_over_time", "sum_over_time", "sum(value)")
_over("promql_count_over_time", "count_over_time", "CAST(count(*) AS DOUBLE)")
_over("promql_max_over_time", "max_over_time", "max(value)")
_over("promql_min_over_time", "min_over_time", "min(value)")
_over("promql_last_over_time", "last_over_time", "arg_max(value, ts)")
_over("promql_first_over_time", "first_over_time", "arg_min(value, ts)")
_over("promql_stddev_over_time", "stddev_over_time", "stddev_pop(value)")
_prom("promql_quantile_over_time", "quantile_over_time(0.9, events[2d])", ["event_type", "user_id"], f"WITH {_WINDOW.format('2 DAY')} SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, step AS ts, round(quantile_cont(value, 0.9), 6) AS value FROM w GROUP BY 1, 2, 3")
_RESETS = f"""WITH {_WINDOW.format("3 DAY")}, x AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type, step ORDER BY ts) AS pv FROM w)"""
_prom("promql_resets", "resets(events[3d])", ["event_type", "user_id"], f"{_RESETS} SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, step AS ts, CAST(count(*) FILTER (WHERE value < pv) AS DOUBLE) AS value FROM x GROUP BY 1, 2, 3")
_prom("promql_changes", "changes(events[3d])", ["event_type", "user_id"], f"{_RESETS} SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, step AS ts, CAST(count(*) FILTER (WHERE value <> pv) AS DOUBLE) AS value FROM x GROUP BY 1, 2, 3")
_EXTRAPOLATED = """, a AS (SELECT user_id, event_type, step, arg_min(value, ts) AS fv, arg_max(value, ts) - arg_min(value, ts) + sum(CASE WHEN value < pv THEN pv ELSE 0 END) AS change, count(*) AS n,
      (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span, (epoch_us(min(ts)) - epoch_us(step - INTERVAL 3 DAY)) / 1e6 AS b, (epoch_us(step) - epoch_us(max(ts))) / 1e6 AS e FROM x GROUP BY 1, 2, 3),
    c AS (SELECT *, span / (n - 1) AS av FROM a WHERE n >= 2 AND span > 0), d AS (SELECT *, CASE WHEN b >= av * 1.1 THEN av / 2 ELSE b END AS b1, CASE WHEN e >= av * 1.1 THEN av / 2 ELSE e END AS e1 FROM c),
    f AS (SELECT *, CASE WHEN change > 0 AND fv >= 0 AND span * fv / change < b1 THEN span * fv / change ELSE b1 END AS b2 FROM d)"""
_prom("promql_rate", "rate(events[3d])", ["event_type", "user_id"], f"{_RESETS} {_EXTRAPOLATED} SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, step AS ts, round(change * ((span + b2 + e1) / span) / 259200, 6) AS value FROM f")
_prom("promql_increase", "increase(events[3d])", ["event_type", "user_id"], f"{_RESETS} {_EXTRAPOLATED} SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, step AS ts, round(change * ((span + b2 + e1) / span), 4) AS value FROM f", 4)
_LAST = f"WITH {_WINDOW.format('2 DAY')}, l AS (SELECT user_id, event_type, step, arg_max(value, ts) AS v FROM w GROUP BY 1, 2, 3)"
for _fn, _sql in (("sum", "sum(v)"), ("avg", "avg(v)"), ("min", "min(v)"), ("max", "max(v)"), ("count", "CAST(count(*) AS DOUBLE)"), ("stddev", "stddev_pop(v)"), ("stdvar", "var_pop(v)"), ("group", "max(1.0)")):
    _prom(f"promql_agg_{_fn}", f"{_fn} by (event_type) (last_over_time(events[2d]))", ["event_type"], f"{_LAST} SELECT event_type, step AS ts, round(CAST({_sql} AS DOUBLE), 4) AS value FROM l GROUP BY 1, 2", 4)
_prom("promql_agg_quantile", "quantile without (user_id) (0.5, last_over_time(events[2d]))", ["event_type"], f"{_LAST} SELECT event_type, step AS ts, round(quantile_cont(v, 0.5), 6) AS value FROM l GROUP BY 1, 2")
_prom("promql_topk", "topk by (event_type) (3, last_over_time(events[2d]))", ["event_type", "user_id"], f"{_LAST} SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, step AS ts, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, step ORDER BY v DESC, CAST(user_id AS VARCHAR)) AS r FROM l) WHERE r <= 3")
_prom("promql_binary", "sum by (event_type) (last_over_time(events[2d])) / count by (event_type) (last_over_time(events[2d])) * 2", ["event_type"], f"{_LAST} SELECT event_type, step AS ts, round(sum(v) / count(*) * 2, 5) AS value FROM l GROUP BY 1, 2", 5)
_prom("promql_group_left", "last_over_time(events[2d]) / on (event_type) group_left sum by (event_type) (last_over_time(events[2d]))", ["event_type", "user_id"], f"{_LAST} SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, step AS ts, round(v / sum(v) OVER (PARTITION BY event_type, step), 6) AS value FROM l")
_prom("promql_comparison", "avg by (event_type) (last_over_time(events[2d])) > bool 50", ["event_type"], f"{_LAST} SELECT event_type, step AS ts, CAST(avg(v) > 50 AS DOUBLE) AS value FROM l GROUP BY 1, 2")
_prom("promql_filter", "last_over_time(events[2d]) > 60 unless last_over_time(events[2d]) > 90", ["event_type", "user_id"], f"{_LAST} SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, step AS ts, round(v, 6) AS value FROM l WHERE v > 60 AND v <= 90")
_prom("promql_offset", "sum(sum_over_time(events[1d] offset 1d))", [], """WITH g AS (SELECT make_timestamp(1704153600000000 + i * 86400000000) AS step FROM generate_series(0, 5) t(i)), p AS (SELECT user_id, event_type, ts, max(value) AS value FROM events GROUP BY 1, 2, 3)
    SELECT step AS ts, round(sum(value), 4) AS value FROM p JOIN g ON ts <= step - INTERVAL 1 DAY AND ts > step - INTERVAL 2 DAY GROUP BY 1""", 4)
_prom("promql_subquery", "max_over_time(sum(sum_over_time(events[1d]))[3d:1d])", [], """WITH g AS (SELECT make_timestamp(1704153600000000 + i * 86400000000) AS step FROM generate_series(-3, 5) t(i)), p AS (SELECT user_id, event_type, ts, max(value) AS value FROM events GROUP BY 1, 2, 3),
    s AS (SELECT step, sum(value) AS v FROM p JOIN g ON ts <= step AND ts > step - INTERVAL 1 DAY GROUP BY 1)
    SELECT a.step AS ts, round(max(b.v), 4) AS value FROM g a JOIN s b ON b.step <= a.step AND b.step > a.step - INTERVAL 3 DAY WHERE a.step >= make_timestamp(1704153600000000) GROUP BY 1""", 4)
_prom("promql_label_replace", 'sum by (kind) (label_replace(last_over_time(events{event_type=~"c.*|p.*"}[2d]), "kind", "x-$1", "event_type", "(.).*"))', ["kind"], f"{_LAST} SELECT 'x-' || event_type[1] AS kind, step AS ts, round(sum(v), 4) AS value FROM l WHERE regexp_matches(event_type, '^(c|p)') GROUP BY 1, 2", 4)
_prom("promql_absent", 'absent(events{event_type="none"})', ["event_type"], "SELECT 'none' AS event_type, make_timestamp(1704153600000000 + i * 86400000000) AS ts, 1.0::DOUBLE AS value FROM generate_series(0, 5) t(i)")
_prom("promql_deriv", "deriv(events[3d])", ["event_type", "user_id"], f"WITH {_WINDOW.format('3 DAY')} SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, step AS ts, round(regr_slope(value, (epoch_us(ts) - epoch_us(step)) / 1e6), 6) AS value FROM w GROUP BY 1, 2, 3 HAVING count(*) >= 2")
_prom("promql_predict_linear", "predict_linear(events[3d], 3600)", ["event_type", "user_id"])
_prom("promql_smoothing", "double_exponential_smoothing(events[3d], 0.5, 0.3)", ["event_type", "user_id"])
_prom("promql_element", "round(sqrt(clamp(last_over_time(events[2d]), 10, 80)), 0.1)", ["event_type", "user_id"], f"{_LAST} SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, step AS ts, round(floor(sqrt(greatest(10, least(80, v))) / 0.1 + 0.5) * 0.1, 6) AS value FROM l")
_prom("promql_clock", "day_of_month() + hour() / 100", [], "SELECT make_timestamp(1704153600000000 + i * 86400000000) AS ts, CAST(2 + i AS DOUBLE) AS value FROM generate_series(0, 5) t(i)")
_prom("promql_minutes_of_a_month", "sum by (event_type) (count_over_time(events[30d]))", ["event_type"], f"WITH {_WINDOW.format('30 DAY')} SELECT event_type, step AS ts, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY 1, 2")
_prom("promql_group_right", "sum by (event_type) (last_over_time(events[2d])) * on (event_type) group_right last_over_time(events[2d])", ["event_type", "user_id"], f"{_LAST} SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, step AS ts, round(v * sum(v) OVER (PARTITION BY event_type, step), 4) AS value FROM l", 4)
_prom("promql_bottomk", "bottomk by (event_type) (2, last_over_time(events[2d]))", ["event_type", "user_id"], f"{_LAST} SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, step AS ts, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, step ORDER BY v, CAST(user_id AS VARCHAR)) AS r FROM l) WHERE r <= 2")
_prom("promql_and_or", '(last_over_time(events{event_type="click"}[2d]) and last_over_time(events[1d])) or last_over_time(events{event_type="view"}[2d])', ["event_type", "user_id"], f"""{_LAST}, d AS (SELECT DISTINCT user_id, event_type, step FROM w WHERE ts > step - INTERVAL 1 DAY)
    SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, step AS ts, round(v, 6) AS value FROM l LEFT JOIN d USING (user_id, event_type, step) WHERE event_type = 'view' OR (event_type = 'click' AND d.user_id IS NOT NULL)""")
_prom("promql_count_values", 'count_values("rounded", round(last_over_time(events[2d]), 50))', ["rounded"], f"{_LAST} SELECT CAST(CAST(floor(v / 50 + 0.5) * 50 AS BIGINT) AS VARCHAR) AS rounded, step AS ts, CAST(count(*) AS DOUBLE) AS value FROM l GROUP BY 1, 2")
_prom("promql_at", "sum by (event_type) (sum_over_time(events[2d] @ end()))", ["event_type"], f"WITH {_WINDOW.format('2 DAY')}, s AS (SELECT event_type, sum(value) AS v FROM w WHERE step = (SELECT max(step) FROM g) GROUP BY 1) SELECT event_type, step AS ts, round(v, 4) AS value FROM s, g", 4)
_prom("promql_scalar", "sum by (event_type) (sum_over_time(events[1d])) / scalar(sum(sum_over_time(events[1d])))", ["event_type"], f"WITH {_WINDOW.format('1 DAY')} SELECT event_type, step AS ts, round(sum(value) / sum(sum(value)) OVER (PARTITION BY step), 6) AS value FROM w GROUP BY 1, 2")
_prom("promql_anchored", "delta(events[2d] anchored)", ["event_type", "user_id"], """WITH g AS (SELECT make_timestamp(1704153600000000 + i * 86400000000) AS step FROM generate_series(0, 5) t(i)), p AS (SELECT user_id, event_type, ts, max(value) AS value FROM events GROUP BY 1, 2, 3),
    w AS (SELECT p.*, g.step FROM p JOIN g ON p.ts <= g.step AND p.ts > g.step - INTERVAL 2 DAY - INTERVAL 5 MINUTE), a AS (SELECT user_id, event_type, step, max(ts) AS last, coalesce(max(ts) FILTER (WHERE ts <= step - INTERVAL 2 DAY), min(ts)) AS first FROM w GROUP BY 1, 2, 3)
    SELECT a.event_type, CAST(a.user_id AS VARCHAR) AS user_id, a.step AS ts, round(z.value - f.value, 6) AS value FROM a JOIN p z ON z.user_id = a.user_id AND z.event_type = a.event_type AND z.ts = a.last JOIN p f ON f.user_id = a.user_id AND f.event_type = a.event_type AND f.ts = a.first WHERE a.last > a.step - INTERVAL 2 DAY""")
_LABELS = "event_type, CAST(user_id AS VARCHAR) AS user_id, step AS ts"
_over("promql_stdvar_over_time", "stdvar_over_time", "var_pop(value)")
_over("promql_present_over_time", "present_over_time", "1.0::DOUBLE")
_over("promql_mad_over_time", "mad_over_time", "mad(value)")
_prom("promql_instant", "events", ["event_type", "user_id"], f"WITH {_WINDOW.format('5 MINUTE')} SELECT {_LABELS}, round(arg_max(value, ts), 6) AS value FROM w GROUP BY 1, 2, 3")
_NEWEST = f"{_RESETS}, z AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type, step ORDER BY ts)) AS dt, row_number() OVER (PARTITION BY user_id, event_type, step ORDER BY ts DESC) AS back FROM x)"
_prom("promql_irate", "irate(events[3d])", ["event_type", "user_id"], f"{_NEWEST} SELECT {_LABELS}, round((CASE WHEN value < pv THEN value ELSE value - pv END) / (dt / 1e6), 6) AS value FROM z WHERE back = 1 AND pv IS NOT NULL")
_prom("promql_idelta", "idelta(events[3d])", ["event_type", "user_id"], f"{_NEWEST} SELECT {_LABELS}, round(value - pv, 6) AS value FROM z WHERE back = 1 AND pv IS NOT NULL")
_GAUGE = _EXTRAPOLATED.replace(" + sum(CASE WHEN value < pv THEN pv ELSE 0 END)", "")
_prom("promql_delta", "delta(events[3d])", ["event_type", "user_id"], f"{_RESETS} {_GAUGE} SELECT {_LABELS}, round(change * ((span + b1 + e1) / span), 4) AS value FROM f", 4)
_prom("promql_unary", "10 + -(2 * last_over_time(events[2d])) ^ 2 % 7", ["event_type", "user_id"], f"{_LAST} SELECT {_LABELS}, round(10 - (2 * v) ** 2 % 7, 3) AS value FROM l", 3)
_prom("promql_trigonometry", "sin(last_over_time(events[2d])) + atan(last_over_time(events[2d])) * pi() + deg(rad(last_over_time(events[2d])))", ["event_type", "user_id"], f"{_LAST} SELECT {_LABELS}, round(sin(v) + atan(v) * pi() + v, 5) AS value FROM l", 5)
_prom("promql_rounding", "ceil(last_over_time(events[2d])) + floor(last_over_time(events[2d])) * 1000 + sgn(last_over_time(events[2d]) - 50) * 0.25 + abs(last_over_time(events[2d]) - 50)", ["event_type", "user_id"], f"{_LAST} SELECT {_LABELS}, round(ceil(v) + floor(v) * 1000 + sign(v - 50) * 0.25 + abs(v - 50), 5) AS value FROM l", 5)
_prom("promql_logarithms", "ln(last_over_time(events[2d]) + 1) + log2(last_over_time(events[2d]) + 1) + log10(last_over_time(events[2d]) + 1) + exp(last_over_time(events[2d]) / 100)", ["event_type", "user_id"], f"{_LAST} SELECT {_LABELS}, round(ln(v + 1) + log2(v + 1) + log10(v + 1) + exp(v / 100), 5) AS value FROM l", 5)
_prom("promql_vector_time", "vector(time()) - 1704153600", [], "SELECT make_timestamp(1704153600000000 + i * 86400000000) AS ts, CAST(i * 86400 AS DOUBLE) AS value FROM generate_series(0, 5) t(i)")
_prom("promql_timestamp", "max by (event_type) (timestamp(events)) - time()", ["event_type"], f"WITH {_WINDOW.format('5 MINUTE')} SELECT event_type, step AS ts, round((max(epoch_us(ts)) - epoch_us(step)) / 1e6, 3) AS value FROM w GROUP BY event_type, step", 3)
_prom("promql_label_join", 'sum by (both) (label_join(last_over_time(events[2d]), "both", "-", "event_type", "user_id"))', ["both"], f"{_LAST} SELECT event_type || '-' || CAST(user_id AS VARCHAR) AS both, step AS ts, round(v, 4) AS value FROM l", 4)
_prom("promql_sort_desc", "sort_desc(sum by (event_type) (last_over_time(events[2d])))", ["event_type"], f"{_LAST} SELECT event_type, step AS ts, round(sum(v), 4) AS value FROM l GROUP BY 1, 2", 4)
_prom("promql_sort_by_label", 'sort_by_label(avg by (event_type) (last_over_time(events[2d])), "event_type")', ["event_type"], f"{_LAST} SELECT event_type, step AS ts, round(avg(v), 4) AS value FROM l GROUP BY 1, 2", 4)
_prom("promql_name_pattern", 'sum by (event_type) (last_over_time({__name__=~"ev.*", event_type!="view"}[2d]))', ["event_type"], f"{_LAST} SELECT event_type, step AS ts, round(sum(v), 4) AS value FROM l WHERE event_type <> 'view' GROUP BY 1, 2", 4)
_prom("promql_matchers", 'count(last_over_time(events{event_type!~"c.*|p.*", user_id=~"[1-4]."}[2d]))', [], f"{_LAST} SELECT step AS ts, CAST(count(*) AS DOUBLE) AS value FROM l WHERE NOT regexp_full_match(event_type, 'c.*|p.*') AND regexp_full_match(CAST(user_id AS VARCHAR), '[1-4].') GROUP BY 1")
_prom("promql_absent_over_time", "absent_over_time(events{event_type=\"none\"}[2d])", ["event_type"], "SELECT 'none' AS event_type, make_timestamp(1704153600000000 + i * 86400000000) AS ts, 1.0::DOUBLE AS value FROM generate_series(0, 5) t(i)")
_prom("promql_duration_expression", "sum by (event_type) (sum_over_time(events[step() * 2] offset step()))", ["event_type"], f"""WITH {_WINDOW.format('3 DAY')} SELECT event_type, step AS ts, round(sum(value), 4) AS value FROM w WHERE ts <= step - INTERVAL 1 DAY GROUP BY 1, 2""", 4)


@query(
    """WITH g AS (SELECT make_timestamp(1704153600000000 + i * 86400000000) AS step FROM generate_series(0, 5) t(i)), b AS (SELECT unnest([25.0, 50.0, 75.0, 100.0, 'Infinity'::DOUBLE]) AS le),
    c AS (SELECT event_type, step, le, count(*) FILTER (WHERE value <= le) AS n, count(value) AS total FROM events, g, b WHERE ts <= step GROUP BY 1, 2, 3),
    p AS (SELECT *, lag(n, 1, 0) OVER w AS pn, lag(le, 1, 0.0) OVER w AS ple FROM c WINDOW w AS (PARTITION BY event_type, step ORDER BY le)),
    f AS (SELECT event_type, step, arg_min({'le': le, 'n': n, 'pn': pn, 'ple': ple, 'total': total}, le) AS x FROM p WHERE n >= 0.9 * total AND total > 0 GROUP BY 1, 2)
    SELECT event_type, step AS ts, round(CASE WHEN isinf(x.le) THEN 100.0 ELSE x.ple + (x.le - x.ple) * (0.9 * x.total - x.pn) / (x.n - x.pn) END, 4) AS value FROM f"""
)
def promql_histogram_quantile(spark, sf_dir):
    """Cumulative buckets of all values up to each step, as samples of a classic histogram."""
    bounds = F.array(*(F.struct(F.lit(b).alias("le"), F.lit(float(b)).alias("bound")) for b in ("25", "50", "75", "100", "Infinity")))
    daily = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_type", "value", F.explode(bounds).alias("b"), F.ceil(F.unix_micros(F.col("ts").cast("timestamp")) / _DAY).alias("day"))
    counted = daily.groupBy("event_type", "b.le", "day").agg(F.count_if(F.col("value") <= F.col("b.bound")).alias("n"))
    steps = spark.range(_STEPS).select((F.col("id") + _START // _DAY).alias("step"))
    upto = counted.join(F.broadcast(steps), F.col("day") <= F.col("step")).groupBy("event_type", "le", "step").agg(F.sum("n").cast("double").alias("value"))  # six rows
    samples = upto.select("event_type", F.regexp_replace("le", "Infinity", "+Inf").alias("le"), F.timestamp_micros((F.col("step") * _DAY).cast("long")).cast("timestamp_ntz").alias("ts"), "value")
    engine = Engine(spark)
    engine.add("sizes", samples, "ts", ["event_type", "le"], ["value"])
    found = engine.range("histogram_quantile(0.9, sizes)", _START, _START + (_STEPS - 1) * _DAY, _DAY)
    return found.select(F.element_at("labels", "event_type").alias("event_type"), "ts", F.round("value", 4).alias("value"))
