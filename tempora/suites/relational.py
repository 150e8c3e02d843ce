"""SQL that the engine takes over from Spark: joins, sets, groupings, frames, decimals and scalar functions.

Most queries are one text that both engines read.
"""

from __future__ import annotations

from tempora.catalog import ORACLE_SQL, QUERIES
from tempora.plans.sql import SqlSession
from tempora.session import table

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    def run(spark, sf_dir):
        used = {t: table(spark, sf_dir, t) for t in _TABLES if t in text}
        return SqlSession(spark, used).sql(text)

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or text


for _kind in ("INNER", "LEFT", "RIGHT", "FULL"):
    _sql(f"join_{_kind.lower()}", f"SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c {_kind} JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0")
_sql("join_semi", "SELECT c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer c SEMI JOIN orders o ON c.c_custkey = o.o_custkey")
_sql("join_anti", "SELECT c_custkey FROM customer c LEFT ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer c ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey")
_sql("join_nation_region", "SELECT a.n_name, b.r_name FROM nation a CROSS JOIN region b WHERE a.n_regionkey <= b.r_regionkey")
_sql("join_theta", "SELECT s.s_suppkey, count(*) AS n FROM supplier s JOIN nation n ON s.s_nationkey < n.n_nationkey GROUP BY s.s_suppkey")
_sql("subquery_exists", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)")
_sql("subquery_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
_sql("subquery_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c")
_sql("lateral_join", "SELECT r.r_name, t.n FROM region r, LATERAL (SELECT count(*) AS n FROM nation n WHERE n.n_regionkey = r.r_regionkey) t")
_sql("set_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region")
_sql("set_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region")
_sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
_sql("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000")
_sql("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier")
_GROUPED = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY "
_sql("grouping_sets", _GROUPED + "GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_sql("grouping_cube", _GROUPED + "CUBE (l_returnflag, l_linestatus)")
_sql("grouping_rollup", _GROUPED + "ROLLUP (l_returnflag, l_linestatus)")
_sql("agg_filter_having", "SELECT o_custkey, count(*) FILTER (WHERE o_totalprice > 50000) AS large, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey HAVING count(*) > 5")
_sql("agg_statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s, round(var_pop(l_quantity), 6) AS v, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_tax), 8) AS c, round(regr_slope(l_extendedprice, l_quantity), 4) AS b FROM lineitem GROUP BY l_returnflag")
_sql("agg_median", "SELECT event_type, round(percentile(value, 0.5), 6) AS m, round(percentile(value, 0.9), 6) AS p FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS m, round(quantile_cont(value, 0.9), 6) AS p FROM events GROUP BY event_type")
_sql("agg_bool_bit", "SELECT l_returnflag, bool_and(l_quantity > 0) AS a, bool_or(l_tax > 0.07) AS o, bit_xor(l_linenumber) AS x FROM lineitem GROUP BY l_returnflag")
_sql("agg_string", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_sql("decimal_sum", "SELECT l_returnflag, sum(CAST(l_extendedprice AS DECIMAL(28, 2))) AS total FROM lineitem GROUP BY l_returnflag")
_sql("decimal_avg", "SELECT l_returnflag, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) / count(*), 6) AS DOUBLE) AS mean FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*), 6) AS mean FROM lineitem GROUP BY l_returnflag")
_sql("window_rank", "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d, CAST(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS BIGINT) AS q FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC)", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS q FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC)")
_sql("window_values", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
_sql("window_share", "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice)")
_sql("window_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events")
_sql("topk_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3")
_sql("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_sql("sort_limit_offset", "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 20 OFFSET 40")
_sql("sql_time_bucket", "SELECT time_bucket('6h', ts) AS b, count(*) AS n FROM events GROUP BY 1", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS b, count(*) AS n FROM events GROUP BY 1")
_sql("sql_epoch_literal", "SELECT event_id FROM events WHERE ts >= 1704499200000000000", "SELECT event_id FROM events WHERE epoch_us(ts) >= 1704499200000000")
_sql("sql_time_predicates", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP_NTZ '2024-01-03' AND TIMESTAMP_NTZ '2024-01-06' AND value > 10", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-06' AND value > 10")
_sql("scalar_string", "SELECT p_partkey, upper(p_name) AS u, substr(p_type, 2, 4) AS s, lpad(p_brand, 12, '*') AS l, replace(p_name, 'a', 'o') AS r, reverse(p_brand) AS v, concat_ws('-', p_brand, p_type) AS c, length(p_name) AS n, levenshtein(p_brand, p_type) AS d FROM part", "SELECT p_partkey, upper(p_name) AS u, substr(p_type, 2, 4) AS s, lpad(p_brand, 12, '*') AS l, replace(p_name, 'a', 'o') AS r, reverse(p_brand) AS v, concat_ws('-', p_brand, p_type) AS c, CAST(length(p_name) AS INTEGER) AS n, CAST(levenshtein(p_brand, p_type) AS INTEGER) AS d FROM part")
_sql("scalar_math", "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS a, round(ln(l_quantity), 6) AS b, ceil(l_tax * 100) AS c, floor(l_tax * 100) AS d, round(power(l_discount, 2), 8) AS e, sign(l_tax - 0.04) AS f, round(atan2(l_tax, l_quantity), 8) AS g FROM lineitem", "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS a, round(ln(l_quantity), 6) AS b, CAST(ceil(l_tax * 100) AS BIGINT) AS c, CAST(floor(l_tax * 100) AS BIGINT) AS d, round(power(l_discount, 2), 8) AS e, CAST(sign(l_tax - 0.04) AS DOUBLE) AS f, round(atan2(l_tax, l_quantity), 8) AS g FROM lineitem")
_sql("scalar_conditional", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, nullif(c_mktsegment, 'BUILDING') AS seg, coalesce(nullif(c_nationkey, 3), -1) AS k, greatest(c_acctbal, 0.0) AS g, least(c_nationkey, 10) AS l FROM customer")
_sql("scalar_date", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS t, quarter(o_orderdate) AS q, o_orderdate + INTERVAL '3' DAY AS later FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS t, CAST(quarter(o_orderdate) AS INTEGER) AS q, o_orderdate + INTERVAL 3 DAY AS later FROM orders")
_sql("scalar_regexp", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '') AS r, regexp_extract(p_type, '([A-Z]+)', 1) AS e, p_brand RLIKE '^Brand#[1-2]' AS m FROM part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '', 'g') AS r, regexp_extract(p_type, '([A-Z]+)', 1) AS e, regexp_matches(p_brand, '^Brand#[1-2]') AS m FROM part")
_sql("scalar_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
_sql("scalar_hash", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
_sql("array_functions", "SELECT user_id, size(array_distinct(collect_list(event_type))) AS kinds, array_join(array_sort(collect_set(event_type)), ',') AS names FROM events GROUP BY user_id", "SELECT user_id, CAST(len(list_distinct(list(event_type))) AS INTEGER) AS kinds, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS names FROM events GROUP BY user_id")
_sql("unnest", "SELECT n_nationkey, x FROM nation LATERAL VIEW explode(sequence(1, n_regionkey + 1)) t AS x", "SELECT n_nationkey, CAST(unnest(generate_series(1, n_regionkey + 1)) AS INTEGER) AS x FROM nation")
_sql("presence_scan", "SELECT DISTINCT user_id, event_type FROM events WHERE value IS NOT NULL")
_sql("tpch_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus")
_sql("tpch_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
_STEPS = "steps AS (SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pt, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS back FROM (SELECT user_id, ts, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY ts))"
_sql("sql_first_last", "SELECT event_type, first(value, ts) AS f, last(value, ts) AS l FROM events GROUP BY event_type", "SELECT event_type, arg_min(value, ts) AS f, arg_max(value, ts) AS l FROM events GROUP BY event_type")
_sql("sql_rate", "SELECT user_id, round(rate(value, ts), 6) AS r, round(irate(value, ts), 6) AS i FROM events GROUP BY user_id", f"WITH {_STEPS} SELECT user_id, round(CASE WHEN count(*) >= 2 THEN sum(CASE WHEN pv IS NULL THEN 0.0 WHEN value < pv THEN value ELSE value - pv END) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) END, 6) AS r, round(max(CASE WHEN back = 1 AND pv IS NOT NULL THEN (CASE WHEN value < pv THEN value ELSE value - pv END) / ((epoch_us(ts) - epoch_us(pt)) / 1e6) END), 6) AS i FROM steps GROUP BY user_id")
