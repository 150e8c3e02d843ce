"""Deletes, message formats, triggers and models' upkeep over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.catalog import query
from tempora.operators import deletion, lifecycle
from tempora.sources import ingest, topics
from tempora.session import table
from tempora.streaming import triggers

_DELETE = deletion.Delete({"event_type": "click"}, datetime(2024, 1, 3), datetime(2024, 1, 20))


def _changes(spark, sf_dir):
    return triggers.change_events(table(spark, sf_dir, "events"), "events", "ts", ["event_type"], ["value"], "event_id")


@query("SELECT event_id, value FROM events WHERE NOT (event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20')")
def delete_range(spark, sf_dir):
    return deletion.apply(table(spark, sf_dir, "events"), [_DELETE], "ts").select("event_id", "value")


@query(
    """SELECT user_id, event_type, count(*) FILTER (WHERE h) AS deleted, count(*) FILTER (WHERE NOT h) AS remaining, count(*) FILTER (WHERE NOT h) > 0 AS partial
    FROM (SELECT *, event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' AS h FROM events) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE h) > 0"""
)
def delete_report(spark, sf_dir):
    return deletion.report(table(spark, sf_dir, "events"), _DELETE, ["user_id", "event_type"], "ts")


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def drop_restore(spark, sf_dir):
    shelf = deletion.Shelf()
    shelf.add("events", table(spark, sf_dir, "events"))
    shelf.drop("events")
    return shelf.restore("events").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user, value FROM events WHERE value IS NOT NULL")
def topic_messages(spark, sf_dir):
    at = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    line = F.concat(F.col("event_type"), F.lit(",user="), F.col("user_id").cast("string"), F.lit(" id="), F.col("event_id").cast("string"), F.lit("i,v="), F.col("value").cast("string"), F.lit(" "), at)
    point = F.struct(F.col("event_type").alias("measurement"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("tags"), F.create_map(F.lit("id"), F.col("event_id").cast("double"), F.lit("v"), F.col("value")).alias("fields"), at.cast("long").alias("timestamp"))
    odd = F.col("event_id") % 2 == 1
    sent = table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.when(odd, "lines").otherwise("json").alias("topic"), F.when(odd, line).otherwise(F.to_json(point)).alias("value"))
    read = topics.points(sent, {"lines": "line", "json": "json"})
    return read.select(F.col("fields")["id"].cast("long").alias("event_id"), F.col("measurement").alias("event_type"), F.col("tags")["user"].alias("user"), F.col("fields")["v"].alias("value"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS user, event_type AS measurement FROM events")
def topic_paths(spark, sf_dir):
    sent = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("site/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("topic"))
    return ingest.topic_tags(sent, "site/{user}/{measurement}").select("event_id", F.col("tags")["user"].alias("user"), "measurement")


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS user, value FROM events WHERE value IS NOT NULL")
def json_points(spark, sf_dir):
    point = F.struct(F.lit("events").alias("measurement"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("tags"), F.create_map(F.lit("id"), F.col("event_id").cast("double"), F.lit("v"), F.col("value")).alias("fields"), F.lit(1).alias("timestamp"))
    sent = table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.to_json(point).alias("value"))
    return ingest.json_points(sent).select(F.col("fields")["id"].cast("long").alias("event_id"), F.col("tags")["user"].alias("user"), F.col("fields")["v"].alias("value"))


@query("SELECT event_id AS seq FROM events WHERE event_type IS NULL OR event_type <> 'click' OR value < 10")
def trigger_negated_tag(spark, sf_dir):
    return triggers.evaluate(_changes(spark, sf_dir), triggers.Trigger("other", "events", "tag event_type != 'click' OR value < 10")).select("seq")


@query(
    """SELECT event_id AS seq FROM (SELECT event_id, count(*) OVER l AS n, avg(value) OVER (p ROWS 2 PRECEDING) AS short, avg(value) OVER l AS long FROM events WINDOW p AS (PARTITION BY event_type ORDER BY event_id), l AS (PARTITION BY event_type ORDER BY event_id ROWS 9 PRECEDING))
    WHERE n >= 10 AND short > long"""
)
def trigger_crossover(spark, sf_dir):
    return triggers.evaluate(_changes(spark, sf_dir), triggers.Trigger("up", "events", "crossover(value, 3, 10, above)")).select("seq")


@query("SELECT event_id AS seq, CASE WHEN value >= 90 THEN 'critical' WHEN value >= 60 THEN 'warning' ELSE 'info' END AS severity FROM events")
def trigger_severity(spark, sf_dir):
    return _changes(spark, sf_dir).select("seq", triggers.severity(F.coalesce(F.col("fields")["value"], F.lit(0.0)), 60, 90).alias("severity"))


@query("SELECT event_id AS seq FROM events WHERE event_type = 'view'")
def subscription(spark, sf_dir):
    return triggers.subscribe(_changes(spark, sf_dir), ["events"], {"event_type": "view"}, ["point_written"]).select("seq")


@query("SELECT date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 6 AS INTEGER)) AS start, event_type, count(value) AS n, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    """The streaming roll-up over a table as a batch: the watermark has no part in it."""
    made = triggers.stream_rollup(_changes(spark, sf_dir), "value", "6 hours", "1 hour")
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), F.element_at(F.split("series", "\u0001"), -1).alias("event_type"), "n", F.round("sum", 4).alias("sum"), "min", "max")


@query(
    """WITH p AS (SELECT event_id, event_type, ts, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS f FROM events), q AS (SELECT * FROM p WHERE f IS NOT NULL),
    m AS (SELECT *, CASE WHEN row_number() OVER w >= 20 THEN avg(abs(value - f)) OVER (w ROWS 19 PRECEDING) END AS mae FROM q WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    o AS (SELECT *, max(CASE WHEN r = 20 THEN mae END) OVER (PARTITION BY event_type) AS base FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM m))
    SELECT event_id, round(mae, 5) AS mae, coalesce(mae > 1.5 * base, false) AS stale FROM o"""
)
def tracked_accuracy(spark, sf_dir):
    over = Window.partitionBy("event_type").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").withColumn("f", F.lag("value").over(over)).where("f IS NOT NULL")
    return lifecycle.tracked_accuracy(pairs, ["event_type"], ["ts", "event_id"], "value", "f", 20).select("event_id", F.round("mae", 5).alias("mae"), "stale")


@query("SELECT event_type, count(*) FILTER (WHERE user_id % 2 = 0) AS true_positives, count(*) FILTER (WHERE user_id % 2 <> 0) AS false_positives, round(avg(CAST(user_id % 2 = 0 AS INTEGER)), 8) AS precision FROM events WHERE value > 90 AND user_id % 5 <> 0 GROUP BY 1")
def feedback_precision(spark, sf_dir):
    """Values over 90 as verdicts; users stand for judgements: every fifth gave none, even ones confirm."""
    judged = table(spark, sf_dir, "events").withColumn("hit", F.coalesce(F.col("value") > 90, F.lit(False))).withColumn("confirmed", F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 2 == 0))
    return lifecycle.feedback_precision(judged, ["event_type"], "hit", "confirmed").withColumn("precision", F.round("precision", 8))


@query("SELECT event_type, map_from_entries([('low', min(value)), ('high', max(value))])['high'] AS high, {'n': count(*), 'm': min(event_id)}.n AS n FROM events GROUP BY 1")
def map_struct_functions(spark, sf_dir):
    made = table(spark, sf_dir, "events").groupBy("event_type").agg(F.create_map(F.lit("low"), F.min("value"), F.lit("high"), F.max("value")).alias("m"), F.named_struct(F.lit("n"), F.count(F.lit(1)), F.lit("m"), F.min("event_id")).alias("s"))
    return made.select("event_type", F.element_at("m", "high").alias("high"), "s.n")
