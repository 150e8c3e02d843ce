"""Messages of topics (a text stream or batch with key, value and topic) as points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.sources import ingest


def points(messages: DataFrame, formats: dict[str, str], topic: str = "topic", value: str = "value") -> DataFrame:
    """(topic, measurement, tags, fields map<string,double>, _time_ns, _time) of messages; several lines or points per message.

    ``formats``: topic to ``line`` or ``json``. Other topics, unreadable lines and fields that are no numbers are left out;
    a point without a time or a measurement has nulls there. Narrow: works on streams.
    """
    parts = []
    for name, kind in formats.items():
        own = messages.where(F.col(topic) == name).select(F.col(topic).alias("topic"), F.col(value).cast("string").alias("value"))
        if kind == "json":
            read = ingest.json_points(own)
        elif kind == "line":
            lines = own.select(F.explode(F.split("value", "\r?\n", -1)).alias("value"))
            read = ingest.line_protocol(lines).where("error IS NULL")
            numbers = F.transform_values("fields", lambda k, v: F.coalesce(v["double"], v["long"].cast("double"), v["decimal"].cast("double")))
            read = read.withColumn("fields", F.map_filter(numbers, lambda k, v: v.isNotNull()))
        else:
            raise ValueError(f"unknown format {kind!r}; known: line, json")
        parts.append(read.select(F.lit(name).alias("topic"), "measurement", "tags", "fields", "_time_ns", "_time"))
    if not parts:
        raise ValueError("at least one topic is needed")
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return made
