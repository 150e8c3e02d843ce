"""Text formats of points as DataFrames: line protocol, JSON points, OTLP metrics in JSON, topic paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nanoseconds per unit of the timestamp; names are fixed values of the format.
PRECISION = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9}
_TAG = r"((?:\\.|[^\\,= ])+)=((?:\\.|[^\\,= ])+)"
_FIELD = r'((?:\\.|[^\\,= ])+)=("(?:\\.|[^"\\])*"|[^", ]+)'
_LINE = r'^((?:\\.|[^\\, ])+)((?:,(?:\\.|[^\\ ])+)?) ((?:"(?:\\.|[^"\\])*"|\\.|[^" \\])+)(?: (-?\d+))?\s*$'


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([,= \\])", "$1")


def _pairs(text: Column, pattern: str) -> Column:
    keys, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.map_from_arrays(F.transform(keys, _plain), values)


def line_protocol(lines: DataFrame, column: str = "value", precision: str = "ns") -> DataFrame:
    """(measurement, tags map, fields map of (kind, double, long, decimal, string, boolean), _time_ns, _time) of each line; ``error`` where it can't be read.

    Kinds by suffix: i integer, u unsigned, d decimal; quoted strings; t, true, f, false in any case; else float.
    Blank lines and comments are left out. Without a timestamp the time is null.
    """
    text = F.trim(F.col(column))
    rows = lines.where(F.col(column).isNotNull() & (text != "") & ~text.startswith("#"))
    part = lambda i: F.regexp_extract(text, _LINE, i)

    def typed(raw: Column) -> Column:
        number = F.regexp_extract(raw, r"^(-?[0-9.eE+-]+)[iud]?$", 1)
        kind = (
            F.when(raw.startswith('"'), "string")
            .when(raw.rlike(r"^(?i:t|true|f|false)$"), "boolean")
            .when(raw.rlike(r"^-?\d+i$"), "integer")
            .when(raw.rlike(r"^\d+u$"), "unsigned")
            .when(raw.rlike(r"^-?\d+(\.\d+)?d$"), "decimal")
            .when(raw.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), "float")
        )
        return F.struct(
            kind.alias("kind"),
            F.when(kind == "float", number.try_cast("double")).alias("double"),
            F.when(kind == "integer", number.try_cast("long")).alias("long"),
            F.when(kind.isin("unsigned", "decimal"), number.try_cast("decimal(38,10)")).alias("decimal"),
            F.when(kind == "string", F.regexp_replace(F.substr(raw, F.lit(2)), r'\\(["\\])|"$', "$1")).alias("string"),
            F.when(kind == "boolean", F.lower(raw).startswith("t")).alias("boolean"),
        )

    read = rows.select(
        F.col(column).alias("line"),
        _plain(part(1)).alias("measurement"),
        F.transform_values(_pairs(part(2), _TAG), lambda k, v: _plain(v)).alias("tags"),
        F.transform_values(_pairs(part(3), _FIELD), lambda k, v: typed(v)).alias("fields"),
        part(4).try_cast("long").alias("__at"),
    )
    at = F.col("__at") * PRECISION[precision]
    bad = (F.col("measurement") == "") | (F.cardinality("fields") == 0) | F.exists(F.map_values("fields"), lambda f: f["kind"].isNull())
    made = read.withColumns({"_time_ns": at, "_time": F.timestamp_micros(F.floor(at / 1000).cast("long")).cast("timestamp_ntz"), "error": F.when(bad, F.lit("not a point"))})
    return made.drop("__at")


_POINT = "struct<measurement:string,tags:map<string,string>,fields:map<string,double>,timestamp:bigint>"


def json_points(lines: DataFrame, column: str = "value") -> DataFrame:
    """(measurement, tags, fields, _time_ns, _time) from JSON objects of one point, or arrays of them."""
    parsed = F.coalesce(F.from_json(column, f"array<{_POINT}>"), F.array(F.from_json(column, _POINT)))
    rows = lines.select(F.explode(parsed).alias("p")).where("p.measurement is not null")
    return rows.select("p.measurement", "p.tags", "p.fields", F.col("p.timestamp").alias("_time_ns"), F.timestamp_micros(F.floor(F.col("p.timestamp") / 1000).cast("long")).cast("timestamp_ntz").alias("_time"))


_ATTRIBUTES = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
_DATA = f"array<struct<attributes:{_ATTRIBUTES},timeUnixNano:string,startTimeUnixNano:string,asDouble:double,asInt:string,count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>,bucketCounts:array<string>,explicitBounds:array<double>>>"
_OTLP = f"struct<resourceMetrics:array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeMetrics:array<struct<metrics:array<struct<name:string,gauge:struct<dataPoints:{_DATA}>,sum:struct<dataPoints:{_DATA}>,summary:struct<dataPoints:{_DATA}>,histogram:struct<dataPoints:{_DATA}>>>>>>>>"


def _attributes(column: Column) -> Column:
    entry = lambda a: F.struct(a["key"].alias("key"), F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string")).alias("value"))
    return F.map_from_entries(F.transform(F.coalesce(column, F.array().cast(_ATTRIBUTES)), entry))


def otlp_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """(measurement, tags, field, value, _start_ns, _time_ns) of OTLP metrics: gauges as ``gauge``, sums as ``value``, summaries and histograms as ``count``, ``sum`` and ``quantile_q`` or ``bucket_le``."""
    r = lines.select(F.explode(F.from_json(column, _OTLP)["resourceMetrics"]).alias("r"))
    m = r.select("r.resource.attributes", F.explode("r.scopeMetrics").alias("s")).select(F.col("attributes").alias("shared"), F.explode("s.metrics").alias("m"))
    parts = []
    for kind in ("gauge", "sum", "summary", "histogram"):
        d = m.where(F.col(f"m.{kind}").isNotNull()).select("shared", "m.name", F.explode(f"m.{kind}.dataPoints").alias("d"))
        simple = F.coalesce(F.col("d.asDouble"), F.col("d.asInt").try_cast("double"))
        pair = lambda n, v: F.struct(n.alias("field"), v.alias("value"))
        if kind in ("gauge", "sum"):
            values = F.array(pair(F.lit("gauge" if kind == "gauge" else "value"), simple))
        else:
            whole = F.array(pair(F.lit("count"), F.col("d.count").try_cast("double")), pair(F.lit("sum"), F.col("d.sum")))
            if kind == "summary":
                more = F.transform(F.col("d.quantileValues"), lambda q: pair(F.concat(F.lit("quantile_"), q["quantile"].cast("string")), q["value"]))
            else:
                bound = lambda i: F.coalesce(F.get(F.col("d.explicitBounds"), i).cast("string"), F.lit("+Inf"))
                more = F.transform(F.col("d.bucketCounts"), lambda c, i: pair(F.concat(F.lit("bucket_"), bound(i)), c.try_cast("double")))
            values = F.concat(whole, F.coalesce(more, F.array().cast("array<struct<field:string,value:double>>")))
        tags = F.map_zip_with(_attributes(F.col("shared")), _attributes(F.col("d.attributes")), lambda k, a, b: F.coalesce(b, a))
        parts.append(d.select(F.col("name").alias("measurement"), tags.alias("tags"), F.explode(values).alias("f"), F.col("d.startTimeUnixNano").try_cast("long").alias("_start_ns"), F.col("d.timeUnixNano").try_cast("long").alias("_time_ns")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("measurement", "tags", "f.field", "f.value", "_start_ns", "_time_ns").where("value is not null")


def topic_tags(topics: DataFrame, pattern: str, column: str = "topic") -> DataFrame:
    """Add ``measurement`` and ``tags`` from a path like ``site/{site}/{measurement}``; other paths are left out."""
    parts = pattern.split("/")
    split = F.split(column, "/", -1)
    rows = topics.where(F.size(split) == len(parts))
    names = {}
    for i, p in enumerate(parts):
        if p.startswith("{") and p.endswith("}"):
            names[p[1:-1]] = split[i]
        elif p != "+":
            rows = rows.where(split[i] == p)
    measurement = names.pop("measurement", F.lit(parts[0]))
    pairs = [x for n, v in names.items() for x in (F.lit(n), v)]
    return rows.withColumn("measurement", measurement).withColumn("tags", F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))


def demo(spark: SparkSession, days: int = 7, step_s: int = 10) -> DataFrame:
    """A week of a house: device, _time, power_w, with a daily cycle and two planted anomalies."""
    n = days * 86400 // step_s
    devices = F.explode(F.array(F.lit("pv"), F.lit("battery"), F.lit("grid"), F.lit("heat_pump")))
    rows = spark.range(n).select("id", devices.alias("device"))
    t = F.col("id") * step_s
    daily = F.sin((t % 86400) / 86400 * 2 * 3.141592653589793 - 1.5707963267948966)
    noise = F.pmod(F.xxhash64("id", "device", F.lit(42)), F.lit(1000)) / 1000.0 - 0.5
    level = F.when(F.col("device") == "pv", F.greatest(daily, F.lit(0.0)) * 5000).when(F.col("device") == "heat_pump", 800 - daily * 300).otherwise(400 + daily * 200)
    planted = F.when((F.col("device") == "pv") & F.col("id").between(n // 2, n // 2 + 30), -3000.0).when((F.col("device") == "heat_pump") & F.col("id").between(n * 3 // 4, n * 3 // 4 + 30), 2500.0).otherwise(0.0)
    return rows.select("device", F.timestamp_seconds(F.lit(1704067200) + t).cast("timestamp_ntz").alias("_time"), (level + noise * 20 + planted).alias("power_w"))


def validate(rows: DataFrame, known: T.StructType) -> T.StructType:
    """The schema that takes these rows in: known columns keep their types, new ones are added, a change of type is refused."""
    fields = {f.name: f for f in known.fields}
    for f in rows.schema.fields:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise ValueError(f"{f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, f)
    return T.StructType(list(fields.values()))
