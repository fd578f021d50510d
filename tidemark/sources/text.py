"""Line protocols as column expressions: the same code parses a batch of lines and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import clean_name
from ..session import finite

_NUM = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def graphite_lines(lines: DataFrame, col: str = "value", now_ms=None) -> DataFrame:
    """(name, ms, value) of `name value epoch` lines; epoch -1 is now. Lines that don't parse (too few
    fields, bad numbers, null, empty) and values that aren't finite are left out; extra fields are
    ignored."""
    f = F.split(F.trim(F.col(col)), r"\s+")
    sec = F.get(f, F.lit(2)).try_cast("bigint")
    now = F.lit(now_ms).cast("bigint") if now_ms is not None else F.unix_millis(F.current_timestamp())
    d = lines.where(F.size(f) >= 3).select(
        clean_name(F.get(f, F.lit(0))).alias("name"),
        F.when(sec == -1, now).otherwise(sec * 1000).alias("ms"),
        F.get(f, F.lit(1)).try_cast("double").alias("value"),
    )
    return d.where(finite("value") & F.col("ms").isNotNull())


def statsd_lines(lines: DataFrame, col: str = "value", *keep: str, compat: bool = False) -> DataFrame:
    """(name, value, metric, sample, delta, keep...) of statsd packets `name[:value|c|g|ms[|@rate]]`.

    A bare name counts 1. A sign before a gauge's value makes it a change (under compat only +). Packets
    with a bad value, an unknown type or a rate outside 0..1 are left out, as are null and empty lines.
    """
    line = F.trim(F.col(col))
    parts = F.split(line, ":")
    bare = F.size(parts) == 1
    f = F.split(F.get(parts, F.lit(1)), r"\|")
    raw, metric, rate = (F.get(f, F.lit(k)) for k in range(3))
    value = F.regexp_extract(raw, rf"^\s*({_NUM})", 1).try_cast("double")
    sample = F.when(F.size(f) > 2, F.regexp_extract(rate, rf"^@({_NUM})", 1).try_cast("double")).otherwise(1.0)
    delta = raw.startswith("+") if compat else raw.rlike("^[+-]")
    d = lines.where(F.length(line) > 0).select(
        clean_name(F.get(parts, F.lit(0))).alias("name"),
        F.when(bare, F.lit(1.0)).otherwise(value).alias("value"),
        F.when(bare, F.lit("c")).otherwise(metric).alias("metric"),
        F.when(bare, F.lit(1.0)).otherwise(sample).alias("sample"),
        F.when(bare, F.lit(False)).otherwise(delta).alias("delta"),
        *keep,
    )
    return d.where(F.col("value").isNotNull() & F.col("metric").isin("c", "g", "ms") & F.col("sample").between(0, 1))


def statsd_commands(stats: DataFrame) -> DataFrame:
    """(cmd, name, value) of parsed packets, other columns kept: counters are divided by their rate (0
    leaves them as they are), signed gauges add, others set, timers append."""
    cmd = F.when(F.col("metric") == "c", "add").when(F.col("metric") == "ms", "append").when(F.col("delta"), "addgauge").otherwise("setgauge")
    v = F.when((F.col("metric") == "c") & (F.col("sample") > 0), F.col("value") / F.col("sample")).otherwise(F.col("value"))
    return stats.withColumn("cmd", cmd).withColumn("value", v)


#: Paths of the pixel interface and what they do.
PIXEL_COMMANDS = {"/pixel": "point", "/pixel/add": "add", "/pixel/addgauge": "addgauge", "/pixel/setgauge": "setgauge", "/pixel/append": "append"}


def pixel_requests(requests: DataFrame, col: str = "value", now_ms=None) -> DataFrame:
    """(cmd, name, value, ms) of request lines `/pixel...?name=value[@epoch]&...`; without an epoch (or
    with 0) the time is now. Parameters that don't parse and other paths are left out."""
    now = F.lit(now_ms).cast("bigint") if now_ms is not None else F.unix_millis(F.current_timestamp())
    path = F.substring_index(F.col(col), "?", 1)
    query = F.when(F.contains(F.col(col), F.lit("?")), F.substring_index(F.col(col), "?", -1))
    d = requests.select(path.alias("path"), F.explode(F.split(query, "&")).alias("p"))
    m = rf"^({_NUM})(?:@({_NUM}))?"
    raw = F.try_url_decode(F.substring_index("p", "=", -1))
    at = F.regexp_extract(raw, m, 2).try_cast("double")
    cmd = F.lit(None).cast("string")
    for k, v in PIXEL_COMMANDS.items():
        cmd = F.when(F.col("path") == k, v).otherwise(cmd)
    d = d.where(F.contains("p", F.lit("="))).select(
        cmd.alias("cmd"),
        clean_name(F.try_url_decode(F.substring_index("p", "=", 1))).alias("name"),
        F.regexp_extract(raw, m, 1).try_cast("double").alias("value"),
        F.when(F.coalesce(at, F.lit(0.0)) == 0, now).otherwise((at * 1000).cast("bigint")).alias("ms"),
    )
    return d.where("cmd is not null and value is not null")


def synthetic_points(spark, names: int, start_ms: int, end_ms: int, step_ms: int, period_ms: int = 600_000, prefix: str = "load") -> DataFrame:
    """(name, ms, value): a sinusoid of 100 per name and step; names are prefix.<number>. Made in
    parallel from ranges, so a load of any size can be produced."""
    n = max(0, (end_ms - start_ms) // step_ms)
    r = spark.range(names * n)
    k, i = F.col("id") % names, F.floor(F.col("id") / names)
    ms = F.lit(start_ms) + i * step_ms
    return r.select(F.format_string(f"{prefix}.%d", k).alias("name"), ms.cast("bigint").alias("ms"), (F.sin(ms % period_ms * (2 * 3.141592653589793 / period_ms)) * 100).alias("value"))
