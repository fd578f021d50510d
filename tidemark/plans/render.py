"""The render request: from targets and a range of time to rows of JSON."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durations import parse_time
from ..frame import Frame
from ..session import finite


def datapoints(f: Frame) -> DataFrame:
    """(name, target, datapoints): [value or null, epoch seconds] in order of time, slots at or before 0
    left out, infinite values null; target is the shown name, the alias if there is one."""
    d = f.df.where("t > 0").select(
        "name", F.coalesce("alias", "name").alias("target"), "t", F.when(finite("v"), F.col("v")).alias("v"), F.floor(F.col("t") / 1000).cast("bigint").alias("sec")
    )
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("t", "v", "sec"))), lambda x: F.array(F.to_json(F.array(x["v"])), x["sec"].cast("string")))
    g = d.groupBy("name", "target").agg(pairs.alias("p"))
    inner = F.transform("p", lambda x: F.concat(F.lit("["), F.regexp_replace(x[0], r"[\[\]]", ""), F.lit(", "), x[1], F.lit("]")))
    return g.select("name", "target", F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]")).alias("datapoints"))


def render_json(f: Frame) -> DataFrame:
    """(name, target, json): one JSON object per series. Sort by name for the answer."""
    return datapoints(f).select(
        "name", "target", F.concat(F.lit('{"target": '), F.regexp_replace(F.to_json(F.array("target")), r"^\[|\]$", ""), F.lit(', "datapoints": '), "datapoints", F.lit("}")).alias("json")
    )


def render(spark, store, targets: list[str], begin: str = "", until: str = "", max_points: int = 512, now_ms: int | None = None, compat: bool = False):
    """(rows, errors) of a render request: rows (target_no, name, target, json) and, by number, what is
    wrong with targets that can't be evaluated. Without `begin` the range is the last 24 hours, without
    `until` it ends now. A target without series, or with an error, has one row with empty datapoints."""
    from ..dsl.engine import Engine
    from ..dsl.parser import DslError

    now = int(time.time() * 1000) if now_ms is None else now_ms
    from_ms, to_ms = parse_time(begin or "-24h", now), parse_time(until, now)
    engine = Engine(spark, store, from_ms, to_ms, max_points, compat)
    parts, errors = [], {}
    for k, text in enumerate(targets):
        try:
            parts.append(render_json(engine.query(text)).withColumn("target_no", F.lit(k)))
        except DslError as e:
            errors[k] = str(e)
    asked = spark.range(len(targets)).select(F.col("id").cast("int").alias("target_no"))
    none = F.lit('{"datapoints": []}')
    if not parts:
        null = F.lit(None).cast("string")
        return asked.select("target_no", null.alias("name"), null.alias("target"), none.alias("json")), errors
    rows = asked.join(reduce(DataFrame.unionByName, parts), "target_no", "left")
    return rows.select("target_no", "name", "target", F.coalesce("json", none).alias("json")).orderBy("target_no", "name"), errors


def body(rows: DataFrame) -> str:
    """The answer as one text; its size is what the request asked for."""
    return "[" + ",\n".join(r["json"] for r in rows.toLocalIterator()) + "]"
