"""Queries for binary sources, streams, alignment and the remaining table operations."""

from __future__ import annotations

import pickle
import struct
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame, from_points, merge
from ..operators import consolidate as con
from ..plans import store
from ..plans.spec import DEFAULT, ArchiveSpec, SeriesSpec
from ..session import DAY_MS, checkpoint_dir, cut, slot_end, table
from ..sources import binary
from ..streaming import pipeline
from .ingest import _KIND_SQL, _POINTS_SQL, SHIFT, SPECS, _commands, _commands_sql, _consolidate_sql, _statsd_sql
from .language import HOUR, _frame_sql, event_points

# ---- binary formats: files made of the events, written to the shared folder and read back

SIX, KEEP = 6 * HOUR, 10 * DAY_MS


def _whisper(archives) -> bytes:
    """A Whisper file of archives (step seconds, points); each has some unused slots."""
    head, body, off = struct.pack(">IIfI", 1, 100, 0.5, len(archives)), b"", 16 + 12 * len(archives)
    for step, pts in archives:
        head += struct.pack(">III", off + len(body), step, len(pts) + 3)
        body += b"".join(struct.pack(">Id", t, v) for t, v in pts) + bytes(36)
    return head + body


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """(name, step, at, v): means by the hour of the last ten days and by six hours of all; series u2 end halfway."""
    p = event_points(spark, d)
    whole = p.select(F.min("ms").alias("lo"), F.max("ms").alias("hi")).first()
    if whole["hi"] is None:
        return spark.createDataFrame([], "name string, step bigint, at bigint, v double")
    hour, six = (F.lit(x).cast("bigint") for x in (HOUR, SIX))
    p = p.where(~F.col("name").endswith(".u2") | (F.col("ms") < (whole["lo"] + whole["hi"]) // 2))
    p = p.withColumn("step", F.explode(F.when(F.col("ms") > whole["hi"] - KEEP, F.array(hour, six)).otherwise(F.array(six))))
    return p.groupBy("name", "step", (F.col("ms") - F.pmod("ms", "step")).alias("at")).agg(F.avg("value").alias("v"))


def _whisper_files(spark: SparkSession, d: str) -> DataFrame:
    def file(pdf):
        points = lambda step: sorted((int(t) // 1000, float(v)) for t, v, k in zip(pdf["at"], pdf["v"], pdf["step"], strict=True) if k == step)
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "content": [_whisper([(HOUR // 1000, points(HOUR)), (SIX // 1000, points(SIX))])]})

    at = _folder(spark, "whisper")
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    files = _cells(spark, d).groupBy("name").applyInPandas(file, "name string, content binary")
    rows = ((r["name"].replace(".", "/"), r["content"]) for r in files.toLocalIterator())
    for name, content in [*rows, ("bad", b"xx")]:
        out = fs.create(jvm.Path(f"{at}/{name}.wsp"))
        out.write(bytearray(content))
        out.close()
    return binary.read_whisper(spark, at)


def whisper_points(spark: SparkSession, d: str) -> DataFrame:
    return _whisper_files(spark, d).withColumn("value", F.round("value", 9))


def whisper_merge(spark: SparkSession, d: str) -> DataFrame:
    return binary.merge_whisper(_whisper_files(spark, d)).withColumn("value", F.round("value", 9))


def whisper_fresh(spark: SparkSession, d: str) -> DataFrame:
    """Series with a point in the last week of the data."""
    p = cut(_whisper_files(spark, d))
    return binary.fresh_whisper(p, p.agg(F.max("ms")).first()[0] or 0, 7).select("name").distinct()


REPLAY = SeriesSpec(HOUR, 12 * HOUR, tuple(ArchiveSpec(cf, SIX, 10_000, 0.5) for cf in ("WMEAN", "MAX")))


def whisper_replay(spark: SparkSession, d: str) -> DataFrame:
    """Imported into an archive of its own, twice: the second import finds nothing new."""
    at, p = _folder(spark, "imported"), cut(_whisper_files(spark, d))
    pipeline.import_whisper(p, REPLAY, at)
    pipeline.import_whisper(p, REPLAY, at)
    back = spark.read.schema("name string, t bigint, v double, step_ms bigint, cf string").parquet(at)
    return back.select("name", "cf", "step_ms", F.col("t").alias("t_ms"), F.round(F.col("v") + SHIFT, 6).alias("v"))


def pickle_points(spark: SparkSession, d: str) -> DataFrame:
    """All events as frames of up to 1,000 points."""

    def frames(batches):
        for b in batches:
            for at in range(0, len(b), 1000):
                x = b.iloc[at : at + 1000]
                body = pickle.dumps([(n, (int(ms) // 1000, float(v))) for n, ms, v in zip(x["name"], x["ms"], x["value"], strict=True)], 2)
                yield pd.DataFrame({"content": [struct.pack(">I", len(body)) + body]})

    p = binary.read_pickles(event_points(spark, d).mapInPandas(frames, "content binary"))
    return p.groupBy("name", "ms").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# ---- streams, run to completion over files in the shared folder


def _folder(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


STREAM = SeriesSpec(600_000, 7_200_000, tuple(ArchiveSpec(cf, r, 10**6, 0.5) for cf in ("WMEAN", "MAX") for r in (HOUR, 6 * HOUR)))


def stream_consolidate(spark: SparkSession, d: str) -> DataFrame:
    """The points as a stream, consolidated with state, written as files and read back."""
    src, out, cp = (_folder(spark, x) for x in ("points", "slots", "state"))
    event_points(spark, d).write.parquet(src)
    s = spark.readStream.schema("name string, ms bigint, value double").parquet(src)
    pipeline.write_archive(pipeline.consolidate_stream(s, STREAM), out, cp).awaitTermination()
    r = spark.read.schema("name string, t bigint, v double, step_ms bigint, cf string").parquet(out)
    return r.select("name", "cf", "step_ms", F.col("t").alias("t_ms"), F.round(F.col("v") + SHIFT, 6).alias("v"))


def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows of a counter stream; the last window stays open, as no later event closes it."""
    src, out, cp = (_folder(spark, x) for x in ("commands", "counters", "state"))
    event_points(spark, d).select(F.lit("add").alias("cmd"), "name", "value", F.timestamp_millis("ms").alias("ts")).write.parquet(src)
    s = spark.readStream.schema("cmd string, name string, value double, ts timestamp").parquet(src)
    q = pipeline.counter_windows(s, DAY_MS).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp)
    q.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema("name string, ms bigint, value double").parquet(out).select("name", F.col("ms").alias("t_ms"), F.round("value", 9).alias("value"))


def _stream_statsd(spark: SparkSession, d: str, cmds: tuple[str, ...]) -> DataFrame:
    src, out, cp = (_folder(spark, x) for x in ("commands", "windows", "state"))
    c = _commands(spark, d).where(F.col("cmd").isin(*cmds)).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    c.repartitionByRange(3, "ts").write.parquet(src)
    s = spark.readStream.schema("cmd string, name string, value double, id bigint, ts timestamp").parquet(src)
    q = pipeline.statsd_windows(s, 6 * HOUR).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp)
    q.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema("name string, ms bigint, value double").parquet(out).select("name", F.col("ms").alias("t_ms"), F.round("value", 9).alias("value"))


def stream_gauges(spark: SparkSession, d: str) -> DataFrame:
    """A stream of gauge commands; the last window stays open."""
    return _stream_statsd(spark, d, ("addgauge", "setgauge"))


def stream_timers(spark: SparkSession, d: str) -> DataFrame:
    """A stream of timer commands; the last window stays open."""
    return _stream_statsd(spark, d, ("append",))


def merged_archive(spark: SparkSession, d: str) -> DataFrame:
    """Slots written twice: the second writing of a slot wins, other partitions stay."""
    at = _folder(spark, "archive")
    rows = con.consolidate(event_points(spark, d), STREAM).where("v is not null").select("name", "cf", "step_ms", "t", "v")
    rows = cut(rows)
    pipeline.merge_archive(rows, at)
    pipeline.merge_archive(rows.where("cf = 'MAX' and name like '%.u0'").withColumn("v", F.lit(-1.0)), at)
    back = spark.read.parquet(at)
    return back.groupBy("cf", F.col("step_ms").cast("bigint").alias("step_ms")).agg(F.count("*").alias("n"), F.sum((F.col("v") == -1).cast("int")).alias("changed"))


# ---- frames and tables


def align_lcm(spark: SparkSession, d: str) -> DataFrame:
    """Hourly and six-hourly series side by side: all come to six hours."""
    p = event_points(spark, d)
    a = from_points(p.where("name like 'events.view.%'"), HOUR)
    b = from_points(p.where("name like 'events.click.%'"), 6 * HOUR)
    return _out(merge([a, b]))


def _out(f: Frame) -> DataFrame:
    return f.df.select("name", F.col("t").alias("t_ms"), F.round(F.col("v") + SHIFT, 6).alias("v"))


def pdp_extremes(spark: SparkSession, d: str) -> DataFrame:
    p = event_points(spark, d).withColumn("slot", slot_end("ms", DAY_MS))
    return con.pdp_summary(p, ["name", "slot"], "value", "ms")


def heartbeat_intervals(spark: SparkSession, d: str) -> DataFrame:
    return con.intervals(event_points(spark, d), 7_200_000).groupBy("name").agg(
        F.count("*").alias("n"), F.count("v").alias("known"), F.sum(F.col("t1") - F.col("t0")).alias("span_ms")
    )


def delete_series(spark: SparkSession, d: str) -> DataFrame:
    """tv without the sources whose removal is logged."""
    tv = table(spark, d, "tv").distinct().withColumn("name", F.col("ds_id").cast("string"))
    gone = table(spark, d, "ds_deletes").select(F.col("ds_id").cast("string").alias("name"))
    return store.delete_series(tv, gone).groupBy("ds_id").agg(F.count("*").alias("n"))


def create_archives(spark: SparkSession, d: str) -> DataFrame:
    return store.create_archives(table(spark, d, "ds"), DEFAULT.archives).groupBy("cf", "step_ms", "size").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        whisper_points, whisper_merge, whisper_fresh, whisper_replay, pickle_points, stream_consolidate, stream_counters, stream_gauges, stream_timers, merged_archive, align_lcm,
        pdp_extremes, heartbeat_intervals, delete_series, create_archives,
    )
}

_WSP = f"""with e as (select 'events.' || event_type || '.u' || (user_id % 3) as name, epoch_us(ts) // 1000 as ms, value from events),
w as (select min(ms) as lo, max(ms) as hi from e), x as (select e.*, hi from e, w where name not like '%.u2' or ms < (lo + hi) // 2),
k as (select name, 0 as archive, {HOUR}::bigint as step_ms, ms // {HOUR} * {HOUR} as ms, avg(value) as value from x where ms > hi - {KEEP} group by 1, 4
union all select name, 1, {SIX}, ms // {SIX} * {SIX}, avg(value) from x group by 1, 4),
m as (select name, ms + step_ms as ms, value from k where archive = 0 or ms < coalesce((select min(f.ms) from k f where f.name = k.name and f.archive = 0), ms + 1))"""
_P = "with p as (select 'events.' || event_type || '.u' || (user_id % 3) as name, epoch_us(ts) // 1000 as ms, value from events)"



def _closed(kind: str) -> str:
    """Windows of the batch form that the latest command of the stream has closed."""
    cmds = {"g": "cmd in ('addgauge', 'setgauge')", "t": "cmd = 'append'"}[kind]
    c = f"select * from ({_commands_sql(_KIND_SQL)}) where {cmds}"
    return f"select * from ({_statsd_sql(c, 6 * HOUR)}) where t_ms <= (select max(ms) from ({c}))"


ORACLES = {
    "whisper_points": _WSP + " select name, archive, step_ms, ms, round(value, 9) as value from k",
    "whisper_merge": _WSP + " select name, ms, round(value, 9) as value from m",
    "whisper_fresh": _WSP + f" select name from k group by 1 having max(ms) >= (select max(ms) from k) - {7 * DAY_MS}",
    "whisper_replay": "select * from (" + _consolidate_sql(REPLAY).replace(_POINTS_SQL, _WSP + " select * from m") + ") where v is not null",
    "pickle_points": _P + " select name, ms // 1000 * 1000 as ms, count(*) as n, round(sum(value), 4) as total from p group by 1, 2",
    "stream_consolidate": "select * from (" + _consolidate_sql(STREAM) + ") where v is not null and step_ms > 0",
    "stream_counters": _P + f", c as (select name, ms // {DAY_MS} * {DAY_MS} + {DAY_MS} as t_ms, sum(value) as s from p group by 1, 2) select name, t_ms, round(s / 86400, 9) as value from c where t_ms <= (select max(ms) from p)",
    "stream_gauges": _closed("g"),
    "stream_timers": _closed("t"),
    "merged_archive": "with s as (" + _consolidate_sql(STREAM) + ") select cf, step_ms, count(*) as n, (count(*) filter (where cf = 'MAX' and name like '%.u0'))::bigint as changed from s where v is not null group by 1, 2",
    "align_lcm": _frame_sql("ev_1h") + f""", va as (select min(t) as lo, max(t) as hi from p where name like 'events.view.%'),
    h as (select f.name, ((f.t - 1) // {6 * HOUR} + 1) * {6 * HOUR} as t_ms, round(avg(f.v) + {SHIFT}, 6) as v from f, va where f.name like 'events.view.%' and f.t between va.lo and va.hi group by 1, 2)
select * from h union all select * from (""" + _frame_sql("ev_6h").replace("from events)", "from events where event_type = 'click')") + f" select name, t as t_ms, round(v + {SHIFT}, 6) as v from f)",
    "pdp_extremes": _P + f" select name, ((ms - 1) // {DAY_MS} + 1) * {DAY_MS} as slot, max(value) as v_max, min(value) as v_min, arg_max(value, ms) as v_last from p group by 1, 2",
    "heartbeat_intervals": _P + ", i as (select name, ms - lag(ms) over (partition by name order by ms) as d from p) select name, count(*) as n, count(*) filter (where d <= 7200000) as known, sum(d)::bigint as span_ms from i where d > 0 group by 1",
    "delete_series": "select ds_id, count(*) as n from (select distinct * from tv) where ds_id not in (select ds_id from ds_deletes where ds_id is not null) group by 1",
    "create_archives": "with n as (select count(distinct name) as n from ds) select 'WMEAN' as cf, s as step_ms, k as size, n from n, (values (10000::bigint, 2160::bigint), (60000, 1440), (600000, 13392), (86400000, 1825)) x(s, k)",
}
