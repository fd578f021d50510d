"""Structured Streaming forms of ingestion: lines to points, statsd windows, consolidation with state.

Contract: with no late points the streams give what the batch operators give on all the data at once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.statsd import KINDS, THRESHOLDS
from ..plans.spec import SeriesSpec
from ..session import bounded_broadcast, cut, finite
from ..sources.binary import read_pickles, replay_whisper
from ..sources.network import TcpFrames, TcpLines, UdpLines, listen
from ..sources.text import graphite_lines, statsd_commands, statsd_lines


def points_from_text(spark, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of (name, ms, value) from text files of Graphite lines that arrive in a folder; the number
    of files per trigger is the back-pressure, nothing is dropped."""
    r = spark.readStream.format("text")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return graphite_lines(r.load(path))


def points_from_tcp(spark, port: int, host: str = "127.0.0.1") -> DataFrame:
    """Stream of points from connections that send Graphite lines."""
    return graphite_lines(listen(spark, TcpLines, port, host))


def points_from_udp(spark, port: int, host: str = "127.0.0.1") -> DataFrame:
    """Stream of points from datagrams of Graphite lines."""
    return graphite_lines(listen(spark, UdpLines, port, host))


def points_from_pickles(spark, port: int, host: str = "127.0.0.1") -> DataFrame:
    """Stream of points from connections that send pickled frames."""
    return read_pickles(listen(spark, TcpFrames, port, host))


def statsd_from_tcp(spark, port: int, host: str = "127.0.0.1") -> DataFrame:
    """Stream of statsd commands from connections that send packets, one a line."""
    return commands_from_lines(listen(spark, TcpLines, port, host))


def statsd_from_udp(spark, port: int, host: str = "127.0.0.1") -> DataFrame:
    """Stream of statsd commands from datagrams."""
    return commands_from_lines(listen(spark, UdpLines, port, host))


def commands_from_lines(lines: DataFrame) -> DataFrame:
    """Stream of statsd commands (cmd, name, value, ts, id) from lines (value) of a socket, datagrams or
    files. Packets carry no time: theirs is that of their arrival, the `timestamp` of the lines if they have
    one, else that of the trigger; ties are ordered by the number of the `line`, if there is one."""
    ts = F.col("timestamp") if "timestamp" in lines.columns else F.current_timestamp()
    number = F.col("line") if "line" in lines.columns else F.lit(0)
    c = lines.select(F.struct(F.col("value").alias("line"), ts.alias("ts"), number.cast("bigint").alias("id")).alias("x"))
    c = statsd_commands(statsd_lines(c.select("x.line", "x.ts", "x.id"), "line", "ts", "id"))
    return c.select("cmd", "name", "value", "ts", "id")


def counter_windows(commands: DataFrame, window_ms: int = 10_000, delay: str = "0 seconds") -> DataFrame:
    """Streaming counters: sum per second in tumbling windows of event time; commands behind the
    watermark are late and dropped. commands: (cmd, name, value, ts timestamp)."""
    w = F.window("ts", f"{window_ms} milliseconds")
    g = commands.where("cmd = 'add'").withWatermark("ts", delay).groupBy(w, "name").agg(F.sum("value").alias("total"))
    return g.select("name", F.unix_millis("window.end").alias("ms"), (F.col("total") / (window_ms / 1000)).alias("value"))


def flush_window(cmds: list[tuple], window_ms: int, thresholds: tuple[int, ...] = THRESHOLDS) -> list[tuple[str, float]]:
    """(suffix of the name, value) of one name's commands (ms, id, cmd, value) in one window, one by one."""
    cmds = sorted(cmds, key=lambda c: c[:2])
    kind, value, values = KINDS[cmds[0][2]], 0.0, []
    for _, _, cmd, v in cmds:
        if cmd == "append":
            values.append(v)
        else:
            value = v if cmd == "setgauge" else value + v
    if kind != "t":
        return [("", value / (window_ms / 1000) if kind == "c" else value)]
    values.sort()
    n, total = len(values), sum(values)
    out = [(".count", float(n)), (".lower", values[0]), (".upper", values[-1]), (".sum", total), (".mean", total / n)]
    for t in thresholds:
        k = max(1, int(np.floor(t / 100 * n + 0.5)))
        part = sum(values[:k])
        out += [(f".sum_{t:02d}", part), (f".mean_{t:02d}", part / k), (f".upper_{t:02d}", values[k - 1])]
    return out


def statsd_windows(commands: DataFrame, window_ms: int = 10_000, delay: str = "0 seconds", thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Streaming statsd aggregation of all kinds: what statsd.aggregate() gives for each window, once the
    watermark (`delay` behind the latest command) has passed its end. Commands behind the watermark are late
    and dropped. commands: (cmd, name, value, ts timestamp, id bigint). The state of a name is the commands of
    its open windows; for counters alone, counter_windows() needs no more than their sums."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cmds = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            cmds += zip(b["ms"].tolist(), b["id"].tolist(), b["cmd"], b["value"].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs()
        end = lambda ms: ms - ms % window_ms + window_ms
        by_window: dict[int, list] = {}
        for c in cmds:
            by_window.setdefault(end(c[0]), []).append(c)
        rows = [(key[0] + tag, e, v) for e in sorted(by_window) if e <= mark for tag, v in flush_window(by_window[e], window_ms, thresholds)]
        left = [c for e in sorted(by_window) if e > mark for c in by_window[e]]
        if left:
            state.update(tuple(map(list, zip(*left, strict=True))))
            state.setTimeoutTimestamp(end(left[0][0]) - 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["name", "ms", "value"]).astype({"value": "float64"})

    ok = commands.where(finite("value") & F.col("name").isNotNull() & F.col("cmd").isin(*KINDS))
    ok = ok.select("cmd", "name", "value", "ts", F.unix_millis("ts").alias("ms"), F.col("id").cast("bigint").alias("id"))
    schema = "ms array<bigint>, id array<bigint>, cmd array<string>, value array<double>"
    return ok.withWatermark("ts", delay).groupBy("name").applyInPandasWithState(run, "name string, ms bigint, value double", schema, "append", GroupStateTimeout.EventTimeTimeout)


class Consolidator:
    """The state of one series: its open primary slot and the open slot of every archive."""

    def __init__(self, spec: SeriesSpec, last: int | None = None, pdp=(0.0, 0), slots=None):
        self.spec, self.last, self.vd, self.dur = spec, last, pdp[0], pdp[1]
        # per archive: value sum or value, known duration, reset seen
        self.slots = slots or [[np.nan, 0, 0] for _ in spec.archives]

    def state(self) -> tuple:
        flat = [float(x) for s in self.slots for x in s]
        return (self.last if self.last is not None else -1, float(self.vd), int(self.dur), flat)

    @classmethod
    def load(cls, spec: SeriesSpec, state: tuple) -> Consolidator:
        last, vd, dur, flat = state
        slots = [[flat[3 * k], int(flat[3 * k + 1]), int(flat[3 * k + 2])] for k in range(len(spec.archives))]
        return cls(spec, last if last >= 0 else None, (vd, int(dur)), slots)

    def point(self, ms: int, value: float) -> list[tuple[str, int, int, float | None]]:
        """Feed one point; (cf, step, slot end, value) of the archive slots that it completes. A point
        not later than the last one is rejected."""
        if self.spec.heartbeat_ms == 0:
            return self._owned(ms, value)
        last, self.last = self.last, ms
        if last is None:
            return []
        if ms <= last:
            self.last = last
            return []
        s = self.spec.step_ms
        v = value if ms - last <= self.spec.heartbeat_ms else None
        up, lo = -(-last // s) * s, ms // s * s
        out: list = []
        if last != up:
            self._add(v, min(up, ms) - last)
            if ms < up:
                return out
            out += self._update(up - s, up, self.vd / self.dur if self.dur else None, self.dur)
            self.vd, self.dur = 0.0, 0
        if lo > up:
            out += self._update(up, lo, v, None)
        if ms > lo:
            self._add(v, ms - max(lo, last))
        return out

    def _owned(self, ms: int, value: float) -> list:
        """Heartbeat 0: a value owns the whole step it falls into, skipped steps are unknown. A slot that was
        put out may be put out again: the later value counts."""
        s, last = self.spec.step_ms, self.last
        if last is not None and ms < last:
            return []
        self.last, e, out = ms, ms // s * s + s, []
        if last is not None and e - s > (prev := last // s * s + s):
            out += self._update(prev, e - s, None, None)
        return out + self._update(e - s, e, value, s)

    def _add(self, v: float | None, d: int) -> None:
        if v is not None and d > 0:
            self.vd += v * d
            self.dur += d

    def _update(self, b: int, e: int, v: float | None, dur: int | None) -> list:
        out = []
        for k, a in enumerate(self.spec.archives):
            r, span = a.step_ms, e - b
            d = dur if dur is not None else (span if span > self.spec.step_ms and r >= span else self.spec.step_ms)
            slot = b // r * r + r
            while True:
                acc = self.slots[k]
                if v is None:
                    if a.cf == "WMEAN" and d == r:
                        acc[:] = [np.nan, 0, 1]
                elif d > 0:
                    known = acc[1] > 0
                    if a.cf == "WMEAN":
                        acc[0] = (acc[0] if known else 0.0) + v * d
                    elif a.cf == "MAX":
                        acc[0] = max(acc[0], v) if known else v
                    elif a.cf == "MIN":
                        acc[0] = min(acc[0], v) if known else v
                    else:
                        acc[0] = v
                    acc[1] += d
                if slot > e:
                    break
                value: float | None
                if acc[1] / r < a.xff:
                    value = None
                elif acc[1] == 0:
                    value = None if acc[2] or a.xff > 0 else 0.0
                else:
                    value = acc[0] / acc[1] if a.cf == "WMEAN" else acc[0]
                out.append((a.cf, r, slot, value))
                self.slots[k] = [np.nan, 0, 0]
                if slot == e:
                    break
                slot += r
        return out


STATE = "last bigint, vd double, dur bigint, slots array<double>, wait_ms array<bigint>, wait_value array<double>"
SLOTS = "name string, cf string, step_ms bigint, t bigint, v double"


def consolidate_stream(points: DataFrame, spec: SeriesSpec, delay: str | None = None) -> DataFrame:
    """Stream of finished archive slots (name, cf, step_ms, t, v) from a stream of points (name, ms,
    value). Points of a trigger are sorted per series; one not later than the series' last is dropped.
    With a delay, points wait for others that come after them but belong before them, until the watermark
    (`delay` behind the latest point) has passed them; what still waits when the stream ends is in its state.
    Slots without a value are put out as null. Retention is left to the table that receives them. With
    heartbeat 0 a slot may come again with another value: such a stream is written by merge_stream()."""
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = Consolidator.load(spec, state.get[:4]) if state.exists else Consolidator(spec)
        p = list(zip(*state.get[4:], strict=True)) if state.exists else []
        for b in batches:
            p += [(ms, v) for ms, v in zip(b["ms"].tolist(), b["value"].tolist(), strict=True) if np.isfinite(v)]
        mark = state.getCurrentWatermarkMs() if delay else None
        waiting = [x for x in p if mark is not None and x[0] > mark]
        ready = sorted((x for x in p if mark is None or x[0] <= mark), key=lambda x: (x[0], -x[1]))
        # of a slot that comes again the last value counts
        slots = {r[:3]: r[3] for ms, v in ready for r in c.point(ms, v)}
        rows = [(key[0], *k, v) for k, v in slots.items()]
        state.update((*c.state(), [ms for ms, _ in waiting], [v for _, v in waiting]))
        if waiting:
            state.setTimeoutTimestamp(min(ms for ms, _ in waiting))
        yield pd.DataFrame(rows, columns=["name", "cf", "step_ms", "t", "v"]).astype({"v": "float64"})

    ok = points.where("name is not null and ms is not null and value is not null")
    if delay:
        ok = ok.withColumn("__ts", F.timestamp_millis("ms")).withWatermark("__ts", delay)
    timeout = GroupStateTimeout.EventTimeTimeout if delay else GroupStateTimeout.NoTimeout
    return ok.groupBy("name").applyInPandasWithState(run, SLOTS, STATE, "append", timeout)


def write_archive(slots: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append finished slots to Parquet files partitioned by (step_ms, cf); missing slots are absent."""
    w = slots.where("v is not null").writeStream.format("parquet").partitionBy("step_ms", "cf").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).outputMode("append").start()


def _exists(spark, path: str) -> bool:
    """Whether the file system has the folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def merge_archive(new: DataFrame, path: str) -> None:
    """Merge slots into an archive of the same layout: a new value replaces the old one of its (name, cf,
    step_ms, t). For foreachBatch and batch jobs, not for a folder that write_archive() fills. Only the
    partitions that are touched are rewritten; the merged rows are written to the
    checkpoint folder first, since a table can't be overwritten while it is read."""
    spark = new.sparkSession
    if _exists(spark, path):
        old = spark.read.parquet(path)
        parts = new.select("step_ms", "cf").distinct()
        old = old.join(bounded_broadcast(parts), ["step_ms", "cf"], "left_semi").join(new, ["name", "cf", "step_ms", "t"], "left_anti")
        new = new.unionByName(old.select(*new.columns))
    cut(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step_ms", "cf").parquet(path)


def merge_stream(slots: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Merge slots, missing ones too, into an archive: what comes later replaces what is there."""
    w = slots.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: merge_archive(df, path))
    return (w.trigger(availableNow=True) if once else w).outputMode("append").start()


def progress_points(progress: dict, prefix: str = "stats") -> list[tuple[str, int, float]]:
    """(name, ms, value) rows of a streaming query's progress: rates, rows and durations."""
    ms = int(pd.Timestamp(progress["timestamp"]).timestamp() * 1000)
    out = [(f"{prefix}.{k}", ms, float(progress[k])) for k in ("numInputRows", "inputRowsPerSecond", "processedRowsPerSecond") if progress.get(k) is not None]
    return out + [(f"{prefix}.duration_ms.{k}", ms, float(v)) for k, v in (progress.get("durationMs") or {}).items()]


class ProgressPoints(StreamingQueryListener):
    """Hands the progress of every streaming query of the session to sink as points. Register it with
    spark.streams.addListener()."""

    def __init__(self, sink: Callable[[list[tuple[str, int, float]]], None], prefix: str = "stats"):
        self.sink, self.prefix = sink, prefix

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        self.sink(progress_points(p, f"{self.prefix}.{p.get('name') or p['id']}"))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def import_whisper(points: DataFrame, spec: SeriesSpec, path: str) -> None:
    """Write the archives of whisper_points() into the archive at path. Of a series that is there already only
    what is later than its newest slot is taken, so an import can be repeated, and go on with newer files."""
    spark = points.sparkSession
    last = None
    if _exists(spark, path):
        last = spark.read.parquet(path).groupBy("name").agg(F.max("t").alias("last_ms"))
    slots = replay_whisper(points, spec, last).where("v is not null")
    merge_archive(slots.select("name", "cf", "step_ms", "t", "v"), path)
