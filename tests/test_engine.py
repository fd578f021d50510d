"""Language, consolidation, sources and streams."""

from __future__ import annotations

import json
import pickle
import struct

import numpy as np
import pytest

from tidemark.dsl.engine import Engine
from tidemark.dsl.parser import DslError
from tidemark.frame import literal_series, merge, regroup
from tidemark.functions import register
from tidemark.operators import consolidate as con
from tidemark.operators import statsd
from tidemark.plans import render, spec
from tidemark.plans.spec import ArchiveSpec, SeriesSpec
from tidemark.plans.store import Archive, Store
from tidemark.sources import binary, text
from tidemark.streaming import pipeline

TO = 1_489_657_260_000
HOUR = 3_600_000


@pytest.fixture(scope="module")
def engine(spark):
    data = [(f"foo.bar{k}.baz", "WMEAN", 60_000, TO - i * 60_000, 10.0 * k) for k in (1, 2) for i in range(60)]
    half = [("half.x.y", "WMEAN", 60_000, TO - i * 60_000, 10.0 if i >= 30 else None) for i in range(60)]
    df = spark.createDataFrame(data + half, "name string, cf string, step_ms long, t long, v double")
    return Engine(spark, Store(df, [Archive(60_000, 60, TO // 60_000 * 60_000)]), TO - HOUR, TO, 0)


def values(f):
    return [r.v for r in f.df.orderBy("name", "t").collect()]


C = "group(constantLine(10), constantLine(20), constantLine(30))"


@pytest.mark.parametrize(
    ("text", "want"),
    [(f"diffSeries({C})", -40), ("diffSeries(constantLine(10), constantLine(20), constantLine(30))", -10), ("divideSeries(constantLine(10), constantLine(20))", 0.5),
     (f"sumSeries({C})", 60), (f"percentileOfSeries({C}, 50)", 20), (f"avg({C})", 20), (f"multiplySeries({C})", 6000), (f"countSeries({C})", 3),
     ("averageSeriesWithWildcards('foo.*.baz', 1)", 15), ("sumSeriesWithWildcards('foo.*.baz', 1)", 30), ("groupByNode('foo.*.baz', 0, 'sumSeries')", 30),
     ("hitcount(scale(foo.bar1.baz, 6), '1min')", 3600), ("summarize(scale(foo.bar1.baz, 6), '1min', 'sum')", 3600), ("sum(timeStack('foo.bar1.baz', '15min', 0, 3))", 40),
     ("weightedAverage(foo.bar1.baz, foo.bar2.baz, 0)", 10), ("rangeOfSeries(foo.*.baz)", 10)],
)
def test_pinned(engine, text, want):
    got = values(engine.query(text))
    assert got and got == pytest.approx([want] * len(got))


def test_more_pinned(spark, engine):
    e = Engine(spark, engine.store, TO - HOUR, TO, 100)
    assert set(values(e.query("consolidateBy(constantLine(10), 'sum')"))) == {360.0}
    assert set(values(e.query("changed(sinusoid())"))) == {1.0}
    assert values(e.query("nPercentile(sinusoid(), 50)"))[0] == pytest.approx(0, abs=1e-9)
    assert values(engine.query("integral(foo.bar1.baz)"))[:3] == [0, 10, 20]
    assert [r.alias for r in engine.query(f"asPercent({C})").df.select("alias").distinct().orderBy("alias").collect()] == [f"asPercent(constantLine({k}))" for k in (10, 20, 30)]
    assert values(engine.query("transformNull(half.x.y, 3)")).count(3.0) == 30
    assert sum(v is not None for v in values(engine.query("keepLastValue(half.x.y, 4)"))) == 34
    assert len(values(engine.query("movingAverage(foo.bar1.baz, 10)"))) == 50
    assert values(engine.query("exclude(foo.*.*, 'bar1')")) == [20.0] * 60


@pytest.mark.parametrize(
    ("text", "part"),
    [("nope(a)", "No such function"), ("scale(foo.bar1.baz)", "Missing argument"), ("scale(foo.bar1.baz, x)", "number"), ("scale(1, 2)", "series"), ("scale(foo.bar1.baz, 2, 3)", "at most"),
     ("scale(foo.bar1.baz, factor=2, factor=3)", "twice"), ("scale(foo.bar1.baz, other=2)", "no argument"), ("groupByNode(foo.*.baz, 0, 'diffSeries')", "groupByNode"), ("hitcount(foo.bar1.baz, '1d12h')", "hitcount")],
)
def test_errors(engine, text, part):
    with pytest.raises(DslError, match=part):
        engine.query(text)


def test_register(engine):
    register("twice", "s:series", lambda ctx, s: s.with_v(s.df["v"] * 2))
    assert set(values(engine.query("twice(foo.bar1.baz)"))) == {20.0}
    from tidemark.functions import FUNCTIONS

    del FUNCTIONS["twice"]


def test_frames(spark):
    a, b = literal_series(spark, "a", [1, 2, None, 4], 10, 10), literal_series(spark, "b", [5, 7], 20, 20)
    m = merge([a, b])
    assert sorted((r.name, r.t, r.v) for r in m.df.collect()) == [("a", 20, 1.5), ("a", 40, 4.0), ("b", 20, 5.0), ("b", 40, 7.0)]
    assert sorted((r.name, r.t, r.v) for r in regroup(a, 40).df.collect()) == [("a", 40, pytest.approx(7 / 3))]
    twice = merge([a, literal_series(spark, "a", [9], 10, 10)])
    assert [r.v for r in twice.df.collect()] == [9.0]
    assert [(r.t, r.v) for r in regroup(literal_series(spark, "c", [1, 2, 3, 4, 5], 10, 10), 20, complete=True).df.orderBy("t").collect()] == [(20, 1.5), (40, 3.5)]
    j = json.loads(render.render_json(a).first().json)
    assert j == {"target": "a", "datapoints": [[1.0, 0], [2.0, 0], [None, 0], [4.0, 0]]}


def test_max_points_add_a_step(engine):
    """60 points wanted of 60 slots: the width is one step more."""
    s = engine.store
    assert {r.step_ms for r in s.fetch("foo.bar1.baz", TO - HOUR, TO, 60).df.collect()} == {120_000}
    assert {r.step_ms for r in s.fetch("foo.bar1.baz", TO - HOUR, TO, 61).df.collect()} == {60_000}


def test_names_from_the_series_table(spark, engine):
    series = spark.createDataFrame([("foo.bar1.baz",), ("foo.new.baz",), ("foo.new.baz",), ("x.y.z",), (None,)], "name string")
    f = Store(engine.store.archive, engine.store.archives, series=series).fetch("foo.*.baz", TO - HOUR, TO)
    rows = f.df.groupBy("name").agg({"t": "count", "v": "count"}).collect()
    assert sorted((r.name, r["count(t)"], r["count(v)"]) for r in rows) == [("foo.bar1.baz", 60, 60), ("foo.new.baz", 60, 0)]


def test_points_of_unknown_series_are_dropped(spark):
    p = spark.createDataFrame([("a.x", 1, 1.0), ("b.x", 1, 1.0), ("c", 1, 1.0), (None, 1, 1.0)], "name string, ms long, value double")
    rules = [SeriesSpec(10_000, HOUR, (), r"^b"), SeriesSpec(10_000, HOUR, (), r"[.]x$")]
    assert sorted((r.name, r.rule_no) for r in spec.assigned(p, rules).collect()) == [("a.x", 1), ("b.x", 0)]
    assert spec.assigned(p, []).count() == 0


def test_render_request(spark, engine):
    rows, errors = render.render(spark, engine.store, ["foo.*.baz", "none.*", "scale(foo.bar1.baz)", "alias(foo.bar2.baz, 'say \\'b\\'')"], "-10min", "", 100, TO)
    body = json.loads(render.body(rows))
    assert [x.get("target") for x in body] == ["foo.bar1.baz", "foo.bar2.baz", None, None, "say 'b'"] and list(errors) == [2] and "Missing argument" in errors[2]
    assert [v for v, _ in body[1]["datapoints"]] == [20.0] * 10 and body[2] == {"datapoints": []}
    assert body[1]["datapoints"][-1][1] == TO // 60_000 * 60
    none, errors = render.render(spark, engine.store, ["nope(1)"], now_ms=TO)
    assert json.loads(render.body(none)) == [{"datapoints": []}] and len(errors) == 1


@pytest.mark.parametrize("n", [7, 9])
def test_warm_up_of_moving_windows(spark, n):
    """Under compat the ring of a window first overwrites its newest value."""
    p, data = 4, [float(x * x) for x in range(n)]
    ring, want, at = data[:p], [], p - 1
    for v in data[p:]:
        ring[at % p] = v
        at += 1
        want.append(sum(ring) / p)
    s = literal_series(spark, "s", data, 10, 10)
    e = Engine(spark, type("S", (), {"fetch": lambda *_: s})(), 0, n * 10, 0, compat=True)
    assert values(e.query("movingAverage(s, 4)")) == pytest.approx(want)


def test_holt_winters_names_and_errors(spark):
    season = [10.0, 20.0, 30.0, 20.0, 15.0, 12.0] * 4
    season[14] = 60.0
    s = literal_series(spark, "a.b", season, HOUR * 4, HOUR * 4)
    e = Engine(spark, type("S", (), {"fetch": lambda *_: s})(), 0, 26 * HOUR * 4, 0)
    r = e.query("holtWintersForecast(a.b, '1d', 7, 0.5, 0.2, 0.5, 3, 'smooth,conf,aberr')").df.collect()
    assert {(x.name, x.alias) for x in r} == {
        ("a.b", "holtWintersForecast(a.b)"), ("a.b.upper", "holtWintersConfidenceUpper(a.b)"), ("a.b.lower", "holtWintersConfidenceLower(a.b)"), ("a.b.aberrant", "holtWintersAberration(a.b)")
    }
    by = {(x.name, x.t // (HOUR * 4)): x.v for x in r}
    assert by[("a.b.upper", 20)] - by[("a.b", 20)] == pytest.approx(by[("a.b", 20)] - by[("a.b.lower", 20)]) and by[("a.b", 26)] is not None
    assert by[("a.b.aberrant", 26)] is None and by[("a.b.aberrant", 20)] == 0
    assert len(values(e.query("holtWintersAberration(a.b)"))) == 26 and len(values(e.query("holtWintersConfidenceBands(a.b)"))) == 52
    for bad in ("0.5, 0, 0", "1, 0.5, 0.5", "-1, 0, 0"):
        with pytest.raises(DslError):
            e.query(f"holtWintersForecast(a.b, '1d', 7, {bad})")
    assert e.query("holtWintersForecast(a.b, '2d', 7, 0.5, 0.2, 0.5)").df.count() == 26 and e.query("holtWintersForecast(a.b, '3d', 7)").df.count() == 0


def slots(df):
    return {(r.name, r.cf, r.step_ms, r.t): r.v for r in df.collect()}


def test_range_golden(spark):
    p = spark.createDataFrame([("s", 103_000, 1.0), ("s", 156_000, 100.0)], "name string, ms long, value double")
    sp = SeriesSpec(10_000, HOUR, tuple(ArchiveSpec("WMEAN", s * 1000, 10) for s in (10, 20, 50, 100)))
    got = {(r.step_ms // 1000, r.t // 1000): r.v for r in con.consolidate(p, sp).collect()}
    assert got == {**{(10, t): 100 for t in (110, 120, 130, 140, 150)}, (20, 120): 100, (20, 140): 100, (50, 150): 100}


def test_heartbeat0_golden(spark):
    pts = [("s", t * 1000, float(v)) for t, v in ((104, 100), (105, 120), (106, 120), (118, 90), (119, 80), (144, 100), (159, 100))]
    sp = SeriesSpec(10_000, 0, (ArchiveSpec("WMEAN", 20_000, 10),))
    got = {r.t // 1000: r.v for r in con.consolidate(spark.createDataFrame(pts, "name string, ms long, value double"), sp).collect()}
    assert {k: v for k, v in got.items() if v} == {120: 80, 160: 100}


def test_long_gaps_are_cut_to_what_is_kept(spark):
    """Five years of ten-second slots, of which 100 are kept: the gap is not taken apart before."""
    year = 31_536_000_000
    p = spark.createDataFrame([("s", 0, 1.0), ("s", 5 * year, 2.0), ("s", 5 * year + 5_000, 3.0), ("s", 5 * year + 20_000, 4.0)], "name string, ms long, value double")
    sp = SeriesSpec(10_000, 10 * year, (ArchiveSpec("WMEAN", 10_000, 100, 0.0), ArchiveSpec("LAST", 10_000, 3, 0.0), ArchiveSpec("MAX", 60_000, 5, 0.0)))
    got = slots(con.consolidate(p, sp))
    assert len(got) == 108 and got[("s", "WMEAN", 10_000, 5 * year)] == 2 and got[("s", "LAST", 10_000, 5 * year + 20_000)] == 4
    assert con._credits(con.updates(p, sp), sp).count() < 300


@pytest.mark.parametrize("gap", [3_000, 25_000, 90_000])
@pytest.mark.parametrize("xff", [0.0, 0.5])
def test_batch_equals_sequential(spark, gap, xff, monkeypatch):
    monkeypatch.setattr(con, "BLOCK_STEPS", 1)  # many blocks a series
    rng = np.random.default_rng(gap)
    sp = SeriesSpec(10_000, 120_000, tuple(ArchiveSpec(cf, r, 10**6, xff) for cf in ("WMEAN", "MIN", "MAX", "LAST") for r in (10_000, 60_000)))
    pts, want = [], {}
    for k in range(6):
        ms = np.cumsum(rng.exponential(gap, 60).astype(int) + 1) + 5
        v = rng.normal(10, 3, 60).round(2)
        pts += [(f"s{k}", int(m), float(x)) for m, x in zip(ms, v, strict=True)]
        c = pipeline.Consolidator(sp)
        for m, x in zip(ms, v, strict=True):
            want |= {(f"s{k}", *r[:3]): r[3] for r in c.point(int(m), float(x))}
    got = slots(con.consolidate(spark.createDataFrame(pts, "name string, ms long, value double"), sp))
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v)), k


def test_heartbeat0_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    sp = SeriesSpec(10_000, 0, tuple(ArchiveSpec(cf, r, 10**6, 0.5) for cf in ("WMEAN", "MIN", "MAX", "LAST") for r in (10_000, 30_000)))
    ms = np.cumsum(rng.choice([500, 2_000, 9_000, 45_000], 80)) + 5
    pts = [(f"s{i % 2}", int(t), float(v)) for i, (t, v) in enumerate(zip(ms, rng.normal(5, 1, 80).round(3), strict=True))]
    for k in range(4):
        spark.createDataFrame(pts[20 * k : 20 * k + 20], "name string, ms long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("name string, ms long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    pipeline.merge_stream(pipeline.consolidate_stream(s, sp), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.name, r.cf, r.step_ms, r.t): r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = slots(con.consolidate(spark.createDataFrame(pts, "name string, ms long, value double"), sp))
    assert got.keys() == want.keys() and all(got[k] == (None if v is None else pytest.approx(v)) for k, v in want.items())


def test_consolidate_edges(spark):
    sp = SeriesSpec(10_000, 60_000, (ArchiveSpec("WMEAN", 10_000, 3),))
    df = spark.createDataFrame([("a", 5, 1.0), (None, 5, 1.0), ("a", None, 1.0), ("a", 10, float("nan")), ("a", 11, float("inf")), ("a", 12, None)], "name string, ms long, value double")
    assert con.consolidate(df, sp).count() == 0 and con.consolidate(df.limit(0), sp).count() == 0
    many = spark.createDataFrame([("a", 10_000 * i, float(i)) for i in range(1, 9)], "name string, ms long, value double")
    assert {r.t: r.v for r in con.consolidate(many, sp).collect()} == {60_000: 6, 70_000: 7, 80_000: 8}


def test_streams_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    sp = SeriesSpec(10_000, 120_000, (ArchiveSpec("WMEAN", 60_000, 10**6, 0.0), ArchiveSpec("MAX", 20_000, 10**6, 0.0)))
    sec = np.cumsum(rng.integers(1, 40, 80)) + 100
    lines = [f"s.{i % 2} {v:.3f} {t}" for i, (t, v) in enumerate(zip(sec, rng.normal(5, 1, 80), strict=True))]
    (src / "a.txt").write_text("\n".join(lines[:40]) + "\nbroken line\n")

    def run():
        q = pipeline.write_archive(pipeline.consolidate_stream(pipeline.points_from_text(spark, str(src), 1), sp), str(out), str(tmp_path / "cp"))
        q.awaitTermination()

    run()
    (src / "b.txt").write_text("\n".join(lines[40:] + ["s.0 99 101"]))  # the last one is late
    run()
    got = {(r.name, r.cf, r.step_ms, r.t): r.v for r in spark.read.parquet(str(out)).collect()}
    batch = con.consolidate(text.graphite_lines(spark.createDataFrame([(x,) for x in lines], "value string")), sp)
    want = {k: v for k, v in slots(batch).items() if v is not None}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    new = spark.createDataFrame([(k[0], k[1], k[2], k[3], 77.0) for k in list(want)[:3]], "name string, cf string, step_ms bigint, t bigint, v double")
    merged = str(tmp_path / "merged")
    pipeline.merge_archive(spark.read.parquet(str(out)).select(*new.columns), merged)
    pipeline.merge_archive(new, merged)
    again = spark.read.parquet(merged)
    assert again.where("v = 77").count() == 3 and again.count() == len(want)


def test_counter_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([("add", "a", 2.0, "2025-01-01 00:00:01"), ("add", "a", 3.0, "2025-01-01 00:00:09"), ("add", "a", 1.0, "2025-01-01 00:00:41")], "cmd string, name string, value double, ts string").selectExpr("cmd", "name", "value", "cast(ts as timestamp) ts").coalesce(1).write.parquet(str(src / "x"))
    s = spark.readStream.schema("cmd string, name string, value double, ts timestamp").parquet(str(src / "x"))
    q = pipeline.counter_windows(s).writeStream.format("memory").queryName("counters").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.name, r.value) for r in spark.sql("select * from counters").collect()][:1] == [("a", 0.5)]


def test_statsd(spark):
    lines = ["a:1|c|@0.1", "a", "b:3|g", "b:+2|g", "b:-1|g", "t:5|ms", "bad:x|c", "bad:1|q", "bad:1|c|@2", "", "c:1e1|c", None]
    s = text.statsd_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r.name, r.value, r.metric, r.sample, r.delta) for r in s.collect()) == [
        ("a", 1, "c", 0.1, False), ("a", 1, "c", 1, False), ("b", -1, "g", 1, True), ("b", 2, "g", 1, True), ("b", 3, "g", 1, False), ("c", 10, "c", 1, False), ("t", 5, "ms", 1, False)
    ]
    c = [("addgauge", "g", 1.0, 1, 0), ("setgauge", "g", 10.0, 2, 1), ("addgauge", "g", 2.0, 2, 2), ("addgauge", "h", 4.0, 3, 3), ("add", "h", 9.0, 4, 4)]
    c += [("append", "t", float(i), 5, i) for i in range(1, 11)] + [("add", "n", 5.0, 9_999, 0), ("add", "n", 5.0, 10_000, 0), (None, "x", 1.0, 1, 0), ("add", None, 1.0, 1, 0), ("add", "x", float("nan"), 1, 0)]
    a = statsd.aggregate(spark.createDataFrame(c, "cmd string, name string, value double, ms long, id long"))
    got = {(r.name, r.ms): r.value for r in a.collect()}
    assert got[("g", 10_000)] == 12 and got[("h", 10_000)] == 13 and got[("n", 10_000)] == 0.5 and got[("n", 20_000)] == 0.5
    assert [got[(f"t.{k}", 10_000)] for k in ("count", "lower", "upper", "sum", "mean", "sum_90", "mean_90", "upper_90")] == [10, 1, 10, 55, 5.5, 45, 5, 9]
    assert not any(k[0] == "x" for k in got)


def random_commands(n, names):
    rng = np.random.default_rng(n)
    cmds = np.array(["add", "addgauge", "setgauge", "append"])
    return [(str(cmds[k]), f"n{i}", float(v), int(ms), j) for j, (k, i, v, ms) in enumerate(zip(rng.integers(0, 4, n), rng.integers(0, names, n), rng.normal(0, 50, n).round(2), rng.integers(0, 60_000, n), strict=True))]


@pytest.mark.parametrize("thresholds", [(90,), (5, 50), ()])
def test_statsd_equals_one_by_one(spark, thresholds):
    """Commands of all kinds under the same names, timers with ties and values of either sign."""
    c = random_commands(600, 5) + [("append", "ties", float(v), 70_000, 1_000 + i) for i, v in enumerate([3, 3, 3, 0, -2, -2, 1e-9, 5e9])]
    want = {}
    for key in {(name, ms // 10_000) for _, name, _, ms, _ in c}:
        one = [(ms, i, cmd, v) for cmd, name, v, ms, i in c if (name, ms // 10_000) == key]
        want |= {(key[0] + tag, key[1] * 10_000 + 10_000): v for tag, v in pipeline.flush_window(one, 10_000, thresholds)}
    got = {(r.name, r.ms): r.value for r in statsd.aggregate(spark.createDataFrame(c, "cmd string, name string, value double, ms long, id long"), 10_000, thresholds).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    compat = {(r.name, r.ms): r.value for r in statsd.aggregate(spark.createDataFrame(c, "cmd string, name string, value double, ms long, id long"), 10_000, (50,), compat=True).collect()}
    assert compat[("ties.sum", 80_000)] == 5e9 and compat[("ties.sum_50", 80_000)] == 1e-9 and compat[("ties.mean_50", 80_000)] == 1e-9 / 4


def test_statsd_stream_equals_batch(spark, tmp_path):
    """Over several triggers, with commands out of order within the delay and one that is too late."""
    c = random_commands(400, 4)
    schema = "cmd string, name string, value double, ms long, id long"
    src = tmp_path / "in"
    # file k holds the commands of 10 seconds, those of the last second of the file before among them
    parts = [[x for x in c if (x[3] + 1000 * (x[4] % 2)) // 10_000 == k] for k in range(7)]
    parts[4].append(("add", "late", 1.0, 5, 9_999))
    parts.append([("add", "end", 1.0, 200_000, 10_000)])
    for k, p in enumerate(parts):
        spark.createDataFrame(p, schema).selectExpr("cmd", "name", "value", "timestamp_millis(ms) as ts", "id").coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema("cmd string, name string, value double, ts timestamp, id long").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = pipeline.statsd_windows(s, 10_000, "1 seconds").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.name, r.ms): r.value for r in spark.sql("select * from windows").collect()}
    want = {(r.name, r.ms): r.value for r in statsd.aggregate(spark.createDataFrame(c, schema), 10_000).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_graphite_and_pixel(spark):
    g = text.graphite_lines(spark.createDataFrame([("a b 1",), ("x/y  2.5   100",), ("n 1 -1",), ("short 1",), ("n nan 5",), (None,)], "value string"), now_ms=7)
    assert sorted((r.name, r.ms, r.value) for r in g.collect()) == [("n", 7, 1.0), ("x-y", 100_000, 2.5)]
    p = text.pixel_requests(spark.createDataFrame([("/pixel?a%20b=1.5@2&c=3",), ("/pixel/add?z=x",), ("/other?a=1",), ("/pixel/append?t=4",), ("/pixel",)], "value string"), now_ms=9)
    assert sorted((r.cmd, r.name, r.value, r.ms) for r in p.collect()) == [("append", "t", 4.0, 9), ("point", "a_b", 1.5, 2000), ("point", "c", 3.0, 9)]


def test_whisper(spark, tmp_path):
    def file(archives):
        head, body, off = struct.pack(">IIfI", 1, 100, 0.5, len(archives)), b"", 16 + 12 * len(archives)
        for step, pts in archives:
            head += struct.pack(">III", off + len(body), step, len(pts))
            body += b"".join(struct.pack(">Id", t, v) for t, v in pts)
        return head + body

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "c.wsp").write_bytes(file([(10, [(120, 2.0), (110, 1.0), (0, 0.0)]), (60, [(60, 7.0), (120, 8.0)])]))
    (tmp_path / "bad.wsp").write_bytes(b"\0\1\2")
    w = binary.read_whisper(spark, str(tmp_path), "p")
    assert w.count() == 4
    assert sorted((r.name, r.ms, r.value) for r in binary.merge_whisper(w).collect()) == [("p.a.b.c", 120_000, 1.0), ("p.a.b.c", 120_000, 7.0), ("p.a.b.c", 130_000, 2.0)]
    assert binary.fresh_whisper(w, 200_000 + 86_400_000, 1).count() == 0 and binary.fresh_whisper(w, 121_000, 1).count() == 4
    assert binary.whisper_spec((tmp_path / "a" / "b" / "c.wsp").read_bytes()).step_ms == 10_000


def test_pickle(spark):
    frame = lambda x: struct.pack(">I", len(pickle.dumps(x, 2))) + pickle.dumps(x, 2)
    ok, evil = frame([("a", (1, 2.5)), ("b", (2, 3))]), frame(np.float64(3))
    df = spark.createDataFrame([(bytearray(ok + ok[:7]),), (bytearray(evil),), (None,)], "content binary")
    assert sorted(map(tuple, binary.read_pickles(df).collect())) == [("a", 1000, 2.5), ("b", 2000, 3.0)]


def test_merge_keeps_old_slots_of_all_touched_partitions(spark, tmp_path, monkeypatch):
    """No limit on the touched partitions: one of a single row, in place of 10,000, loses nothing."""
    at = str(tmp_path / "archive")
    old = spark.createDataFrame([("a", c, s, 0, 1.0) for c in ("AVG", "MAX") for s in (10, 60)], "name string, cf string, step_ms long, t long, v double")
    pipeline.merge_archive(old, at)
    limit = type(old).limit
    monkeypatch.setattr(type(old), "limit", lambda df, n: limit(df, 1))
    pipeline.merge_archive(old.selectExpr("name", "cf", "step_ms", "5L as t", "v"), at)
    assert spark.read.parquet(at).count() == 8


def test_points_wait_for_earlier_ones(spark, tmp_path):
    """Over triggers: a point that comes a trigger late, within the delay, is sorted in."""
    src, sp = tmp_path / "in", SeriesSpec(10_000, 120_000, (ArchiveSpec("WMEAN", 20_000, 10**6, 0.0), ArchiveSpec("LAST", 10_000, 10**6, 0.0)))
    rng = np.random.default_rng(4)
    ms = np.cumsum(rng.integers(1_000, 9_000, 60)) + 7
    pts = [(f"s{i % 2}", int(t), float(v)) for i, (t, v) in enumerate(zip(ms, rng.normal(5, 1, 60).round(3), strict=True))]
    order = sorted(range(60), key=lambda i: (i // 10) * 10 + (12 if i % 10 == 7 else i % 10))  # some come with the next ten
    for k in range(6):
        spark.createDataFrame([pts[i] for i in order[10 * k : 10 * k + 10]], "name string, ms long, value double").coalesce(1).write.mode("append").parquet(str(src))
    end = [("s0", int(ms[-1]) + 10**6, 0.0), ("s1", int(ms[-1]) + 10**6, 0.0)]
    spark.createDataFrame(end, "name string, ms long, value double").coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema("name string, ms long, value double").option("maxFilesPerTrigger", 1).parquet(str(src))
    pipeline.write_archive(pipeline.consolidate_stream(s, sp, "60 seconds"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.name, r.cf, r.step_ms, r.t): r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {k: v for k, v in slots(con.consolidate(spark.createDataFrame(pts, "name string, ms long, value double"), sp)).items() if v is not None}
    assert {k: v for k, v in got.items() if k[3] <= ms[-2] - 20_000} == {k: pytest.approx(v) for k, v in want.items() if k[3] <= ms[-2] - 20_000}
    assert len(want) > 40


def test_udp_lines_and_progress(spark, tmp_path):
    import socket
    import time

    from tidemark.sources.network import _Udp

    free = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    free.bind(("127.0.0.1", 0))
    port = free.getsockname()[1]
    free.close()
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    r = _Udp("127.0.0.1", port, 100)
    assert list(r.read({"line": 0})[0]) == []
    out.sendto(b"a 1 100\nb 2 200\n", ("127.0.0.1", port))
    time.sleep(0.2)
    rows, end = r.read({"line": 0})
    assert list(rows) == [("a 1 100", 0), ("b 2 200", 1)] and end == {"line": 2}
    assert list(r.readBetweenOffsets({"line": 1}, end)) == [("b 2 200", 1)]
    r.commit({"line": 1})
    assert list(r.read({"line": 1})[0]) == [("b 2 200", 1)]
    r.commit(end)
    assert list(r.read(end)[0]) == []
    r.sock.close()

    seen: list = []
    listener = pipeline.ProgressPoints(seen.extend, "stats")
    spark.streams.addListener(listener)
    q = pipeline.points_from_udp(spark, port).writeStream.format("memory").queryName("udp").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(150):
            out.sendto(b"x.y 1.5 100\nbroken\n", ("127.0.0.1", port))
            time.sleep(0.2)
            if spark.sql("select * from udp").count() and any(n == "stats.udp.numInputRows" and v > 0 for n, _, v in seen):
                break
    finally:
        q.stop()
        spark.streams.removeListener(listener)
    assert {tuple(r) for r in spark.sql("select name, ms, value from udp").collect()} == {("x.y", 100_000, 1.5)}
    assert any(n == "stats.udp.numInputRows" and v > 0 for n, _, v in seen)


def test_tcp_lines_and_frames(spark, tmp_path):
    import socket
    import time

    from tidemark.sources.network import MAX_FRAME, _TcpFrames, _TcpLines

    def port():
        with socket.socket() as s:
            s.bind(("127.0.0.1", 0))
            return s.getsockname()[1]

    def sent(reader, *parts):
        """What the reader has after each part of one connection, and after its end."""
        got, list_ = [], lambda: [x for x, _ in reader.read({"line": 0})[0]]
        list_()
        with socket.create_connection(reader.at) as c:
            for p in parts:
                c.sendall(p)
                time.sleep(0.1)
                got.append(list_())
        time.sleep(0.1)
        return [*got, list_()]

    lines = _TcpLines("127.0.0.1", port())
    assert sent(lines, b"a 1 1\r\nb 2", b" 2\nc 3 3") == [["a 1 1"], ["a 1 1", "b 2 2"], ["a 1 1", "b 2 2", "c 3 3"]]
    lines.sock.close()
    frame = lambda x: struct.pack(">I", len(x)) + x
    frames = _TcpFrames("127.0.0.1", port())
    assert sent(frames, frame(b"one")[:5], frame(b"one")[5:] + frame(b""), struct.pack(">I", MAX_FRAME + 1)) == [[], [frame(b"one"), frame(b"")], [frame(b"one"), frame(b"")], [frame(b"one"), frame(b"")]]
    frames.sock.close()

    p = port()
    q = pipeline.points_from_pickles(spark, p).writeStream.format("memory").queryName("pickles").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(150):
            try:
                with socket.create_connection(("127.0.0.1", p), 1) as c:
                    c.sendall(frame(pickle.dumps([("a.b", (7, 1.5))], 2)))
            except OSError:
                pass
            time.sleep(0.2)
            if spark.sql("select * from pickles").count():
                break
    finally:
        q.stop()
    assert {tuple(r) for r in spark.sql("select * from pickles").collect()} == {("a.b", 7_000, 1.5)}


def test_commands_from_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a:3|c|@0.5\nb:-2|g\nbad:x|c\n")
    c = pipeline.commands_from_lines(spark.readStream.format("text").load(str(tmp_path)))
    q = c.writeStream.format("memory").queryName("commands").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.sql("select * from commands").collect()
    assert sorted((x.cmd, x.name, x.value) for x in r) == [("add", "a", 6.0), ("addgauge", "b", -2.0)] and all(x.ts for x in r)
    n = pipeline.commands_from_lines(spark.createDataFrame([("g:1|g", 7), ("g:2|g", 8)], "value string, line long"))
    assert sorted((x.value, x.id) for x in n.collect()) == [(1.0, 7), (2.0, 8)]


def test_whisper_import_goes_on(spark, tmp_path):
    sp = SeriesSpec(10_000, 120_000, (ArchiveSpec("WMEAN", 10_000, 1_000, 0.0),))
    at = str(tmp_path / "archive")
    points = lambda n: spark.createDataFrame([("a", 0, 10_000, 100_000 + 10_000 * i, float(i)) for i in range(n)], "name string, archive int, step_ms long, ms long, value double")
    for n in (5, 5, 9):
        pipeline.import_whisper(points(n), sp, at)
    got = {r.t: r.v for r in spark.read.parquet(at).collect()}
    want = {r.t: r.v for r in binary.replay_whisper(points(9), sp).where("v is not null").collect()}
    # the first point of what is new opens the series again: the slot that it ends is not known
    assert {t: v for t, v in want.items() if t != 160_000} == {t: v for t, v in got.items() if t != 160_000} and len(got) >= 7


def test_checkpoint_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tidemark import session

    conf = SimpleNamespace(get=lambda *_: None)
    monkeypatch.delenv("TIDEMARK_CHECKPOINT_DIR", raising=False)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert session.checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "hdfs://x/y"), sparkContext=None)) == "hdfs://x/y"
    here = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]"))
    assert session.checkpoint_dir(here) == session.checkpoint_dir(here)
