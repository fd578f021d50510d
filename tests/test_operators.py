"""Core data operators against brute force and in their edge cases."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import grid, orphans, qdigest, rolling, spikes
from tidemark.queries import data

T = lambda s: pd.Timestamp(s, tz="UTC").to_pydatetime()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_orphans(spark):
    p = spark.createDataFrame([(1, T("2025-01-01"), "x"), (1, T("2025-01-01"), "x"), (2, T("2025-03-01"), "x"), (None, None, "x")], "id long, at timestamp, key string")
    c = spark.createDataFrame(
        [(10, 1, T("2025-02-01")), (10, 1, T("2025-02-01")), (11, 2, T("2025-02-01")), (12, 2, T("2025-04-01")), (13, 3, T("2025-02-01")), (13, 3, T("2025-02-01")), (14, None, T("2025-02-01")), (15, 3, None), (16, 2, None)],
        "id long, parent_table long, child_at timestamp",
    )
    parents, children = [orphans.Parent("p", p, "id", "at")], [orphans.Child("c", c, "id", "parent_table", "p", "child_at")]
    r = orphans.orphan_rows(parents, children)
    assert sorted((x.child_id, x.reason) for x in r.collect()) == [(11, "later"), (13, "absent"), (15, "absent")]
    rep = {(x.reason, x.period): x.n_orphans for x in orphans.orphan_report(r).collect()}
    assert rep == {("later", "2025-02-01"): 1, ("absent", "2025-02-01"): 1, ("absent", None): 1}
    assert orphans.orphan_rows(parents, [orphans.Child("c", c.limit(0), "id", "parent_table", "p", "child_at")]).count() == 0
    none = orphans.orphan_rows([orphans.Parent("p", p.limit(0), "id")], children)
    assert none.count() == 6  # 10, 11, 12, 13, 15, 16: the distinct rows with a key


def brute_grid(points, step, hb):
    out = {}
    for k, ps in points.items():
        ps = sorted(ps)
        slot = lambda m: ((m - 1) // step + 1) * step
        have = {slot(m) for m, _ in ps}
        miss = set()
        for (a, _), (b, _) in zip(ps, ps[1:], strict=False):
            if b - a > hb:
                miss |= set(range(slot(a) + step, slot(b), step))
        for s in range(min(have), max(have) + 1, step):
            out[(k, s)] = (s in miss, sum(1 for m, _ in ps if slot(m) == s))
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_grid(spark, block):
    rng = np.random.default_rng(1)
    pts = {k: [(int(m), float(v)) for m, v in zip(np.cumsum(rng.exponential(900 * (k + 1), 60)) + 1, rng.normal(size=60), strict=True)] for k in range(4)}
    data = [(k, 1000, 2500, m, v) for k, ps in pts.items() for m, v in ps]
    df = spark.createDataFrame(data + data[:3] + [(None, 1000, 2500, 5, 1.0), (9, None, 2500, 5, 1.0)], "key long, step_ms long, heartbeat_ms long, ms long, value double")
    got = {(r.key, r.slot_ms): (r.missing, r.n) for r in grid.regular_grid(df, block_slots=block).collect()}
    want = brute_grid({k: v for k, v in pts.items()}, 1000, 2500)
    assert got.keys() == want.keys()
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert sum(v[1] for v in got.values()) == len(data) + 3
    g = {(r.key, r.slot_ms): r for r in grid.regular_grid(df, block_slots=block).collect()}
    for (k, s), r in g.items():
        if r.n == 0 and not r.missing:
            back = max(x for (kk, x), y in g.items() if kk == k and x < s and y.n)
            last = max(m for m, _ in pts[k] if m <= back)
            assert r.filled == (pytest.approx(g[(k, back)].value) if s - last <= 2500 else None)
    assert grid.regular_grid(df.limit(0)).count() == 0


def test_usable_readings(spark):
    d = spark.createDataFrame(
        [("a", T("2025-01-01"), 1.0, T("2025-01-02")), ("a", T("2025-01-01"), float("nan"), T("2025-01-02")), ("a", None, 1.0, T("2025-01-02")), ("a", T("2025-01-01"), 1.0, T("2025-02-02")), (None, T("2025-01-01"), 1.0, T("2025-01-01")), ("a", T("2025-01-01"), float("inf"), None)],
        "key string, ts timestamp, ms double, received_at timestamp",
    )
    assert grid.usable_readings(d, "key", "ts", "ms", "received_at").count() == 1
    assert grid.usable_readings(d, "key", "ts", "ms").count() == 2


def test_rolling(spark):
    rng = np.random.default_rng(2)
    data = [(int(e), T("2025-01-01") + dt.timedelta(hours=int(h)), float(v)) for e in range(3) for h, v in zip(rng.integers(0, 24 * 60, 40), rng.normal(size=40), strict=True)]
    extra = [(0, T("2025-01-05"), float("nan")), (None, T("2025-01-05"), 1.0), (1, None, 1.0), (2, T("2026-01-01"), None), data[0]]
    df = spark.createDataFrame(data + extra, "day long, n timestamp, total double")
    got = {(r.entity, r.day): r for r in rolling.rolling_totals(df, "day", "n", "total").collect()}
    days: dict = {}
    for e, t, v in set(data):
        d = (t - dt.timedelta(milliseconds=1)).date()
        days.setdefault(e, {}).setdefault(d, []).append(v)
    n = 0
    for e, by in days.items():
        d = min(by)
        while d <= max(by):
            n += 1
            for w in (7, 30):
                vals = [v for k in range(w) for v in by.get(d - dt.timedelta(days=k), [])]
                r = got[(e, d)]
                assert r[f"n_{w}"] == len(vals) and r[f"sum_{w}"] == pytest.approx(sum(vals))
                assert r[f"mean_{w}"] == (pytest.approx(np.mean(vals)) if vals else None)
            d += dt.timedelta(days=1)
    assert n == len(got)
    assert rolling.rolling_totals(df.limit(0), "day", "n", "total").count() == 0


def test_percentiles(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.lognormal(2, 2, 20_000), [np.nan, np.inf]])
    pdf = pd.DataFrame({"name": np.where(np.arange(len(v)) % 3 == 0, "a", "b"), "day": np.arange(len(v)) % 5, "n": v})
    df = spark.createDataFrame(pdf).repartition(5).unionByName(spark.createDataFrame([("c", 1, None), (None, 1, 2.0), (None, 1, 4.0)], "name string, day long, n double"))
    eps = 0.01
    whole = qdigest.percentiles(qdigest.partial_digest(df, ["name"], "n", eps), ["name"], [0.5, 0.99], eps)
    days = qdigest.percentiles(qdigest.digest(df, ["name", "day"], "n", eps, fan_in=2), ["name"], [0.5, 0.99], eps, fan_in=2)
    for got in (whole, days):
        got = {(r["name"], r.quantile): r for r in got.collect()}
        assert {k[0] for k in got} == {"a", "b", None}
        for k in "ab":
            s = np.sort(v[(pdf.name == k) & np.isfinite(v)])
            for q in (0.5, 0.99):
                r = got[(k, q)]
                assert r.n == len(s) and r.rank_error <= eps * len(s)
                rank = np.ceil(q * len(s))
                cell = abs(r.value) * 2**-20
                assert np.searchsorted(s, r.value - cell) - r.rank_error <= rank <= np.searchsorted(s, r.value + cell, "right") + r.rank_error
        assert got[(None, 0.5)].value == pytest.approx(2, rel=2e-6)
    assert qdigest.percentiles(qdigest.digest(df.limit(0), ["name"], "n"), ["name"], [0.5]).count() == 0


def test_digests_of_many_tasks(spark, monkeypatch):
    """Rounds go by the tasks that made the digests, and no call holds more than some blocks of rows."""
    rng = np.random.default_rng(8)
    n = 60_000
    v = rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"group": np.where(np.arange(n) % 3, "hot", "warm"), "v": v})).repartition(40)
    d = qdigest.partial_digest(df, ["group"], "v", 0.05)
    assert d.groupBy("group", "part").count().groupBy("group").count().where("count >= 40").count() == 2
    for fan_in in (3, 64):
        for r in qdigest.percentiles(d, ["group"], [0.1, 0.5, 0.99], 0.05, fan_in).collect():
            s = np.sort(v[(np.arange(n) % 3 > 0) == (r["group"] == "hot")])
            rank = np.ceil(r.quantile * len(s))
            assert r.n == len(s) and np.searchsorted(s, r.value - 1e-5) - r.rank_error <= rank <= np.searchsorted(s, r.value + 1e-5, "right") + r.rank_error
    with pytest.raises(ValueError):
        qdigest.partial_digest(df.withColumnRenamed("group", "n"), ["n"], "v")


def test_tasks_of_a_scan_are_counted(spark, tmp_path):
    spark.range(1000).selectExpr("'a' as g", "cast(id as double) as v").repartition(6).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(2**40))
    try:
        t = spark.read.parquet(str(tmp_path / "t"))
        d = qdigest.partial_digest(t, ["g"], "v", 0.5)
        assert qdigest._partitions(d) == d.select("part").distinct().count() == 6
        assert qdigest._partitions(t.unionByName(t).distinct()) > 0
        assert [r.n for r in qdigest.percentiles(d, ["g"], [0.5], 0.5, fan_in=2).collect()] == [1000]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_merging_holds_few_digests(monkeypatch):
    """500 digests of one group reach one task: it works them off in blocks."""
    monkeypatch.setattr(qdigest, "BLOCK_ROWS", 8_000)
    rng, sizes = np.random.default_rng(1), []
    inner = qdigest.compress
    monkeypatch.setattr(qdigest, "compress", lambda g, *a: sizes.append(len(g)) or inner(g, *a))

    def batches():
        for _ in range(500):
            code = qdigest.encode(rng.normal(size=2_000)) + (1 << 32)
            _, node, count = inner(np.zeros(len(code), np.int64), code, np.ones(len(code), np.int64), 0.05)
            yield pa.RecordBatch.from_arrays([pa.array(["k"] * len(node)), pa.array(node), pa.array(count), pa.array(np.full(len(node), 5))], names=["k", "node", "n", "group"])

    out = pa.Table.from_batches(list(qdigest._merger(["k"], 0.05)(batches())))
    assert sum(out["n"].to_pylist()) == 1_000_000 and len(sizes) > 50 and max(sizes) < 8_000


def test_implausible(spark):
    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame({"source_table": "t", "source": "s", "row_id": np.arange(n), "ms": np.arange(n) * 60_000, "value": 50 + rng.normal(0, 1, n), "log": False})
    pdf.loc[[100, 250], "value"] = [90.0, 10.0]
    pdf.loc[300:315, "value"] = 50.5
    df = spark.createDataFrame(pdf)
    df = df.unionByName(df.where("row_id in (100, 101)"))
    odd = df.unionByName(spark.createDataFrame([("t", None, 900, 5, 1.0, False), ("t", "s", 901, None, 1.0, False), ("t", "s", 902, 7, float("nan"), False)], df.schema))
    want = {(100, "additive"), (250, "additive")} | {(i, "stuck") for i in range(300, 316)}
    assert {(r.row_id, r.reason) for r in spikes.implausible(odd).collect()} == want
    # the same when the source is cut into chunks of time
    assert {(r.row_id, r.reason) for r in spikes.implausible(odd, chunk_rows=150).collect()} == want
    assert spikes.implausible(df.limit(0)).count() == 0
    lim = spark.createDataFrame([("x", 0.0, None), ("y", None, float("nan"))], "suffix string, min_possible double, max_possible double")
    bad = spikes.outside_limits(df.withColumn("suffix", F.lit("x")).withColumn("value", F.when(F.col("row_id") == 3, -1.0).otherwise(F.col("value"))), lim)
    assert {r.row_id for r in bad.collect()} == {3}


def test_implausible_chunks_judge_as_the_source(spark):
    """What is usual is the source's, not that of a chunk of it."""
    rng = np.random.default_rng(9)
    n = 3650
    ms = np.arange(n) * 600_000
    noise = np.where(np.arange(n) < 3000, 1.0, 0.05)
    v = 50 + rng.normal(0, 1, n) * noise
    v[400:1100] = 51.25  # 19 % of the source, but most of a chunk of 1,000 readings
    v[3200] += 2  # far from usual in the quiet part only
    v[[1500, 1501, 2700, 3640]] += [30, 30, -40, 25]
    step = np.where(np.arange(n) % 3 == 0, 1, 5) * 100_000 + np.arange(n) * 600_000
    state = np.where(np.arange(n) // 400 % 3 == 1, 7.0, 20 + 5 * np.sin(2 * np.pi * step / 86_400_000) + rng.normal(0, 0.2, n))
    log = np.exp(rng.normal(3, 0.3, n))
    log[[10, 2000, 3649]] *= 1e4
    log[100] = 0.0
    parts = [("s", ms, v, False), ("state", step, state, False), ("log", ms, log, True)]
    pdf = pd.concat([pd.DataFrame({"source_table": "t", "source": s, "row_id": np.arange(n) + 10_000 * i, "ms": t, "value": x, "log": b}) for i, (s, t, x, b) in enumerate(parts)])
    df = spark.createDataFrame(pdf)
    df = df.unionByName(df.where("row_id in (1499, 1500, 2000)"))
    whole = {(r.row_id, r.reason) for r in spikes.implausible(df).collect()}
    assert {(i, "stuck") for i in range(400, 1100)} | {(i, "additive") for i in (1500, 1501, 2700, 3640)} == {x for x in whole if x[0] < 10_000}
    assert {x[0] for x in whole if x[0] >= 20_000} == {20_010, 20_100, 22_000, 23_649}
    got = spikes.implausible(df, chunk_rows=1000).collect()
    assert len(got) == len(whole) and {(r.row_id, r.reason) for r in got} == whole


def test_grid_counts_readings_delivered_again_once(spark):
    rows = [("a", 10, 100, 1, 1.0), ("a", 10, 100, 2, 3.0), ("a", 10, 100, 2, 3.0), ("a", 10, 100, 2, 3.0), ("a", 10, 100, 3, 3.0)]
    df = spark.createDataFrame(rows, "key string, step_ms long, heartbeat_ms long, ms long, value double")
    assert [(r.n, r.value) for r in grid.regular_grid(df).collect()] == [(5, pytest.approx(7 / 3))]


def test_rolling_keeps_small_sums_beside_large_ones(spark):
    rows = [(k, 7, T(f"2025-01-{d:02d}"), v) for k, d, v in [(1, 2, 1e19), (2, 2, 0.1), (3, 3, -1e19), (4, 3, 0.2), (4, 3, 0.2), (5, 9, 5.0)]]
    df = spark.createDataFrame(rows, "id long, e long, t timestamp, v double")
    got = {r.day.day: r for r in rolling.rolling_totals(df, "e", "t", "v", (7,), end_inclusive=False, dedupe=["id"]).collect()}
    assert got[3].sum_7 == pytest.approx(0.3) and got[3].n_7 == 4 and got[9].sum_7 == pytest.approx(-1e19) and got[2].total == 1e19 and len(got) == 8
    assert got[3].n == 2 and rolling.daily(df, "e", "t", "v", dedupe=False).where("n = 3").count() == 1


def test_percentiles_of_all_stats(spark, tmp_path):
    """Every name of stats has percentiles, a name with delta rows only and the null name included."""
    rows = [(1, "a", 1.0, False), (1, "a", 1.0, False), (2, "a", 9.0, None), (3, "a", -50.0, True), (4, "only", 3.0, True), (5, None, 7.0, False), (6, "a", float("nan"), False)]
    s = spark.createDataFrame(rows, "stat_id long, name string, value double, delta boolean")
    s.withColumn("ts", F.timestamp_millis(F.col("stat_id") * 80_000_000)).write.parquet(str(tmp_path / "stats.parquet"))
    for q in (data.p3_percentiles, data.p3_from_days):
        got = {(r["name"], r.delta): r.n for r in q(spark, str(tmp_path)).where("quantile = 0.5").collect()}
        assert got == {("a", False): 2, ("a", True): 1, ("only", True): 1, (None, False): 1}


def test_days_without_readings_go_through_the_rolling_totals(spark):
    q = data.p4_found(spark, "/root/testdata/sf0.001")
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    # both windows of the counts and of both parts of the sums
    assert all(len(re.findall(rf"sum\({c}#\d+L?\) windowspecdefinition", plan)) == 2 for c in ("n", "small", "large"))
    days = data.p4_rolling(spark, "/root/testdata/sf0.001").select("ds_id", "calendar_day")
    assert q.count() > 0 and q.exceptAll(days).count() == 0


def test_limits_of_many_suffixes(spark):
    lim = spark.range(10_050).select(F.col("id").cast("string").alias("suffix"), F.lit(0.0).alias("min_possible"), F.lit(None).cast("double").alias("max_possible"))
    bad = spark.range(10_050).select(F.lit("t").alias("source_table"), F.col("id").cast("string").alias("suffix"), F.col("id").alias("row_id"), F.lit(-1.0).alias("value"))
    assert spikes.outside_limits(bad, lim).count() == 10_050
