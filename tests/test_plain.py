"""Plan-time helpers, parser and specifications: no session needed."""

from __future__ import annotations

import re

import numpy as np
import pytest

from tidemark import names
from tidemark.dsl.parser import Call, DslError, Literal, Selector, parse
from tidemark.durations import parse_duration, parse_shift, parse_time, window_points
from tidemark.functions import FUNCTIONS
from tidemark.functions.forecast import Batch, initial_seasonal, initial_trend, prepared
from tidemark.operators import qdigest, spikes
from tidemark.plans.spec import DEFAULT, parse_archive, read_rules
from tidemark.plans.store import Archive, best_archive


@pytest.mark.parametrize(
    ("text", "ms"),
    [("10s", 10_000), ("1h30m", 5_400_000), ("7d", 604_800_000), ("2weeks", 1_209_600_000), ("1mon", 2_592_000_000), ("1y", 31_536_000_000), ("-5min", -300_000), ("0", 0), ("250ms", 250)],
)
def test_durations(text, ms):
    assert parse_duration(text) == ms


@pytest.mark.parametrize("text", ["1d12h", "3days", "7", "", "h", "1.5.2h"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        parse_duration(text)


def test_times_and_windows():
    assert parse_shift("") == 0 and parse_shift("-1h") == -3_600_000
    assert parse_time("now", 5) == 5 and parse_time("-1s", 5000) == 4000 and parse_time("17") == 17_000
    assert window_points("5", 60_000) == 5
    assert window_points("5min", 60_000) == 5 and window_points("5min", 60_000, median=True) == 6
    assert window_points("90s", 60_000) == 2 == window_points("90s", 60_000, median=True)


def test_names():
    assert names.clean_name_py("a b\t\tc/d!é.x-1") == "a_b_c-d.x-1"
    assert names.expand_braces("a.{b,c}.{d,e}") == ["a.b.d", "a.b.e", "a.c.d", "a.c.e"]
    import re

    rx = re.compile(names.glob_regex("a.*.[b-c]?.{x,y}"))
    assert rx.match("a.foo.b1.x") and not rx.match("a.foo.bar.b1.x") and not rx.match("a.foo.d1.y") and not rx.match("a.foo.b1")


def test_parser():
    n = parse("group(a.*.c, 'x y').scale(2).alias(newName=\"z\")")
    assert isinstance(n, Call) and n.name == "alias" and n.kwargs[0][1].value == "z"
    assert n.args[0].name == "scale" and n.args[0].args[0].args == (Selector("a.*.c"), Literal("x y", "'x y'"))
    assert parse("a.{b,c}.d-1") == Selector("a.{b,c}.d-1")
    assert parse("f(-1.5e3, true, None)").args[2].value is None
    for bad in ("f(", "f(a", "f(a=1, 2)", "f(a))", "'abc", "f(,)", ")", ""):
        with pytest.raises(DslError):
            parse(bad)


def test_registry_is_complete():
    assert len(FUNCTIONS) == 69


def test_specs():
    a = parse_archive("MAX:1m:1h30s")
    assert (a.cf, a.step_ms, a.size, a.xff) == ("MAX", 60_000, 60, 0.5)
    assert parse_archive("10s:6h:1").xff == 1
    for bad in ("max:10s", "foo:10s:1h", "10s", "10s:5s", "10s:1h:2", "7s:1h"):
        with pytest.raises(ValueError):
            parse_archive(bad, 2_000)
    assert [x.size for x in DEFAULT.archives] == [2160, 1440, 13392, 1825]


@pytest.mark.parametrize(
    ("asked", "step"),
    [((9_500_000, 9_600_000, 10), 10_000), ((9_500_000, 9_600_000, 3), 20_000), ((9_500_000, 9_600_000, 0), 10_000), ((8_500_000, 8_600_000, 10), 20_000),
     ((5_500_000, 5_600_000, 10), 20_000), ((10_100_000, 10_200_000, 0), 10_000), ((10_100_000, 10_200_000, 3), 20_000)],
)
def test_best_archive(asked, step):
    assert best_archive([Archive(10_000, 100, 10_000_000), Archive(20_000, 100, 10_000_000)], *asked).step_ms == step


def test_rules_file(tmp_path):
    f = tmp_path / "rules.toml"
    f.write_text('min-step = "10s"\nworkers = 4\n[[ds]]\nregexp = "^a[.]"\nstep = "1m"\nheartbeat = "2h"\nrras = ["1m:6h", "MAX:10m:93d:1"]\n[[ds]]\nregexp = ".*"\nstep = "10s"\nheartbeat = "0"\nrras = []\n')
    a, b = read_rules(str(f))
    assert (a.pattern, a.step_ms, a.heartbeat_ms, [(x.cf, x.step_ms, x.size, x.xff) for x in a.archives]) == ("^a[.]", 60_000, 7_200_000, [("WMEAN", 60_000, 360, 0.5), ("MAX", 600_000, 13_392, 1.0)])
    assert b.step_ms == 10_000 and b.archives == ()
    for bad in ('[[ds]]\nstep = "1m"', f.read_text().replace('"1m"', '"1s"', 1), f.read_text().replace("^a[.]", "(")):
        f.write_text(bad)
        with pytest.raises((ValueError, re.error)):
            read_rules(str(f))


def holt_winters(y, season, ahead, a, b, g):
    """One series, step by step."""
    s, d = list(initial_seasonal(y, season)), [0.0] * season
    level, trend, out, dev, sse = y[0], initial_trend(y, season), [y[0]], [0.0], 0.0
    for i in range(1, len(y) + ahead):
        k = i % season
        if i >= len(y):
            out.append((level + (i - len(y) + 1) * trend) * s[k])
        else:
            last, level = level, a * y[i] / s[k] + (1 - a) * (level + trend)
            trend = b * (level - last) + (1 - b) * trend
            s[k] = g * y[i] / level + (1 - g) * s[k]
            out.append((level + trend) * s[k])
            if i > 2:
                f = out[-1] / y[i]
                d[k] = g * (1 - (1 / f if f > 1 else f)) + (1 - g) * d[k]
                sse += (out[-1] - y[i]) ** 2
        dev.append(d[k])
    return out, dev, sse


def test_forecast_parts():
    y = np.tile([10.0, 20.0, 30.0, 20.0], 6) + np.arange(24)
    assert initial_trend(y, 4) == pytest.approx(1.0)
    assert initial_seasonal(np.tile([10.0, 30.0], 3), 2).tolist() == [0.5, 1.5]
    with pytest.raises(ValueError):
        initial_trend(y[:5], 4)
    rng = np.random.default_rng(2)
    ys = [y, np.tile([5.0, 9.0, 7.0, 8.0], 9) + rng.normal(0, 1, 36), 100 + rng.normal(0, 5, 11)]
    batch, params = Batch(ys, 4), np.array([[0.5, 0.2, 0.5], [0.1, 0.01, 0.9], [0.9, 0.1, 0.1]])
    errors = batch.errors(params, np.arange(3))
    for (out, dev), e, x, p, m in zip(batch.run(params, np.array([4, 0, 3])), errors, ys, params, (4, 0, 3), strict=True):
        want = holt_winters(x, 4, m, *p)
        assert out == pytest.approx(want[0]) and dev == pytest.approx(want[1]) and e == pytest.approx(want[2])
    assert batch.errors(np.array([[1.0, 0.5, 0.5]]), np.array([0]))[0] == np.inf
    best = batch.fit()
    assert ((best > 0) & (best < 1)).all()
    grid = np.array(np.meshgrid(*[np.linspace(0.05, 0.95, 10)] * 3)).reshape(3, -1).T
    for k in range(3):
        assert batch.errors(best[k : k + 1], np.array([k]))[0] <= 1.1 * batch.errors(grid, np.full(len(grid), k)).min()
    assert [b.tolist() for b in Batch(ys[1:2], 4).fit()] == [best[1].tolist()]


def test_forecast_preparation():
    v = np.array([np.nan, np.nan, 1.0, np.nan, 3.0, 4.0, np.nan])
    t = np.arange(1, 8) * 10
    first, seen, filled, ahead = prepared(t, v, 20, 10, 20, 90, 9)
    assert (first, filled.tolist(), ahead, len(seen)) == (30, [1, 1, 3, 4], 3, 4)
    assert prepared(t, v, 20, 10, 40, 90, 1) is None  # since 40, two values
    assert prepared(t, v * np.nan, 20, 10, 20, 90, 9) is None


def test_digest_codes_keep_order():
    v = np.sort(np.concatenate([np.random.default_rng(0).normal(size=1000) * 10.0 ** np.arange(-5, 5).repeat(100), [0.0, 1e308, -1e308]]))
    assert (np.diff(qdigest.encode(v)) >= 0).all()
    assert np.allclose(qdigest.decode(qdigest.encode(v)), v, rtol=2**-20, atol=0)


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy"])
def test_digest_rank_error(kind):
    rng = np.random.default_rng(3)
    v = {"normal": rng.normal(size=60_000), "ties": rng.integers(0, 5, 60_000).astype(float), "heavy": rng.pareto(0.5, 60_000)}[kind]
    eps, nodes, counts = 0.01, [], []
    for part in np.array_split(v, 7):
        _, n, c = qdigest.compress(np.zeros(len(part), np.int64), qdigest.encode(part) + (1 << 32), np.ones(len(part), np.int64), eps)
        nodes.append(n)
        counts.append(c)
    _, n, c = qdigest.compress(np.zeros(sum(map(len, nodes)), np.int64), np.concatenate(nodes), np.concatenate(counts), eps)
    assert c.sum() == len(v) and len(n) < 3 * 33 / eps
    s = np.sort(qdigest.encode(v))
    for q in (0, 0.01, 0.5, 0.9, 0.99, 1):
        code, total = qdigest.quantile_nodes(n, c, [q])
        lo, hi = np.searchsorted(s, code[0], "left"), np.searchsorted(s, code[0], "right")
        rank = max(1, np.ceil(q * total))
        assert lo - eps * total <= rank <= hi + eps * total


def test_spikes_stuck_and_shifts():
    rng = np.random.default_rng(5)
    n = 600
    ms = np.arange(n) * 3_600_000
    v = 100 + 30 * np.sin(2 * np.pi * ms / 86_400_000) + rng.normal(0, 1, n)
    v[300:] += 500  # a lasting change of level is no case
    assert not spikes.judge(ms, v, False).any()
    w = v.copy()
    w[[50, 200, 201, 400]] += [40, -35, -35, 60]
    w[450:465] = w[450]
    why = spikes.judge(ms, w, False)
    assert set(np.flatnonzero(why == 1)) == {50, 200, 201, 400}
    assert set(np.flatnonzero(why == 2)) == set(range(450, 465))
    assert not spikes.judge(ms, np.full(n, 7.0), False).any()
    assert not spikes.judge(ms[:5], w[:5], False).any()
    assert not spikes.judge(ms, np.where(np.arange(n) // 40 % 2, 0.0, 50 + rng.normal(0, 1, n)), False).any()


def test_spikes_masked_for_many_rounds():
    """A quarter of the readings are outliers of falling size, of which each round unmasks a few."""
    rng = np.random.default_rng(3)
    n = 200
    v = 50 + rng.normal(0, 1, n)
    at = rng.permutation(np.arange(2, n, 4))
    v[at] += 60 * 1.11 ** np.arange(len(at)) * rng.choice([-1, 1], len(at))
    assert set(np.flatnonzero(spikes.judge(np.arange(n) * 60_000, v, False) == 1)) == set(at)
