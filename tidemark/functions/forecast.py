"""Multiplicative Holt-Winters forecasting.

The recursion is sequential in time, so it runs in numpy over all series of a block side by side: one
step handles the same slot of every series, and the fit moves the simplexes of all of them together.
A series is handed over whole (its length is bounded by its archive), blocks are bounded in rows.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa

from ..durations import parse_duration
from ..frame import COLUMNS, Frame
from ..grouped import by_group, hashed, whole_groups
from .registry import register

#: The four starting points (alpha, beta, gamma) of the fit.
STARTS = np.array([[0.1, 0.01, 0.9], [0.9, 0.1, 0.1], [0.5, 0.2, 0.5], [0.1, 0.9, 0.1]])
#: Rows that are forecast side by side.
BLOCK_ROWS = 200_000


def initial_trend(y: np.ndarray, season: int) -> float:
    """Mean slope between the first two seasons."""
    if len(y) < 2 * season:
        raise ValueError("two seasons are needed")
    return float(np.mean((y[season : 2 * season] - y[:season]) / season))


def initial_seasonal(y: np.ndarray, season: int) -> np.ndarray:
    """Seasonal factors: each place's mean ratio to the mean of its season, over the whole seasons (ones
    if a season's mean is 0)."""
    k = len(y) // season
    if k < 1:
        raise ValueError("one season is needed")
    block = y[: k * season].reshape(k, season)
    mean = block.mean(axis=1, keepdims=True)
    return (block / mean).mean(axis=0) if (mean != 0).all() else np.ones(season)


class Batch:
    """Series of one season side by side: values (slot, series), padded with NaN behind their ends."""

    def __init__(self, ys: list[np.ndarray], season: int):
        self.season = season
        self.n = np.array([len(y) for y in ys])
        self.y = np.full((self.n.max(), len(ys)), np.nan)
        for k, y in enumerate(ys):
            self.y[: len(y), k] = y
        self.trend = np.array([initial_trend(y, season) for y in ys])
        self.factors = np.stack([initial_seasonal(y, season) for y in ys], axis=1)

    def errors(self, params: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Sums of squared errors behind the third slot for rows of params; of: each row's series."""
        y = self.y[:, of]
        fits = self._smooth(y, self.factors[:, of].copy(), self.trend[of], *params.T)[0]
        e = np.where(np.arange(len(y))[3:, None] < self.n[of], (fits - y)[3:] ** 2, 0.0).sum(axis=0)
        inside = ((params > 0) & (params < 1)).all(axis=1)
        return np.where(inside & np.isfinite(e), e, np.inf)

    def _smooth(self, y, s, slope, a, b, g):
        """Smoothed values; s is changed in place, level and slope are kept at every slot."""
        out, levels, slopes = np.empty_like(y), np.empty_like(y), np.empty_like(y)
        level = out[0] = levels[0] = y[0]
        slopes[0] = slope
        a1, b1, g1 = 1 - a, 1 - b, 1 - g
        for i in range(1, len(y)):
            f, v = s[i % self.season], y[i]
            new = a * (v / f) + a1 * (level + slope)
            slope = b * (new - level) + b1 * slope
            # factors stand still behind a series' end
            nf = g * (v / new) + g1 * f
            s[i % self.season] = np.where(v == v, nf, f) if np.isnan(v).any() else nf
            level = new
            out[i] = (new + slope) * nf
            levels[i], slopes[i] = level, slope
        return out, levels, slopes

    def run(self, params: np.ndarray, ahead: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per series its smoothed values with `ahead` forecasts, and their deviations (shares of the value)."""
        s = self.factors.copy()
        with np.errstate(all="ignore"):
            fits, levels, slopes = self._smooth(self.y, s, self.trend, *params.T)
            ratio = fits / self.y
            part = 1 - np.where(ratio > 1, 1 / ratio, ratio)
        out = []
        for k, (n, m) in enumerate(zip(self.n.tolist(), ahead.tolist(), strict=True)):
            i = np.arange(n, n + m)
            tail = (levels[n - 1, k] + (i - n + 1) * slopes[n - 1, k]) * s[i % self.season, k]
            dev, d = np.zeros(n + m), np.zeros(self.season)
            g = params[k, 2]
            for j in range(1, n + m):
                if 2 < j < n:
                    d[j % self.season] = g * part[j, k] + (1 - g) * d[j % self.season]
                dev[j] = d[j % self.season]
            out.append((np.concatenate([fits[:n, k], tail]), dev))
        return out

    def fit(self, eps: float = 1e-6, most: int = 1000) -> np.ndarray:
        """(alpha, beta, gamma) of least squared error per series: downhill simplex with reflection 1,
        contraction 0.5, expansion 2 and shrinking 0.5. All moves a simplex may make are tried at once."""
        count = len(self.n)
        pts = np.repeat(STARTS[None], count, axis=0)
        with np.errstate(all="ignore"):
            vals = self.errors(pts.reshape(-1, 3), np.repeat(np.arange(count), 4)).reshape(count, 4)
            for _ in range(most):
                order = np.argsort(vals, axis=1, kind="stable")
                pts, vals = np.take_along_axis(pts, order[..., None], 1), np.take_along_axis(vals, order, 1)
                on = np.flatnonzero(~(vals.std(axis=1) < eps))
                if not len(on):
                    break
                p, f = pts[on], vals[on]
                c = p[:, :3].mean(axis=1)
                away = c - p[:, 3]
                tries = np.concatenate([np.stack([c + away, c + 2 * away, c + 0.5 * away, c - 0.5 * away], 1), (p[:, :1] + p[:, 1:]) / 2], axis=1)
                e = self.errors(tries.reshape(-1, 3), np.repeat(on, 7)).reshape(-1, 7)
                outer = e[:, 0] < f[:, 3]
                small = np.where(outer, e[:, 2], e[:, 3])
                shrink = (e[:, 0] >= f[:, 2]) & ~(small < np.minimum(e[:, 0], f[:, 3]))
                pick = np.where(e[:, 0] < f[:, 0], np.where(e[:, 1] < e[:, 0], 1, 0), np.where(e[:, 0] < f[:, 2], 0, np.where(outer, 2, 3)))
                row = np.arange(len(on))
                p[:, 3] = np.where(shrink[:, None], p[:, 3], tries[row, pick])
                f[:, 3] = np.where(shrink, f[:, 3], e[row, pick])
                p[shrink, 1:], f[shrink, 1:] = tries[shrink, 4:], e[shrink, 4:]
                pts[on], vals[on] = p, f
        return pts[np.arange(count), np.argmin(vals, axis=1)]


def prepared(t: np.ndarray, v: np.ndarray, season_ms: int, step: int, from_ms: int, to_ms: int, limit: int):
    """(times, observed, values to smooth, forecasts) of one series, or None if there are fewer than two
    seasons. It begins `limit` seasons before its last value, or with the view if that is earlier;
    leading missing values are skipped, inner ones take the last value; missing ones at the end are forecast."""
    known = np.flatnonzero(np.isfinite(v))
    if not len(known):
        return None
    latest = t[known[-1]]
    since = min(from_ms, min(to_ms, latest) - season_ms * limit)
    known = known[t[known] > since]
    if not len(known):
        return None
    a, b = known[0], known[-1]
    at = np.arange(a, b + 1)
    filled = v[np.maximum.accumulate(np.where(np.isfinite(v[a : b + 1]), at, a))]
    if len(filled) < 2 * max(1, season_ms // step):
        return None
    return t[a], v[a : b + 1], filled, int(max(0, (to_ms - t[b]) // step))


#: Per part of `show`: suffix of the name, function in the alias.
PARTS = {"smooth": ("", "holtWintersForecast"), "upper": (".upper", "holtWintersConfidenceUpper"), "lower": (".lower", "holtWintersConfidenceLower"), "aberr": (".aberrant", "holtWintersAberration")}
SCHEMA = "name string, alias string, t bigint, v double, step_ms bigint"


def _forecaster(season_ms: int, from_ms: int, to_ms: int, limit: int, params, scale: float, show: list[str], compat: bool):
    def flush(table: pa.Table):
        names, steps = table["name"].to_numpy(zero_copy_only=False), table["step_ms"].to_numpy()
        t, v = table["t"].to_numpy(), table["v"].to_numpy(zero_copy_only=False).astype(float)
        at = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]))
        by_step: dict[int, list] = {}
        for a, b in zip(at[:-1], at[1:], strict=True):
            step = int(steps[a])
            if (p := prepared(t[a:b], v[a:b], season_ms, step, from_ms, to_ms, limit)) is not None:
                by_step.setdefault(step, []).append((names[a], *p))
        for step, series in by_step.items():
            batch = Batch([s[3] for s in series], max(1, season_ms // step))
            best = np.tile(np.asarray(params, float), (len(series), 1)) if all(params) else batch.fit()
            for (name, first, seen, _, _), (y, dev) in zip(series, batch.run(best, np.array([s[4] for s in series])), strict=True):
                times = first + step * np.arange(len(y))
                band = y * dev * scale
                observed = np.concatenate([seen, np.full(len(y) - len(seen), np.nan)])
                x = y if compat else observed
                off = np.where(x < y - band, x - (y - band), np.where(x > y + band, x - (y + band), np.where(np.isnan(x), np.nan, 0.0)))
                values = {"smooth": y, "upper": y + band, "lower": y - band, "aberr": off}
                view = (times > from_ms) & (times <= to_ms)
                for what in show:
                    x = values[what][view]
                    tag, fn = PARTS[what]
                    k = len(x)
                    cols = [pa.array([name + tag] * k, pa.string()), pa.array([f"{fn}({name})"] * k, pa.string()), pa.array(times[view], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(x, mask=~np.isfinite(x)), pa.array(np.full(k, step), pa.int64())], names=COLUMNS)

    return whole_groups(flush, BLOCK_ROWS)


def _run(ctx, s: Frame, season_len: str, limit: int, params, scale: float, show: str) -> Frame:
    if any(not 0 <= p < 1 for p in params):
        raise ValueError("alpha, beta and gamma lie between 0 and 1, or are 0 to be fitted")
    if any(params) and not all(params):
        raise ValueError("if one of alpha, beta and gamma is 0, all must be")
    parts = [k for word, ks in (("smooth", ("smooth",)), ("conf", ("upper", "lower")), ("aberr", ("aberr",))) if word in show for k in ks]
    run = _forecaster(parse_duration(season_len), ctx.from_ms, ctx.to_ms, limit, params, scale, parts, ctx.compat)
    rows = s.df.select(*COLUMNS).withColumn("group", hashed("name"))
    return replace(s, df=by_group(rows, "name", "t").mapInArrow(run, SCHEMA))


@register(
    "holtWintersForecast",
    "seriesList:series seasonLen:string=1d seasonLimit:number=7 alpha:number=0 beta:number=0 gamma:number=0 devScale:number=10 show:string=smooth",
)
def holt_winters_forecast(ctx, s, season_len, limit, alpha, beta, gamma, scale, show):
    """show holds any of the words smooth, conf (bands of devScale deviations) and aberr (distance of the
    observed value outside the bands; of the smoothed one under compat). With alpha, beta and gamma 0 they are fitted."""
    return _run(ctx, s, season_len, int(limit), (alpha, beta, gamma), float(scale), show)


@register("holtWintersConfidenceBands", "seriesList:series delta:number=3")
def holt_winters_bands(ctx, s, delta):
    return _run(ctx, s, "1d", 7, (0, 0, 0), float(delta), "conf")


@register("holtWintersAberration", "seriesList:series delta:number=3")
def holt_winters_aberration(ctx, s, delta):
    return _run(ctx, s, "1d", 7, (0, 0, 0), float(delta), "aberr")
