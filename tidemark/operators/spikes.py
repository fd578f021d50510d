"""Problem 5: implausible readings.

Robust autoregression per source: a source's readings in order of time are modelled as level + daily
swing + autoregressive remainder. Additive outliers (one to four readings) are tested for and taken out
again and again until none is left; a longer run on a new level is a level shift, which the level
follows and which is no case. Stuck runs and violations of physical limits are found separately.

Rows are hashed to tasks by source and handled source by source in numpy. A source with too many readings
for one task is cut into chunks of equally many successive readings with a margin from both neighbours.
What is local (levels, runs) is found within a chunk; what belongs to the source (usual spread, share of
repeats, state values, daily swing, autoregression) is added up over all its chunks, one pass for each fact
that depends on those before it, so that chunks judge as the whole source would (see Known).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grouped import by_group, hashed, whole_groups
from ..session import bounded_broadcast, cut, finite, sound_unions, written

DAY = 86_400_000
#: A run of more outlying readings than this is a new level.
MAX_PATCH = 4
#: Readings of one chunk of a source, and how many on either side are lent by the neighbours: half the
#: widest running median (150) and for each round of tests some 35 readings (six good ones among patches).
CHUNK_ROWS = 50_000
MARGIN = 1_000
#: Kinds of summary rows.
SUM, CELL, VALUE, COUNT = range(4)


class Whole:
    """Facts of a source all of whose readings are at hand. Each takes a function that summarizes the
    readings at hand, which is only called where the fact isn't known yet."""

    def add(self, fn) -> tuple[np.ndarray, np.ndarray]:
        """Sums and maxima of a vector over all chunks."""
        v = np.asarray(fn(), float)
        return v, v

    def order(self, fn) -> tuple[float, float]:
        """The readings' values at half and at 90 percent of their number (0 if there are none)."""
        a = fn()
        if len(a) == 0:
            return 0.0, 0.0
        k50, k90 = len(a) // 2, min(len(a) - 1, int(0.9 * len(a)))
        p = np.partition(a, (k50, k90))
        return float(p[k50]), float(p[k90])

    def values(self, fn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values with a number and a size each, added up by value."""
        return fn()

    def most(self, fn) -> int:
        """How often the most frequent value occurs (3 or less may come out as 0)."""
        a = fn()
        return int(np.unique(a, return_counts=True)[1].max()) if len(a) else 0


WHOLE = Whole()


class Ask(Exception):
    """A fact that isn't known yet: summary rows (kind, cell, n, lo, hi, s) of one chunk."""


class Known:
    """Facts of a source that were put together from its chunks so far; the first unknown one raises Ask
    with this chunk's share. Branches between facts depend on facts only, so that all chunks of a
    source ask the same. Order statistics are taken from cells of width 2**-11 of the value, between the
    least and the greatest value in the cell; the other facts are exact up to the order of summation."""

    def __init__(self, answers: list) -> None:
        self.answers = iter(answers)

    def _next(self, kind: int, fn, rows):
        if (a := next(self.answers, None)) is not None:
            return a
        cell, n, lo, hi, s = rows(fn())
        mark = [(SUM, -1, 0, float(kind), 0.0, 0.0)]  # a source whose chunks have nothing to add is answered, too
        raise Ask(mark + [(kind, *r) for r in zip(cell.tolist(), n.tolist(), lo.tolist(), hi.tolist(), s.tolist(), strict=True)])

    def add(self, fn):
        def rows(v):
            v = np.asarray(v, float)
            return np.arange(len(v)), np.zeros(len(v), int), v, v, v

        a = self._next(SUM, fn, rows)
        return np.array(a[0]), np.array(a[1])

    def order(self, fn):
        def rows(a):
            a = np.sort(a) + 0.0
            bits = a.view(np.int64)
            key = np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits) >> 41
            at = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(a) else np.zeros(0, int)
            end = np.append(at[1:], len(a)) if len(a) else at
            return key[at], end - at, a[at], a[end - 1], np.zeros(len(at))

        a = self._next(CELL, fn, rows)
        return a[0][0], a[0][1]

    def values(self, fn):
        a = self._next(VALUE, fn, lambda r: ((r[0] + 0.0).view(np.int64), r[1], r[0], r[0], r[2]))
        return np.array(a[0]), np.array(a[1]), np.array(a[2])

    def most(self, fn):
        def rows(a):
            v, n = np.unique(a, return_counts=True)
            return (v + 0.0).view(np.int64), n, v, v, v

        return int(self._next(COUNT, fn, rows)[0][0])


def _answer(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
    """The fact that the chunks of one source asked for, from their merged summary rows."""
    kind = int(p["lo"][(p["kind"] == SUM) & (p["cell"] == -1)].iloc[0])
    p = p[(p["kind"] == kind) & ((kind != SUM) | (p["cell"] >= 0))].sort_values("cell")
    a, b, c = [], [], []
    if kind == SUM:
        a, b = p["s"].tolist(), p["hi"].tolist()
    elif kind == CELL:
        upto = p["n"].cumsum().to_numpy()
        total = int(upto[-1]) if len(upto) else 0
        for k in (total // 2, min(total - 1, int(0.9 * total))) if total else ():
            i = int(np.searchsorted(upto, k, side="right"))
            n, lo, hi = int(p["n"].iloc[i]), p["lo"].iloc[i], p["hi"].iloc[i]
            a.append(float(lo + (hi - lo) * ((k - (upto[i] - n)) / (n - 1) if n > 1 else 0.0)))
        a = a or [0.0, 0.0]
    elif kind == VALUE:
        a, b, c = p["lo"].tolist(), p["n"].astype(float).tolist(), p["s"].tolist()
    else:
        a = [float(p["n"].max()) if len(p) else 0.0]
    return pd.DataFrame({"src": [key[0]], "a": [a], "b": [b], "c": [c]})


def running_median(x: np.ndarray, width: int) -> np.ndarray:
    """Centred running median; at both ends the window shrinks to what there is."""
    n, h = len(x), width // 2
    out = np.empty(n)
    if n > width > 31:
        out[h : n - h] = pd.Series(x).rolling(width).median().to_numpy()[width - 1 :]
    elif n > width:
        w = np.lib.stride_tricks.sliding_window_view(x, width)
        for at in range(0, len(w), 65_536):
            out[h + at : h + at + min(65_536, len(w) - at)] = np.partition(w[at : at + 65_536], h, axis=1)[:, h]
    ends = np.arange(n) if n <= width else np.concatenate([np.arange(h), np.arange(n - h, n)])
    if n:
        from_, to = np.maximum(ends - h, 0), np.minimum(ends + h + 1, n)
        at = from_[:, None] + np.arange(min(width, n))
        w = np.sort(np.where(at < to[:, None], x[np.minimum(at, n - 1)], np.inf), axis=1)
        k, row = to - from_, np.arange(len(ends))
        out[ends] = (w[row, (k - 1) // 2] + w[row, k // 2]) / 2
    return out


def level_shifts(z: np.ndarray, m: np.ndarray, width: int, least: float) -> list[int]:
    """Places where readings z go over to a level at least `least` away: the medians m of the `width`
    readings before and from there on differ by so much, and the absolute deviations from the two
    levels are least in sum if the change is put there. A patch of outliers is too short to be one."""
    h = width // 2
    if len(z) < 2 * width:
        return []
    big = np.flatnonzero(np.abs(m[width + h : len(m) - h] - m[h : len(m) - width - h]) >= least) + width
    out = []
    for run in np.split(big, np.flatnonzero(np.diff(big) > width) + 1) if len(big) else ():
        a, b = max(0, int(run[0]) - h), min(len(z), int(run[-1]) + h + 1)
        before, after = m[int(run[0]) - h - 1], m[min(len(m) - 1, int(run[-1]) + h)]
        d = np.abs(z[a:b] - before) - np.abs(z[a:b] - after)
        # sum of d before the place, least where all nearer to the old level lie before it
        out.append(a + int(np.argmin(np.concatenate(([0.0], np.cumsum(d))))))
    return out


def _carried(x: np.ndarray, at: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A level m of the readings at places `at`, carried to all readings by position."""
    if len(at) == len(x):
        return m
    left = np.clip(np.searchsorted(at, np.arange(len(x)), side="right") - 1, 0, len(at) - 1)
    right = np.clip(np.searchsorted(at, np.arange(len(x)), side="left"), 0, len(at) - 1)
    # between two good readings the nearer side of a level shift is unknown; their mean is off by half
    # a shift at most, so the side is taken that is closer to the reading
    a, b = m[left], m[right]
    return np.where(np.abs(x - a) <= np.abs(x - b), a, b)


def spread(facts, deviations) -> float:
    """Usual size of the deviations as a standard deviation: the larger of the estimates by their
    median and by their 90th percentile (the second holds where most deviations are equal)."""

    def sizes():
        a = np.abs(deviations())
        return a[np.isfinite(a)]

    p50, p90 = facts.order(sizes)
    return float(max(1.4826 * p50, p90 / 1.645))


def daily_swing(ms: np.ndarray, x: np.ndarray, facts, mine: np.ndarray, n: int, span: float, max_harmonics: int = 3) -> np.ndarray | None:
    """The daily component of x by robust harmonic regression about a slow level, or None.

    It is used only if it explains most of the variation that is left about the slow level. n and span
    are those of the source.
    """
    if n < 24 or span < 2.5 * DAY:
        return None
    per_day = max(2, round(n / (span / DAY)))
    k = max(1, min(max_harmonics, (per_day - 1) // 2))
    d = 2 * k + 1
    if n < 6 * d:
        return None
    ph = 2 * np.pi * (ms % DAY) / DAY
    a = np.stack([np.ones(len(x))] + [f(j * ph) for j in range(1, k + 1) for f in (np.cos, np.sin)], axis=1)
    am, held = a[mine], []

    def r() -> np.ndarray:
        if not held:
            held.append((x - running_median(x, 2 * min(per_day, 150) + 1))[mine])
        return held[0]

    med, _ = facts.order(r)
    s = s0 = spread(facts, lambda: r() - med)
    if s0 <= 0:
        return None
    weigh = lambda: (np.abs(r() - med) < 6 * s0).astype(float)
    for _ in range(4):

        def normal(weigh=weigh):
            aw = am * weigh()[:, None]
            return np.concatenate([(aw.T @ am).ravel(), aw.T @ r()])

        sums, _ = facts.add(normal)
        try:
            beta = np.linalg.solve(sums[: d * d].reshape(d, d) + 1e-9 * n * np.eye(d), sums[d * d :])
        except np.linalg.LinAlgError:
            return None
        s = spread(facts, lambda beta=beta: r() - am @ beta)
        if s <= 0:
            break
        weigh = lambda beta=beta, s=s: np.clip(1 - ((r() - am @ beta) / (4.7 * s)) ** 2, 0, None) ** 2
    if s > 0.75 * s0:
        return None
    return a[:, 1:] @ beta[1:]


def ar_coefficient(r: np.ndarray, good: np.ndarray, s: float, facts, mine: np.ndarray) -> float:
    """Robust AR(1) coefficient of r from neighbouring good readings, each bounded at three times the
    usual deviation s, limited so that the process stays stationary."""

    def sums():
        ok = good[1:] & good[:-1] & mine[1:]
        c = np.clip(r, -3 * s, 3 * s)
        a, b = c[:-1][ok], c[1:][ok]
        return len(a), a @ b, a @ a

    n, num, den = facts.add(sums)[0]
    return float(np.clip(num / den, -0.95, 0.95)) if n >= 30 and den > 0 else 0.0


def patches(out: np.ndarray) -> np.ndarray:
    """Keep the runs of at most MAX_PATCH outlying readings; longer runs are level shifts."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0]))))
    keep = np.zeros(len(out), bool)
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a <= MAX_PATCH:
            keep[a:b] = True
    return keep


def additive_outliers(
    ms: np.ndarray, x: np.ndarray, facts, mine: np.ndarray, n: int, span: float, times: float = 8.0, width: int = 11
) -> np.ndarray:
    """Flags of readings that are away from the level by `times` the usual spread about it.

    Each round, without the outliers known so far, fits level, swing and autoregression; tests for level
    shifts, on both sides of which the level is fitted apart; and tests both the deviation itself (level
    test) and the innovation of the autoregression (additive-outlier test).
    Rounds end when the flags repeat: those of the round before, or, if they go round in a circle, the
    readings that are flagged all the way round.
    """
    out = np.zeros(len(x), bool)
    past = [out]
    swing = daily_swing(ms, x, facts, mine, n, span)
    y = x - swing if swing is not None else x
    while True:
        good = ~out
        at = np.flatnonzero(good)
        # patches leave a fifth of the readings at least
        m = n // 5 if n >= 5 * width + 5 else int(good.sum())
        wide = min(width, max(3, (m - 1) // 2 * 2 + 1))
        z = y[at]
        level = running_median(z, wide)
        s = spread(facts, lambda z=z, level=level, at=at: (z - level)[mine[at]])
        if s <= 0:
            return np.zeros(len(x), bool)
        if places := level_shifts(z, level, wide, times * s):
            level = np.concatenate([running_median(part, wide) for part in np.split(z, places)])
        r = y - _carried(y, at, level) if len(at) else y
        phi = ar_coefficient(r, good, s, facts, mine)
        clean = np.where(good, r, 0.0)
        before = np.concatenate(([0.0], clean))[: len(r)]
        e = r - phi * before
        s_e = spread(facts, lambda e=e, good=good: e[good & mine])
        new = patches((np.abs(r) >= times * s) & (np.abs(e) >= 0.75 * times * max(s_e, 1e-300)))
        changes = facts.add(lambda new=new: [(new != p)[mine].sum() for p in past])[0]
        if (changes == 0).any():
            return np.logical_and.reduce(past[int(np.flatnonzero(changes == 0)[-1]) :])
        past.append(new)
        out = new


def stuck_runs(
    v: np.ndarray, distinct: np.ndarray, facts=WHOLE, mine: np.ndarray | None = None, least: int = 12, often: float = 0.05
) -> np.ndarray:
    """Flags of the readings in runs of `least` or more successive equal values, if the source hardly
    repeats a value otherwise. `distinct` is False for a redelivery of the reading before it, which
    belongs to the run but doesn't lengthen it."""
    flags = np.zeros(len(v), bool)
    mine = np.ones(len(v), bool) if mine is None else mine
    start = np.concatenate(([True], v[1:] != v[:-1]))
    run = np.cumsum(start) - 1
    size = np.bincount(run, weights=distinct.astype(float))
    # a margin shows at least as many readings of a run as make it long
    long = size >= least
    firsts, here = v[np.flatnonzero(start)], mine[np.flatnonzero(start)]
    rest = ~long[run] & distinct & mine

    def runs():
        inside = long[run] & mine
        values, at = np.unique(v[inside], return_inverse=True)
        begun = np.searchsorted(values, firsts[long & here])
        return values, np.bincount(begun, minlength=len(values)), np.bincount(at, weights=distinct[inside].astype(float), minlength=len(values))

    values, begun, sizes = facts.values(runs)
    if not len(values):
        return flags
    n, m, repeats = facts.add(lambda: (mine.sum(), rest.sum(), (size[~long & here] - 1).clip(0).sum()))[0]
    if m < least or repeats > often * m or facts.most(lambda: v[rest]) > max(3, often * m):
        return flags
    # a value that comes back in runs again and again is a state of the source
    stuck = values[(begun <= 2) & (sizes <= 0.25 * n)]
    return long[run] & np.isin(v, stuck)


def judge(ms: np.ndarray, v: np.ndarray, log: bool, times: float = 8.0, facts=WHOLE, mine: np.ndarray | None = None) -> np.ndarray:
    """Reasons per reading of one source in order of time: 0 none, 1 spike, 2 stuck. Of a chunk, `mine`
    marks the readings that aren't lent by a neighbour."""
    why = np.zeros(len(v), np.int8)
    mine = np.ones(len(v), bool) if mine is None else mine
    distinct = np.concatenate(([True], (ms[1:] != ms[:-1]) | (v[1:] != v[:-1])))
    why[stuck_runs(v, distinct, facts, mine)] = 2
    if log:
        ok = v > 0
        x = np.log(np.where(ok, v, 1.0))
    else:
        ok, x = np.ones(len(v), bool), v
    use = ok & distinct

    def counts():
        t = ms[use & mine]
        return len(t), (~ok & mine).sum(), mine.sum(), *((-t[0], t[-1]) if len(t) else (-np.inf, -np.inf))

    (n, bad, total, *_), (*_, lo, hi) = facts.add(counts)
    if n >= 8:
        f = np.zeros(len(v), bool)
        f[use] = additive_outliers(ms[use], x[use], facts, mine[use], int(n), hi + lo, times)
        if log and 0 < bad < 0.05 * total:
            f |= ~ok
        # a redelivery shares the verdict of the reading before it
        first = np.maximum.accumulate(np.where(distinct, np.arange(len(v)), 0))
        why[f[first] & (why == 0)] = 1
    return why


def _columns(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """group, ms, value, log, row_id of the rows without repetitions, and where these rows are."""
    cols = [t[c].to_numpy() for c in ("group", "ms", "value", "log", "row_id")]
    g, ms, ident = cols[0], cols[1], cols[4]
    new = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (ms[1:] != ms[:-1]) | (ident[1:] != ident[:-1]))))
    return [c[new] for c in cols], new


def _groups(g: np.ndarray):
    at = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))
    return zip(at[:-1], at[1:], strict=True)


def _found(t: pa.Table, at: np.ndarray, why: np.ndarray) -> list[pa.RecordBatch]:
    names = t["source_table"].combine_chunks().take(pa.array(at))
    ident = t["row_id"].combine_chunks().take(pa.array(at))
    return [pa.RecordBatch.from_arrays([names, ident, pa.array(why.astype(np.int32))], names=["source_table", "row_id", "why"])]


def _verdicts(times: float):
    """Function of whole sources to their flagged rows."""

    def flush(t: pa.Table) -> list[pa.RecordBatch] | None:
        (group, ms, v, log, _), new = _columns(t)
        why = np.zeros(len(group), np.int8)
        for a, b in _groups(group):
            if b - a >= 8:
                why[a:b] = judge(ms[a:b], v[a:b], bool(log[a]), times)
        hit = np.flatnonzero(why)
        return _found(t, new[hit], why[hit]) if len(hit) else None

    return flush


def _chunk_verdicts(times: float, answers: dict[int, list]):
    """Function of whole chunks to their flagged rows; answers: the facts of each source cut into chunks."""

    def flush(t: pa.Table) -> list[pa.RecordBatch] | None:
        (group, ms, v, log, _), new = _columns(t)
        own, src = (t[c].to_numpy(zero_copy_only=False)[new] for c in ("own", "src"))
        why = np.zeros(len(group), np.int8)
        for a, b in _groups(group):
            why[a:b] = judge(ms[a:b], v[a:b], bool(log[a]), times, Known(answers[int(src[a])]), own[a:b])
        hit = np.flatnonzero((why > 0) & own)
        return _found(t, new[hit], why[hit]) if len(hit) else None

    return flush


def _questions(times: float, answers: dict[int, list], done: set[int]):
    """Function of whole chunks to the summary rows of the next fact that each chunk's source needs."""

    def flush(t: pa.Table) -> list[pa.RecordBatch] | None:
        (group, ms, v, log, _), new = _columns(t)
        own, src = (t[c].to_numpy(zero_copy_only=False)[new] for c in ("own", "src"))
        out: list[tuple] = []
        for a, b in _groups(group):
            if (key := int(src[a])) in done:
                continue
            try:
                judge(ms[a:b], v[a:b], bool(log[a]), times, Known(answers.get(key, [])), own[a:b])
            except Ask as ask:
                out += [(key, *row) for row in ask.args[0]]
        if not out:
            return None
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["src", "kind", "cell", "n", "lo", "hi", "s"])]

    return flush


def _table(readings: DataFrame, *keep: str) -> DataFrame:
    """The usable readings with the hash `src` of their source, written once: what is then read several
    times is narrow. src is null where the source or the time is."""
    sound_unions(readings.sparkSession)
    src = F.when(F.col("source").isNotNull() & F.col("ms").isNotNull(), F.xxhash64("source_table", "source")).alias("src")
    return written(readings.where(finite("value")).select("source_table", src, "row_id", "ms", "value", "log", *keep))


def reasons(readings: DataFrame, limits: DataFrame, times: float = 8.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows of implausible() and of outside_limits() over the same readings, which also hold a suffix."""
    t = _table(readings, "suffix")
    return _implausible(t, times, chunk_rows).unionByName(outside_limits(t, limits))


def implausible(readings: DataFrame, times: float = 8.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Additive outliers and stuck runs: (source_table, row_id, reason) with reason 'additive' or 'stuck'.

    readings: (source_table string, source string, row_id bigint, ms bigint, value double, log boolean);
    log asks for a logarithmic scale. Rows with a null source, time or value, or a value that is not
    finite, are passed over; sources with fewer than 8 readings have no usual behaviour. Ties in time
    are ordered by row_id. Each row comes out at most once (stuck before additive); rows that share source,
    time and row_id are one row. Empty input gives an empty result.
    """
    return _implausible(_table(readings), times, chunk_rows)


def _implausible(t: DataFrame, times: float, chunk_rows: int) -> DataFrame:
    r = t.where("src is not null").select("source_table", "src", "row_id", "ms", "value", "log")
    hot = cut(r.groupBy("src").agg(F.count("*").alias("total")).where(F.col("total") > chunk_rows).select("src"))
    any_hot = not hot.isEmpty()
    few = bounded_broadcast(hot)
    cold = r.join(few, "src", "left_anti") if any_hot else r
    out = by_group(cold.withColumnRenamed("src", "group"), "ms", "row_id").mapInArrow(whole_groups(_verdicts(times)), FLAGGED)
    if any_hot:
        x = cut(by_group(_chunks(r.join(few, "src", "left_semi"), chunk_rows), "ms", "row_id"))
        answers: dict[int, list] = {}
        done: set[int] = set()
        # facts are a few numbers a source; a round of this loop is one Spark job over the hot sources
        while got := _facts(x, times, answers, done):
            done |= answers.keys() - got.keys()
            for src, a in got.items():
                answers.setdefault(src, []).append(a)
        out = out.unionByName(x.mapInArrow(whole_groups(_chunk_verdicts(times, answers)), FLAGGED))
    return out.select("source_table", "row_id", F.when(F.col("why") == 2, "stuck").otherwise("additive").alias("reason"))


FLAGGED = "source_table string, row_id bigint, why int"


def _chunks(r: DataFrame, chunk_rows: int) -> DataFrame:
    """Rows of hot sources with the chunk they belong to (own) and as margin with the chunks near them.

    A source's chunks differ by one reading at most. Rows are sorted over all partitions, however many
    share an hour or an instant; a row's position in its source is the one within its partition and the
    rows of the source in the partitions before, so that no window runs over a source's rows.
    """
    order = ["src", "ms", "row_id"]
    at = F.monotonically_increasing_id()
    r = r.dropDuplicates(order).repartitionByRange(*order).sortWithinPartitions(*order)
    r = cut(r.withColumn("id", at).withColumn("part", F.spark_partition_id()))
    runs = r.groupBy("src", "part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("src").orderBy("part")
    runs = runs.withColumn("offset", F.sum("n").over(w) - F.col("n") - F.col("first")).withColumn("total", F.sum("n").over(Window.partitionBy("src")))
    runs = cut(runs.select("src", "part", "offset", "total"))
    r = r.join(bounded_broadcast(runs), ["src", "part"]).withColumn("at", F.col("id") + F.col("offset"))
    r = r.withColumn("k", F.ceil(F.col("total") / chunk_rows))
    near = F.expr(f"sequence(greatest(0, at - {MARGIN}) * k div total, least(total - 1, at + {MARGIN}) * k div total)")
    r = r.withColumn("mine", F.expr("at * k div total")).withColumn("chunk", F.explode(near))
    r = r.withColumn("own", F.col("chunk") == F.col("mine")).withColumn("group", hashed("src", "chunk"))
    return r.select("source_table", "src", "group", "row_id", "ms", "value", "log", "own")


def _facts(x: DataFrame, times: float, answers: dict[int, list], done: set[int]) -> dict[int, tuple]:
    """The next fact of every hot source that needs one."""
    rows = x.mapInArrow(whole_groups(_questions(times, answers, done)), "src bigint, kind int, cell bigint, n bigint, lo double, hi double, s double")
    merged = rows.groupBy("src", "kind", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s").alias("s"))
    merged = merged.where(f"kind != {COUNT} or n > 3")
    got = merged.groupBy("src").applyInPandas(_answer, "src bigint, a array<double>, b array<double>, c array<double>").collect()
    return {g["src"]: (g["a"], g["b"], g["c"]) for g in got}


def outside_limits(readings: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows of readings (source_table, suffix, row_id, value) outside (min_possible, max_possible) of
    their suffix in limits; a null or NaN limit is no limit, a suffix without a row has none."""
    lim = bounded_broadcast(limits.select("suffix", F.nanvl("min_possible", F.lit(None)).alias("lo"), F.nanvl("max_possible", F.lit(None)).alias("hi")))
    j = readings.where(finite("value")).join(lim, "suffix")
    bad = F.coalesce(F.col("value") < F.col("lo"), F.lit(False)) | F.coalesce(F.col("value") > F.col("hi"), F.lit(False))
    return j.where(bad).select("source_table", "row_id", F.lit("limit").alias("reason"))
