"""Rate consolidation: points with arbitrary times become slots of fixed-step archives.

Relational form of the sequential algorithm. Per series, in order of time:
1. a point's value covers the time since the point before it; over `heartbeat` it is unknown;
2. the interval is cut at the series' own steps: a head that completes a primary slot, whole primary
   slots in the middle, and a tail that begins one;
3. a completed primary slot is one update of every archive; so is the whole middle;
4. an update credits one and the same duration to every archive slot it touches;
5. a slot ending by the last update is known if its credits reach xff; a mean credited unknown for a
   whole step starts the slot anew.
All of it is projection, explode and grouping. The lag over a series' points runs in blocks of its time
axis, to which the end of the block before is handed by a window over blocks, so that no task holds a series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import SeriesSpec
from ..session import sound_unions


def _up(c, step):
    return -F.floor(-c / step).cast("bigint") * step


def _floor(c, step):
    return c - F.pmod(c, step if hasattr(step, "cast") else F.lit(step).cast("bigint"))


#: Length of a block of a series' time axis: in steps, and at least in milliseconds.
BLOCK_STEPS, BLOCK_MS = 64, 60_000


def _in_order(points: DataFrame, step_ms: int, then) -> DataFrame:
    """clean_points() with t0, the time of the series' point before (null for the first), last_ms, the series'
    last time, and seq, which numbers its points in order of time and `then` (with gaps)."""
    p = clean_points(points).withColumn("block", F.floor(F.col("ms") / max(BLOCK_MS, BLOCK_STEPS * step_ms)).cast("bigint"))
    w = Window.partitionBy("name")
    ends = p.groupBy("name", "block").agg(F.max("ms").alias("end"))
    edges = ends.select("name", "block", F.lag("end").over(w.orderBy("block")).alias("ms"), F.max("end").over(w).alias("last_ms"))
    null = lambda kind: F.lit(None).cast(kind)
    both = p.select("name", "block", "ms", "value", null("bigint").alias("last_ms"), F.lit(1).alias("real")).unionByName(
        edges.select("name", "block", "ms", null("double").alias("value"), "last_ms", F.lit(0).alias("real"))
    )
    b = Window.partitionBy("name", "block").orderBy("real", "ms", then)
    # the edge stands first in its block
    both = both.withColumn("t0", F.lag("ms").over(b)).withColumn("last_ms", F.first("last_ms").over(b))
    both = both.withColumn("seq", F.col("block") * (1 << 32) + F.row_number().over(b))
    return both.where("real = 1").select("name", "ms", "value", "t0", "last_ms", "seq")


def clean_points(points: DataFrame) -> DataFrame:
    """Points with a name, a time and a finite value (infinite ones are errors, NaN is ignored)."""
    inf = F.lit(float("inf"))
    return points.where(
        F.col("name").isNotNull() & F.col("ms").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != inf) & (F.col("value") != -inf)
    ).select("name", F.col("ms").cast("bigint").alias("ms"), F.col("value").cast("double").alias("value"))


def intervals(points: DataFrame, heartbeat_ms: int) -> DataFrame:
    """(name, t0, t1, v, last_ms): v is null where the points are more than a heartbeat apart, last_ms is
    the series' last time. Of points with one time the greatest value stands first and the others cover
    nothing."""
    p = _in_order(points, max(1, heartbeat_ms // BLOCK_STEPS), F.desc("value"))
    v = F.when(F.col("ms") - F.col("t0") <= heartbeat_ms, F.col("value")).alias("v")
    return p.where("t0 is not null and ms > t0").select("name", "t0", F.col("ms").alias("t1"), v, "last_ms")


def updates(points: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(name, last_e, b, e, v, dur, seq): one row per update of the archives; last_e is the end of the
    series' last update, dur the credited duration of a completed primary slot, null for a middle run,
    whose credit depends on the archive's step, seq the order of the updates."""
    if spec.heartbeat_ms == 0:
        return _owned_updates(points, spec)
    s = spec.step_ms
    i = intervals(points, spec.heartbeat_ms).withColumn("up", _up(F.col("t0"), s)).withColumn("lo", _floor(F.col("t1"), s))
    i = i.withColumn("last_e", _floor(F.col("last_ms"), s))
    ragged = F.col("t0") != F.col("up")
    # one pass gives the two partial pieces of an interval
    head = F.struct(F.col("up").alias("slot"), (F.least("up", "t1") - F.col("t0")).alias("d"), (F.col("t1") >= F.col("up")).alias("done"))
    tail = F.struct((F.col("lo") + s).alias("slot"), (F.col("t1") - F.greatest("lo", "t0")).alias("d"), F.lit(False).alias("done"))
    has_tail = (F.col("t1") > F.col("lo")) & ~(ragged & (F.col("t1") < F.col("up")))
    pieces = i.select("name", "last_e", "v", F.explode(F.array_compact(F.array(F.when(ragged, head), F.when(has_tail, tail)))).alias("p"))
    known = F.col("v").isNotNull()
    pdp = (
        pieces.select("name", "last_e", "v", "p.*")
        .groupBy("name", "slot", "last_e")
        .agg(
            F.sum(F.when(known, F.col("v") * F.col("d"))).alias("vd"),
            F.coalesce(F.sum(F.when(known, F.col("d"))), F.lit(0)).alias("dur"),
            F.bool_or("done").alias("done"),
        )
        .where("done")
        .select("name", "last_e", (F.col("slot") - s).alias("b"), F.col("slot").alias("e"), F.try_divide("vd", "dur").alias("v"), "dur")
    )
    middle = i.where("lo > up").select("name", "last_e", F.col("up").alias("b"), F.col("lo").alias("e"), "v", F.lit(None).cast("bigint").alias("dur"))
    return pdp.unionByName(middle).withColumn("seq", F.col("e"))


def _owned_updates(points: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Heartbeat 0: a value owns the whole step it falls into, skipped steps are unknown. seq numbers the
    updates in order of arrival."""
    s = spec.step_ms
    p = _in_order(points, s, F.asc("value")).withColumn("e", _floor(F.col("ms"), s) + s).withColumn("prev", _floor(F.col("t0"), s) + s)
    p = p.withColumn("last_e", _floor(F.col("last_ms"), s) + s)
    own = p.select("name", "last_e", (F.col("e") - s).alias("b"), "e", F.col("value").alias("v"), F.lit(s).cast("bigint").alias("dur"), (2 * F.col("seq")).alias("seq"))
    gap = p.where(F.col("e") - s > F.col("prev")).select(
        "name", "last_e", F.col("prev").alias("b"), (F.col("e") - s).alias("e"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("bigint").alias("dur"), (2 * F.col("seq") - 1).alias("seq")
    )
    return own.unionByName(gap)


def _credits(u: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row per update, archive step r and slot of it that the update touches, of the slots that have ended
    and are kept: a long gap is cut to what the archive holds before it is taken apart."""
    sizes = {a.step_ms: max(x.size for x in spec.archives if x.step_ms == a.step_ms) for a in spec.archives}
    steps = F.array(*(F.struct(F.lit(r).cast("bigint").alias("r"), F.lit(n).cast("bigint").alias("size")) for r, n in sizes.items()))
    r, span, last = F.col("r"), F.col("e") - F.col("b"), F.col("last_e")
    u = u.withColumn("a", F.explode(steps)).select("name", "last_e", "b", "e", "v", "seq", "dur", "a.*")
    run = F.when((span > spec.step_ms) & (r >= span), span).otherwise(F.lit(spec.step_ms))
    first = F.greatest(_floor(F.col("b"), r) + r, _floor(last, r) - (F.col("size") - 1) * r)
    end = F.least(-_floor(-F.col("e"), r), _floor(last, r))
    return u.select("name", "last_e", "e", "v", "seq", "r", F.coalesce("dur", run).alias("d"), F.explode(F.when(first <= end, F.sequence(first, end, r))).alias("slot"))


def consolidate(points: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(name, cf, step_ms, t, v) of every archive of the specification.

    points: (name, ms, value). A slot that ended with nothing known is missing if xff > 0 or a reset
    happened in it, else 0. Only the last `size` slots of each archive and series are kept. The first
    point of a series opens it and gives no value; late points are sorted in. Null, NaN and infinite
    values, null names and times are ignored. Empty input gives an empty result.

    All archives come from one grouping of the credits by series, step and slot.
    """
    sound_unions(points.sparkSession)
    c = _credits(updates(points, spec), spec)
    slot = Window.partitionBy("name", "r", "slot")
    known = F.col("v").isNotNull()
    if spec.heartbeat_ms == 0:
        # a slot is closed by every update that reaches its end; only what came after the last but one
        # closing, up to the last, decides
        c = c.withColumn("close", (F.col("e") >= F.col("slot")).cast("int")).withColumn("k", F.sum("close").over(slot.orderBy("seq")) - F.col("close"))
        c = c.withColumn("n", F.max(F.col("k") + F.col("close")).over(slot)).where("n > 0 and k = n - 1")
    if any(a.cf == "WMEAN" for a in spec.archives):
        c = c.withColumn("reset", F.max(F.when(~known & (F.col("d") == F.col("r")), F.col("seq"))).over(slot))
    else:
        c = c.withColumn("reset", F.lit(None).cast("bigint"))
    live = known & (F.col("reset").isNull() | (F.col("seq") > F.col("reset")))
    mean_dur = F.sum(F.when(live, F.col("d")))
    x = F.when(known, F.col("v"))
    g = c.groupBy("name", "r", "slot").agg(
        F.max("last_e").alias("last_e"),
        F.coalesce(mean_dur, F.lit(0)).alias("mean_dur"),
        F.coalesce(F.sum(F.when(known, F.col("d"))), F.lit(0)).alias("dur"),
        F.try_divide(F.sum(F.when(live, F.col("v") * F.col("d"))), mean_dur).alias("WMEAN"),
        F.max(x).alias("MAX"), F.min(x).alias("MIN"), F.max_by(x, F.when(known, F.col("seq"))).alias("LAST"),
        F.max("reset").isNotNull().alias("was_reset"),
    )
    kept = F.array(*(F.struct(F.lit(a.cf).alias("cf"), F.lit(a.step_ms).cast("bigint").alias("of"), F.lit(a.size).cast("bigint").alias("size"), F.lit(float(a.xff)).alias("xff")) for a in spec.archives))
    g = g.withColumn("a", F.explode(F.filter(kept, lambda a: a["of"] == F.col("r")))).select("*", "a.*")
    g = g.where(F.col("slot") > _floor(F.col("last_e"), F.col("r")) - F.col("size") * F.col("r"))
    mean = F.col("cf") == "WMEAN"
    dur = F.when(mean, F.col("mean_dur")).otherwise(F.col("dur"))
    value = F.when(mean, F.col("WMEAN")).when(F.col("cf") == "MAX", F.col("MAX")).when(F.col("cf") == "MIN", F.col("MIN")).otherwise(F.col("LAST"))
    nothing = F.when((mean & F.col("was_reset")) | (F.col("xff") > 0), None).otherwise(0.0)
    v = F.when(dur / F.col("r") < F.col("xff"), None).when(dur == 0, nothing).otherwise(value)
    return g.select("name", "cf", F.col("r").alias("step_ms"), F.col("slot").alias("t"), v.alias("v"))


def weighted_mean(df: DataFrame, keys: list[str], value: str, duration: str) -> DataFrame:
    """Duration-weighted mean per group; unknown values and durations of 0 or less don't count."""
    d, v = F.col(duration), F.col(value)
    ok = v.isNotNull() & ~F.isnan(v) & (d > 0)
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(ok, v * d)), F.sum(F.when(ok, d))).alias("v"), F.coalesce(F.sum(F.when(ok, d)), F.lit(0)).alias("dur")
    )


def clock_durations(df: DataFrame, name: str = "name", ms: str = "ms") -> DataFrame:
    """Each reading with the time until the next one of its series (null for the last): the duration of
    a gauge's value."""
    w = Window.partitionBy(name).orderBy(ms)
    return df.withColumn("dur_ms", F.lead(ms).over(w) - F.col(ms))


def pdp_summary(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Greatest, least and last known value per group; `order` says which is last."""
    known = F.col(value).isNotNull() & ~F.isnan(value)
    v = F.when(known, F.col(value))
    return df.groupBy(*keys).agg(F.max(v).alias("v_max"), F.min(v).alias("v_min"), F.max_by(v, F.when(known, F.col(order))).alias("v_last"))
