"""Functions from each series to a series of the same name."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..durations import parse_duration, parse_shift, window_points
from ..frame import COLUMNS, Frame, by_time, quantile, whole
from .registry import register

V = lambda: F.col("v")


def _lag():
    return F.lag("v").over(by_time())


@register("absolute", "seriesList:series")
def absolute(ctx, s):
    return s.with_v(F.abs(V()))


@register("scale", "seriesList:series factor:number")
def scale(ctx, s, factor):
    return s.with_v(V() * factor)


@register("scaleToSeconds", "seriesList:series seconds:number")
def scale_to_seconds(ctx, s, seconds):
    return s.with_v(V() * seconds)


@register("offset", "seriesList:series factor:number")
def offset(ctx, s, factor):
    return s.with_v(V() + factor)


@register("offsetToZero", "seriesList:series")
def offset_to_zero(ctx, s):
    return s.with_v(V() - F.min("v").over(whole()))


@register("logarithm log", "seriesList:series base:number=10")
def logarithm(ctx, s, base):
    """Non-positive values become missing."""
    return s.with_v(F.when(V() > 0, F.log(V()) / math.log(base)))


@register("derivative", "seriesList:series")
def derivative(ctx, s):
    return s.with_v(V() - _lag())


@register("nonNegativeDerivative", "seriesList:series maxValue:number=none")
def non_negative_derivative(ctx, s, most):
    """Positive differences; otherwise missing, or the way over maxValue if that exceeds the value."""
    d = s.df.withColumn("last", _lag())
    v = F.when(V() - F.col("last") > 0, V() - F.col("last"))
    if most is not None:
        v = v.when(F.lit(most) > V(), (F.lit(most) - F.col("last")) + V() + 1)
    return replace(s, df=d.withColumn("v", v).drop("last"))


@register("integral", "seriesList:series")
def integral(ctx, s):
    """Running sum of the earlier values; missing ones add nothing."""
    w = by_time().rowsBetween(Window.unboundedPreceding, -1)
    return s.with_v(F.coalesce(F.sum("v").over(w), F.lit(0.0)))


@register("transformNull", "seriesList:series default:number=0")
def transform_null(ctx, s, default):
    return s.with_v(F.coalesce(V(), F.lit(float(default))))


@register("keepLastValue", "seriesList:series limit:number=0")
def keep_last_value(ctx, s, limit):
    """Fill at most `limit` successive missing values with the last one. Leading ones stay missing (0
    under compat)."""
    up_to = by_time().rowsBetween(Window.unboundedPreceding, 0)
    d = s.df.withColumn("island", F.count("v").over(up_to)).withColumn("last", F.last("v", True).over(up_to))
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("name", "island").orderBy("t")))
    k = F.col("k") - F.when(F.col("island") > 0, 1).otherwise(0)
    fill = F.coalesce("last", F.lit(0.0)) if ctx.compat else F.col("last")
    return replace(s, df=d.withColumn("v", F.when(V().isNotNull(), V()).when(k <= int(limit), fill)).select(*COLUMNS))


@register("changed", "seriesList:series")
def changed(ctx, s):
    """0 where the value equals the one before, else 1; missing equals nothing."""
    return s.with_v(F.when(V() == _lag(), 0.0).otherwise(1.0))


@register("hitcount", "seriesList:series intervalString:string alignToInterval:bool=false")
def hitcount(ctx, s, interval, _align):
    return s.with_v(V() * (parse_duration(interval) / 1000))


@register("summarize", "seriesList:series intervalString:string func:string=sum alignToFrom:bool=false")
def summarize(ctx, s, interval, func, _align):
    return s.with_v(V() * (parse_duration(interval) / 1000)) if func == "sum" else s


@register("consolidateBy", "seriesList:series consolidationFunc:string")
def consolidate_by(ctx, s, func):
    if func == "sum" and ctx.max_points > 0:
        return s.with_v(V() * ((ctx.to_ms - ctx.from_ms) / 1000 / ctx.max_points))
    return s


@register("timeShift", "seriesList:series timeShift:string resetEnd:bool=true")
def time_shift(ctx, s, shift, _reset):
    return replace(s, df=s.df.withColumn("t", F.col("t") + F.lit(parse_shift(shift)).cast("bigint")))


@register("timeStack", "pattern:series timeShiftUnit:string timeShiftStart:number timeShiftEnd:number")
def time_stack(ctx, s, unit, begin, end):
    """One copy of each series per i in begin..end: the window (to - (i+1) p, to - i p], moved forward i p.

    The pattern is fetched over the whole stretch, so the copies come from one read of the archive.
    """
    p = abs(parse_duration(unit))
    parts = []
    for i in range(int(begin), int(end) + 1):
        d = s.df.where((F.col("t") > ctx.to_ms - (i + 1) * p) & (F.col("t") <= ctx.to_ms - i * p))
        tag = lambda c: F.concat(F.lit("timeStack("), c, F.lit(f",{i})"))  # noqa: E731, B023
        parts.append(d.select(tag(F.col("name")).alias("name"), tag(F.col("alias")).alias("alias"), (F.col("t") + i * p).alias("t"), "v", "step_ms"))
    return replace(s, df=reduce(DataFrame.unionByName, parts) if parts else s.df.limit(0))


def _moving(ctx, s: Frame, p: int, value) -> Frame:
    """Trailing windows of p points; the first p points are not put out. Windows are exact, but under
    compat the first p - 1 of them span p + 1 points without point p, whose place the next one takes."""
    d = s.df.withColumn("k", F.row_number().over(by_time()))
    guarded = lambda c, w: F.when(F.count(c).over(w) == p, value(c, w))
    v = guarded("v", by_time().rowsBetween(-(p - 1), 0))
    if ctx.compat:
        d = d.withColumn("u", F.when(F.col("k") != p, V()))
        v = F.when(F.col("k") < 2 * p, guarded("u", by_time().rowsBetween(-p, 0))).otherwise(v)
    return replace(s, df=d.withColumn("v", v).where(F.col("k") > p).select(*COLUMNS))


def _points(s: Frame, text: str, median: bool) -> int:
    return max(1, window_points(str(text), s.step_ms, median))


@register("movingAverage", "seriesList:series windowSize:string")
def moving_average(ctx, s, size):
    """Mean of the trailing window; a missing value in it makes the mean missing."""
    p = _points(s, size, False)
    return _moving(ctx, s, p, lambda c, w: F.avg(c).over(w))


@register("movingMedian", "seriesList:series windowSize:string")
def moving_median(ctx, s, size):
    p = _points(s, size, True)
    return _moving(ctx, s, p, lambda c, w: F.percentile(c, F.lit(0.5)).over(w))


@register("stdev", "seriesList:series points:number windowTolerance:number=0.1")
def stdev(ctx, s, points, _tolerance):
    """Moving sample standard deviation."""
    p = max(1, int(points))
    return _moving(ctx, s, p, lambda c, w: F.stddev_samp(c).over(w))


def _series_quantile(s: Frame, n: float) -> DataFrame:
    """(name, q): percentile n of each whole series, missing values counting as the lowest. One series
    is one group: its slots are bounded by the archive's size."""
    values = F.transform(F.collect_list(F.struct("v")), lambda x: x["v"])
    return s.df.groupBy("name").agg(quantile(values, n / 100).alias("q"))


@register("nPercentile", "seriesList:series n:number")
def n_percentile(ctx, s, n):
    return replace(s, df=s.df.join(_series_quantile(s, n), "name").withColumn("v", F.col("q")).select(*COLUMNS))


@register("removeAbovePercentile", "seriesList:series n:number")
def remove_above_percentile(ctx, s, n):
    return replace(s, df=s.df.join(_series_quantile(s, n), "name").withColumn("v", F.when(~F.coalesce(V() > F.col("q"), F.lit(False)), V())).select(*COLUMNS))


@register("removeBelowPercentile", "seriesList:series n:number")
def remove_below_percentile(ctx, s, n):
    return replace(s, df=s.df.join(_series_quantile(s, n), "name").withColumn("v", F.when(~F.coalesce(V() < F.col("q"), F.lit(False)), V())).select(*COLUMNS))


@register("removeAboveValue", "seriesList:series n:number")
def remove_above_value(ctx, s, n):
    return s.with_v(F.when(V() <= n, V()))


@register("removeBelowValue", "seriesList:series n:number")
def remove_below_value(ctx, s, n):
    return s.with_v(F.when(V() >= n, V()))


@register("sinusoid", "")
def sinusoid(ctx):
    """One cycle in maxPoints samples, the first one step after `from`."""
    n = max(1, int(ctx.max_points))
    step = max(1, (ctx.to_ms - ctx.from_ms) // n)
    d = ctx.spark.range(n).select(
        F.lit(ctx.legend).alias("name"), F.lit(ctx.legend).alias("alias"), (F.lit(ctx.from_ms + step) + F.col("id") * step).alias("t"),
        F.sin(F.lit(2 * math.pi / n) * F.col("id")).alias("v"), F.lit(step).cast("bigint").alias("step_ms"),
    )
    return Frame(d, frozenset([step]))


@register("constantLine", "value:number")
def constant_line(ctx, value):
    """Two points, at `to` and one range later."""
    step = max(1, ctx.to_ms - ctx.from_ms)
    d = ctx.spark.range(2).select(
        F.lit(ctx.legend).alias("name"), F.lit(ctx.legend).alias("alias"), (F.lit(ctx.to_ms) + F.col("id") * step).alias("t"),
        F.lit(float(value)).alias("v"), F.lit(step).cast("bigint").alias("step_ms"),
    )
    return Frame(d, frozenset([step]))
