"""Functions that keep some of the series. Decisions are aggregates per name and semi-joins, never
driver-side loops; ties are broken by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import register

MEAN = lambda: F.when(F.count("v") == F.count("*"), F.avg("v"))
DEVIATION = lambda: F.when(F.count("v") == F.count("*"), F.stddev_samp("v"))
CURRENT = lambda: F.max_by("v", "t")


def _best(s, value, n, down: bool):
    names = s.df.groupBy("name").agg(value.alias("x"))
    order = F.desc_nulls_last("x") if down else F.asc_nulls_last("x")
    return s.keep(names.orderBy(order, "name").limit(int(n)))


@register("highestCurrent", "seriesList:series n:number=1")
def highest_current(ctx, s, n):
    return _best(s, CURRENT(), n, True)


@register("highestMax", "seriesList:series n:number=1")
def highest_max(ctx, s, n):
    return _best(s, F.max("v"), n, True)


@register("lowestAverage", "seriesList:series n:number=1")
def lowest_average(ctx, s, n):
    """A series with any missing value has no average and comes last."""
    return _best(s, MEAN(), n, False)


@register("lowestCurrent", "seriesList:series n:number=1")
def lowest_current(ctx, s, n):
    return _best(s, CURRENT(), n, False)


@register("mostDeviant", "seriesList:series n:number")
def most_deviant(ctx, s, n):
    return _best(s, DEVIATION(), n, True)


@register("limit", "seriesList:series n:number")
def limit(ctx, s, n):
    return s.keep(s.df.select("name").distinct().orderBy("name").limit(int(n)))


def _threshold(s, value, beyond):
    """Drop the series for which `beyond` is false; series without any value stay."""
    return s.keep(s.df.groupBy("name").agg(value.alias("x")).where(F.col("x").isNull() | beyond(F.col("x"))))


@register("maximumAbove", "seriesList:series n:number")
def maximum_above(ctx, s, n):
    return _threshold(s, F.max("v"), lambda x: x > n)


@register("maximumBelow", "seriesList:series n:number")
def maximum_below(ctx, s, n):
    return _threshold(s, F.max("v"), lambda x: x < n)


@register("minimumAbove", "seriesList:series n:number")
def minimum_above(ctx, s, n):
    return _threshold(s, F.min("v"), lambda x: x > n)


@register("minimumBelow", "seriesList:series n:number")
def minimum_below(ctx, s, n):
    return _threshold(s, F.min("v"), lambda x: x < n)


@register("exclude", "seriesList:series pattern:string")
def exclude(ctx, s, pattern):
    from dataclasses import replace

    return replace(s, df=s.df.where(~F.col("name").rlike(pattern)))


@register("useSeriesAbove", "seriesList:series value:number=0 search:string replace:string")
def use_series_above(ctx, s, value, search, replacement):
    """Series whose maximum exceeds value, shown under a name with `search` replaced literally."""
    from dataclasses import replace

    kept = _threshold(s, F.max("v"), lambda x: x > value)
    return replace(kept, df=kept.df.withColumn("alias", F.replace(F.col("name"), F.lit(search), F.lit(replacement))))
