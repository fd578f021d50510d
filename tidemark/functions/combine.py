"""Cross-series functions: many series become one value per slot (or per group and slot).

Missing values: sum counts them as 0; the average divides by all series; max, min and range skip them;
products and differences are missing if any member is.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import COLUMNS, Frame, merge, regroup
from .registry import register

HOW = {
    "sum": lambda: F.coalesce(F.sum("v"), F.lit(0.0)),
    "avg": lambda: F.coalesce(F.sum("v"), F.lit(0.0)) / F.count("*"),
    "max": lambda: F.max("v"),
    "min": lambda: F.min("v"),
    "multiply": lambda: F.when(F.count("v") == F.count("*"), F.product("v")),
    "range": lambda: F.max("v") - F.min("v"),
    "count": lambda: F.count("*").cast("double"),
    "nonnull": lambda: F.count("v").cast("double"),
}
#: Names under which a function may be given to groupByNode.
BY_NAME = {
    "sum": "sum", "sumSeries": "sum", "avg": "avg", "averageSeries": "avg", "max": "max", "maxSeries": "max", "min": "min", "minSeries": "min",
    "multiplySeries": "multiply", "rangeOfSeries": "range", "countSeries": "count", "isNonNull": "nonnull",
}


def one(f: Frame, legend: str, value, extra: tuple = ()) -> Frame:
    """Fold a frame to a single series named by the text of the call."""
    g = f.df.groupBy("t", *extra).agg(value.alias("v"))
    lit = F.lit(legend)
    return Frame(g.select(lit.alias("name"), lit.alias("alias"), "t", "v", F.lit(f.step_ms).cast("bigint").alias("step_ms")), frozenset([f.step_ms]))


def _fold(how: str):
    def fn(ctx, *series):
        return one(merge(list(series)), ctx.legend, HOW[how]())

    return fn


for _names, _how in (
    ("sumSeries sum", "sum"), ("averageSeries avg", "avg"), ("maxSeries max", "max"), ("minSeries min", "min"),
    ("multiplySeries", "multiply"), ("rangeOfSeries", "range"), ("countSeries", "count"),
):
    register(_names, "seriesList:series*", _fold(_how))


@register("isNonNull", "seriesList:series")
def is_non_null(ctx, s):
    return one(regroup(s, s.step_ms), ctx.legend, HOW["nonnull"]())


@register("percentileOfSeries", "seriesList:series n:number interpolate:bool=false")
def percentile_of_series(ctx, s, n, _interpolate):
    """Percentile across the series of a slot; missing values count as the lowest. The two values next to
    the position p * (n + 1) are picked by rank, so that no slot is collected."""
    slot = Window.partitionBy("t")
    d = s.df.select("t", "v", F.row_number().over(slot.orderBy(F.asc_nulls_first("v"))).alias("rank"), F.count("*").over(slot).alias("n"))
    pos = F.lit(n / 100) * (F.col("n") + 1)
    low = F.greatest(F.lit(1), F.least(F.col("n"), F.floor(pos)))
    part = F.when((pos < 1) | (pos >= F.col("n")), 0.0).otherwise(pos - F.floor(pos))
    d = d.withColumn("low", low).withColumn("part", part).where((F.col("rank") == F.col("low")) | ((F.col("part") > 0) & (F.col("rank") == F.col("low") + 1)))
    a = F.max(F.when(F.col("rank") == F.col("low"), F.col("v")))
    b = F.max(F.when(F.col("rank") > F.col("low"), F.col("v")))
    f = F.max("part")
    return one(replace(s, df=d), ctx.legend, F.when(f == 0, a).otherwise(a + f * (b - a)))


@register("group", "seriesList:series*")
def group(ctx, *series):
    return merge(list(series))


def _ordered(series) -> DataFrame:
    """Rows with their place `ord` = (argument, name); an argument is left out once the arguments before
    it have brought two series or more."""
    step = merge(list(series)).step_ms
    rows = reduce(DataFrame.unionByName, [regroup(f, step).df.select(*COLUMNS, F.lit(i).alias("arg")) for i, f in enumerate(series)])
    if len(series) > 2:
        sizes = rows.groupBy("arg").agg(F.countDistinct("name").alias("n"))
        before = sizes.alias("a").join(sizes.alias("b"), F.col("b.arg") < F.col("a.arg"), "left").groupBy("a.arg").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
        rows = rows.join(F.broadcast(before.where("before < 2").select("arg")), "arg", "left_semi")
    return rows.withColumn("ord", F.struct("arg", "name"))


@register("diffSeries", "seriesList:series*")
def diff_series(ctx, *series):
    """The first series minus all others; any missing member makes the slot missing."""
    f = Frame(_ordered(series), merge(list(series)).steps)
    n = F.count("*")
    value = F.when(n < 2, F.raise_error(F.lit("diffSeries: at least two series are needed")).cast("double"))
    value = value.when(F.count("v") == n, 2 * F.min_by("v", "ord") - F.sum("v"))
    return one(f, ctx.legend, value)


@register("divideSeries", "seriesList:series*")
def divide_series(ctx, *series):
    """The first of exactly two series divided by the second; division by zero is missing."""
    f = Frame(_ordered(series), merge(list(series)).steps)
    value = F.when(F.count("*") != 2, F.raise_error(F.lit("divideSeries: exactly two series are needed")).cast("double"))
    return one(f, ctx.legend, value.otherwise(F.try_divide(F.min_by("v", "ord"), F.max_by("v", "ord"))))


@register("asPercent", "seriesList:series total:numseries=none")
def as_percent(ctx, s, total):
    """Each series as a percentage of the sum of all, of a number, or of the sum of other series."""
    s = regroup(s, s.step_ms)
    if isinstance(total, Frame):
        both = merge([s, total]).step_ms
        s = regroup(s, both)
        t = regroup(total, both).df.groupBy("t").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))
        df = s.df.join(t, "t", "left")
    elif total is None:
        t = s.df.groupBy("t").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))
        df = s.df.join(t, "t")
    else:
        df = s.df.withColumn("total", F.lit(float(total)))
    word = "asPersent" if ctx.compat else "asPercent"
    df = df.withColumn("v", F.try_divide(F.col("v"), F.col("total")) * 100).withColumn("alias", F.concat(F.lit(f"{word}("), "alias", F.lit(")")))
    return Frame(df.select(*COLUMNS), s.steps)


def component(name, node: int):
    """Component `node` of a dotted name, counted from 0; null where the name is too short."""
    return F.get(F.split(name, "[.]"), F.lit(int(node)))


@register("weightedAverage", "seriesListAvg:series seriesListWeight:series node:number")
def weighted_average(ctx, a, w, node):
    """Pair series by a component of their names; sum of value times weight over sum of weights."""
    step = merge([a, w]).step_ms
    side = lambda f, v: regroup(f, step).df.select(component(F.col("name"), node).alias("key"), "t", F.col("v").alias(v)).where("key is not null")
    j = side(a, "a").join(side(w, "w"), ["key", "t"])
    total = F.sum("w")
    f = Frame(j.select("t", (F.col("a") * F.col("w")).alias("v"), "w"), frozenset([step]))
    return one(f, ctx.legend, F.when(total != 0, F.sum("v") / total))


def _keyed(f: Frame, key, how: str) -> Frame:
    g = f.df.withColumn("key", key).where("key is not null").groupBy("key", "t").agg(HOW[how]().alias("v"))
    return Frame(g.select(F.col("key").alias("name"), F.col("key").alias("alias"), "t", "v", F.lit(f.step_ms).cast("bigint").alias("step_ms")), frozenset([f.step_ms]))


def _without(positions):
    drop = sorted({int(p) for p in positions})
    parts = F.split("name", "[.]")
    return F.array_join(F.filter(parts, lambda x, i: ~i.isin(drop)) if drop else parts, ".")


@register("sumSeriesWithWildcards", "spec:series position:number*")
def sum_with_wildcards(ctx, s, *positions):
    return _keyed(regroup(s, s.step_ms), _without(positions), "sum")


@register("averageSeriesWithWildcards", "spec:series position:number*")
def average_with_wildcards(ctx, s, *positions):
    return _keyed(regroup(s, s.step_ms), _without(positions), "avg")


@register("groupByNode", "spec:series node:number func:string")
def group_by_node(ctx, s, node, func):
    if func not in BY_NAME:
        raise ValueError(f"groupByNode: {func} is not a function of one list of series")
    return _keyed(regroup(s, s.step_ms), component(F.col("name"), node), BY_NAME[func])
