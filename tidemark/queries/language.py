"""One query per function of the language over frames made from events, lineitem and orders.

Each entry holds the expression, run through parser, binder and frame builder, and the body of the SQL
it must agree with over a relation f(name, t, v) of the same frame. Values are rounded to 6 decimals.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsl.engine import Engine
from ..frame import Frame, literal_series
from ..plans.store import Archive, Store
from ..session import slot_end, table

HOUR, DAY = 3_600_000, 86_400_000
#: Keeps exact halves from being rounded up by one engine and down by the other.
SHIFT = 3.3e-9


def _archive(points: DataFrame, step: int, how: str) -> tuple[DataFrame, Archive] | None:
    r = points.agg(F.min("ms").alias("lo"), F.max("ms").alias("hi")).first()
    if r["lo"] is None:
        return None
    lo, hi = (-(-x // step) * step for x in (r["lo"], r["hi"]))
    cells = points.groupBy("name", slot_end("ms", step).alias("t")).agg(getattr(F, how)("value").alias("v"))
    rows = cells.select("name", F.lit("WMEAN").alias("cf"), F.lit(step).cast("bigint").alias("step_ms"), "t", "v")
    return rows, Archive(step, (hi - lo) // step + 1, hi)


def event_points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    name = F.concat(F.lit("events."), "event_type", F.lit(".u"), (F.col("user_id") % 3).cast("string"))
    return e.select(name.alias("name"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value")


def _sales(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.select(
        F.concat(F.lit("sales."), "l_returnflag", F.lit("."), "l_linestatus").alias("name"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ms"),
        F.col("l_extendedprice").alias("value"),
    )


def _orders(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders")
    return x.select(
        F.concat(F.lit("orders."), F.lower("o_orderstatus"), F.lit("."), F.substring("o_orderpriority", 1, 1)).alias("name"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"),
        F.col("o_totalprice").alias("value"),
    )


FRAMES = {
    "ev_1h": (event_points, HOUR, "avg"), "ev_6h": (event_points, 6 * HOUR, "avg"), "li_1d": (_sales, DAY, "sum"), "ord_1d": (_orders, DAY, "sum"),
}

_NAME_SQL = {
    "ev": ("'events.' || event_type || '.u' || (user_id % 3)", "ts", "value", "events"),
    "li": ("'sales.' || l_returnflag || '.' || l_linestatus", "l_shipdate", "l_extendedprice", "lineitem"),
    "ord": ("'orders.' || lower(o_orderstatus) || '.' || substr(o_orderpriority, 1, 1)", "o_orderdate", "o_totalprice", "orders"),
}


def _frame_sql(frame: str) -> str:
    name, ts, value, source = _NAME_SQL[frame.split("_")[0]]
    _, step, how = FRAMES[frame]
    return f"""with p as (select {name} as name, ((epoch_us({ts}) // 1000 - 1) // {step} + 1) * {step} as t, {value} as value from {source}),
a as (select name, t, {how}(value) as v from p group by 1, 2), b as (select min(t) as lo, max(t) as hi from p),
g as (select n.name, x.t from (select distinct name from p) n, (select unnest(range(lo, hi + 1, {step})) as t from b) x),
f as (select g.name, g.t, a.v from g left join a using (name, t)) """


def engine(spark: SparkSession, d: str, frame: str = "ev_1h", max_points: int = 0, compat: bool = False) -> Engine:
    make, step, how = FRAMES[frame]
    found = _archive(make(spark, d), step, how)
    if found is None:
        empty = spark.createDataFrame([], "name string, cf string, step_ms bigint, t bigint, v double")
        return Engine(spark, Store(empty, [Archive(step, 1, 0)]), -step, 0, max_points, compat)
    rows, a = found
    return Engine(spark, Store(rows, [a]), a.begins_ms, a.latest_ms, max_points, compat)


def output(f: Frame, digits: int = 6) -> DataFrame:
    return f.df.select(F.coalesce("alias", "name").alias("target"), F.col("t").alias("t_ms"), F.round(F.col("v") + SHIFT, digits).alias("v"))


def run(spark: SparkSession, d: str, text: str, frame: str = "ev_1h", max_points: int = 0, compat: bool = False, digits: int = 6) -> DataFrame:
    return output(engine(spark, d, frame, max_points, compat).query(text), digits)


def _fold(value: str, legend: str) -> str:
    return f"select '{legend}' as target, t as t_ms, round({value}, 6) as v from f group by t"


def _each(value: str, target: str = "name", extra: str = "") -> str:
    return f"select {target} as target, t as t_ms, round({value}, 6) as v from f {extra}"


def _windowed(value: str, where: str = "true") -> str:
    """value may use w (by time) and whole-series windows over x."""
    return f"select name as target, t as t_ms, round(v, 6) as v from (select name, t, {value} as v, row_number() over w as k from f window w as (partition by name order by t)) where {where}"


def _kept(having: str) -> str:
    return f"select name as target, t as t_ms, round(v, 6) as v from f where name in (select name from f group by name having {having})"


def _top(value: str, n: int, way: str) -> str:
    return f"select name as target, t as t_ms, round(v, 6) as v from f where name in (select name from (select name, {value} as x from f group by name) order by x {way} nulls last, name limit {n})"


_Q6 = """case when pos < 1 then s[1].v when pos >= n then s[n].v when pos = floor(pos) then s[pos::int].v
  else s[floor(pos)::int].v + (pos - floor(pos)) * (s[floor(pos)::int + 1].v - s[floor(pos)::int].v) end"""


def _quantiles(by: str, p: float) -> str:
    return f"""q as (select {by}, {_Q6} as q from (select {by}, s, len(s) as n, {p} * (len(s) + 1) as pos from
  (select {by}, list_sort(list({{'has': v is not null, 'v': v}}), 'asc', 'nulls first') as s from f group by {by})))"""


E, S = "events.*.*", "'sum'"
SPECS: dict[str, tuple[str, str | None, str]] = {
    # combine
    "dsl_sum_series": (f"sumSeries({E})", _fold("coalesce(sum(v), 0)", f"sumSeries({E})"), "ev_1h"),
    "dsl_sum": ("sum(events.view.*)", _fold("coalesce(sum(v) filter (where name like 'events.view.%'), 0)", "sum(events.view.*)"), "ev_1h"),
    "dsl_average_series": (f"averageSeries({E})", _fold("coalesce(sum(v), 0) / count(*)", f"averageSeries({E})"), "ev_1h"),
    "dsl_avg": (f"avg({E})", _fold("coalesce(sum(v), 0) / count(*)", f"avg({E})"), "ev_6h"),
    "dsl_max_series": (f"maxSeries({E})", _fold("max(v)", f"maxSeries({E})"), "ev_1h"),
    "dsl_max": ("max(sales.*.*)", _fold("max(v)", "max(sales.*.*)"), "li_1d"),
    "dsl_min_series": (f"minSeries({E})", _fold("min(v)", f"minSeries({E})"), "ev_1h"),
    "dsl_min": ("min(orders.*.*)", _fold("min(v)", "min(orders.*.*)"), "ord_1d"),
    "dsl_multiply_series": ("multiplySeries(events.{view,click}.u0)", _fold("case when count(v) filter (where name in ('events.view.u0', 'events.click.u0')) = 2 then product(v) filter (where name in ('events.view.u0', 'events.click.u0')) end", "multiplySeries(events.{view,click}.u0)"), "ev_1h"),
    "dsl_range_of_series": (f"rangeOfSeries({E})", _fold("max(v) - min(v)", f"rangeOfSeries({E})"), "ev_1h"),
    "dsl_percentile_of_series": (f"percentileOfSeries({E}, 90)", ", " + _quantiles("t", 0.9) + f" select 'percentileOfSeries({E}, 90)' as target, t as t_ms, round(q, 6) as v from q", "ev_1h"),
    "dsl_count_series": (f"countSeries({E})", _fold("count(*)::double", f"countSeries({E})"), "ev_1h"),
    "dsl_is_non_null": (f"isNonNull({E})", _fold("count(v)::double", f"isNonNull({E})"), "ev_1h"),
    "dsl_diff_series": ("diffSeries(events.click.*)", "select 'diffSeries(events.click.*)' as target, t as t_ms, round(case when count(v) = count(*) then 2 * max(v) filter (where name = 'events.click.u0') - sum(v) end, 6) as v from f where name like 'events.click.%' group by t", "ev_6h"),
    "dsl_divide_series": ("divideSeries(events.click.u0, events.view.u0)", "select 'divideSeries(events.click.u0, events.view.u0)' as target, t as t_ms, round(max(v) filter (where name = 'events.click.u0') / nullif(max(v) filter (where name = 'events.view.u0'), 0), 6) as v from f where name in ('events.click.u0', 'events.view.u0') group by t", "ev_6h"),
    "dsl_as_percent": (f"asPercent({E})", _each("v / nullif(coalesce(sum(v) over (partition by t), 0), 0) * 100", "'asPercent(' || name || ')'"), "ev_1h"),
    "dsl_as_percent_number": (f"asPercent({E}, 250)", _each("v / 250 * 100", "'asPercent(' || name || ')'"), "ev_1h"),
    "dsl_as_percent_series": ("asPercent(events.view.*, events.*.u0)", "select 'asPercent(' || name || ')' as target, t as t_ms, round(v / nullif(total, 0) * 100, 6) as v from (select *, coalesce(sum(v) filter (where name like '%.u0') over (partition by t), 0) as total from f) where name like 'events.view.%'", "ev_1h"),
    "dsl_weighted_average": ("weightedAverage(events.view.*, events.click.*, 2)", "select 'weightedAverage(events.view.*, events.click.*, 2)' as target, a.t as t_ms, round(case when sum(b.v) <> 0 then sum(a.v * b.v) / sum(b.v) end, 6) as v from f a join f b on a.t = b.t and split_part(a.name, '.', 3) = split_part(b.name, '.', 3) where a.name like 'events.view.%' and b.name like 'events.click.%' group by a.t", "ev_6h"),
    "dsl_group": ("group(events.view.*, events.*.u1)", _each("v", "name", "where name like 'events.view.%' or name like '%.u1'"), "ev_1h"),
    "dsl_sum_with_wildcards": (f"sumSeriesWithWildcards({E}, 1)", "select 'events.' || split_part(name, '.', 3) as target, t as t_ms, round(coalesce(sum(v), 0), 6) as v from f group by 1, 2", "ev_1h"),
    "dsl_average_with_wildcards": (f"averageSeriesWithWildcards({E}, 2)", "select 'events.' || split_part(name, '.', 2) as target, t as t_ms, round(coalesce(sum(v), 0) / count(*), 6) as v from f group by 1, 2", "ev_1h"),
    "dsl_group_by_node": (f"groupByNode({E}, 1, 'maxSeries')", "select split_part(name, '.', 2) as target, t as t_ms, round(max(v), 6) as v from f group by 1, 2", "ev_1h"),
    # each series
    "dsl_absolute": (f"absolute(offset({E}, -60))", _each("abs(v - 60)"), "ev_1h"),
    "dsl_scale": (f"scale({E}, 2.5)", _each("v * 2.5"), "ev_1h"),
    "dsl_scale_to_seconds": (f"scaleToSeconds({E}, 60)", _each("v * 60"), "ev_1h"),
    "dsl_offset": (f"offset({E}, 7)", _each("v + 7"), "ev_1h"),
    "dsl_offset_to_zero": (f"offsetToZero({E})", _each("v - min(v) over (partition by name)"), "ev_1h"),
    "dsl_logarithm": (f"logarithm(offset({E}, -60))", _each("case when v > 60 then ln(v - 60) / ln(10) end"), "ev_1h"),
    "dsl_log": (f"log({E}, 2)", _each("case when v > 0 then ln(v) / ln(2) end"), "ev_1h"),
    "dsl_derivative": (f"derivative({E})", _windowed("v - lag(v) over w"), "ev_1h"),
    "dsl_non_negative_derivative": (f"nonNegativeDerivative({E}, 400)", _windowed("case when v - lag(v) over w > 0 then v - lag(v) over w when 400 > v then (400 - lag(v) over w) + v + 1 end"), "ev_1h"),
    "dsl_integral": (f"integral({E})", "select name as target, t as t_ms, round(coalesce(sum(v) over (partition by name order by t rows between unbounded preceding and 1 preceding), 0), 3) as v from f", "ev_1h"),
    "dsl_transform_null": (f"transformNull({E}, -1)", _each("coalesce(v, -1)"), "ev_1h"),
    "dsl_keep_last_value": (f"keepLastValue({E}, 2)", "select name as target, t as t_ms, round(case when v is not null then v when k <= 2 then l end, 6) as v from (select *, row_number() over (partition by name, i order by t) - case when i > 0 then 1 else 0 end as k from (select *, count(v) over (partition by name order by t) as i, last_value(v ignore nulls) over (partition by name order by t) as l from f))", "ev_1h"),
    "dsl_changed": (f"changed({E})", _windowed("case when v = lag(v) over w then 0.0 else 1.0 end"), "ev_1h"),
    "dsl_hitcount": (f"hitcount({E}, '1min')", _each("v * 60"), "ev_1h"),
    "dsl_summarize": (f"summarize({E}, '1h')", _each("v * 3600"), "ev_1h"),
    "dsl_summarize_avg": (f"summarize({E}, '1h', 'avg')", _each("v"), "ev_1h"),
    "dsl_time_shift": (f"timeShift({E}, '1d')", f"select name as target, t + {DAY} as t_ms, round(v, 6) as v from f", "ev_1h"),
    "dsl_time_stack": (f"timeStack({E}, '1d', 0, 2)", f"select 'timeStack(' || name || ',' || i || ')' as target, t + i * {DAY} as t_ms, round(v, 6) as v from f, b, (select unnest([0, 1, 2]) as i) where t > hi - (i + 1) * {DAY} and t <= hi - i * {DAY}", "ev_1h"),
    "dsl_moving_average": (f"movingAverage({E}, 5)", _windowed("case when count(v) over (w rows 4 preceding) = 5 then avg(v) over (w rows 4 preceding) end", "k > 5"), "ev_6h"),
    "dsl_moving_average_duration": (f"movingAverage({E}, '18h')", _windowed("case when count(v) over (w rows 2 preceding) = 3 then avg(v) over (w rows 2 preceding) end", "k > 3"), "ev_6h"),
    "dsl_moving_median": (f"movingMedian({E}, 4)", _windowed("case when count(v) over (w rows 3 preceding) = 4 then quantile_cont(v, 0.5) over (w rows 3 preceding) end", "k > 4"), "ev_6h"),
    "dsl_stdev": (f"stdev({E}, 6)", _windowed("case when count(v) over (w rows 5 preceding) = 6 then stddev_samp(v) over (w rows 5 preceding) end", "k > 6"), "ev_6h"),
    "dsl_n_percentile": (f"nPercentile({E}, 75)", ", " + _quantiles("name", 0.75) + " select name as target, t as t_ms, round(q, 6) as v from f join q using (name)", "ev_1h"),
    "dsl_remove_above_percentile": (f"removeAbovePercentile({E}, 75)", ", " + _quantiles("name", 0.75) + " select name as target, t as t_ms, round(case when not coalesce(v > q, false) then v end, 6) as v from f join q using (name)", "ev_6h"),
    "dsl_remove_below_percentile": (f"removeBelowPercentile({E}, 25)", ", " + _quantiles("name", 0.25) + " select name as target, t as t_ms, round(case when not coalesce(v < q, false) then v end, 6) as v from f join q using (name)", "ev_6h"),
    "dsl_remove_above_value": (f"removeAboveValue({E}, 60)", _each("case when v <= 60 then v end"), "ev_1h"),
    "dsl_remove_below_value": (f"removeBelowValue({E}, 60)", _each("case when v >= 60 then v end"), "ev_1h"),
    # selection and names
    "dsl_exclude": (f"exclude({E}, 'u[01]')", _each("v", "name", "where not regexp_matches(name, 'u[01]')"), "ev_1h"),
    "dsl_limit": (f"limit({E}, 4)", "select name as target, t as t_ms, round(v, 6) as v from f where name in (select distinct name from f order by name limit 4)", "ev_1h"),
    "dsl_highest_current": (f"highestCurrent({E}, 3)", _top("arg_max_null(v, t)", 3, "desc"), "ev_6h"),
    "dsl_highest_max": (f"highestMax({E}, 3)", _top("max(v)", 3, "desc"), "ev_1h"),
    "dsl_lowest_average": (f"lowestAverage({E}, 3)", _top("case when count(v) = count(*) then avg(v) end", 3, "asc"), "ev_6h"),
    "dsl_lowest_current": (f"lowestCurrent({E}, 3)", _top("arg_max_null(v, t)", 3, "asc"), "ev_6h"),
    "dsl_most_deviant": (f"mostDeviant({E}, 3)", _top("case when count(v) = count(*) then stddev_samp(v) end", 3, "desc"), "ev_6h"),
    "dsl_maximum_above": (f"maximumAbove({E}, 300)", _kept("max(v) > 300 or max(v) is null"), "ev_1h"),
    "dsl_maximum_below": (f"maximumBelow({E}, 300)", _kept("max(v) < 300 or max(v) is null"), "ev_1h"),
    "dsl_minimum_above": (f"minimumAbove({E}, 1)", _kept("min(v) > 1 or min(v) is null"), "ev_1h"),
    "dsl_minimum_below": (f"minimumBelow({E}, 1)", _kept("min(v) < 1 or min(v) is null"), "ev_1h"),
    "dsl_use_series_above": (f"useSeriesAbove({E}, 300, 'events', 'seen')", _kept("max(v) > 300 or max(v) is null").replace("select name as target", "select replace(name, 'events', 'seen') as target"), "ev_1h"),
    "dsl_alias": ("alias(events.view.u0, 'views')", _each("v", "'views'", "where name = 'events.view.u0'"), "ev_1h"),
    "dsl_alias_by_metric": ("aliasByMetric(events.view.*)", _each("v", "split_part(name, '.', 3)", "where name like 'events.view.%'"), "ev_1h"),
    "dsl_alias_by_node": (f"aliasByNode({E}, 1, -1)", _each("v", "split_part(name, '.', 2) || '.' || split_part(name, '.', 3)"), "ev_1h"),
    "dsl_alias_sub": (f"aliasSub({E}, '^events[.](.*)[.]u', '\\1-')", _each("v", "regexp_replace(name, '^events[.](.*)[.]u', '\\1-')"), "ev_1h"),
    "dsl_color": ("color(events.view.*, 'red')", _each("v", "name", "where name like 'events.view.%'"), "ev_1h"),
    # language
    "dsl_chain": ("group(events.view.*).scale(2).offset(1)", _each("v * 2 + 1", "name", "where name like 'events.view.%'"), "ev_1h"),
    "dsl_keywords": ("transformNull(events.view.*, default=3)", _each("coalesce(v, 3)", "name", "where name like 'events.view.%'"), "ev_1h"),
    "dsl_nested": ("sumSeries(scale(events.view.*, 2), events.click.u0)", "select 'sumSeries(scale(events.view.*, 2), events.click.u0)' as target, t as t_ms, round(coalesce(sum(case when name like 'events.view.%' then v * 2 else v end), 0), 6) as v from f where name like 'events.view.%' or name = 'events.click.u0' group by t", "ev_1h"),
    # fitted parameters have no SQL
    "dsl_holt_winters_fitted": ("group(holtWintersForecast(sumSeries(events.*.*)), holtWintersConfidenceBands(sumSeries(events.*.*)), holtWintersAberration(sumSeries(events.*.*)))", None, "ev_6h"),
}

#: Holt-Winters with given parameters: part, alpha, beta, gamma, devScale, value and name in SQL.
HOLT_WINTERS = {
    "dsl_holt_winters_forecast": ("smooth", (0.5, 0.2, 0.5), [("y", "Forecast")]),
    "dsl_holt_winters_bands": ("conf", (0.3, 0.1, 0.4), [("y + y * dev * 3", "ConfidenceUpper"), ("y - y * dev * 3", "ConfidenceLower")]),
    "dsl_holt_winters_aberration": (
        "aberr", (0.3, 0.1, 0.4),
        [("case when x < y - y * dev * 3 then x - (y - y * dev * 3) when x > y + y * dev * 3 then x - (y + y * dev * 3) else 0 end", "Aberration")],
    ),
}


def _holt_winters(show: str, params: tuple, _parts: list) -> str:
    return f"holtWintersForecast(sumSeries({E}), '1d', 7, {', '.join(map(str, params))}, 3, '{show}')"


def _holt_winters_sql(_show: str, params: tuple, parts: list) -> str:
    """The recursion over the hours of the sum of all series; a season has 24."""
    a, b, g = params
    rows = " union all ".join(f"select 'holtWinters{name}(sumSeries({E}))' as target, t as t_ms, case when isfinite({value}) then round({value}, 3) end as v from r" for value, name in parts)
    return (
        _frame_sql("ev_1h").replace("with p", "with recursive p", 1)
        + f""", s as (select t, coalesce(sum(v), 0) as x from f group by t),
ys as (select list(x order by t) as xs, min(t) as t0, count(*)::int as n from s),
m as (select *, list_transform(range(n // 24), lambda j: list_avg(xs[j * 24 + 1 : j * 24 + 24])) as means from ys),
z as (select xs, t0, n, (list_sum(xs[25:48]) - list_sum(xs[1:24])) / 576 as trend,
  list_transform(range(24), lambda k: list_avg(list_transform(range(n // 24), lambda j: xs[j * 24 + k + 1] / means[j + 1]))) as factors from m),
w as (select 0 as i, xs[1] as level, trend, factors as s, list_transform(range(24), lambda k: 0.0::double) as d, xs[1] as y, 0.0::double as dev from z
  union all select i, level, trend, s[:k] || [nf] || s[k + 2:], d[:k] || [nd] || d[k + 2:], y, nd from (
    select *, case when i > 2 then {g} * (1 - case when y / x > 1 then x / y else y / x end) + {1 - g} * d[k + 1] else d[k + 1] end as nd from (
    select *, (level + trend) * nf as y from (
    select *, {b} * (level - last) + {1 - b} * slope as trend, {g} * x / level + {1 - g} * f as nf from (
    select *, {a} * x / f + {1 - a} * (last + slope) as level from (
    select w.i + 1 as i, (w.i + 1) % 24 as k, w.level as last, w.trend as slope, w.s, w.d, z.xs[w.i + 2] as x, w.s[(w.i + 1) % 24 + 1] as f from w, z where w.i + 1 < z.n)))))),
r as (select z.t0 + w.i * {HOUR}::bigint as t, w.y, w.dev, z.xs[w.i + 1] as x from w, z) """
        + rows
    )


def _warm_up(value: str, p: int) -> str:
    """Moving windows of p points under compat: the first p - 1 windows lack point p."""
    return f"""select name as target, t as t_ms, round(case when k < {2 * p} then case when count(u) over e = {p} then {value.format("u", "e")} end
  else case when count(v) over x = {p} then {value.format("v", "x")} end end, 6) as v
from (select *, case when k <> {p} then v end as u from (select *, row_number() over (partition by name order by t) as k from f))
window e as (partition by name order by t rows {p} preceding), x as (partition by name order by t rows {p - 1} preceding) qualify k > {p}"""


COMPAT = {
    "dsl_moving_average_compat": (f"movingAverage({E}, 5)", _warm_up("avg({}) over {}", 5)),
    "dsl_moving_median_compat": (f"movingMedian({E}, 4)", _warm_up("quantile_cont({}, 0.5) over {}", 4)),
    "dsl_stdev_compat": (f"stdev({E}, 6)", _warm_up("stddev_samp({}) over {}", 6)),
}


def _points_query(text: str, points: int):
    return lambda spark, d: run(spark, d, text, "ev_1h", points)


def dsl_literal_series(spark: SparkSession, d: str) -> DataFrame:
    return output(literal_series(spark, "lit", [1.0, None, 3.5], 60_000, 60_000))


QUERIES = {k: partial(run, text=v[0], frame=v[2]) for k, v in SPECS.items()} | {
    k: partial(run, text=_holt_winters(*v), frame="ev_1h", digits=3) for k, v in HOLT_WINTERS.items()
} | {k: partial(run, text=v[0], frame="ev_6h", compat=True) for k, v in COMPAT.items()} | {
    # running sums differ in more than their last digit with the order of summation
    "dsl_integral": partial(run, text=SPECS["dsl_integral"][0], frame=SPECS["dsl_integral"][2], digits=3),
    "dsl_sinusoid": _points_query("sinusoid()", 60),
    "dsl_constant_line": _points_query("constantLine(12.5)", 60),
    "dsl_consolidate_by": _points_query(f"consolidateBy({E}, 'sum')", 100),
    "dsl_literal_series": dsl_literal_series,
}
_ORACLES = {k: _frame_sql(v[2]) + v[1] for k, v in SPECS.items() if v[1]} | {
    k: _holt_winters_sql(*v) for k, v in HOLT_WINTERS.items()
} | {k: _frame_sql("ev_6h") + v[1] for k, v in COMPAT.items()} | {
    "dsl_sinusoid": _frame_sql("ev_1h") + f", w as (select lo - {HOUR} as a, (hi - lo + {HOUR}) // 60 as s from b) select 'sinusoid()' as target, a + s + i * s as t_ms, round(sin(2 * pi() / 60 * i), 6) as v from w, (select unnest(range(60)) as i)",
    "dsl_constant_line": _frame_sql("ev_1h") + f" select 'constantLine(12.5)' as target, hi + i * (hi - lo + {HOUR}) as t_ms, 12.5::double as v from b, (select unnest([0, 1]) as i)",
    "dsl_consolidate_by": _frame_sql("ev_1h") + f", w as (select ((hi - lo + {HOUR}) // 100 // {HOUR} + 1) * {HOUR} as w from b) select name as target, ((t - 1) // w + 1) * w as t_ms, round(avg(v) * any_value((hi - lo + {HOUR}) / 1000 / 100), 6) as v from f, b, w group by 1, 2",
    "dsl_literal_series": "select 'lit' as target, t_ms::bigint as t_ms, v::double as v from (values (60000, 1.0), (120000, null), (180000, 3.5)) x(t_ms, v)",
}
ORACLES = {k: v.replace("round(", f"round({SHIFT} + ") for k, v in _ORACLES.items()}
