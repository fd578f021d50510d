"""Queries for scans, parsers, consolidation, statsd aggregation, views and answers."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import from_points, points_step, regroup
from ..names import clean_name, glob_filter
from ..operators import consolidate as con
from ..operators import statsd
from ..plans import render, spec, store
from ..session import cut, slot_end, table
from ..sources import text
from .language import DAY, HOUR, SHIFT, _frame_sql, engine, event_points

MIN = 60_000


def _r(c: str):
    return F.round(c, 9).alias(c)


# ---- consolidation


def _spec(cfs: tuple[str, ...], xff: float, heartbeat: int = 120 * MIN, size: int = 10**6) -> spec.SeriesSpec:
    return spec.SeriesSpec(10 * MIN, heartbeat, tuple(spec.ArchiveSpec(cf, r, size, xff) for cf in cfs for r in (10 * MIN, HOUR, 6 * HOUR)))


SPECS = {
    "consolidate_wmean": _spec(("WMEAN",), 0.5),
    "consolidate_wmean_xff0": _spec(("WMEAN",), 0.0),
    "consolidate_minmaxlast": _spec(("MIN", "MAX", "LAST"), 0.0),
    "consolidate_retention": _spec(("WMEAN",), 0.0, size=100),
    "consolidate_heartbeat0": _spec(("WMEAN", "MIN", "MAX", "LAST"), 0.5, 0),
}


def consolidated(spark: SparkSession, d: str, name: str) -> DataFrame:
    return con.consolidate(event_points(spark, d), SPECS[name]).select("name", "cf", "step_ms", F.col("t").alias("t_ms"), F.round(F.col("v") + SHIFT, 6).alias("v"))


_POINTS_SQL = "select 'events.' || event_type || '.u' || (user_id % 3) as name, epoch_us(ts) // 1000 as ms, value, event_id from events"


def _consolidate_sql(sp: spec.SeriesSpec) -> str:
    s, hb, a = sp.step_ms, sp.heartbeat_ms, sp.archives[0]
    cfs = ", ".join(f"('{x}')" for x in dict.fromkeys(x.cf for x in sp.archives))
    steps = ", ".join(f"({x}::bigint)" for x in dict.fromkeys(x.step_ms for x in sp.archives))
    if hb:
        head = f"""i0 as (select name, lag(ms) over (partition by name order by ms, value desc) as t0, ms as t1, value from p),
i as (select name, t0, t1, case when t1 - t0 <= {hb} then value end as v, (t0 + {s} - 1) // {s} * {s} as up, t1 // {s} * {s} as lo from i0 where t1 > t0),
pieces as (select name, up as slot, v, least(up, t1) - t0 as d, t1 >= up as done from i where t0 <> up
  union all select name, lo + {s}, v, t1 - greatest(lo, t0), false from i where t1 > lo and not (t0 <> up and t1 < up)),
u as (select name, slot - {s} as b, slot as e, slot as seq, sum(v * d) / nullif(sum(d) filter (where v is not null), 0) as v, coalesce(sum(d) filter (where v is not null), 0) as dur
  from pieces group by name, slot having bool_or(done) union all select name, up, lo, lo, v, null from i where lo > up),"""
    else:
        head = f"""o as (select name, value, ms // {s} * {s} + {s} as e, lag(ms // {s} * {s} + {s}) over w as prev, row_number() over w as k from p window w as (partition by name order by ms)),
u as (select name, e - {s} as b, e, 2 * k as seq, value as v, {s} as dur from o union all
  select name, prev, e - {s}, 2 * k - 1, null, null from o where e - {s} > prev),"""
    live = "v is not null and (cf <> 'WMEAN' or reset is null or seq > reset)"
    owned = "where true" if hb else "where k >= 0 and n > 0 and k = n - 1"
    return f"""with p as ({_POINTS_SQL}), {head}
c0 as (select name, e, v, seq, r, coalesce(dur, case when e - b > {s} and r >= e - b then e - b else {s} end) as d,
  unnest(range(b // r * r + r, (e + r - 1) // r * r + 1, r)) as slot from u, (values {steps}) x(r)),
c1 as (select *, sum((e >= slot)::int) over (partition by name, r, slot order by seq) - (e >= slot)::int as k, sum((e >= slot)::int) over (partition by name, r, slot) as n from c0),
c as (select *, max(case when v is null and d = r then seq end) over (partition by name, r, slot) as reset from c1 {owned}),
g as (select name, cf, r, slot, coalesce(sum(d) filter (where {live}), 0) as dur, max(reset) is not null and cf = 'WMEAN' as was_reset,
  case cf when 'WMEAN' then sum(v * d) filter (where {live}) / nullif(sum(d) filter (where {live}), 0) when 'MAX' then max(v) when 'MIN' then min(v)
  else arg_max(v, seq) filter (where v is not null) end as x from c, (values {cfs}) y(cf) group by name, cf, r, slot),
l as (select name, max(e) as last_e from u group by name)
select name, cf, r::bigint as step_ms, slot::bigint as t_ms, round(case when dur / r < {a.xff} then null when dur = 0 then case when was_reset or {a.xff} > 0 then null else 0 end else x end + {SHIFT}, 6) as v
from g join l using (name) where slot <= last_e and slot > last_e // r * r - {a.size} * r"""


# ---- parsers


def _lines(spark: SparkSession, d: str, make) -> DataFrame:
    return event_points_with_id(spark, d).select(make.alias("value"))


def event_points_with_id(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.concat(F.lit("events/"), "event_type", F.lit(" u"), (F.col("user_id") % 3).cast("string")).alias("raw"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value")


def parse_graphite(spark: SparkSession, d: str) -> DataFrame:
    """Good lines and, for every tenth event, one that must be rejected."""
    p = event_points_with_id(spark, d)
    name = F.translate("raw", " ", ".")
    good = F.concat_ws(" ", name, F.col("value").cast("string"), F.floor(F.col("ms") / 1000).cast("string"))
    bad = F.concat_ws(" ", name, F.lit("many"), F.lit("1"))
    lines = p.select(F.explode(F.array(good, F.when(F.col("event_id") % 10 == 0, bad).otherwise(""))).alias("value"))
    return text.graphite_lines(lines, now_ms=0).groupBy("name", F.col("ms").alias("t_ms")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def parse_statsd(spark: SparkSession, d: str) -> DataFrame:
    p = event_points_with_id(spark, d)
    k = F.col("event_id") % 6
    v = F.col("value").cast("string")
    name = F.translate("raw", " ", ".")
    line = (
        F.when(k == 0, F.concat(name, F.lit(":"), v, F.lit("|c|@0.5"))).when(k == 1, F.concat(name, F.lit(":"), v, F.lit("|g")))
        .when(k == 2, F.concat(name, F.lit(":+"), v, F.lit("|g"))).when(k == 3, F.concat(name, F.lit(":"), v, F.lit("|ms"))).when(k == 4, name)
        .otherwise(F.concat(name, F.lit(":"), v, F.lit("|c|@1.5")))
    )
    c = text.statsd_commands(text.statsd_lines(p.select(line.alias("value"))))
    return c.groupBy("name", "cmd").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def parse_pixel(spark: SparkSession, d: str) -> DataFrame:
    p = event_points_with_id(spark, d)
    path = F.element_at(F.array(*(F.lit(x) for x in text.PIXEL_COMMANDS)), (F.col("event_id") % 5 + 1).cast("int"))
    line = F.concat(path, F.lit("?"), F.translate("raw", " ", "."), F.lit("="), F.col("value").cast("string"), F.lit("@"), F.floor(F.col("ms") / 1000).cast("string"))
    c = text.pixel_requests(p.select(line.alias("value")), now_ms=0)
    return c.groupBy("cmd", "name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("ms").alias("last_ms"))


def sanitize_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "points").select(clean_name("name").alias("name")).groupBy("name").agg(F.count("*").alias("n"))


# ---- scans


def scan_gap_filled(spark: SparkSession, d: str) -> DataFrame:
    f = from_points(event_points(spark, d), HOUR)
    return f.df.select("name", F.col("t").alias("t_ms"), _r("v"))


def scan_regrouped(spark: SparkSession, d: str) -> DataFrame:
    """As scanned in memory: a last group whose end the series doesn't reach is left out."""
    g = regroup(from_points(event_points(spark, d), HOUR), 7 * HOUR, complete=True)
    return g.df.select("name", F.col("t").alias("t_ms"), _r("v"))


def scan_max_points(spark: SparkSession, d: str) -> DataFrame:
    """maxDataPoints: the width of a group is the range over 100 rounded down to the step, plus a step."""
    e = engine(spark, d)
    return e.store.fetch("events.*.*", e.from_ms, e.to_ms, 100).df.select("name", F.col("t").alias("t_ms"), _r("v"))


def scan_range(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d)
    return e.store.fetch("events.view.*", e.to_ms - 2 * DAY, e.to_ms).df.select("name", F.col("t").alias("t_ms"), _r("v"))


def glob_lookup(spark: SparkSession, d: str) -> DataFrame:
    ds = table(spark, d, "ds")
    return ds.where(glob_filter("name", "{kiln,quarry}.*-000*.[a-l]*.temp_?")).select("name").distinct()


def find_nodes(spark: SparkSession, d: str) -> DataFrame:
    return store.find_response(table(spark, d, "ds").select("name").distinct(), "*.*")


def ident_search(spark: SparkSession, d: str) -> DataFrame:
    ds = table(spark, d, "ds").withColumn("tags", F.from_json("ident", "map<string,string>"))
    return store.search(ds, "tags", {"name": "TEMP_c$", "zone": "^w"}).select("id", "name").distinct()


def ident_canonical(spark: SparkSession, d: str) -> DataFrame:
    ds = table(spark, d, "ds").withColumn("tags", F.from_json("ident", "map<string,string>"))
    return ds.select(F.map_keys("tags")[0].alias("k"), store.ident_key("tags").alias("ident")).groupBy("ident").agg(F.count("*").alias("n"))


def load_sources(spark: SparkSession, d: str) -> DataFrame:
    v = store.ds_view(table(spark, d, "ds").distinct(), table(spark, d, "ds_state"))
    return v.select("id", "step_ms", F.unix_millis("lastupdate").alias("last_ms"), "duration_ms", F.when(~F.isnan("value"), F.col("value")).alias("value"))


def load_archives(spark: SparkSession, d: str) -> DataFrame:
    v = store.rra_view(table(spark, d, "rra").distinct(), table(spark, d, "rra_bundle"), table(spark, d, "ds").distinct())
    return v.groupBy("rra_step_ms", "span_ms", "cf").agg(F.count("*").alias("n"), F.sum("heartbeat_ms").alias("heartbeats"))


def tv_debug(spark: SparkSession, d: str) -> DataFrame:
    v = store.tvd_view(table(spark, d, "tv").distinct())
    return v.groupBy("ds_id", "slots").agg(F.count("*").alias("n"))


def new_series(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "points").select(clean_name("name").alias("name"))
    return spec.new_series(p, table(spark, d, "ds"))


def rule_match(spark: SparkSession, d: str) -> DataFrame:
    rules = [spec.SeriesSpec(10_000, 60_000, (), p) for p in (r"^kiln\.", r"temp_c$", r"\.west\.")]
    return spec.match_rules(table(spark, d, "ds").select("name").distinct(), rules).groupBy("rule_no").agg(F.count("*").alias("n"))


def best_archive(spark: SparkSession, d: str) -> DataFrame:
    """Which archive answers a range; three situations over one pair of archives."""
    a = [store.Archive(10_000, 100, 10_000_000), store.Archive(20_000, 100, 10_000_000)]
    asked = [(9_500_000, 9_600_000, 10), (9_500_000, 9_600_000, 3), (8_500_000, 8_600_000, 10), (5_500_000, 5_600_000, 0), (10_100_000, 10_200_000, 0)]
    return spark.createDataFrame([(f, t, p, store.best_archive(a, f, t, p).step_ms) for f, t, p in asked], "from_ms bigint, to_ms bigint, points int, step_ms bigint")


def pdp_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    r = con.clock_durations(event_points(spark, d)).withColumn("day", slot_end("ms", DAY))
    return con.weighted_mean(r, ["name", "day"], "value", "dur_ms").select("name", "day", _r("v"), "dur")


# ---- statsd


def _commands(spark: SparkSession, d: str) -> DataFrame:
    e = event_points_with_id(spark, d)
    cmd = F.element_at(F.array(*(F.lit(x) for x in ("add", "append", "addgauge", "setgauge"))), (F.col("event_id") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("c"), F.lit("t"), F.lit("g"), F.lit("g")), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(cmd.alias("cmd"), F.concat(F.translate("raw", "/ ", ".."), F.lit("."), kind).alias("name"), "value", "ms", F.col("event_id").alias("id"))


def statsd_windows(spark: SparkSession, d: str) -> DataFrame:
    a = statsd.aggregate(_commands(spark, d), 6 * HOUR)
    return a.select("name", F.col("ms").alias("t_ms"), F.round("value", 9).alias("value"))


def statsd_paced(spark: SparkSession, d: str) -> DataFrame:
    """Counters combined per second first: the same totals."""
    a = statsd.aggregate(statsd.paced_sums(_commands(spark, d)), 6 * HOUR)
    return a.select("name", F.col("ms").alias("t_ms"), F.round("value", 9).alias("value"))


def paced_gauge(spark: SparkSession, d: str) -> DataFrame:
    g = statsd.paced_gauges(event_points(spark, d), DAY)
    return g.select("name", F.col("ms").alias("t_ms"), F.round("value", 9).alias("value"))


def statsd_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Commands of all kinds under the same names: the first of a window says what it is, the others act on its value."""
    c = _commands(spark, d).withColumn("name", F.regexp_replace("name", r"\.[ctg]$", ""))
    return statsd.aggregate(c, HOUR).select("name", F.col("ms").alias("t_ms"), F.round("value", 9).alias("value"))


def statsd_table(spark: SparkSession, d: str) -> DataFrame:
    """The parsed packets of stats in windows of six hours; values to 12 digits."""
    s = table(spark, d, "stats").distinct().where("name is not null and name <> ''")
    c = text.statsd_commands(s).select("cmd", "name", "value", F.unix_millis("ts").alias("ms"), F.col("stat_id").alias("id"))
    a = statsd.aggregate(c, 6 * HOUR, (50, 90))
    return a.select("name", F.col("ms").alias("t_ms"), F.format_string("%.11e", F.col("value") * (1 + 1.3e-13)).cast("double").alias("value"))


def _statsd_sql(commands: str, window_ms: int, value: str = "round({}, 9)", thresholds: tuple[int, ...] = (90,)) -> str:
    """commands: SQL of (cmd, name, value, ms, id)."""
    after = "c.cmd in ('add', 'addgauge') and (set_at is null or (c.ms, c.id) > set_at)"
    tags = "".join(
        f", {{'tag': '.sum_{t}', 'v': list_sum(s[1:k{t}])}}, {{'tag': '.mean_{t}', 'v': list_sum(s[1:k{t}]) / k{t}}}, {{'tag': '.upper_{t}', 'v': s[k{t}]}}" for t in thresholds
    )
    ks = "".join(f", greatest(round({t / 100} * len(s))::int, 1) as k{t}" for t in thresholds)
    return f"""with c as (select *, ms // {window_ms} * {window_ms} + {window_ms} as t_ms from ({commands})),
k as (select name, t_ms, arg_min(cmd, (ms, id)) as kind, max((ms, id)) filter (where cmd = 'setgauge') as set_at, arg_max(value, (ms, id)) filter (where cmd = 'setgauge') as set_to from c group by 1, 2),
v as (select k.name, k.t_ms, kind, coalesce(any_value(set_to), 0) + coalesce(sum(c.value) filter (where {after}), 0) as v from k join c using (name, t_ms) where kind <> 'append' group by 1, 2, 3),
t as (select c.name, c.t_ms, list_sort(list(c.value)) as s from c join k using (name, t_ms) where kind = 'append' and c.cmd = 'append' group by 1, 2),
t2 as (select *, len(s) as n{ks} from t)
select name, t_ms, {value.format(f"case kind when 'add' then v / {window_ms / 1000} else v end")} as value from v
union all select name || x.tag, t_ms, {value.format("x.v")} from (select name, t_ms, unnest([{{'tag': '.count', 'v': n::double}}, {{'tag': '.lower', 'v': s[1]}}, {{'tag': '.upper', 'v': s[n]}},
  {{'tag': '.sum', 'v': list_sum(s)}}, {{'tag': '.mean', 'v': list_sum(s) / n}}{tags}]) as x from t2)"""


def _commands_sql(suffix: str) -> str:
    return f"""select ['add', 'append', 'addgauge', 'setgauge'][event_id % 4 + 1] as cmd, 'events.' || event_type || '.u' || (user_id % 3){suffix} as name,
  value, epoch_us(ts) // 1000 as ms, event_id as id from events"""


_KIND_SQL = " || '.' || ['c', 't', 'g', 'g'][event_id % 4 + 1]"
_STATS_SQL = """select case metric when 'c' then 'add' when 'ms' then 'append' else case when delta then 'addgauge' else 'setgauge' end end as cmd, name,
  case when metric = 'c' and sample > 0 then value / sample else value end as value, epoch_ms(ts) as ms, stat_id as id
  from (select distinct * from stats where name <> '' and ts is not null) where value is not null and not isnan(value) and not isinf(value)"""


# ---- answers


def _parsed(rows: DataFrame, *keep: str) -> DataFrame:
    """The points of JSON answers, one row each."""
    j = F.from_json("json", "target string, datapoints array<array<double>>")
    p = rows.select(*keep, j.alias("j")).select(*keep, F.col("j.target").alias("target"), F.explode_outer("j.datapoints").alias("p"))
    return p.select(*keep, "target", F.col("p")[1].cast("bigint").alias("sec"), F.round(F.col("p")[0], 9).alias("v"))


def render_answer(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, "ev_6h")
    return _parsed(render.render_json(e.query("aliasByNode(removeAboveValue(events.*.*, 60), 1, 2)")))


TARGETS = ["scale(events.view.*, 2)", "nothing.here.*", "sumSeries(events.click.*)", "nope(1)"]


def render_request(spark: SparkSession, d: str) -> DataFrame:
    """Several targets over the last ten days of the data, in at most 60 points a series; one finds no series, one is wrong."""
    e = engine(spark, d)
    rows, errors = render.render(spark, e.store, TARGETS, "-10d", "now", 60, e.to_ms)
    wrong = spark.createDataFrame([(k, v) for k, v in errors.items()], "target_no int, error string")
    return _parsed(rows, "target_no").join(F.broadcast(wrong), "target_no", "left")


def events_answer(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([("[]",)], "json string")


def synthetic_load(spark: SparkSession, d: str) -> DataFrame:
    p = text.synthetic_points(spark, 7, 0, 600_000, 10_000)
    return p.select("name", "ms", F.round("value", 9).alias("value"))


def stored_archive(spark: SparkSession, d: str) -> DataFrame:
    """Consolidated, then read back through the SQL view."""
    rows = cut(con.consolidate(event_points(spark, d), SPECS["consolidate_wmean"]))
    store.register_views(spark, rows, rows.select("name").distinct())
    return spark.sql("select name, step_ms, count(r) as n, round(avg(r), 9) as mean, unix_millis(max(t)) as last_ms from tv group by name, step_ms")


QUERIES = {k: partial(consolidated, name=k) for k in SPECS} | {
    f.__name__: f
    for f in (
        parse_graphite, parse_statsd, parse_pixel, sanitize_names, scan_gap_filled, scan_regrouped, scan_max_points, scan_range, glob_lookup, find_nodes, ident_search,
        ident_canonical, load_sources, load_archives, tv_debug, new_series, rule_match, best_archive, pdp_weighted_mean, statsd_windows, statsd_mixed, statsd_paced,
        paced_gauge, statsd_table, render_answer, render_request, events_answer, synthetic_load, stored_archive,
    )
}

_RAW = "select event_id, 'events-' || event_type || '.u' || (user_id % 3) as name, epoch_us(ts) // 1000 as ms, value from events"
_CLEAN = "regexp_replace(replace(regexp_replace(name, '[ \\t\\n\\f\\r\\v]+', '_', 'g'), '/', '-'), '[^A-Za-z_0-9.\\-]', '', 'g')"

ORACLES = {k: _consolidate_sql(s) for k, s in SPECS.items()} | {
    "parse_graphite": f"with p as ({_RAW}) select name, ms // 1000 * 1000 as t_ms, count(*) as n, round(sum(value), 4) as total from p group by 1, 2",
    "parse_statsd": f"""with p as ({_RAW}) select name, ['add', 'setgauge', 'addgauge', 'append', 'add'][event_id % 6 + 1] as cmd, count(*) as n,
  round(sum(case event_id % 6 when 0 then value / 0.5 when 4 then 1 else value end), 4) as total from p where event_id % 6 < 5 group by 1, 2""",
    "parse_pixel": f"with p as ({_RAW}) select ['point', 'add', 'addgauge', 'setgauge', 'append'][event_id % 5 + 1] as cmd, name, count(*) as n, round(sum(value), 4) as total, max(ms // 1000 * 1000) as last_ms from p group by 1, 2",
    "sanitize_names": f"select {_CLEAN} as name, count(*) as n from points group by 1",
    "scan_gap_filled": _frame_sql("ev_1h") + "select name, t as t_ms, round(v, 9) as v from f",
    "scan_regrouped": _frame_sql("ev_1h") + f"select name, ((t - 1) // {7 * HOUR} + 1) * {7 * HOUR} as t_ms, round(avg(v), 9) as v from f group by 1, 2 having max(t) = t_ms",
    "scan_max_points": _frame_sql("ev_1h") + f", w as (select ((hi - lo + {HOUR}) // 100 // {HOUR} + 1) * {HOUR} as w from b) select name, ((t - 1) // w + 1) * w as t_ms, round(avg(v), 9) as v from f, w group by 1, 2",
    "scan_range": _frame_sql("ev_1h") + f"select name, t as t_ms, round(v, 9) as v from f, b where name like 'events.view.%' and t > hi - {2 * DAY}",
    "glob_lookup": "select distinct name from ds where regexp_full_match(name, '(kiln|quarry)[.][^.]*-000[^.]*[.][a-l][^.]*[.]temp_[^.]')",
    "find_nodes": """with n as (select distinct name from ds where name is not null), k as (select split_part(name, '.', 1) || '.' || split_part(name, '.', 2) as id, len(string_split(name, '.')) = 2 as leaf from n where name like '%.%'),
g as (select id, split_part(id, '.', 2) as text, bool_or(leaf) as leaf, bool_or(not leaf) as expandable from k group by 1)
select id, text, leaf, expandable from g qualify row_number() over (partition by text order by id) = 1""",
    "ident_search": "select distinct id, name from ds where regexp_matches(ident->>'name', 'TEMP_c$', 'i') and regexp_matches(ident->>'zone', '^w', 'i')",
    "ident_canonical": """with x as (select ident as raw, list_sort(json_keys(ident)) as ks from ds)
select '{' || array_to_string(list_transform(ks, lambda k: '"' || k || '":"' || (raw->>k) || '"'), ',') || '}' as ident, count(*) as n from x group by 1""",
    "load_sources": """with d as (select distinct * from ds) select d.id, d.step_ms, epoch_ms(s.lastupdate[d.idx]) as last_ms, s.duration_ms[d.idx] as duration_ms,
  case when not isnan(s.value[d.idx]) then s.value[d.idx] end as value from d left join ds_state s on s.seg = d.seg""",
    "load_archives": """select b.step_ms as rra_step_ms, b.step_ms * b.size as span_ms, r.cf, count(*) as n, sum(d.heartbeat_ms)::bigint as heartbeats
  from (select distinct * from rra) r join rra_bundle b on b.id = r.rra_bundle_id join (select distinct * from ds) d on d.id = r.ds_id group by 1, 2, 3""",
    "tv_debug": """with v as (select *, (epoch_ms(t) - lag(epoch_ms(t)) over (partition by ds_id, rra_id order by t, tv_id)) // step_ms as slots from (select distinct * from tv))
select ds_id, slots, count(*) as n from v group by 1, 2""",
    "new_series": f"with p as (select distinct {_CLEAN} as name from points where name is not null) select name from p where name not in (select name from ds where name is not null)",
    "rule_match": r"select case when regexp_matches(name, '^kiln\.') then 0 when regexp_matches(name, 'temp_c$') then 1 when regexp_matches(name, '\.west\.') then 2 end as rule_no, count(*) as n from (select distinct name from ds) group by 1",
    "best_archive": "select * from (values (9500000::bigint, 9600000::bigint, 10, 10000::bigint), (9500000, 9600000, 3, 20000), (8500000, 8600000, 10, 20000), (5500000, 5600000, 0, 20000), (10100000, 10200000, 0, 10000)) x(from_ms, to_ms, points, step_ms)",
    "pdp_weighted_mean": f"""with p as ({_POINTS_SQL}), q as (select *, lead(ms) over (partition by name order by ms) - ms as d, ((ms - 1) // {DAY} + 1) * {DAY} as day from p)
select name, day, round(sum(value * d) filter (where d > 0) / nullif(sum(d) filter (where d > 0), 0), 9) as v, coalesce(sum(d) filter (where d > 0), 0)::bigint as dur from q group by 1, 2""",
    "statsd_windows": _statsd_sql(_commands_sql(_KIND_SQL), 6 * HOUR),
    "statsd_mixed": _statsd_sql(_commands_sql(""), HOUR),
    "statsd_table": _statsd_sql(_STATS_SQL, 6 * HOUR, "cast(printf('%.11e', ({}) * (1 + 1.3e-13)) as double)", (50, 90)),
    "statsd_paced": "select * from (" + _statsd_sql(_commands_sql(_KIND_SQL), 6 * HOUR) + ") where name like '%.c'",
    "paced_gauge": f"""with p as ({_POINTS_SQL}), q as (select *, ms // {DAY} * {DAY} + {DAY} as t_ms from p),
z as (select *, coalesce(lead(ms) over (partition by name, t_ms order by ms), t_ms) - ms as d from q)
select name, t_ms, round(sum(value * d) / nullif(sum(d), 0), 9) as value from z group by 1, 2""",
    "events_answer": "select '[]' as json",
    "synthetic_load": "select 'load.' || k as name, (i * 10000)::bigint as ms, round(sin((i * 10000) % 600000 * (2 * pi() / 600000)) * 100, 9) as value from range(7) a(k), range(60) b(i)",
    "stored_archive": "with s as (" + _consolidate_sql(SPECS["consolidate_wmean"]).replace("round(case", "(case").replace(f"else x end + {SHIFT}, 6)", "else x end)") + ") select name, step_ms, count(v) as n, round(avg(v), 9) as mean, max(t_ms) as last_ms from s group by 1, 2",
    "render_answer": _frame_sql("ev_6h") + "select split_part(name, '.', 2) || '.' || split_part(name, '.', 3) as target, t // 1000 as sec, round(case when v <= 60 then v end, 9) as v from f",
    "render_request": _frame_sql("ev_1h") + f""", k as (select name, ((t - 1) // {5 * HOUR} + 1) * {5 * HOUR} as t, avg(v) as v from f, b where t > hi - {10 * DAY} group by 1, 2)
select 0 as target_no, name as target, t // 1000 as sec, round(v * 2, 9) as v, null as error from k where name like 'events.view.%' union all
select 1, null, null, null, null union all
select 2, 'sumSeries(events.click.*)', t // 1000, round(coalesce(sum(v), 0), 9), null from k where name like 'events.click.%' group by t union all
select 3, null, null, null, 'No such function: nope'""",
}
