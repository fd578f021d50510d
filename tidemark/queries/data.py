"""Queries p1 to p5 over the test tables, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..names import clean_name, suffix
from ..operators import grid, orphans, qdigest, rolling, spikes
from ..session import bounded_broadcast, cut, finite, table



#: Keeps exact halves of the last digit from being rounded up by one engine and down by the other.
NUDGE = 1 + 1.3e-14


def _stable(c: str):
    """Sums in different orders differ in their last bits; 13 significant digits are compared."""
    return F.when(F.col(c).isNotNull(), F.format_string("%.12e", F.col(c) * NUDGE).cast("double")).alias(c)


def _stable_sql(x: str) -> str:
    return f"cast(printf('%.12e', ({x}) * {NUDGE!r}) as double)"


# ---- p1


def _references(spark: SparkSession, d: str):
    ds, rra, state = (table(spark, d, t) for t in ("ds", "rra", "ds_state"))
    parents = [orphans.Parent("ds", ds, "id", "created_at"), orphans.Parent("ds_state", state, "seg")]
    children = [
        orphans.Child("rra", rra, "id", "ds_id", "ds", "created_at"),
        orphans.Child("ds", ds, "id", "seg", "ds_state", "created_at"),
    ]
    return parents, children


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_rows(*_references(spark, d)).select("child_table", "child_id").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(orphans.orphan_rows(*_references(spark, d)), "month")


_P1_ROWS = """
with p as (select id, min(created_at) as at from ds group by id),
r as (select distinct 'rra' as child_table, 'ds' as parent_table, x.id as child_id, x.ds_id as key, x.created_at as child_at,
             case when p.id is null then 'absent' else 'later' end as reason
      from rra x left join p on p.id = x.ds_id
      where x.ds_id is not null and (p.id is null or p.at > x.created_at)
      union all
      select distinct 'ds', 'ds_state', x.id, x.seg, x.created_at, 'absent' from ds x
      where x.seg is not null and not exists (select 1 from ds_state s where s.seg = x.seg))
"""

# ---- p2


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """One row per name: a number to shuffle by instead of the name, step and heartbeat."""
    ds = table(spark, d, "ds")
    return ds.where(F.col("name").isNotNull()).groupBy("name").agg(F.min(F.struct("id", "step_ms", "heartbeat_ms")).alias("s")).select("name", "s.*")


def points_grid(spark: SparkSession, d: str) -> DataFrame:
    """Regular series of all known sources in points, keyed by ds.id, with the name."""
    p = table(spark, d, "points")
    # names are cleaned and looked up once each, not reading by reading
    raw = p.select(F.col("name").alias("raw")).distinct().withColumn("name", clean_name("raw"))
    known = cut(raw.join(_sources(spark, d), "name").select("raw", "id", "step_ms", "heartbeat_ms"))
    u = grid.usable_readings(p, "name", "ts", "value", "received_at").withColumnRenamed("key", "raw")
    r = u.join(bounded_broadcast(known), "raw").select(F.col("id").alias("key"), "step_ms", "heartbeat_ms", "ms", "value")
    return grid.regular_grid(r)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    names = _sources(spark, d).select(F.col("id").alias("key"), "name")
    return points_grid(spark, d).where("missing").select("key", "slot_ms").join(names, "key").select("name", "slot_ms")


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    g = points_grid(spark, d)
    return g.select(F.col("key").alias("ds_id"), "slot_ms", "n", _stable("value"), _stable("filled"), "missing")


_P2_BASE = """
with d as (select name, min(id) as id, arg_min(step_ms, id) as step_ms, arg_min(heartbeat_ms, id) as heartbeat_ms
           from ds where name is not null group by name),
u as (select d.name, d.id, d.step_ms, d.heartbeat_ms, epoch_ms(p.ts) as ms, p.value,
             ((epoch_ms(p.ts) - 1) // d.step_ms + 1) * d.step_ms as slot
      from points p join d on d.name = regexp_replace(replace(regexp_replace(p.name, '[ \\t\\n\\f\\r\\v]+', '_', 'g'), '/', '-'), '[^A-Za-z_0-9.\\-]', '', 'g')
      where p.value is not null and not isnan(p.value) and not isinf(p.value) and p.ts is not null
        and abs(epoch_us(p.ts) - epoch_us(p.received_at)) <= 7 * 86400000000::bigint)
"""

# ---- p3


def _stat_values(spark: SparkSession, d: str) -> DataFrame:
    """Finite values of stats, exact duplicates once. Delta rows are changes, not readings: a group of
    their own beside the readings of the same name. A null name is a name."""
    s = table(spark, d, "stats").where(finite("value"))
    return s.select("stat_id", "name", F.coalesce("delta", F.lit(False)).alias("delta"), "value", "ts").distinct()


QS, EPS = (0.5, 0.9, 0.95, 0.99), 0.005


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    keys = ["name", "delta"]
    return qdigest.percentiles(qdigest.partial_digest(_stat_values(spark, d), keys, "value", EPS), keys, QS, EPS)


def p3_from_days(spark: SparkSession, d: str) -> DataFrame:
    """The same percentiles put together from digests that were made for single days."""
    v = _stat_values(spark, d).withColumn("day", F.to_date("ts"))
    days = qdigest.digest(v, ["name", "delta", "day"], "value", EPS)
    return qdigest.percentiles(days, ["name", "delta"], QS, EPS)


def p3_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Per group and quantile of p3_percentiles and p3_from_days: whether the exact rank of the value is within
    the stated error (the value stands for a cell of relative width 2**-20)."""
    v = _stat_values(spark, d).select("name", "delta", "value")
    made = p3_percentiles(spark, d).withColumn("made", F.lit("tasks")).unionByName(p3_from_days(spark, d).withColumn("made", F.lit("days")))
    q = F.struct("made", "quantile", "n", "rank_error", (F.col("value") - F.abs("value") * 2.0**-20).alias("lo"), (F.col("value") + F.abs("value") * 2.0**-20).alias("hi"))
    per = made.groupBy("name", "delta").agg(F.collect_list(q).alias("qs"))
    j = v.join(per, v["name"].eqNullSafe(per["name"]) & (v["delta"] == per["delta"])).select(v["name"], v["delta"], "value", F.explode("qs").alias("q"))
    g = j.groupBy("name", "delta", "q").agg(F.count("*").alias("total"), F.count_if(F.col("value") < F.col("q.lo")).alias("below"), F.count_if(F.col("value") <= F.col("q.hi")).alias("upto"))
    rank = F.greatest(F.ceil(F.col("q.quantile") * F.col("total") - 1e-9), F.lit(1))
    ok = (F.col("total") == F.col("q.n")) & (F.col("below") - F.col("q.rank_error") <= rank) & (rank <= F.col("upto") + F.col("q.rank_error")) & (F.col("q.rank_error") <= EPS * F.col("total"))
    return g.select("name", "delta", "q.made", "q.quantile", "total", ok.alias("within"))


# ---- p4


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Days without readings among the rolling totals. The totals are asked for, which they always pass,
    since columns nobody asks for would be left out of the plan."""
    days = rolling.rolling_totals(table(spark, d, "tv"), "ds_id", "t", "r", (7, 30), dedupe=["tv_id"])
    return days.where("n = 0 and n_7 <= n_30 and sum_7 is not null and sum_30 is not null").select(F.col("entity").alias("ds_id"), F.date_format("day", "yyyy-MM-dd").alias("calendar_day"))


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    r = rolling.rolling_totals(table(spark, d, "tv"), "ds_id", "t", "r", (7, 30), dedupe=["tv_id"])
    r = r.select("entity", "day", "n_7", "n_30", _stable("sum_7"), _stable("sum_30"))
    mean = lambda w: F.when(F.col(f"n_{w}") > 0, F.col(f"sum_{w}") / F.col(f"n_{w}")).alias(f"mean_{w}")
    return r.select(F.col("entity").alias("ds_id"), F.date_format("day", "yyyy-MM-dd").alias("calendar_day"), *r.columns[2:], mean(7), mean(30))


_P4_DAYS = """
with x as (select distinct * from tv), u as (
  select ds_id, cast(make_timestamp((epoch_ms(t) - 1) * 1000) as date) as day, r from x
  where r is not null and not isnan(r) and not isinf(r) and t is not null and ds_id is not null),
a as (select ds_id, day, count(*) as n, coalesce(sum(r) filter (where abs(r) < 1099511627776), 0) as small, coalesce(sum(r) filter (where abs(r) >= 1099511627776), 0) as large from u group by 1, 2),
b as (select ds_id, min(day) as lo, max(day) as hi from a group by 1),
c as (select ds_id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as day from b),
g as (select c.ds_id, c.day, coalesce(n, 0) as n, coalesce(small, 0) as small, coalesce(large, 0) as large from c left join a using (ds_id, day))
"""

# ---- p5


#: Parameters of p5: how far a reading's time may lie after and before its receipt (ms), and the suffixes of
#: names that are taken on a logarithmic scale.
AHEAD, BEHIND = 7 * 86_400_000, 90 * 86_400_000
LOG_SUFFIXES = ("latency_ms", "hits")


def _measurements(spark: SparkSession, d: str) -> DataFrame:
    """Readings of the three tables in one form. The time of a reading is ts, however late it arrived, but
    its receipt where ts is null or no late arrival explains it: more than AHEAD after the receipt or more
    than BEHIND before it."""
    log = F.col("suffix").isin(*LOG_SUFFIXES)

    def time(t: DataFrame):
        ts, at = F.unix_millis("ts"), F.unix_millis("received_at")
        return F.when(ts.isNull() | (ts > at + AHEAD) | (ts < at - BEHIND), at).otherwise(ts).alias("ms")

    def cols(table_name: str, ident: str, source, ms, value: str):
        return [F.lit(table_name).alias("source_table"), source.alias("source"), F.col(ident).alias("row_id"), ms, F.col(value).alias("value")]

    s = table(spark, d, "stats").where(finite("value") & ~F.coalesce("delta", F.lit(False)))
    s = s.select(*cols("stats", "stat_id", F.when(F.col("name") != "", F.col("name")), time(s), "value")).withColumn("suffix", suffix("source"))
    p = table(spark, d, "points").where(finite("value"))
    p = p.select(*cols("points", "point_id", clean_name("name"), time(p), "value")).withColumn("suffix", suffix("source"))
    units = table(spark, d, "ds").where(F.col("name").isNotNull()).groupBy(F.col("id").alias("ds_id")).agg(suffix(F.min("name")).alias("suffix"))
    v = table(spark, d, "tv").where(finite("r"))
    v = v.join(units, "ds_id", "left")
    v = v.select(*cols("tv", "tv_id", F.col("ds_id").cast("string"), F.unix_millis("t").alias("ms"), "r"), "suffix")
    return reduce(DataFrame.unionByName, [s, p, v]).withColumn("log", F.coalesce(log, F.lit(False)))


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every implausible reading with each of its reasons."""
    return spikes.reasons(_measurements(spark, d), table(spark, d, "metric_units")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_reasons(spark, d).select("source_table", "row_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_grid, p3_percentiles, p3_from_days, p3_ranks, p4_found, p4_rolling, p5_found, p5_reasons)}

ORACLES = {
    "p1_found": _P1_ROWS + "select distinct child_table, child_id from r",
    "p1_report": _P1_ROWS
    + """select child_table, parent_table, reason, strftime(date_trunc('month', child_at at time zone 'UTC'), '%Y-%m-%d') as period,
       count(*) as n_orphans, count(distinct key) as n_keys from r group by 1, 2, 3, 4""",
    "p2_found": _P2_BASE
    + """, n as (select *, lead(ms) over w as next_ms, lead(slot) over w as next_slot from u window w as (partition by name order by ms))
select name, unnest(range(slot + step_ms, next_slot, step_ms)) as slot_ms from n where next_ms - ms > heartbeat_ms""",
    "p2_grid": _P2_BASE
    + f""", o as (select id, slot, step_ms, heartbeat_ms, ms, value, count(*) as n from u group by all),
c as (select id, slot, step_ms, heartbeat_ms, sum(n)::bigint as n, avg(value) as value, min(ms) as first_ms, max(ms) as last_ms from o group by 1, 2, 3, 4),
s as (select *, lead(slot) over w as next_slot, lead(first_ms) over w as next_ms from c window w as (partition by id order by slot)),
g as (select *, unnest(range(slot, coalesce(next_slot, slot + step_ms), step_ms)) as slot_ms from s)
select id as ds_id, slot_ms, case when slot = slot_ms then n else 0 end as n,
       {_stable_sql("case when slot = slot_ms then value end")} as value,
       {_stable_sql("case when slot = slot_ms then value when next_ms - last_ms <= heartbeat_ms and slot_ms - last_ms <= heartbeat_ms then value end")} as filled,
       slot <> slot_ms and next_ms - last_ms > heartbeat_ms as missing from g""",
    "p3_ranks": """with v as (select distinct stat_id, name, coalesce(delta, false) as delta, value, ts from stats where value is not null and not isnan(value) and not isinf(value)),
g as (select name, delta, count(*) as total from v group by 1, 2)
select name, delta, made, quantile, total, true as within from g, (values ('tasks'), ('days')) m(made), (values (0.5::double), (0.9), (0.95), (0.99)) q(quantile)""",
    "p4_found": _P4_DAYS + "select ds_id, strftime(day, '%Y-%m-%d') as calendar_day from g where n = 0",
    "p4_rolling": _P4_DAYS
    + f""", w as (select ds_id, day, sum(n) over a as n_7, sum(n) over b as n_30, {_stable_sql("sum(small) over a + sum(large) over a")} as s7, {_stable_sql("sum(small) over b + sum(large) over b")} as s30
  from g window a as (partition by ds_id order by day rows 6 preceding), b as (partition by ds_id order by day rows 29 preceding))
select ds_id, strftime(day, '%Y-%m-%d') as calendar_day, cast(n_7 as bigint) as n_7, cast(n_30 as bigint) as n_30, s7 as sum_7, s30 as sum_30,
       case when n_7 > 0 then s7 / n_7 end as mean_7, case when n_30 > 0 then s30 / n_30 end as mean_30 from w""",
}
