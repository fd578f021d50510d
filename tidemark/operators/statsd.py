"""statsd-like aggregation of commands in windows of fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import finite, sound_unions

#: Thresholds of timers, in percent.
THRESHOLDS = (90,)
COUNTER, GAUGE, TIMER = range(3)
NO_BUCKET = -(2**40)
#: What a first command makes of its name in a window: counter, gauge or timer.
KINDS = {"add": "c", "addgauge": "g", "setgauge": "g", "append": "t"}


def flush_end(ms, window_ms: int):
    """End of the tumbling window [start, end) that holds a command, aligned to the clock."""
    return ms - F.pmod(ms, F.lit(window_ms).cast("bigint")) + window_ms


def aggregate(commands: DataFrame, window_ms: int = 10_000, thresholds: tuple[int, ...] = THRESHOLDS, compat: bool = False) -> DataFrame:
    """(name, ms, value) at each window's end.

    commands: (cmd add | addgauge | setgauge | append, name, value, ms, id); id breaks ties in time. The kind of
    a name in a window is that of its first command; commands of other kinds act on the value it has. That
    is the last value set plus what was added after it (all additions if none was set): a gauge gives it as
    it is, a counter per second. A timer gives .count .lower .upper .sum .mean and, per threshold, .sum_N .mean_N
    .upper_N of the values appended up to it, and takes nothing else; nothing can be appended to the others.
    compat gives the timers' sums without cumulation. Unknown commands, null names and values that are not
    finite are ignored; nothing in gives nothing out.
    """
    sound_unions(commands.sparkSession)
    c = commands.where(finite("value") & F.col("name").isNotNull() & F.col("ms").isNotNull() & F.col("cmd").isin(*KINDS))
    # numbers for kinds and places in time keep the grouping a hash aggregate
    kind = F.when(F.col("cmd") == "add", COUNTER).when(F.col("cmd") == "append", TIMER).otherwise(GAUGE)
    wide = F.lit(str(2**64)).cast("decimal(20,0)")
    at = F.col("ms").cast("decimal(20,0)") * wide + F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(0))
    c = c.select("name", flush_end(F.col("ms"), window_ms).alias("end"), kind.alias("does"), (F.col("cmd") == "setgauge").alias("sets"), "value", at.alias("at"))
    g = c.groupBy("name", "end").agg(
        F.min_by("does", "at").alias("kind"), F.max(F.when(F.col("sets"), F.col("at"))).alias("set_at"),
        F.max_by(F.when(F.col("sets"), F.col("value")), F.when(F.col("sets"), F.col("at"))).alias("set_to"),
    )
    timer = F.col("kind") == TIMER
    after = ~timer & ~F.col("sets") & (F.col("does") != TIMER) & (F.col("set_at").isNull() | (F.col("at") > F.col("set_at")))
    j = c.join(g, ["name", "end"]).where(~timer | (F.col("does") == TIMER))
    # values of a timer about a hundredth apart share a bucket; what is no timer is one row of a bucket of its own
    size = F.floor(F.log(2.0, F.abs("value")) * 64).cast("bigint") + 100_000
    bucket = F.when(timer, F.when(F.col("value") == 0, 0).otherwise(F.signum("value").cast("bigint") * size))
    v = j.groupBy("name", "end", "kind", F.coalesce(bucket, F.lit(NO_BUCKET)).alias("bucket"), F.when(timer, F.col("value") + 0.0).alias("value")).agg(
        F.count("*").alias("n"), F.max("set_to").alias("set_to"), F.sum(F.when(after, F.col("value"))).alias("added")
    )
    return _flushed(v, window_ms, thresholds, compat)


def _flushed(v: DataFrame, window_ms: int, thresholds: tuple[int, ...], compat: bool) -> DataFrame:
    """Equal values of timers are counted together (v); the k smallest of a window are found by its buckets
    first and then in one bucket, so that no task sorts all values of a hot timer."""
    b = v.groupBy("name", "end", "kind", "bucket").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("value")).alias("total"), F.min("value").alias("lower"), F.max("value").alias("upper"), F.max("set_to").alias("set_to"), F.sum("added").alias("added")
    )
    whole = Window.partitionBy("name", "end")
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("count", F.sum("n").over(whole)).withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    g = b.groupBy("name", "end", "kind").agg(
        F.max("count").alias("n"), F.min("lower").alias("lower"), F.max("upper").alias("upper"), F.sum("total").alias("sum"), F.max("set_to").alias("set_to"), F.sum("added").alias("added")
    )
    value = F.coalesce("set_to", F.lit(0.0)) + F.coalesce("added", F.lit(0.0))
    value = F.when(F.col("kind") == COUNTER, value / (window_ms / 1000)).otherwise(value)
    total = F.col("upper") if compat else F.col("sum")
    timer = _rows([(".count", F.col("n").cast("double")), (".lower", F.col("lower")), (".upper", F.col("upper")), (".sum", total), (".mean", total / F.col("n"))])
    rows = _put_out(g, F.when(F.col("kind") == TIMER, timer).otherwise(_rows([("", value)])))
    if not thresholds:
        return rows
    ks = F.array(*(F.struct(F.lit(t).alias("t"), F.greatest(F.round(F.lit(t / 100) * F.col("count"), 0).cast("bigint"), F.lit(1)).alias("k")) for t in thresholds))
    hit = b.where(F.col("kind") == TIMER).withColumn("x", F.explode(ks)).select("name", "end", "bucket", "n_before", "before", F.col("n").alias("here"), "x.*")
    hit = hit.where((F.col("n_before") < F.col("k")) & (F.col("k") <= F.col("n_before") + F.col("here")))
    i = v.join(hit, ["name", "end", "bucket"])
    w = Window.partitionBy("name", "end", "t").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    i = i.withColumn("a", F.col("n_before") + F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("s", F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("value")).over(w), F.lit(0.0)))
    i = i.where((F.col("a") < F.col("k")) & (F.col("k") <= F.col("a") + F.col("n")))
    part = F.col("value") if compat else F.col("s") + (F.col("k") - F.col("a")) * F.col("value")
    tag = F.lpad(F.col("t").cast("string"), 2, "0")
    at = _rows([(F.concat(F.lit(".sum_"), tag), part), (F.concat(F.lit(".mean_"), tag), part / F.col("k")), (F.concat(F.lit(".upper_"), tag), F.col("value"))])
    return rows.unionByName(_put_out(i, at))


def _rows(named: list):
    return F.array(*(F.struct((F.lit(a) if isinstance(a, str) else a).alias("tag"), b.alias("value")) for a, b in named))


def _put_out(g: DataFrame, rows) -> DataFrame:
    return g.select("name", F.col("end").alias("ms"), F.explode(rows).alias("m")).select(F.concat("name", "m.tag").alias("name"), "ms", "m.value")


def paced_sums(commands: DataFrame, every_ms: int = 1000) -> DataFrame:
    """Counter commands combined to one per name and second; the result aggregates to the same totals."""
    end = flush_end(F.col("ms"), every_ms)
    g = commands.where("cmd = 'add'").groupBy("name", (end - 1).alias("ms")).agg(F.sum("value").alias("value"), F.min("id").alias("id"))
    return g.select(F.lit("add").alias("cmd"), "name", "value", "ms", "id")


def paced_gauges(readings: DataFrame, every_ms: int = 1000) -> DataFrame:
    """Time-weighted mean of a gauge per name and period: a value holds until the next reading of the
    period or its end."""
    end = flush_end(F.col("ms"), every_ms)
    r = readings.where(finite("value")).withColumn("end", end)
    w = Window.partitionBy("name", "end").orderBy("ms")
    r = r.withColumn("d", F.coalesce(F.lead("ms").over(w), F.col("end")) - F.col("ms"))
    return r.groupBy("name", F.col("end").alias("ms")).agg(F.try_divide(F.sum(F.col("value") * F.col("d")), F.sum("d")).alias("value"))
