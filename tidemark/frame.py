"""Frames: the rows (name, alias, t, v, step_ms) of a set of series.

t is the slot END in epoch milliseconds and v a double, null where missing (never NaN). Every series of
a frame has a row for each slot of the range, so cross-series functions pair by t.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import finite, slot_end, sound_unions

COLUMNS = ["name", "alias", "t", "v", "step_ms"]


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    steps: frozenset[int]

    @property
    def step_ms(self) -> int:
        return math.lcm(*self.steps) if self.steps else 1

    def with_v(self, v) -> Frame:
        return replace(self, df=self.df.withColumn("v", v))

    def keep(self, names: DataFrame) -> Frame:
        """The series whose names are among `names`."""
        return replace(self, df=self.df.join(names.select("name"), "name", "left_semi"))


def by_time():
    return Window.partitionBy("name").orderBy("t")


def whole():
    return Window.partitionBy("name")


def literal_series(spark, name: str, data: list[float | None], start_ms: int, step_ms: int) -> Frame:
    """Values at start, start + step, ..."""
    rows = [(name, name, start_ms + i * step_ms, None if v is None or v != v else float(v), step_ms) for i, v in enumerate(data)]
    return Frame(spark.createDataFrame(rows, "name string, alias string, t bigint, v double, step_ms bigint"), frozenset([step_ms]))


def gap_filled(cells: DataFrame, lo: int, hi: int, step_ms: int, names: DataFrame | None = None) -> Frame:
    """Rows (name, t, v) made complete over the slots lo, lo + step, ..., hi, for the given names or those there are."""
    names = cells.select("name").distinct() if names is None else names
    grid = names.withColumn("t", F.explode(F.sequence(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint"), F.lit(step_ms).cast("bigint"))))
    df = grid.join(cells.where(F.col("t").between(lo, hi)), ["name", "t"], "left")
    return Frame(df.select("name", F.col("name").alias("alias"), "t", "v", F.lit(step_ms).cast("bigint").alias("step_ms")), frozenset([step_ms]))


def from_points(points: DataFrame, step_ms: int, how: str = "avg", lo: int | None = None, hi: int | None = None) -> Frame:
    """Frame of points (name, ms, value): one aggregate per end-inclusive slot, gaps filled with missing.

    Without lo and hi the range is that of the data (two numbers are read at plan time). Points without
    a name, time or finite value are left out. Without any point the frame is empty.
    """
    p = points.where(finite("value") & F.col("name").isNotNull() & F.col("ms").isNotNull())
    cells = p.groupBy("name", slot_end("ms", step_ms).alias("t")).agg(getattr(F, how)("value").alias("v"))
    if lo is None or hi is None:
        r = p.agg(F.min("ms").alias("lo"), F.max("ms").alias("hi")).first()
        if r["lo"] is None:
            lo, hi = step_ms, 0
            return Frame(gap_filled(cells.limit(0), step_ms, step_ms, step_ms).df, frozenset([step_ms]))
        lo, hi = (-(-x // step_ms) * step_ms for x in (r["lo"], r["hi"]))
    return gap_filled(cells, lo, hi, step_ms)


def regroup(f: Frame, step_ms: int, complete: bool = False) -> Frame:
    """Every series brought to a coarser step by the mean of what is present (null if nothing is). With
    complete, as archives in memory are scanned, a last group whose end the series doesn't reach is left out."""
    if f.steps == {step_ms}:
        return f
    df = f.df.groupBy("name", slot_end("t", step_ms).alias("end")).agg(F.max("alias").alias("alias"), F.avg("v").alias("v"), F.max("t").alias("last"))
    df = (df.where("last = end") if complete else df).withColumnRenamed("end", "t")
    return Frame(df.select("name", "alias", "t", "v", F.lit(step_ms).cast("bigint").alias("step_ms")), frozenset([step_ms]))


def points_step(from_ms: int, to_ms: int, points: int, step_ms: int) -> int:
    """Width of a group when about `points` values are wanted: the range divided by points, rounded down
    to a multiple of the step, plus one step; the step itself without a limit."""
    if points <= 0:
        return step_ms
    return ((to_ms - from_ms) // points // step_ms + 1) * step_ms


def merge(frames: list[Frame], align: bool = True) -> Frame:
    """Union by name; the series of a later argument replaces an earlier one of the same name. With
    align all series are brought to the least common multiple of their steps."""
    step = math.lcm(*(s for f in frames for s in f.steps)) if any(f.steps for f in frames) else 1
    if align:
        frames = [regroup(f, step) for f in frames]
    if len(frames) == 1:
        return frames[0]
    sound_unions(frames[0].df.sparkSession)
    rows = reduce(DataFrame.unionByName, [f.df.select(*COLUMNS, F.lit(i).alias("arg")) for i, f in enumerate(frames)])
    rows = rows.withColumn("top", F.max("arg").over(whole())).where("arg = top").drop("arg", "top")
    return Frame(rows, frozenset().union(*(f.steps for f in frames)))


def quantile(values, p: float):
    """Quantile of an array column that may hold nulls: they count and sort lowest; position
    p * (n + 1), first or last value outside 1..n, linear between neighbours."""
    rank = F.transform(values, lambda v: F.struct(v.isNotNull().alias("has"), v.alias("v")))
    s, n = F.array_sort(rank), F.size(values)
    pos = F.lit(float(p)) * (n + 1)
    k = F.floor(pos).cast("int")
    at = lambda i: F.get(s, i - 1)["v"]
    between = at(k) + (pos - k) * (at(k + 1) - at(k))
    return F.when(n == 0, None).when(pos < 1, at(F.lit(1))).when(pos >= n, at(n)).when(pos == k, at(k)).otherwise(between)
