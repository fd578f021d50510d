"""Problem 4: rolling totals over trailing periods.

Readings are aggregated to (entity, day) with map-side combining, each entity's calendar from its first
to its last day is generated from its own bounds (an explode, not a cross join of all pairs), and fixed
ROWS frames over the dense days give the trailing sums. One window group is one entity's calendar, so
its size is the number of days and never the number of readings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import finite


#: Greater values are summed apart, so that sums don't depend on the order in which they come and go.
LARGE = 2.0**40


def daily(df: DataFrame, entity: str, t: str, value: str, end_inclusive: bool = True, dedupe: bool | Sequence[str] = True) -> DataFrame:
    """(entity, day, n, small, large): usable readings per UTC day, and the sums of those below and from LARGE.

    With end_inclusive the reading at midnight belongs to the day that ends there (a slot is labelled
    by its END). Null, NaN and infinite values and null times or entities are not usable. Exact
    duplicate rows (equal in every column) count once when dedupe is set; if it names the columns that
    identify a row, only these, entity, day and value are compared (and shuffled).
    """
    at = F.unix_millis(F.col(t).cast("timestamp")) - (1 if end_inclusive else 0)
    if dedupe is True:
        df = df.distinct()
    v = df.where(finite(value) & F.col(t).isNotNull() & F.col(entity).isNotNull())
    ids = [] if isinstance(dedupe, bool) else [F.col(c).alias(f"id{k}") for k, c in enumerate(dedupe)]
    v = v.select(F.col(entity).alias("entity"), F.to_date(F.timestamp_millis(at)).alias("day"), F.col(value).cast("double").alias("v"), *ids)
    if ids:
        v = v.distinct()
    large = F.abs("v") >= LARGE
    parts = [F.coalesce(F.sum(F.when(c, F.col("v"))), F.lit(0.0)).alias(name) for name, c in (("small", ~large), ("large", large))]
    return v.groupBy("entity", "day").agg(F.count("*").alias("n"), *parts)


def densify(days: DataFrame) -> DataFrame:
    """One row for each day from an entity's first to its last; days without readings have n = 0."""
    bounds = days.groupBy("entity").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    cal = bounds.select("entity", F.explode(F.sequence("lo", "hi")).alias("day"))
    return cal.join(days, ["entity", "day"], "left").select(
        "entity",
        "day",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("small", F.lit(0.0)).alias("small"),
        F.coalesce("large", F.lit(0.0)).alias("large"),
    )


def rolling_totals(
    df: DataFrame,
    entity: str,
    t: str,
    value: str,
    windows: tuple[int, ...] = (7, 30),
    end_inclusive: bool = True,
    dedupe: bool | Sequence[str] = True,
) -> DataFrame:
    """Per entity and calendar day: n, total and, for each trailing window of w days (the day itself
    and the w - 1 days before it), n_w, sum_w and mean_w.

    The sum over days without readings is 0, the mean is null there. Days run from the entity's first
    to its last day with a usable reading; entities without any give no rows. Empty input gives an
    empty result.
    """
    out = densify(daily(df, entity, t, value, end_inclusive, dedupe))
    w = Window.partitionBy("entity").orderBy("day")
    for k in windows:
        f = w.rowsBetween(-(k - 1), 0)
        out = out.withColumn(f"n_{k}", F.sum("n").over(f)).withColumn(f"sum_{k}", F.sum("small").over(f) + F.sum("large").over(f))
    for k in windows:
        out = out.withColumn(f"mean_{k}", F.when(F.col(f"n_{k}") > 0, F.col(f"sum_{k}") / F.col(f"n_{k}")))
    return out.withColumn("total", F.col("small") + F.col("large")).drop("small", "large")
