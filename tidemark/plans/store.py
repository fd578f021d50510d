"""Archives and series: choice of the archive, name search and the SQL views.

archive: (name, cf, step_ms, t bigint ms of the slot END, v double). Which archives there are is plan-time
metadata (a handful of rows per specification); the choice becomes a literal filter that prunes
partitions of (step_ms, cf).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import Frame, gap_filled, points_step, regroup
from ..names import glob_filter
from ..session import bounded_broadcast


@dataclass(frozen=True)
class Archive:
    """One archive of a specification: size slots of step_ms; latest is the end of its newest slot."""

    step_ms: int
    size: int
    latest_ms: int
    cf: str = "WMEAN"

    @property
    def begins_ms(self) -> int:
        """End of the oldest slot that is kept, minus one step."""
        return self.latest_ms - self.step_ms * self.size


def best_archive(archives: list[Archive], from_ms: int, to_ms: int, points: int = 0) -> Archive:
    """The archive for a range: of those that hold its start (or all if none does: the longest span),
    the one whose step is nearest to range / points, or the finest without a number of points."""
    if not archives:
        raise ValueError("no archives")
    can = [a for a in archives if a.begins_ms <= from_ms]
    if not can:
        longest = max(a.step_ms * a.size for a in archives)
        can = [a for a in archives if a.step_ms * a.size == longest]
    if points <= 0:
        return min(can, key=lambda a: a.step_ms)
    want = (to_ms - from_ms) / points
    return min(can, key=lambda a: (abs(a.step_ms - want), a.step_ms))


class Store:
    """fetch() of frames from an archive table. With a table of series (name), those that exist without a slot
    in the range are there, too, all missing; and the archive is read once instead of also for its names."""

    def __init__(self, archive: DataFrame, archives: list[Archive], compat: bool = False, series: DataFrame | None = None):
        self.archive, self.archives, self.compat, self.series = archive, archives, compat, series

    def fetch(self, pattern: str, from_ms: int, to_ms: int, max_points: int = 0) -> Frame:
        a = best_archive(self.archives, from_ms, to_ms, max_points)
        lo = max(from_ms, a.begins_ms)
        rows = self.archive.where(
            (F.col("step_ms") == a.step_ms) & (F.col("cf") == a.cf) & (F.col("t") > lo) & (F.col("t") <= to_ms)
        ).where(glob_filter("name", pattern, self.compat))
        names = None if self.series is None else self.series.where(glob_filter("name", pattern, self.compat)).select("name").distinct()
        first, last = (lo // a.step_ms + 1) * a.step_ms, to_ms // a.step_ms * a.step_ms
        if first > last:
            return Frame(gap_filled(rows.select("name", "t", "v").limit(0), last, last, a.step_ms).df, frozenset([a.step_ms]))
        f = gap_filled(rows.select("name", "t", "v"), first, last, a.step_ms, names)
        width = points_step(lo, to_ms, max_points, a.step_ms)
        return regroup(f, width) if width > a.step_ms else f


def search(series: DataFrame, tags: str, wanted: dict[str, str]) -> DataFrame:
    """Series whose map column `tags` has every wanted tag with a value matching its regex (anywhere,
    ignoring case). Null maps match nothing."""
    out = series
    for k, rx in wanted.items():
        out = out.where(F.map_contains_key(tags, k) & F.element_at(tags, k).rlike(f"(?i){rx}"))
    return out


def ident_key(tags):
    """Canonical text of a tag map: JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))


def find_nodes(names: DataFrame, pattern: str, name: str = "name") -> DataFrame:
    """(id, text, leaf, expandable) of the name-tree nodes at the pattern's level that match it."""
    depth = pattern.count(".") + 1
    parts = F.split(F.col(name), "[.]")
    n = names.select(parts.alias("p"), F.size(parts).alias("n")).where(F.col("n") >= depth)
    n = n.select(F.array_join(F.slice("p", 1, depth), ".").alias("id"), (F.col("n") == depth).alias("leaf"))
    g = n.where(glob_filter("id", pattern)).groupBy("id").agg(F.bool_or("leaf").alias("leaf"), F.bool_or(~F.col("leaf")).alias("expandable"))
    return g.select("id", F.substring_index("id", ".", -1).alias("text"), "leaf", "expandable")


def find_response(names: DataFrame, pattern: str) -> DataFrame:
    """find_nodes() without repeated last components: the first id of each is kept."""
    first = F.min_by(F.struct("id", "text", "leaf", "expandable"), "id").alias("n")
    return find_nodes(names, pattern).groupBy("text").agg(first).select("n.*")


def rra_view(rra: DataFrame, bundles: DataFrame, ds: DataFrame | None = None) -> DataFrame:
    """Archives with step and span of their bundle, and (with ds) of the source they belong to."""
    v = rra.join(bounded_broadcast(bundles.select(F.col("id").alias("rra_bundle_id"), F.col("step_ms").alias("rra_step_ms"), "size")), "rra_bundle_id")
    v = v.withColumn("span_ms", F.col("rra_step_ms") * F.col("size"))
    if ds is not None:
        v = v.join(ds.select(F.col("id").alias("ds_id"), "name", F.col("step_ms").alias("ds_step_ms"), "heartbeat_ms"), "ds_id")
    return v


def ds_view(ds: DataFrame, state: DataFrame) -> DataFrame:
    """Sources with their state: element idx (from 1) of the arrays of segment seg; null where the
    segment or the element is absent."""
    at = lambda c: F.get(c, F.col("idx") - 1)
    j = ds.join(state, "seg", "left")
    return j.select(
        "id", "name", "step_ms", "heartbeat_ms", "seg", "idx",
        at("lastupdate").alias("lastupdate"), at("duration_ms").alias("duration_ms"), at("value").alias("value"),
    )


def tvd_view(tv: DataFrame) -> DataFrame:
    """tv with the time of the slot before it and the distance in slots."""
    w = Window.partitionBy("ds_id", "rra_id").orderBy("t", "tv_id")
    return tv.withColumn("prev_t", F.lag("t").over(w)).withColumn(
        "slots", F.expr("(unix_millis(t) - unix_millis(prev_t)) div step_ms")
    )


def register_views(spark, archive: DataFrame, series: DataFrame) -> None:
    """The SQL surface: temp views tv (name, cf, step_ms, t timestamp, r) and series."""
    tv = archive.select("name", "cf", "step_ms", F.timestamp_millis("t").alias("t"), F.col("v").alias("r"))
    tv.createOrReplaceTempView("tv")
    series.createOrReplaceTempView("series")


def delete_series(archive: DataFrame, names: DataFrame) -> DataFrame:
    """archive without the rows of the given series (name); null names delete nothing."""
    return archive.join(names.select("name").distinct(), "name", "left_anti")


def create_archives(series: DataFrame, archives) -> DataFrame:
    """One row per series (name) and archive of its specification: (name, cf, step_ms, size, xff)."""
    kinds = F.array(*(F.struct(F.lit(a.cf).alias("cf"), F.lit(a.step_ms).cast("bigint").alias("step_ms"), F.lit(a.size).cast("bigint").alias("size"), F.lit(float(a.xff)).alias("xff")) for a in archives))
    return series.select("name").where("name is not null").distinct().select("name", F.explode(kinds).alias("a")).select("name", "a.*")
