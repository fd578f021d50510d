"""Problem 2: irregular readings onto a regular grid.

1. Readings are aggregated to (series, time, value), which makes one of those delivered again, and then to
   (series, slot), both with map-side combining: a hot slot is spread over its readings first.
2. The time axis of a series is cut into blocks of `block_slots` slots. Per block only its first and last
   reading go through a per-series window, which gives every block (also the empty ones between) the
   last reading before and the first reading after it. No task ever holds a whole hot series.
3. The sequence of slots of a block is generated after the blocks have been shuffled, in the same task
   that receives the readings of the block; the left join of grid and readings is a union of both and a
   group by slot in that task, with no further shuffle.
4. Windows over (series, block) carry the last observation forward, within max_gap_ms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import finite, slot_end, sound_unions


def usable_readings(
    df: DataFrame, key: str, ts: str, value: str, received_at: str | None = None, max_delay_ms: int = 7 * 86_400_000
) -> DataFrame:
    """Rows (key, ms, value) with a key, a time and a finite value; if received_at is given, only those
    whose two times are at most max_delay_ms apart (a null receipt time is not usable)."""
    ok = finite(value) & F.col(ts).isNotNull() & F.col(key).isNotNull()
    if received_at:
        apart = F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(received_at).cast("timestamp")))
        ok = ok & (apart <= max_delay_ms * 1000)
    return df.where(ok).select(
        F.col(key).alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(value).cast("double").alias("value")
    )


def regular_grid(readings: DataFrame, max_gap_ms=None, block_slots: int = 2048) -> DataFrame:
    """One row per series and slot from the first to the last slot with a reading.

    readings: (key, step_ms, heartbeat_ms, ms, value), usable rows only. max_gap_ms: how far the last
    observation is carried (a number or a column name; default heartbeat_ms).
    Result: key, slot_ms (slot END), n (readings in the slot), value (their mean, null without
    readings), filled (value, or the last earlier reading carried forward), missing.

    `missing` marks a slot without readings that lies strictly between two successive readings more
    than heartbeat_ms apart. A slot without readings between readings that are closer is known and
    gets the value of the last slot with readings carried forward. Rows with a null key, step or heartbeat, or a step below 1, are
    left out; a reading that is there again (same time and value) changes nothing but n. Empty input gives an empty result.
    """
    sound_unions(readings.sparkSession)
    r = readings.where(
        F.col("key").isNotNull() & F.col("step_ms").isNotNull() & F.col("heartbeat_ms").isNotNull() & (F.col("step_ms") > 0)
    )
    carry = F.col(max_gap_ms) if isinstance(max_gap_ms, str) else F.lit(max_gap_ms).cast("bigint")
    gap = F.coalesce(carry, F.col("heartbeat_ms")) if max_gap_ms is not None else F.col("heartbeat_ms")
    fixed = ["step_ms", "heartbeat_ms", "carry_ms"]
    once = r.withColumn("carry_ms", gap).groupBy("key", *fixed, "ms", "value").agg(F.count("*").alias("n"))
    once = once.withColumn("slot", slot_end("ms", "step_ms")).withColumn("block", F.floor(F.col("slot") / F.col("step_ms") / block_slots).cast("bigint"))
    cells = once.groupBy("key", "block", "slot", *fixed).agg(
        F.sum("n").alias("n"), F.avg("value").alias("value"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms")
    )
    # both readers of the cells keep n, so that they have one shuffle in common
    cells = cells.where("n > 0")

    # the neighbours of each block
    blocks = cells.groupBy("key", "block", *fixed).agg(
        F.min("slot").alias("lo"),
        F.max("slot").alias("hi"),
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
        F.max_by("value", "slot").alias("last_value"),
    )
    w = Window.partitionBy("key").orderBy("block")
    blocks = (
        blocks.withColumn("before_ms", F.lag("last_ms").over(w))
        .withColumn("before_value", F.lag("last_value").over(w))
        .withColumn("prev_block", F.lag("block").over(w))
        .withColumn("next_block", F.lead("block").over(w))
        .withColumn("after_ms", F.lead("first_ms").over(w))
    )
    # an occupied block, and the run of empty blocks behind it as descriptors of their own
    own = blocks.select(
        "key",
        "block",
        *fixed,
        F.when(F.col("prev_block").isNull(), F.col("lo")).otherwise(F.col("block") * block_slots * F.col("step_ms")).alias("lo"),
        F.when(F.col("next_block").isNull(), F.col("hi"))
        .otherwise(((F.col("block") + 1) * block_slots - 1) * F.col("step_ms"))
        .alias("hi"),
        "before_ms",
        "before_value",
        "after_ms",
    )
    empty = (
        blocks.where(F.col("next_block") > F.col("block") + 1)
        .withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("next_block") - 1)))
        .select(
            "key",
            "block",
            *fixed,
            (F.col("block") * block_slots * F.col("step_ms")).alias("lo"),
            (((F.col("block") + 1) * block_slots - 1) * F.col("step_ms")).alias("hi"),
            F.col("last_ms").alias("before_ms"),
            F.col("last_value").alias("before_value"),
            "after_ms",
        )
    )
    null = lambda kind: F.lit(None).cast(kind)
    both = own.unionByName(empty).select(
        "key", "block", *fixed, "lo", "hi", "before_ms", "before_value", "after_ms",
        F.lit(0).cast("bigint").alias("n"), null("double").alias("value"), null("bigint").alias("first_ms"), null("bigint").alias("last_ms"),
    ).unionByName(
        cells.select(
            "key", "block", *fixed, F.col("slot").alias("lo"), F.col("slot").alias("hi"),
            null("bigint").alias("before_ms"), null("double").alias("before_value"), null("bigint").alias("after_ms"),
            "n", "value", "first_ms", "last_ms",
        )
    )
    grid = (
        both.repartition("key", "block")
        .withColumn("slot_ms", F.explode(F.sequence("lo", "hi", "step_ms")))
        .groupBy("key", "block", "slot_ms", *fixed)
        .agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("value", "first_ms", "last_ms", "before_ms", "before_value", "after_ms")))
    )
    back = Window.partitionBy("key", "block").orderBy("slot_ms").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("key", "block").orderBy(F.desc("slot_ms")).rowsBetween(Window.unboundedPreceding, 0)
    grid = (
        grid.withColumn("prev_ms", F.coalesce(F.last("last_ms", True).over(back), F.col("before_ms")))
        .withColumn("prev_value", F.coalesce(F.last("value", True).over(back), F.col("before_value")))
        .withColumn("next_ms", F.coalesce(F.last("first_ms", True).over(ahead), F.col("after_ms")))
    )
    empty_slot = F.col("n") == 0
    missing = empty_slot & (F.col("next_ms") - F.col("prev_ms") > F.col("heartbeat_ms"))
    carried = F.when(~missing & (F.col("slot_ms") - F.col("prev_ms") <= F.col("carry_ms")), F.col("prev_value"))
    return grid.select(
        "key", "slot_ms", "n", "value", F.when(empty_slot, carried).otherwise(F.col("value")).alias("filled"), missing.alias("missing")
    )
