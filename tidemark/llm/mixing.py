"""Problem 7: mixing sources to target weights (weighted fair queueing).

Each source's documents are shuffled by a hash, once per repetition; a document's virtual finish time is
the source's tokens up to and including it divided by the source's target share. Taking all documents
with a finish time up to the total budget B gives each source its share of B but for less than one
document. The running totals of a source (few sources, each large) are computed in buckets of the hash:
sums of buckets go through a window of their own, then each bucket is summed up by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 20_000


def _targets(items: DataFrame, targets: DataFrame) -> list[dict]:
    """Target sources with their available documents and tokens. The list of targets is a parameter
    table: more than 10,000 of them are refused."""
    t = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(
        F.max("target_share").alias("share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(1)).alias("max_repeats")
    )
    rows = t.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 target sources")
    total = sum(r["share"] for r in rows)
    names = [r["source"] for r in rows]
    have = {r["source"]: r for r in items.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("docs")).collect()} if names else {}
    return [
        {
            "source": r["source"], "share": r["share"] / total, "max_repeats": int(r["max_repeats"]),
            "tokens": int(have[r["source"]]["tokens"] or 0) if r["source"] in have else 0,
            "docs": have[r["source"]]["docs"] if r["source"] in have else 0,
        }
        for r in rows
    ]


def largest_budget(targets: list[dict]) -> float:
    """The greatest total at which no source needs more than its allowed repetitions; sources without
    any tokens can't contribute and don't limit it."""
    return min((t["max_repeats"] * t["tokens"] / t["share"] for t in targets if t["tokens"] > 0), default=0.0)


def mix(items: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 0) -> tuple[DataFrame, list[dict], float]:
    """(rows, targets with what is there, budget): rows (id, source, copy, size, finish), sorted by finish.

    items: (id, source, size); targets: (source, target_share, max_repeats). Shares are normalised to
    1. Without a budget the largest one that the repetitions allow is used; with a greater one, sources
    that run out stay below their share. copy counts a document's uses from 1 and never exceeds
    max_repeats. Documents with a null id, or of a null or unlisted source, are left out; null sizes
    count as 0; ids must be unique. Empty items or targets give no rows. Targets are a parameter that the
    driver holds: more than 10,000 sources raise a ValueError.
    """
    spark = items.sparkSession
    it = items.where(F.col("id").isNotNull()).select("id", "source", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("bigint").alias("size"))
    info = _targets(it, targets)
    b = largest_budget(info) if budget is None else float(budget)
    plan = []
    for t in info:
        if t["tokens"] > 0 and b > 0:
            plan.append((t["source"], t["share"], min(t["max_repeats"], math.ceil(b * t["share"] / t["tokens"])), max(0, math.ceil(math.log2(max(1, t["docs"] / BUCKET_ROWS))))))
    p = spark.createDataFrame(plan, "source string, share double, epochs int, bits int")
    x = it.join(F.broadcast(p), "source").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    x = x.withColumn("h", F.xxhash64("id", "copy", F.lit(seed)))
    x = x.withColumn("bucket", F.expr("case when bits = 0 then 0 else shiftright(h, 64 - bits) end"))
    sums = x.groupBy("source", "copy", "bucket").agg(F.sum("size").alias("part"))
    w = Window.partitionBy("source").orderBy("copy", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source", "copy", "bucket", F.coalesce(F.sum("part").over(w), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "copy", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    y = x.join(before, ["source", "copy", "bucket"]).withColumn("upto", F.col("before") + F.sum("size").over(inside))
    rows = y.withColumn("finish", F.col("upto") / F.col("share")).where(F.col("finish") <= b)
    return rows.select("id", "source", "copy", "size", "finish").orderBy("finish", "source", "id", "copy"), info, b


def mixing_report(rows: DataFrame, targets: list[dict], budget: float) -> DataFrame:
    """Target and reached share of each source of mix()."""
    spark = rows.sparkSession
    t = spark.createDataFrame(
        [(x["source"], x["share"], x["max_repeats"], x["tokens"], x["docs"]) for x in targets],
        "source string, target_share double, max_repeats int, tokens_there bigint, docs_there bigint",
    )
    got = rows.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("n_rows"), F.max("copy").alias("most_copies"))
    out = t.join(got, "source", "left").na.fill(0, ["tokens", "n_rows", "most_copies"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("actual_share", F.try_divide(F.col("tokens"), whole)).withColumn("budget", F.lit(budget))
