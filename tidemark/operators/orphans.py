"""Problem 1: references to records that do not exist.

Parent keys and child keys are united in one long table, grouped by (parent table, key) with map-side
combining, and the groups without a parent flag (or whose earliest parent is younger than a child) are
kept. The child rows of those keys are found again by a join on the key. Keys with more than HOT_ROWS
children, of which there can be only so many, are joined apart by a broadcast, so that no task holds all
rows of one key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast, cut, sound_unions

HOT_ROWS = 100_000


@dataclass(frozen=True)
class Parent:
    """A referenced table: `key` is what children point at, `at` (optional) when the row came."""

    table: str
    df: DataFrame
    key: str
    at: str | None = None


@dataclass(frozen=True)
class Child:
    """A referring table: rows `id` point with `key` at `parent`; `at` (optional) dates the row."""

    table: str
    df: DataFrame
    id: str
    key: str
    parent: str
    at: str | None = None


def _at(df: DataFrame, name: str | None):
    return (df[name] if name else F.lit(None)).cast("timestamp")


def _children(children: list[Child]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            c.df.select(
                F.lit(c.parent).alias("parent_table"),
                c.df[c.key].cast("string").alias("key"),
                F.lit(c.table).alias("child_table"),
                c.df[c.id].alias("child_id"),
                _at(c.df, c.at).alias("child_at"),
            ).where(F.col("key").isNotNull())
            for c in children
        ],
    )


def orphan_keys(parents: list[Parent], children: list[Child]) -> DataFrame:
    """(parent_table, key, has_parent, parent_at, n_children) of every key with an orphan reference.

    A key is kept if it has children and no parent row, or if the earliest parent row is later than
    the earliest child. Null keys refer to nothing and are left out. Duplicate parent rows count once.
    """
    sound_unions(parents[0].df.sparkSession)
    p = reduce(
        DataFrame.unionByName,
        [
            x.df.select(
                F.lit(x.table).alias("parent_table"),
                x.df[x.key].cast("string").alias("key"),
                F.lit(1).alias("is_parent"),
                _at(x.df, x.at).alias("parent_at"),
                F.lit(None).cast("timestamp").alias("child_at"),
                F.lit(0).alias("n"),
            ).where(F.col("key").isNotNull())
            for x in parents
        ],
    )
    c = _children(children).select(
        "parent_table",
        "key",
        F.lit(0).alias("is_parent"),
        F.lit(None).cast("timestamp").alias("parent_at"),
        "child_at",
        F.lit(1).alias("n"),
    )
    g = p.unionByName(c).groupBy("parent_table", "key").agg(
        (F.max("is_parent") == 1).alias("has_parent"),
        F.min("parent_at").alias("parent_at"),
        F.min("child_at").alias("first_child_at"),
        F.sum("n").alias("n_children"),
    )
    late = F.coalesce(F.col("parent_at") > F.col("first_child_at"), F.lit(False))
    return g.where((F.col("n_children") > 0) & (~F.col("has_parent") | late)).drop("first_child_at")


def orphan_rows(parents: list[Parent], children: list[Child]) -> DataFrame:
    """Every referring row whose reference is an orphan, once: (child_table, child_id, parent_table,
    key, child_at, reason) with reason 'absent' or 'later'.

    A row is an orphan if its key is not null and no parent row has that key, or the earliest parent
    row is later than the row itself. Missing times never make a row 'later'. Exact duplicates of a
    child row come out once. Empty tables give an empty result; extra columns are ignored.
    """
    bad, c = cut(orphan_keys(parents, children)), _children(children)
    hot = F.col("n_children") > HOT_ROWS
    j = c.join(bad.where(~hot), ["parent_table", "key"])
    if not bad.where(hot).isEmpty():
        j = j.unionByName(c.join(bounded_broadcast(bad.where(hot)), ["parent_table", "key"]))
    later = F.coalesce(F.col("parent_at") > F.col("child_at"), F.lit(False))
    return (
        j.where(~F.col("has_parent") | later)
        .select(
            "child_table",
            "child_id",
            "parent_table",
            "key",
            "child_at",
            F.when(F.col("has_parent"), "later").otherwise("absent").alias("reason"),
        )
        .distinct()
    )


def orphan_report(rows: DataFrame, period: str = "month") -> DataFrame:
    """Orphans of orphan_rows() counted by referring table, reason and period of the child row.

    `period` is a date_trunc unit; rows without a time are counted under a null period. Rows that
    differ only in key or time (the same id twice) are each counted.
    """
    return rows.groupBy(
        "child_table",
        "parent_table",
        "reason",
        F.date_format(F.date_trunc(period, "child_at"), "yyyy-MM-dd").alias("period"),
    ).agg(F.count("*").alias("n_orphans"), F.countDistinct("key").alias("n_keys"))
