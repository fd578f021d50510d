"""Whole groups to Python, a bounded number of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_group(df: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """Rows of df (with a bigint column `group`) shuffled by group and sorted by it, then by `order`."""
    df = df.repartition(partitions, "group") if partitions else df.repartition("group")
    return df.sortWithinPartitions("group", *order)


def hashed(*keys: str):
    """A bigint to shuffle and sort groups by; keys that collide only share a call."""
    return F.xxhash64(*keys)


def whole_groups(
    flush: Callable[[pa.Table], Iterable[pa.RecordBatch] | None], rows: int = 20_000, shrink: Callable[[pa.Table], pa.Table] | None = None
) -> Callable:
    """mapInArrow function over the rows of by_group() that hands whole groups to flush, as few at a time
    as make `rows` rows. What a task holds is that and one group; where groups may be of any size, shrink
    replaces the rows of a group that is not complete yet by fewer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            g = t["group"].to_numpy()
            if held and n >= rows and g[0] != held[-1]["group"][-1].as_py():
                yield from flush(pa.concat_tables(held).combine_chunks()) or ()
                held, n = [], 0
            # the last group may go on in the next batch: it stays, what is before it is complete
            cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            if cut:
                held.append(t.slice(0, cut))
                n += cut
                if n >= rows:
                    yield from flush(pa.concat_tables(held).combine_chunks()) or ()
                    held, n = [], 0
            held.append(t.slice(cut))
            n += t.num_rows - cut
            if shrink and n >= 2 * rows:
                held = [shrink(pa.concat_tables(held).combine_chunks())]
                n = held[0].num_rows
        if held:
            yield from flush(pa.concat_tables(held).combine_chunks()) or ()

    return run
