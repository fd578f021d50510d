"""Problem 6: filling fixed-capacity containers with items (best-two-fit).

Items are hashed to shards of a bounded number of items; a shard is packed by one task from the
histogram of its sizes, so its memory is bounded (a task holds one shard of one kind and as many rows of
others) and all shards run at once. A shard leaves at most one badly filled bin per kind, which is little
against the bins of 20,000 items; the README gives the fill for one shard and for several.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grouped import by_group, hashed, whole_groups

SHARD_ITEMS = 20_000


class _Stock:
    """Unpacked items by size: the largest one that fits is found by bisection."""

    def __init__(self, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        values, start = np.unique(sizes[order], return_index=True)
        self.items = {int(v): list(map(int, g))[::-1] for v, g in zip(values, np.split(order, start[1:]), strict=True)} if len(sizes) else {}
        self.sizes = sorted(self.items)

    def floor(self, room: int) -> int | None:
        k = bisect_right(self.sizes, room)
        return self.sizes[k - 1] if k else None

    def take(self, size: int) -> int:
        left = self.items[size]
        item = left.pop()
        if not left:
            del self.items[size]
            del self.sizes[bisect_right(self.sizes, size) - 1]
        return item

    def put(self, size: int, item: int) -> None:
        if size in self.items:
            self.items[size].append(item)
        else:
            self.items[size] = [item]
            self.sizes.insert(bisect_right(self.sizes, size), size)

    def two(self, room: int, more_than: int) -> tuple[int, int] | None:
        """Sizes of two unpacked items whose sum is the greatest that is at most room and above more_than."""
        best, pair = more_than, None
        k = bisect_right(self.sizes, room) - 1
        while k >= 0:
            a = self.sizes[k]
            if 2 * a <= best:  # a is the larger one: no later pair can be better
                break
            b = self.floor(min(room - a, a))
            if b == a and len(self.items[a]) < 2:
                j = bisect_right(self.sizes, a - 1)
                b = self.sizes[j - 1] if j else None
            if b is not None and a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            k -= 1
        return pair


def best_two_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers; every size is between 0 and capacity. Each bin is filled greedily with the
    largest item that fits; then, as long as it helps, its smallest item is replaced by two unpacked
    ones that fill the gap it leaves more tightly."""
    stock, bins = _Stock(np.asarray(sizes, np.int64)), []
    while stock.sizes:
        bin_: list[tuple[int, int]] = []
        room = capacity
        while (s := stock.floor(room)) is not None:
            bin_.append((s, stock.take(s)))
            room -= s
        while room > 0 and stock.sizes and bin_:
            small, item = min(bin_)
            if (pair := stock.two(room + small, small)) is None:
                break
            bin_.remove((small, item))
            bin_ += [(s, stock.take(s)) for s in pair]
            room += small - sum(pair)
            stock.put(small, item)
            while (s := stock.floor(room)) is not None:
                bin_.append((s, stock.take(s)))
                room -= s
        bins.append([i for _, i in bin_])
    return bins


def pack(items: DataFrame, id_col: str, size: str, containers: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Assign every item to bins of each container kind.

    containers: (container string, capacity bigint); kinds with a null or non-positive capacity are left
    out. Result: container, capacity, bin (bigint, unique per container and capacity), id_col, piece, n_pieces, size.
    An item is split only if it alone is larger than the capacity: into full pieces, each a bin of its
    own, and a rest that is packed like any item. Null sizes count as 0 and take no room. Ids are not
    looked at: repeated rows are packed each. Empty input gives an empty result.
    """
    shards = max(1, -(-items.count() // shard_items))
    kinds = containers.where("capacity > 0").select("container", F.col("capacity").cast("bigint").alias("capacity")).distinct()
    # the kinds are a parameter: one array, the same for all items
    kinds = kinds.agg(F.collect_list(F.struct("container", "capacity")).alias("kinds"))
    id_type = dict(items.dtypes)[id_col]
    it = items.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(size)), F.lit(shards)).alias("shard"),
        F.col(id_col).alias("item"),
        F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size"),
        F.explode(kinds.scalar()).alias("kind"),
    ).select("shard", "kind.*", "item", "size")
    it = it.withColumn("group", hashed("shard", "container", "capacity"))

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        shard, cap, sz = (t[c].to_numpy() for c in ("shard", "capacity", "size"))
        kind = t["container"].combine_chunks().dictionary_encode(null_encoding="encode")
        kind = kind.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((cap, kind, shard))
        cuts = np.flatnonzero((np.diff(shard[order]) != 0) | (np.diff(kind[order]) != 0) | (np.diff(cap[order]) != 0)) + 1
        for rows in np.split(order, cuts):
            c, s = int(cap[rows[0]]), sz[rows]
            full, rest = s // c, s % c
            packed = np.flatnonzero((rest > 0) | (s == 0))
            bins = best_two_fit(rest[packed], c)
            j = packed[np.fromiter((i for b in bins for i in b), np.int64, len(packed))]
            k = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
            # the full pieces, each a bin of its own
            of = np.repeat(np.arange(len(rows)), full)
            number = np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full)
            at = np.concatenate([j, of])
            r = pa.array(rows[at])
            yield from pa.table(
                [
                    t["container"].combine_chunks().take(r),
                    t["capacity"].combine_chunks().take(r),
                    pa.array(np.concatenate([k, len(bins) + np.arange(len(of))]) + (int(shard[rows[0]]) << 32)),
                    t["item"].combine_chunks().take(r),
                    pa.array(np.concatenate([full[j], number]).astype(np.int32)),
                    pa.array((full + ((rest > 0) | (s == 0)))[at].astype(np.int32)),
                    pa.array(np.concatenate([rest[j], np.full(len(of), c)])),
                ],
                names=["container", "capacity", "bin", id_col, "piece", "n_pieces", "size"],
            ).to_batches(max_chunksize=50_000)

    schema = f"container string, capacity bigint, bin bigint, `{id_col}` {id_type}, piece int, n_pieces int, size bigint"
    # one task for some shards of a kind, never coalesced: packing takes long for few bytes
    return by_group(it, partitions=min(shards * 3, 20_000)).mapInArrow(whole_groups(flush, shard_items), schema)


def packing_report(packed: DataFrame) -> DataFrame:
    """Per container: items, split items, bins, tokens and the share of the room that is used."""
    bins = packed.groupBy("container", "capacity", "bin").agg(
        F.sum("size").alias("used"), F.sum((F.col("piece") == 0).cast("int")).alias("items"),
        F.sum(((F.col("piece") == 0) & (F.col("n_pieces") > 1)).cast("int")).alias("split"),
    )
    return bins.groupBy("container", "capacity").agg(
        F.count("*").alias("n_bins"),
        F.sum("items").alias("n_items"),
        F.sum("split").alias("n_split"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        (F.sum("used") / (F.count("*") * F.col("capacity"))).alias("fill"),
    )
