"""Problem 3: percentiles of very large numeric columns with a deterministic error bound (q-digest).

Values are quantised to an ordered universe of 2**32 codes: the upper half of the IEEE bits, mapped so
that order is kept (relative width of a cell at most 2**-20). A digest is a set of (node, count) over
the dyadic tree of the universe; node ids are heap numbers, 1 is the root, 2**32 + code a leaf.

Compression moves counts to the parent while a parent with both children holds at most
floor(eps * n / 32); so each inner node holds at most that, and the rank of any value is off by at most
the counts of its 32 ancestors: rank error <= eps * n. Digests merge by node addition, the bounds add up
to eps * (n1 + n2), and compressing the merged digest keeps them.

Every task digests its own rows first, block by block into one running digest, so that a hot group
shrinks to O(32 / eps) nodes per task before anything is shuffled (a group of fewer than 32 / eps values
stays as it is: it has no node to spare). Where there are many tasks, digests are merged in rounds of
`fan_in`, told apart by the task that made them. A merging task, too, holds a running digest: it never holds
more than a block of rows beside the digest of one group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grouped import by_group, hashed, whole_groups
from ..session import finite

BITS = 32
#: Rows digested at once, and so the memory of a task.
BLOCK_ROWS = 1_000_000


def encode(v: np.ndarray) -> np.ndarray:
    """Order-preserving codes 0 .. 2**32 - 1 of finite doubles; -0.0 is 0.0."""
    b = (np.asarray(v, np.float64) + 0.0).view(np.int64)
    u = np.where(b >= 0, b ^ np.int64(-(2**63)), ~b).view(np.uint64)
    return (u >> np.uint64(64 - BITS)).astype(np.int64)


def decode(code: np.ndarray) -> np.ndarray:
    """The middle of a code's cell (the ends of the universe are finite)."""
    u = (np.asarray(code).astype(np.uint64) << np.uint64(64 - BITS)) | np.uint64(1 << (63 - BITS))
    b = np.where(u >= np.uint64(1 << 63), u ^ np.uint64(1 << 63), ~u).view(np.float64)
    exact = np.where(np.asarray(code) == 1 << (BITS - 1), 0.0, b)
    return np.clip(np.nan_to_num(exact, nan=0.0), -np.finfo(np.float64).max, np.finfo(np.float64).max)


def _add(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum counts of equal keys; keys come out sorted."""
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[at], np.add.reduceat(count, at)


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node addition and compression of many digests at once; group: small integers from 0."""
    if not len(node):
        return group, node, count
    n = np.bincount(group, weights=count).astype(np.int64)
    most = np.floor(eps * n / BITS).astype(np.int64)
    shift = np.int64(BITS + 1)
    key, count = _add((group.astype(np.int64) << shift) | node, count.astype(np.int64))
    done_key, done_count = [], []
    # groups that are too small to compress pass through
    small = most[key >> shift] < 1
    done_key.append(key[small])
    done_count.append(count[small])
    key, count = key[~small], count[~small]
    low = (np.int64(1) << shift) - 1
    for level in range(BITS):
        if not len(key):
            break
        here = (key & low) >= np.int64(1) << (BITS - level)
        k, c = key[here], count[here]
        up_key, up_count = key[~here], count[~here]
        g, nd = k >> shift, k & low
        pk, start, inv = np.unique((g << shift) | (nd >> 1), return_index=True, return_inverse=True)
        total = np.bincount(inv, weights=c).astype(np.int64)
        if len(up_key):
            at = np.minimum(np.searchsorted(up_key, pk), len(up_key) - 1)
            has = up_key[at] == pk
            own = np.where(has, up_count[at], 0)
        else:
            own = np.zeros(len(pk), np.int64)
        move = total + own <= most[pk >> shift]
        stay = ~move[inv]
        done_key.append(k[stay])
        done_count.append(c[stay])
        key, count = _add(np.concatenate([up_key, pk[move]]), np.concatenate([up_count, total[move]]))
    done_key.append(key)
    done_count.append(count)
    key, count = np.concatenate(done_key), np.concatenate(done_count)
    return key >> shift, key & low, count


def quantile_nodes(node: np.ndarray, count: np.ndarray, qs: Sequence[float]) -> tuple[np.ndarray, int]:
    """Codes of the quantiles of one digest, and its n: nodes in order of their greatest value (smaller
    nodes first) are summed up to rank ceil(q * n)."""
    level = BITS - np.floor(np.log2(node)).astype(np.int64)
    top = ((node - (np.int64(1) << (BITS - level)) + 1) << level) - 1
    order = np.lexsort((level, top))
    cum = np.cumsum(count[order])
    n = int(cum[-1])
    rank = np.clip(np.ceil(np.asarray(qs) * n - 1e-9), 1, n)
    return top[order][np.searchsorted(cum, rank)], n


def _group_codes(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, list[int]]:
    """Small integers for the distinct key tuples, and the first row of each."""
    code = np.zeros(t.num_rows, np.int64)
    for k in keys:
        c = t[k].combine_chunks() if t[k].num_chunks else pa.array([], t[k].type)
        d = c.dictionary_encode(null_encoding="encode") if not pa.types.is_dictionary(c.type) else c
        idx = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = code * (len(d.dictionary) + 1) + idx
        _, code = np.unique(code, return_inverse=True)
    _, first, inv = np.unique(code, return_index=True, return_inverse=True)
    return inv, first


def _digested(t: pa.Table, keys: list[str], eps: float) -> pa.Table:
    """Rows (keys..., node, n) of any number of digests as one digest per group."""
    inv, first = _group_codes(t, keys)
    g, node, n = compress(inv, t["node"].to_numpy(), t["n"].to_numpy(), eps)
    rows = pa.array(first[g])
    cols = [t[c].combine_chunks().take(rows) for c in t.column_names if c not in ("node", "n")]
    return pa.table([*cols, pa.array(node), pa.array(n)], names=[*(c for c in t.column_names if c not in ("node", "n")), "node", "n"])


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def partial_digest(df: DataFrame, keys: list[str], value: str, eps: float = 0.005) -> DataFrame:
    """Digests (keys..., node, n, part) of the finite values per group and task, without a shuffle; merge()
    and percentiles() unite them. part numbers the tasks.

    Null, NaN and infinite values are left out; a null key is a group of its own. Groups without a
    usable value give no rows, nor does an empty table. Extra columns are ignored; keys may not be called
    part, node or n.
    """
    if {"part", "node", "n"} & set(keys):
        raise ValueError("keys may not be called part, node or n")
    src = df.where(finite(value)).select(*keys, F.col(value).cast("double").alias("__v"), F.spark_partition_id().cast("bigint").alias("__part"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "part", "node", "n"]
        held: list[pa.Table] = []
        rows, part = 0, 0
        for b in batches:
            code = pa.array(encode(b.column("__v").to_numpy(zero_copy_only=False)) + (np.int64(1) << BITS))
            held.append(pa.table([*(b.column(k) for k in keys), b.column("__part"), code, pa.array(np.ones(b.num_rows, np.int64))], names=names))
            rows += b.num_rows
            if rows >= BLOCK_ROWS:
                held = [_digested(pa.concat_tables(held), keys, eps)]
                rows = held[0].num_rows
                # many small groups, which can't be made smaller: they are handed on
                if rows >= BLOCK_ROWS // 2:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
        if rows:
            yield from _digested(pa.concat_tables(held), keys, eps).to_batches(max_chunksize=50_000)

    return src.mapInArrow(local, f"{_key_schema(df, keys)}, part bigint, node bigint, n bigint")


def digest(df: DataFrame, keys: list[str], value: str, eps: float = 0.005, fan_in: int = 64) -> DataFrame:
    """partial_digest() merged to one digest per group, to be stored and merged again later."""
    return merge(partial_digest(df, keys, value, eps), keys, eps, fan_in)


def merge(digests: DataFrame, keys: list[str], eps: float = 0.005, fan_in: int = 64) -> DataFrame:
    """Digests (keys..., node, n) of the same eps united per `keys` (a subset of the keys they were made with)
    by node addition and compressed again."""
    ks, d = _fan_in(digests, keys, eps, fan_in)
    out = _grouped(d, ks).mapInArrow(_merger(ks, eps), f"{_key_schema(d, ks)}, node bigint, n bigint")
    return out.select(*(F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)), "node", "n")


def _partitions(df: DataFrame) -> int:
    """Number of tasks of df's last stage, as planned; nothing is run for it. Of a scan, which doesn't say, it
    is that of its splits; of other plans that don't say, what the session makes of a shuffle."""
    plan = df._jdf.queryExecution().executedPlan()
    if (n := plan.outputPartitioning().numPartitions()) > 0:
        return n
    if plan.getClass().getSimpleName() != "AdaptiveSparkPlanExec":
        return plan.execute().getNumPartitions()
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _grouped(d: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return by_group(d.withColumn("group", hashed(*keys, *more)))


def _fan_in(digests: DataFrame, keys: list[str], eps: float, fan_in: int) -> tuple[list[str], DataFrame]:
    """Merge partial digests of many tasks in rounds of fan_in, so that the last task of a hot group
    receives about fan_in of them. Digests without a `part` count as made by the tasks that read them. The
    keys go by names of their own until they are put out."""
    width = _partitions(digests)
    part = F.col("part") if "part" in digests.columns else F.spark_partition_id().cast("bigint")
    ks = [f"k{i}" for i in range(len(keys))]
    d = digests.select(*(F.col(name).alias(k) for k, name in zip(ks, keys, strict=True)), part.alias("part"), "node", "n")
    schema = d.schema
    while width > fan_in:
        width = -(-width // fan_in)
        salted = d.withColumn("part", F.pmod("part", F.lit(width)))
        d = _grouped(salted, ks, "part").mapInArrow(_merger([*ks, "part"], eps), schema)
    return ks, d.drop("part")


def _merger(keys: list[str], eps: float):
    """Whole groups of digests to one digest each."""

    def flush(t: pa.Table) -> list[pa.RecordBatch]:
        return _digested(t.select([*keys, "node", "n"]), keys, eps).to_batches(max_chunksize=50_000)

    return whole_groups(flush, BLOCK_ROWS // 4, _shrinker(keys, eps))


def _shrinker(keys: list[str], eps: float):
    def shrink(t: pa.Table) -> pa.Table:
        return _digested(t, keys, eps).select(t.column_names)

    return shrink


def percentiles(
    digests: DataFrame, keys: list[str], qs: Sequence[float], eps: float = 0.005, fan_in: int = 64
) -> DataFrame:
    """(keys..., n, quantile, value, rank_error) from whole or partial digests of eps, which are united
    per `keys` by node addition; one row per group and quantile.

    value is an actual reading's cell (relative width at most 2**-20); its rank differs from
    ceil(quantile * n) by at most rank_error = floor(eps * n) (0: exact but for the cell).
    """
    qs = [float(q) for q in qs]
    names = keys
    if not all(0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie between 0 and 1")

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        inv, first = _group_codes(t, keys)
        g, node, n = compress(inv, t["node"].to_numpy(), t["n"].to_numpy(), 0.0)
        order = np.argsort(g, kind="stable")
        g, node, n = g[order], node[order], n[order]
        at = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))
        rows, total, value, err = [], [], [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            code, m = quantile_nodes(node[a:b], n[a:b], qs)
            rows += [int(first[g[a]])] * len(qs)
            total += [m] * len(qs)
            value += decode(code).tolist()
            err += [int(eps * m / BITS) * BITS] * len(qs)
        cols = [t[k].combine_chunks().take(pa.array(rows, pa.int64())) for k in keys]
        yield from pa.table(
            [*cols, pa.array(total, pa.int64()), pa.array(qs * (len(at) - 1)), pa.array(value, pa.float64()), pa.array(err, pa.int64())],
            names=[*keys, "n", "quantile", "value", "rank_error"],
        ).to_batches()

    keys, d = _fan_in(digests, names, eps, fan_in)
    schema = f"{_key_schema(d, keys)}, n bigint, quantile double, value double, rank_error bigint"
    out = _grouped(d, keys).mapInArrow(whole_groups(flush, BLOCK_ROWS // 4, _shrinker(keys, eps)), schema)
    return out.select(*(F.col(k).alias(name) for k, name in zip(keys, names, strict=True)), "n", "quantile", "value", "rank_error")
