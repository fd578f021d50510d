"""Sizes of texts in tokens of a public tokenizer, Arrow batch by Arrow batch."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Vocabulary file (ranks, one per line) and the pattern that goes with it; both are parameters. Sessions
#: name another file in spark.tidemark.ranks.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded in parts that end where a word begins, which gives the same tokens.
PART_CHARS = 100_000


@lru_cache(maxsize=2)
def encoder(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


_WORD_BEGINS = re.compile(r"(?<=\S)(?= [^\W\d_])")


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Cut text where a space and a letter follow a non-space, at the first such place after `size`."""
    at = 0
    while len(text) - at > size:
        m = _WORD_BEGINS.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def count_tokens(texts: list[str | None], ranks: str = RANKS, pattern: str = PATTERN) -> list[int]:
    enc = encoder(ranks, pattern)
    return [0 if not t else sum(len(enc.encode_ordinary(p)) for p in parts(t)) for t in texts]


def shipped(spark: SparkSession, ranks: str | None = None) -> str:
    """Hand the vocabulary file (spark.tidemark.ranks or RANKS if none is given) to all executors; the name
    by which they find it. The file need only be where the driver is."""
    at = os.path.realpath(ranks or spark.conf.get("spark.tidemark.ranks", RANKS))
    sc = spark.sparkContext
    known = getattr(sc, "_tidemark_files", set())
    if at not in known:
        sc.addFile(at)
        sc._tidemark_files = known | {at}
    return os.path.basename(at)


def with_sizes(df: DataFrame, id_col: str, text: str, *keep: str, ranks: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(id_col, keep..., n_tokens) of every row; null and empty texts have 0 tokens. Only the columns
    named are read; texts leave the JVM once, whole."""
    src = df.select(id_col, *keep, text)
    name = shipped(df.sparkSession, ranks)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.select(id_col, *keep).dtypes) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        for b in batches:
            n = count_tokens(b.column(b.num_columns - 1).to_pylist(), SparkFiles.get(name), pattern)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    return src.mapInArrow(run, schema)
