"""Binary formats: Whisper files and pickled Graphite frames, read by spark.read.format("binaryFile")."""

from __future__ import annotations

import io
import pickle
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import ArchiveSpec, SeriesSpec

_POINT = np.dtype([("sec", ">u4"), ("value", ">f8")])


def whisper_archives(content: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(step seconds, number of points, points) of a Whisper file: a header of aggregation type, longest
    retention, xff and number of archives; per archive offset, seconds per point and points; all
    big-endian. Truncated files raise ValueError."""
    if len(content) < 16:
        raise ValueError("no header")
    _, _, _, n = struct.unpack_from(">IIfI", content, 0)
    if len(content) < 16 + 12 * n:
        raise ValueError("header cut off")
    out = []
    for k in range(n):
        offset, step, size = struct.unpack_from(">III", content, 16 + 12 * k)
        if offset + 12 * size > len(content):
            raise ValueError("archive cut off")
        out.append((step, size, np.frombuffer(content, _POINT, size, offset)))
    return out


def whisper_spec(content: bytes) -> SeriesSpec:
    """Series step = step of the first archive; all archives are weighted means."""
    a = whisper_archives(content)
    return SeriesSpec(a[0][0] * 1000, 7_200_000, tuple(ArchiveSpec("WMEAN", s * 1000, n) for s, n, _ in a))


def whisper_name(path, root: str, prefix: str = ""):
    """Series name of a file path column: below root, / becomes a dot, without .wsp."""
    p = F.regexp_replace(path, "^file:/*", "/")
    p = F.regexp_replace(F.substring(p, F.lit(len(root.rstrip("/")) + 2), F.length(p)), r"\.wsp$", "")
    return F.concat(F.lit(f"{prefix}." if prefix else ""), F.translate(p, "/", "."))


def read_whisper(spark, root: str, prefix: str = "") -> DataFrame:
    """(name, archive, step_ms, ms, value) of all .wsp files below root; unused slots (time 0) are left
    out, unreadable files give no rows. Files are read in parallel, one at a time per task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wsp").option("recursiveFileLookup", "true").load(root)
    return whisper_points(files.select(whisper_name(F.col("path"), root, prefix).alias("name"), "content"))


def whisper_points(files: DataFrame) -> DataFrame:
    """(name, archive, step_ms, ms, value) of files (name, content)."""
    files = files.select("name", "content").where("content is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = whisper_archives(content)
                except (ValueError, struct.error):
                    continue
                for k, (step, _, pts) in enumerate(found):
                    p = pts[pts["sec"] > 0]
                    if len(p):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([name] * len(p)), pa.array(np.full(len(p), k, np.int32)), pa.array(np.full(len(p), step * 1000, np.int64)),
                                pa.array(p["sec"].astype(np.int64) * 1000), pa.array(p["value"].astype(np.float64)),
                            ],
                            names=["name", "archive", "step_ms", "ms", "value"],
                        )

    return files.mapInArrow(run, "name string, archive int, step_ms bigint, ms bigint, value double")


def merge_whisper(points: DataFrame) -> DataFrame:
    """(name, ms, value): for each period the finest data there is. A coarser archive gives only what is
    older than the oldest point of the finer ones; times move to the slot END."""
    start = points.groupBy("name", "archive").agg(F.min("ms").alias("start"))
    w = Window.partitionBy("name").orderBy("archive").rowsBetween(Window.unboundedPreceding, -1)
    before = start.withColumn("until", F.min("start").over(w)).select("name", "archive", "until")
    j = points.join(before, ["name", "archive"]).where("until is null or ms < until")
    return j.select("name", (F.col("ms") + F.col("step_ms")).alias("ms"), "value")


def fresh_whisper(points: DataFrame, now_ms: int, days: float) -> DataFrame:
    """Without the series whose newest point is older than `days`."""
    new = points.groupBy("name").agg(F.max("ms").alias("newest")).where(F.col("newest") >= now_ms - int(days * 86_400_000))
    return points.join(new, "name", "left_semi")


def replay_whisper(points: DataFrame, spec: SeriesSpec, last: DataFrame | None = None) -> DataFrame:
    """Merged points fed to consolidation; last (name, last_ms): what is already there is skipped."""
    from ..operators.consolidate import consolidate

    p = merge_whisper(points)
    if last is not None:
        p = p.join(last, "name", "left").where("last_ms is null or ms > last_ms").drop("last_ms")
    return consolidate(p, spec)


class _Plain(pickle.Unpickler):
    """Lists, tuples, strings and numbers only."""

    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")

    def persistent_load(self, pid):
        raise pickle.UnpicklingError("persistent ids are not allowed")


def pickled_points(content: bytes) -> list[tuple[str, int, float]]:
    """(name, seconds, value) of frames of a 4-byte big-endian length and a pickled [(name, (sec,
    value)), ...]. Decoding stops at the first frame that is cut off or not of this form."""
    out: list[tuple[str, int, float]] = []
    at = 0
    while at + 4 <= len(content):
        (n,) = struct.unpack_from(">I", content, at)
        at += 4
        if at + n > len(content):
            break
        try:
            items = _Plain(io.BytesIO(content[at : at + n])).load()
            frame = [(str(name), int(sec), float(value)) for name, (sec, value) in items]
        except Exception:  # noqa: BLE001 - bytes from outside may fail in any way
            break
        out += frame
        at += n
    return out


def read_pickles(files: DataFrame, content: str = "content") -> DataFrame:
    """(name, ms, value) of a column of byte strings; names are taken as they are. Null gives nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for c in b.column(0).to_pylist() if c for r in pickled_points(c)]
            if rows:
                names, sec, value = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([s * 1000 for s in sec], pa.int64()), pa.array(value)], names=["name", "ms", "value"])

    return files.select(content).mapInArrow(run, "name string, ms bigint, value double")
