"""Series specifications: text form, rules by name, plan-time dataclasses."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durations import parse_duration

CFS = ("WMEAN", "MIN", "MAX", "LAST")


@dataclass(frozen=True)
class ArchiveSpec:
    """One archive: consolidation function, step, number of slots, least known share of a slot."""

    cf: str
    step_ms: int
    size: int
    xff: float = 0.0

    @property
    def span_ms(self) -> int:
        return self.step_ms * self.size


@dataclass(frozen=True)
class SeriesSpec:
    step_ms: int
    heartbeat_ms: int
    archives: tuple[ArchiveSpec, ...]
    pattern: str = ".*"


def parse_archive(text: str, step_ms: int | None = None) -> ArchiveSpec:
    """`[wmean|min|max|last:]step:span[:xff]`; xff is 0.5 if not given; the span is rounded down to whole
    steps. A step that is no multiple of the series' step is an error."""
    parts = text.strip().split(":")
    cf = "WMEAN"
    if parts and parts[0].upper() in CFS:
        cf = parts.pop(0).upper()
    elif parts and re.fullmatch(r"[A-Za-z_]+", parts[0]):
        raise ValueError(f"unknown consolidation function {parts[0]!r}")
    if len(parts) not in (2, 3):
        raise ValueError(f"bad archive specification {text!r}")
    step, span = parse_duration(parts[0]), parse_duration(parts[1])
    xff = float(parts[2]) if len(parts) == 3 else 0.5
    if step <= 0 or span < step or not 0 <= xff <= 1:
        raise ValueError(f"bad archive specification {text!r}")
    if step_ms and step % step_ms:
        raise ValueError(f"{text!r}: step is no multiple of {step_ms} ms")
    return ArchiveSpec(cf, step, span // step, xff)


#: The built-in default: 10 s readings, two hours of heartbeat, four mean archives.
DEFAULT = SeriesSpec(
    10_000,
    7_200_000,
    tuple(ArchiveSpec("WMEAN", parse_duration(a), parse_duration(b) // parse_duration(a)) for a, b in (("10s", "6h"), ("1m", "24h"), ("10m", "93d"), ("1d", "1825d"))),
)


def read_rules(path: str, min_step_ms: int | None = None) -> list[SeriesSpec]:
    """The rules of a TOML file in their order: tables [[ds]] with regexp, step, heartbeat and rras, and at
    the top optionally min-step, below which no step may lie. Other settings are not looked at."""
    with open(path, "rb") as f:
        conf = tomllib.load(f)
    least = parse_duration(conf["min-step"]) if "min-step" in conf else min_step_ms or 1
    out = []
    for d in conf.get("ds", []):
        if missing := {"regexp", "step", "heartbeat", "rras"} - d.keys():
            raise ValueError(f"{path}: a [[ds]] lacks {', '.join(sorted(missing))}")
        re.compile(d["regexp"])
        step = parse_duration(d["step"])
        if step < least:
            raise ValueError(f"{path}: step {d['step']} is below the least step")
        out.append(SeriesSpec(step, parse_duration(d["heartbeat"]), tuple(parse_archive(x, step) for x in d["rras"]), d["regexp"]))
    return out


def match_rules(names: DataFrame, rules: list[SeriesSpec], name: str = "name") -> DataFrame:
    """names with rule_no, the first rule whose pattern matches anywhere in the name; null if none does
    (such points are unknown and dropped by assigned())."""
    col = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        col = F.when(F.col(name).rlike(rules[i].pattern), F.lit(i)).otherwise(col)
    return names.withColumn("rule_no", col)


def assigned(points: DataFrame, rules: list[SeriesSpec]) -> DataFrame:
    return match_rules(points, rules).where("rule_no is not null")


def new_series(points: DataFrame, series: DataFrame) -> DataFrame:
    """Names that are in points but not yet in series, to be appended to it."""
    return points.select("name").where("name is not null").distinct().join(series.select("name"), "name", "left_anti")
