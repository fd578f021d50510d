"""Functions that change how series are shown."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from .registry import register


def _alias(s, a):
    return replace(s, df=s.df.withColumn("alias", a))


@register("alias", "seriesList:series newName:string")
def alias(ctx, s, name):
    return _alias(s, F.lit(name))


@register("aliasByMetric", "seriesList:series")
def alias_by_metric(ctx, s):
    return _alias(s, F.substring_index("name", ".", -1))


@register("aliasByNode", "seriesList:series nodes:number*")
def alias_by_node(ctx, s, *nodes):
    """Chosen components joined by dots; negative ones count from the end, those out of range are left
    out; of a name with a call in it the innermost first argument is taken."""
    inner = F.regexp_extract("name", r"^[^(]*\(([^(),]*)", 1)
    name = F.when(F.contains(F.col("name"), F.lit("(")) & (inner != ""), inner).otherwise(F.col("name"))
    parts = F.split(name, "[.]")
    picked = [F.get(parts, F.lit(int(n))) if n >= 0 else F.get(parts, F.size(parts) + int(n)) for n in nodes]
    return _alias(s, F.concat_ws(".", *picked))


@register("aliasSub", "seriesList:series search:string replace:string")
def alias_sub(ctx, s, search, replacement):
    r"""Regex replacement on the name; \N and $N name groups."""
    return _alias(s, F.regexp_replace("name", search, re.sub(r"\\(\d)", r"$\1", replacement)))


@register("color", "seriesList:series theColor:string")
def color(ctx, s, _color):
    return s
