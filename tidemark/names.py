"""Metric names: cleaning, glob patterns, components."""

from __future__ import annotations

import re

from pyspark.sql import functions as F


def clean_name(c):
    """Cleaned metric name: white-space runs become _, / becomes -, then all but A-Za-z_0-9.- goes.

    White space is the ASCII set [ \\t\\n\\f\\r\\v]; null stays null and an empty name stays empty.
    """
    c = F.col(c) if isinstance(c, str) else c
    c = F.translate(F.regexp_replace(c, r"[ \t\n\f\r\x0B]+", "_"), "/", "-")
    return F.regexp_replace(c, r"[^A-Za-z_0-9.\-]", "")


def clean_name_py(name: str) -> str:
    """The driver-side twin of clean_name."""
    name = re.sub(r"[ \t\n\f\r\v]+", "_", name).replace("/", "-")
    return re.sub(r"[^A-Za-z_0-9.\-]", "", name)


def suffix(c):
    """Last dot-separated component of a name."""
    c = F.col(c) if isinstance(c, str) else c
    return F.substring_index(c, ".", -1)


def expand_braces(pattern: str) -> list[str]:
    """`a.{b,c}.d` -> [`a.b.d`, `a.c.d`]; several groups multiply; duplicates are dropped."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    out: list[str] = []
    for alt in m.group(1).split(","):
        out += expand_braces(pattern[: m.start()] + alt + pattern[m.end() :])
    return list(dict.fromkeys(out))


def glob_regex(pattern: str) -> str:
    """Anchored regex of a dotted glob: `*` and `?` stay inside a component, `[...]` is a class."""
    alts = []
    for p in expand_braces(pattern):
        out, i = "", 0
        while i < len(p):
            ch = p[i]
            if ch == "*":
                out += "[^.]*"
            elif ch == "?":
                out += "[^.]"
            elif ch == "[" and "]" in p[i + 1 :]:
                j = p.index("]", i + 1)
                body = p[i + 1 : j]
                out += "[" + body.replace("\\", "\\\\") + "]"
                i = j
            elif ch == "\\" and i + 1 < len(p):
                i += 1
                out += re.escape(p[i])
            else:
                out += re.escape(ch)
            i += 1
        alts.append(out)
    return "^(?:" + "|".join(alts) + ")$"


def literal_prefix(pattern: str) -> str:
    """The part of a glob before its first special character; lets Parquet statistics prune."""
    return re.split(r"[*?\[{\\]", pattern, maxsplit=1)[0]


def glob_filter(c, pattern: str, compat: bool = False):
    """Predicate that a name matches a dotted glob over its full length.

    compat=True also keeps a leaf whose name matches a dotted prefix of the pattern (`a.b.*` finds the
    leaf `a.b`).
    """
    c = F.col(c) if isinstance(c, str) else c
    pre = literal_prefix(pattern)
    cond = c.rlike(glob_regex(pattern))
    if compat:
        parts = pattern.split(".")
        for k in range(1, len(parts)):
            if "{" not in pattern:
                cond = cond | c.rlike(glob_regex(".".join(parts[:k])))
        return cond
    return c.startswith(pre) & cond if pre else cond
