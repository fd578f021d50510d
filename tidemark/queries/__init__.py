"""Registered queries and the SQL they are compared with."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from ..session import ship, sound_unions

_MODULES = ("data", "language", "ingest", "more")


def _all(what: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(import_module(f"{__name__}.{m}"), what)
    return out


def ready(f):
    """The query with the session prepared first."""

    @wraps(f, assigned=("__doc__",))
    def run(spark, sf_dir):
        ship(spark)
        sound_unions(spark)
        return f(spark, sf_dir)

    return run


def all_queries() -> dict:
    return {k: ready(f) for k, f in _all("QUERIES").items()}


def all_oracles() -> dict:
    return _all("ORACLES")
