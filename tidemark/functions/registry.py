"""The one registry of DSL functions, and how to add to it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

REQUIRED = object()


@dataclass(frozen=True)
class Arg:
    """kind: series, number, string, bool or numseries."""

    name: str
    kind: str
    default: object = REQUIRED


@dataclass(frozen=True)
class Function:
    name: str
    fn: Callable
    args: tuple[Arg, ...]
    variadic: bool = False


@dataclass
class Context:
    """What a call knows besides its arguments."""

    spark: object
    store: object
    from_ms: int
    to_ms: int
    max_points: int = 0
    compat: bool = False
    legend: str = ""
    extra: dict = field(default_factory=dict)


FUNCTIONS: dict[str, Function] = {}


def _arg(text: str) -> Arg:
    name, _, rest = text.partition(":")
    kind, eq, default = rest.partition("=")
    value: object = REQUIRED
    if eq:
        value = {"none": None, "true": True, "false": False}.get(default, default)
        if kind in ("number", "numseries") and isinstance(value, str):
            value = float(value)
    return Arg(name, kind, value)


def register(names: str, spec: str, fn: Callable | None = None):
    """register("scale", "seriesList:series factor:number")(fn): fn(ctx, *arguments) -> Frame. A spec
    that ends in * repeats its last argument; several names are aliases."""

    def add(f: Callable) -> Callable:
        args = tuple(_arg(a) for a in spec.rstrip("*").split())
        for n in names.split():
            FUNCTIONS[n] = Function(n, f, args, spec.endswith("*"))
        return f

    return add(fn) if fn else add
