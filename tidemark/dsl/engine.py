"""From expression text to a lazy frame: parse, bind the arguments, build the plan."""

from __future__ import annotations

from ..frame import Frame
from ..functions import FUNCTIONS, Context
from ..functions.registry import REQUIRED, Arg
from .parser import Call, DslError, Literal, Selector, parse


class Engine:
    """Evaluates expressions over a store with fetch(pattern, from_ms, to_ms, max_points) -> Frame."""

    def __init__(self, spark, store, from_ms: int, to_ms: int, max_points: int = 0, compat: bool = False):
        self.spark, self.store, self.compat = spark, store, compat
        self.from_ms, self.to_ms, self.max_points = from_ms, to_ms, max_points

    def query(self, text: str) -> Frame:
        """The frame of an expression. Several series of different steps are aligned (implicit group)."""
        return FUNCTIONS["group"].fn(self._context(text), self._series(parse(text)))

    def _context(self, legend: str) -> Context:
        return Context(self.spark, self.store, self.from_ms, self.to_ms, self.max_points, self.compat, legend)

    def _series(self, node, since: int | None = None) -> Frame:
        if isinstance(node, Call):
            return self._call(node)
        pattern = node.pattern if isinstance(node, Selector) else str(node.value)
        return self.store.fetch(pattern, self.from_ms if since is None else since, self.to_ms, self.max_points)

    def _value(self, fn: str, arg: Arg, node, since: int | None):
        if node is None:
            return None
        if arg.kind == "series":
            if isinstance(node, Literal) and not isinstance(node.value, str):
                raise DslError(f"{fn}: {arg.name}: a series is expected, not {node.text}")
            return self._series(node, since)
        if arg.kind == "numseries":
            if isinstance(node, Literal) and not isinstance(node.value, str):
                return node.value
            return self._series(node, since)
        if isinstance(node, Call):
            raise DslError(f"{fn}: {arg.name}: a {arg.kind} is expected, not {node.text}")
        value = node.pattern if isinstance(node, Selector) else node.value
        if arg.kind == "string":
            return str(node.text) if isinstance(node, Literal) and not isinstance(value, str) else value
        if arg.kind == "number":
            if isinstance(value, str):
                try:
                    value = float(value)
                except ValueError:
                    raise DslError(f"{fn}: {arg.name}: a number is expected, not {node.text}") from None
            return value
        if isinstance(value, str) and value.lower() in ("true", "false"):
            value = value.lower() == "true"
        if not isinstance(value, bool):
            raise DslError(f"{fn}: {arg.name}: true or false is expected, not {node.text}")
        return value

    def _since(self, c: Call) -> int | None:
        """Functions that look back read more of the archive than the view."""
        from ..durations import parse_duration

        text = lambda k, d: next((v.value for n, v in c.kwargs if n == k and isinstance(v, Literal)), d)
        pos = lambda i, d: c.args[i].value if len(c.args) > i and isinstance(c.args[i], Literal) else d
        if c.name == "timeStack":
            return self.to_ms - int(abs(parse_duration(str(pos(1, text("timeShiftUnit", "0")))) * (float(pos(3, text("timeShiftEnd", 0))) + 1)))
        if c.name.startswith("holtWinters"):
            season, limit = (pos(1, text("seasonLen", "1d")), pos(2, text("seasonLimit", 7))) if c.name == "holtWintersForecast" else ("1d", 7)
            # forecasts begin behind the newest slot there is
            latest = max((a.latest_ms for a in getattr(self.store, "archives", ())), default=self.to_ms)
            return min(self.from_ms, min(self.to_ms, latest) - int(parse_duration(str(season)) * float(limit)))
        return None

    def _call(self, c: Call) -> Frame:
        f = FUNCTIONS.get(c.name)
        if f is None:
            raise DslError(f"No such function: {c.name}")
        since = self._since(c)
        names = [a.name for a in f.args]
        given: dict[str, object] = {}
        rest: list = []
        for i, node in enumerate(c.args):
            if i < len(names) - (1 if f.variadic else 0):
                given[names[i]] = node
            elif f.variadic:
                rest.append(node)
            else:
                raise DslError(f"{c.name}: at most {len(names)} arguments are taken")
        for k, node in c.kwargs:
            if k not in names:
                raise DslError(f"{c.name}: no argument {k}")
            if k in given:
                raise DslError(f"{c.name}: argument {k} given twice")
            if f.variadic and k == names[-1]:
                rest.append(node)
            else:
                given[k] = node
        values = []
        for a in f.args[: -1 if f.variadic else None]:
            if a.name in given:
                values.append(self._value(c.name, a, given[a.name], since))
            elif a.default is REQUIRED:
                raise DslError(f"{c.name}: Missing argument {a.name}")
            else:
                values.append(a.default)
        if f.variadic:
            if not rest:
                raise DslError(f"{c.name}: Missing argument {names[-1]}")
            values += [self._value(c.name, f.args[-1], node, since) for node in rest]
        try:
            return f.fn(self._context(c.text), *values)
        except DslError:
            raise
        except ValueError as e:
            raise DslError(f"{c.name}: {e}") from e
