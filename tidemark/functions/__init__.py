"""DSL functions: importing this package fills the registry."""

from . import calculate, combine, forecast, naming, select  # noqa: F401
from .registry import FUNCTIONS, Context, register  # noqa: F401
