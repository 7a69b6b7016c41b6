"""MySQL's scalar functions as Catalyst expressions.

CALLS maps a function's lower-case name to a callable that takes the Spark SQL text of its arguments and returns that of the call. Everything is a composition of built-in functions, inside whole-stage code generation, but for the Arrow functions of `udfs`, which register() adds to a session. A null argument gives null unless a function says otherwise; dates that can't be read give null.
"""

from __future__ import annotations

from collections.abc import Callable

CALLS: dict[str, Callable[[list[str]], str]] = {}


def define(*names: str):
    """Adds a callable of positional arguments under its names."""

    def add(f):
        for n in names:
            CALLS[n] = lambda args, f=f: f(*args)
        return f

    return add


def builtin(pairs: str) -> None:
    """Adds calls that go to a Spark function as they are: "name:spark name" or "name"."""
    for pair in pairs.split():
        name, _, target = pair.partition(":")
        CALLS[name] = lambda args, t=target or name: f"{t}({', '.join(args)})"


from . import bits, datetime, hashing, json, math, network, session, spatial, string  # noqa: E402,F401
from .udfs import register  # noqa: E402,F401


def expr(text: str, variables: dict | None = None):
    """A Column from a MySQL-flavoured expression, for select, filter and the like."""
    from pyspark.sql import functions as F

    from ..plans.rewrite import rewrite_expression

    return F.expr(rewrite_expression(text, variables))
