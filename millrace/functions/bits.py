"""Bit functions and bit aggregates."""

from __future__ import annotations

from . import CALLS, define


@define("bit_count")
def bit_count(n):
    return f"bit_count(cast({n} as bigint))"


@define("bit_and")
def bit_and(x):
    """All bits (-1 as a signed number) over no rows."""
    return f"coalesce(bit_and(cast({x} as bigint)), -1)"


@define("bit_or")
def bit_or(x):
    return f"coalesce(bit_or(cast({x} as bigint)), 0)"


@define("bit_xor")
def bit_xor(x):
    return f"coalesce(bit_xor(cast({x} as bigint)), 0)"


# Aggregates whose names mean another estimator in Spark.
CALLS["variance"] = CALLS["var_pop"] = lambda args: f"var_pop({args[0]})"
CALLS["std"] = CALLS["stddev"] = lambda args: f"stddev_samp({args[0]})"
CALLS["any_value"] = lambda args: f"any_value({args[0]}, true)"
