"""Numeric functions."""

from __future__ import annotations

from . import builtin, define

builtin("abs sqrt exp ln log2 log10 pi radians degrees sin cos tan asin acos cot mod:try_mod")


def number(x):
    """A text's leading number, 0 if it has none; other values as they are."""
    return x


@define("sign")
def sign(n):
    return f"cast(sign({n}) as int)"


@define("pow", "power")
def power(a, b):
    return f"nullif(power({a}, {b}), double('NaN'))"


@define("ceil", "ceiling")
def ceil(n):
    return f"ceil({n})"


@define("floor")
def floor(n):
    return f"floor({n})"


@define("round")
def round_(n, d="0"):
    """Half away from zero; a whole number for no decimals or fewer, a double otherwise."""
    if d.lstrip("(-").rstrip(")").isdigit():
        return f"cast(round({n}, {d}) as {'double' if d.isdigit() and int(d) > 0 else 'bigint'})"
    return f"cast(sign({n}) * floor(abs({n}) * power(10, {d}) + 0.5) / power(10, {d}) as double)"


@define("truncate")
def truncate(n, d):
    return f"cast(sign({n}) * floor(abs({n}) * power(10, {d})) / power(10, {d}) as double)"


@define("log")
def log(a, b=None):
    return f"ln({a})" if b is None else f"if({a} <= 0 or {a} = 1, null, ln({b}) / ln({a}))"


@define("rand")
def rand(seed=None):
    """Spark's generator; with a seed it repeats for the same plan and partitions."""
    return f"rand({seed})" if seed else "rand()"


@define("atan", "atan2")
def atan(y, x=None):
    return f"atan({y})" if x is None else f"atan2({y}, {x})"


@define("conv")
def conv(s, a, b):
    return f"if(cast({s} as string) rlike '^ *-?[0-9A-Za-z]+' and conv(cast({s} as string), {a}, {b}) <> '0' or cast({s} as string) rlike '^ *-?0+ *$', conv(cast({s} as string), {a}, {b}), null)"


@define("bin")
def bin_(n):
    return f"bin(cast({n} as bigint))"


@define("oct")
def oct_(n):
    return f"conv(cast({n} as string), 10, 8)"


@define("sleep")
def sleep(n):
    return "0"


@define("benchmark")
def benchmark(n, x):
    return "0"
