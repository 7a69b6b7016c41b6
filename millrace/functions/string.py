"""String and conversion functions."""

from __future__ import annotations

from . import CALLS, builtin, define

builtin("ucase:upper upper lcase:lower lower substring_index concat_ws coalesce nullif ifnull:nvl reverse repeat space ascii ord:ascii bit_length octet_length char_length character_length:char_length left right")

SPACES = r"'\\s+'"


@define("length", "len")
def length(s):
    """Bytes, not characters."""
    return f"octet_length(cast({s} as string))"


@define("substring", "substr", "mid")
def substring(s, pos, n=None):
    """1-based; place 0 gives '', a negative place counts from the end and stops at the start."""
    at = f"greatest({pos}, -char_length({s}))"
    cut = f"substring({s}, {at}" + (f", greatest({n}, 0))" if n is not None else ")")
    return f"if({pos} = 0, if({s} is null, null, ''), {cut})"


@define("trim")
def trim(s, what=None):
    return f"trim(BOTH {what} FROM {s})" if what else rf"regexp_replace({s}, '^\\s+|\\s+$', '')"


@define("ltrim")
def ltrim(s, what=None):
    return f"trim(LEADING {what} FROM {s})" if what else rf"regexp_replace({s}, '^\\s+', '')"


@define("rtrim")
def rtrim(s, what=None):
    return f"trim(TRAILING {what} FROM {s})" if what else rf"regexp_replace({s}, '\\s+$', '')"


@define("insert")
def insert(s, pos, n, new):
    """The text itself where pos lies outside of it; a negative n replaces all that follows."""
    cut = f"if({n} < 0 or {pos} + {n} > char_length({s}), char_length({s}), {n})"
    return f"if({pos} between 1 and char_length({s}), overlay({s} PLACING {new} FROM {pos} FOR {cut}), if({new} is null or {n} is null, null, {s}))"


@define("concat")
def concat(*args):
    return f"concat({', '.join(f'cast({a} as string)' for a in args)})"


@define("isnull")
def isnull(x):
    return f"cast({x} is null as bigint)"


@define("if")
def if_(c, a, b):
    return f"if(coalesce(cast({c} as boolean), false), {a}, {b})"


@define("weight_string")
def weight_string(s):
    return f"encode(upper({s}), 'UTF-16BE')"


@define("hex")
def hex_(x):
    return f"hex({x})"


@define("unhex")
def unhex(h):
    return f"decode(unhex(if({h} rlike '^[0-9A-Fa-f]*$', {h}, null)), 'UTF-8')"


def _pad(side, s, n, p):
    return f"case when {n} < 0 then null when {n} <= char_length({s}) then substring({s}, 1, {n}) when {p} = '' then null else {side}({s}, {n}, {p}) end"


@define("lpad")
def lpad(s, n, p="' '"):
    return _pad("lpad", s, n, p)


@define("rpad")
def rpad(s, n, p="' '"):
    return _pad("rpad", s, n, p)


@define("replace")
def replace(s, a, b):
    return f"replace({s}, {a}, {b})"


@define("strcmp")
def strcmp(a, b):
    return f"case when {a} < {b} then -1 when {a} = {b} then 0 when {a} > {b} then 1 end"


@define("locate")
def locate(sub, s, pos="1"):
    return f"locate({sub}, {s}, {pos})"


@define("instr")
def instr(s, sub):
    return f"instr({s}, {sub})"


@define("char")
def char(*codes):
    return f"concat({', '.join(f'''coalesce(char({c}), '')''' for c in codes)})"


@define("format")
def format_(n, d):
    return f"format_number(cast({n} as decimal(38, 10)), cast(greatest({d}, 0) as int))"


@define("field")
def field(x, *items):
    """1-based place of the first equal item, 0 if there is none or x is null."""
    return "(case " + " ".join(f"when {x} = {a} then {i}" for i, a in enumerate(items, 1)) + " else 0 end)"


@define("elt")
def elt(n, *items):
    return f"try_element_at(array({', '.join(items)}), if({n} < 1, null, cast({n} as int)))"


@define("find_in_set")
def find_in_set(x, items):
    return f"find_in_set({x}, {items})"


@define("make_set")
def make_set(bits, *items):
    return f"if({bits} is null, null, concat_ws(',', " + ", ".join(f"if((cast({bits} as bigint) & {1 << i}) <> 0, {a}, null)" for i, a in enumerate(items)) + "))"


@define("export_set")
def export_set(bits, on, off, separator="','", n="64"):
    return f"array_join(transform(sequence(0, cast(least(greatest({n}, 1), 64) as int) - 1), i -> if((shiftrightunsigned(cast({bits} as bigint), i) & 1) = 1, {on}, {off})), {separator})"


@define("quote")
def quote(s):
    return f"coalesce(concat(chr(39), replace(replace({s}, chr(92), repeat(chr(92), 2)), chr(39), concat(chr(92), chr(39))), chr(39)), 'NULL')"


@define("regexp", "regexp_like")
def regexp(s, p):
    return f"({s} rlike {p})"


@define("greatest")
def greatest(*args):
    """Null if any argument is."""
    return f"if({' or '.join(f'{a} is null' for a in args)}, null, greatest({', '.join(args)}))"


@define("least")
def least(*args):
    return f"if({' or '.join(f'{a} is null' for a in args)}, null, least({', '.join(args)}))"


@define("interval")
def interval(x, *limits):
    """How many of the ascending limits are at most x; -1 for null."""
    return f"if({x} is null, -1, " + " + ".join(f"cast({x} >= {a} as int)" for a in limits) + ")"


CALLS["char_length"] = lambda args: f"char_length(cast({args[0]} as string))"
CALLS["character_length"] = CALLS["char_length"]
