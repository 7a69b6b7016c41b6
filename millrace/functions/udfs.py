"""Arrow functions for what Catalyst has no expression for: JSON edits and searches, geometry from text, zlib, IPv6."""

from __future__ import annotations

import ipaddress
import json
import os
import re
import struct
import zlib
from functools import lru_cache
from itertools import repeat

import pyarrow as pa

STEP = re.compile(r'\.(?:"((?:[^"\\]|\\.)*)"|([A-Za-z_$][\w$]*|\*))|\[(\d+|\*|last(?:-\d+)?)\]')


@lru_cache(256)
def path(text: str) -> tuple:
    """Steps of a JSON path: member names and places (whole numbers; negative ones from the end)."""
    if not text.startswith("$"):
        raise ValueError(f"JSON path {text!r}")
    steps, at = [], 1
    while at < len(text):
        m = STEP.match(text, at)
        if not m or "*" in (m[2], m[3]):
            raise ValueError(f"JSON path {text!r}")
        steps.append(m[1] if m[1] is not None else m[2] if m[2] is not None else int(m[3]) if m[3].isdigit() else -1 - int(m[3][5:] or 0))
        at = m.end()
    return tuple(steps)


def step(x, s):
    """The value one step down, and whether there is one. Place 0 of a scalar or an object is itself."""
    if isinstance(s, str):
        return (x[s], True) if isinstance(x, dict) and s in x else (None, False)
    if isinstance(x, list):
        s = s if s >= 0 else len(x) + s
        return (x[s], True) if 0 <= s < len(x) else (None, False)
    return (x, True) if s in (0, -1) else (None, False)


def lookup(x, steps):
    for s in steps:
        x, found = step(x, s)
        if not found:
            return None, False
    return x, True


def edited(x, steps, value, mode):
    """x with a value put at a path. mode "set": add or replace; "insert": add only; "replace": replace only."""
    if not steps:
        return value if mode != "insert" else x
    head, rest = steps[0], steps[1:]
    if isinstance(head, str):
        if not isinstance(x, dict):
            return x
        if head in x:
            return {**x, head: edited(x[head], rest, value, mode)}
        return {**x, head: value} if not rest and mode != "replace" else x
    if not isinstance(x, list):
        if head in (0, -1):
            return edited(x, rest, value, mode)
        return [x, value] if not rest and mode != "replace" else x
    at = head if head >= 0 else len(x) + head
    if 0 <= at < len(x):
        return [*x[:at], edited(x[at], rest, value, mode), *x[at + 1 :]]
    return [*x, value] if not rest and mode != "replace" and at >= len(x) else x


def removed(x, steps):
    head, rest = steps[0], steps[1:]
    inner, found = step(x, head)
    if not found or not isinstance(x, (dict, list)):
        return x
    if isinstance(head, str):
        return {**x, head: removed(inner, rest)} if rest else {k: v for k, v in x.items() if k != head}
    at = head if head >= 0 else len(x) + head
    return [*x[:at], removed(inner, rest), *x[at + 1 :]] if rest else x[:at] + x[at + 1 :]


def changed(x, steps, f):
    """x with f applied to the value at a path, if there is one."""
    if not steps:
        return f(x)
    inner, found = step(x, steps[0])
    if not found:
        return x
    if isinstance(x, dict):
        return {**x, steps[0]: changed(inner, steps[1:], f)}
    if isinstance(x, list):
        at = steps[0] if steps[0] >= 0 else len(x) + steps[0]
        return [*x[:at], changed(inner, steps[1:], f), *x[at + 1 :]]
    return changed(inner, steps[1:], f)


def patch(a, b):
    """RFC 7396."""
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = patch(out.get(k), v)
    return out


def preserve(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **{k: preserve(a[k], v) if k in a else v for k, v in b.items()}}
    as_list = lambda x: x if isinstance(x, list) else [x]
    return as_list(a) + as_list(b)


def contains(t, c) -> bool:
    if isinstance(t, dict) and isinstance(c, dict):
        return all(k in t and contains(t[k], v) for k, v in c.items())
    if isinstance(t, list):
        return all(any(contains(x, y) for x in t) for y in c) if isinstance(c, list) else any(contains(x, c) for x in t)
    return type(t) is type(c) and t == c or _numbers(t, c) and t == c


def _numbers(*xs) -> bool:
    return all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in xs)


def overlaps(a, b) -> bool:
    if isinstance(a, list) or isinstance(b, list):
        a, b = (x if isinstance(x, list) else [x] for x in (a, b))
        return any(x == y and isinstance(x, bool) == isinstance(y, bool) for x in a for y in b)
    if isinstance(a, dict) and isinstance(b, dict):
        return any(k in b and b[k] == v for k, v in a.items())
    return a == b


def depth(x) -> int:
    inner = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
    return 1 + max(map(depth, inner), default=0)


def strings(x, at="$"):
    if isinstance(x, str):
        yield at, x
    elif isinstance(x, dict):
        for k, v in x.items():
            yield from strings(v, f"{at}.{k}" if re.fullmatch(r"[A-Za-z_]\w*", k) else f'{at}."{k}"')
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from strings(v, f"{at}[{i}]")


@lru_cache(256)
def like(pattern: str) -> re.Pattern:
    out = re.sub(r"\\(.)|([%_])|(.)", lambda m: re.escape(m[1]) if m[1] else {"%": ".*", "_": "."}[m[2]] if m[2] else re.escape(m[3]), pattern, flags=re.S)
    return re.compile(out, re.S)


#: JSON Schema: Python types of each name.
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def faults(schema, x, at="#"):
    """Keywords of a JSON Schema that a document fails, as (keyword, place)."""
    if not isinstance(schema, dict):
        return
    kinds = schema.get("type")
    if kinds is not None:
        fits = lambda k: _numbers(x) if k == "number" else _numbers(x) and float(x).is_integer() if k == "integer" else isinstance(x, KINDS.get(k, object))
        if not any(fits(k) for k in (kinds if isinstance(kinds, list) else [kinds])):
            yield "type", at
            return
    if "enum" in schema and x not in schema["enum"]:
        yield "enum", at
    if _numbers(x):
        for word, bad in (("minimum", lambda b: x < b), ("maximum", lambda b: x > b), ("exclusiveMinimum", lambda b: x <= b), ("exclusiveMaximum", lambda b: x >= b), ("multipleOf", lambda b: x % b != 0)):
            if word in schema and _numbers(schema[word]) and bad(schema[word]):
                yield word, at
    if isinstance(x, str):
        if len(x) < schema.get("minLength", 0):
            yield "minLength", at
        if len(x) > schema.get("maxLength", len(x)):
            yield "maxLength", at
        if "pattern" in schema and not re.search(schema["pattern"], x):
            yield "pattern", at
    if isinstance(x, list):
        if len(x) < schema.get("minItems", 0):
            yield "minItems", at
        if len(x) > schema.get("maxItems", len(x)):
            yield "maxItems", at
        if isinstance(schema.get("items"), dict):
            for i, v in enumerate(x):
                yield from faults(schema["items"], v, f"{at}/{i}")
    if isinstance(x, dict):
        for k in schema.get("required", []):
            if k not in x:
                yield "required", at
        for k, sub in schema.get("properties", {}).items():
            if k in x:
                yield from faults(sub, x[k], f"{at}/{k}")
        if schema.get("additionalProperties") is False and set(x) - set(schema.get("properties", {})):
            yield "additionalProperties", at
    for word, ok in (("allOf", lambda n, all_: n == all_), ("anyOf", lambda n, all_: n > 0), ("oneOf", lambda n, all_: n == 1)):
        if word in schema and not ok(sum(not list(faults(s, x, at)) for s in schema[word]), len(schema[word])):
            yield word, at
    if "not" in schema and not list(faults(schema["not"], x, at)):
        yield "not", at


#: json.dumps would make one at each call.
ENCODER = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def dumps(x) -> str:
    return ENCODER.encode(x)


_parsed = lru_cache(16)(json.loads)


def known(text):
    """A document that is likely the same in every row, such as a schema; the value is shared and not to be changed. Long ones aren't kept."""
    return _parsed(text) if len(text) <= 65536 else json.loads(text)


def sql_value(v):
    """An SQL value as a JSON value; text that the caller marked as JSON stays text."""
    return v.item() if hasattr(v, "item") else v


def nullable(f):
    """Null in, null out; what can't be read gives null."""

    def run(*args):
        if any(a is None or a != a for a in args if not isinstance(a, (bytes, str))):
            return None
        try:
            return f(*args)
        except (ValueError, TypeError, KeyError, IndexError, struct.error, zlib.error):
            return None

    return run


def _pairs(j, rest, f):
    x = json.loads(j)
    for p, v in zip(rest[::2], rest[1::2]):
        x = f(x, path(p), sql_value(v))
    return dumps(x)


def json_editor(mode):
    def run(j, *rest):
        if j is None or any(p is None for p in rest[::2]):
            return None
        try:
            return _pairs(j, rest, lambda x, steps, v: edited(x, steps, v, mode))
        except ValueError:
            return None

    return run


def json_remove(j, *paths):
    x = json.loads(j)
    for p in paths:
        steps = path(p)
        x = removed(x, steps) if steps else x
    return dumps(x)


def json_array_append(j, *rest):
    return _pairs(j, rest, lambda x, steps, v: changed(x, steps, lambda y: [*(y if isinstance(y, list) else [y]), v]))


def json_array_insert(j, *rest):
    def put(x, steps, v):
        at = steps[-1]
        if not isinstance(at, int):
            raise ValueError("the path has to end in a place")
        return changed(x, steps[:-1], lambda y: [*y[: min(at, len(y))], v, *y[min(at, len(y)) :]] if isinstance(y, list) else y)

    return _pairs(j, rest, put)


def json_merge(f):
    def run(*docs):
        out = json.loads(docs[0])
        for d in docs[1:]:
            out = f(out, known(d))
        return dumps(out)

    return run


def json_contains(t, c, p="$"):
    x, found = lookup(json.loads(t), path(p))
    return int(contains(x, known(c))) if found else None


def json_search(j, which, pattern, *_):
    rx = like(pattern)
    hits = [at for at, s in strings(json.loads(j)) if rx.fullmatch(s)]
    if not hits:
        return None
    return dumps(hits[0] if which.lower() == "one" or len(hits) == 1 else hits)


def json_schema_valid(schema, j):
    return int(next(faults(known(schema), json.loads(j)), None) is None)


def json_schema_report(schema, j):
    bad = next(faults(known(schema), json.loads(j)), None)
    return '{"valid":true}' if bad is None else dumps({"valid": False, "reason": f"The JSON document location '{bad[1]}' failed requirement '{bad[0]}' at JSON Schema location '#'", "document-location": bad[1], "schema-failed-keyword": bad[0]})


#: Well-known binary: geometry numbers.
WKB = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6}


def wkb(text: str) -> bytes:
    m = re.fullmatch(r"\s*([A-Za-z]+)\s*(\(.*\))\s*", text, re.S)
    kind = m[1].upper() if m else ""
    if kind not in WKB:
        raise ValueError(text)
    xy = lambda s: struct.pack("<dd", *map(float, s.replace("(", " ").replace(")", " ").split()))
    line = lambda s: (lambda p: struct.pack("<I", len(p)) + b"".join(map(xy, p)))(s.split(","))
    inside = m[2].strip()[1:-1]

    def parts(s):
        out, level, start = [], 0, 0
        for i, c in enumerate(s):
            level += (c == "(") - (c == ")")
            if c == "," and not level:
                out.append(s[start:i])
                start = i + 1
        return [x.strip() for x in [*out, s[start:]]]

    rings = lambda s: (lambda p: struct.pack("<I", len(p)) + b"".join(line(x.strip()[1:-1]) for x in p))(parts(s))
    head = lambda k: struct.pack("<BI", 1, WKB[k])
    if kind == "POINT":
        body = xy(inside)
    elif kind == "LINESTRING":
        body = line(inside)
    elif kind == "POLYGON":
        body = rings(inside)
    else:
        one = kind[5:]
        each = parts(inside)
        make = {"POINT": xy, "LINESTRING": lambda s: line(s[1:-1]), "POLYGON": lambda s: rings(s[1:-1])}[one]
        body = struct.pack("<I", len(each)) + b"".join(head(one) + make(x) for x in each)
    return head(kind) + body


def geometry(b: bytes, at: int = 0):
    """(kind, coordinates, end): a point's pair, a line's pairs, a polygon's rings, or the parts of a collection."""
    order = "<" if b[at] else ">"
    kind = struct.unpack_from(order + "I", b, at + 1)[0]
    at += 5
    number = lambda: struct.unpack_from(order + "I", b, at)[0]

    def line(at):
        n = struct.unpack_from(order + "I", b, at)[0]
        return [struct.unpack_from(order + "dd", b, at + 4 + 16 * i) for i in range(n)], at + 4 + 16 * n

    if kind == 1:
        return kind, struct.unpack_from(order + "dd", b, at), at + 16
    if kind == 2:
        points, end = line(at)
        return kind, points, end
    n, at, out = number(), at + 4, []
    for _ in range(n):
        if kind == 3:
            x, at = line(at)
        else:
            k, c, at = geometry(b, at)
            x = (k, c)
        out.append(x)
    return kind, out, at


def _along(points):
    return sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(points, points[1:]))


def _ring(points):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, [*points[1:], points[0]]))) / 2


def st_part(i):
    def run(b):
        kind, xy, _ = geometry(b)
        return float(xy[i]) if kind == 1 else None

    return run


def st_numpoints(b):
    kind, c, _ = geometry(b)
    return len(c) if kind == 2 else None


def st_length(b):
    kind, c, _ = geometry(b)
    return _along(c) if kind == 2 else sum(_along(x) for _, x in c) if kind == 5 else None


def st_area(b):
    kind, c, _ = geometry(b)
    own = lambda rings: _ring(rings[0]) - sum(map(_ring, rings[1:])) if rings else 0.0
    return own(c) if kind == 3 else sum(own(x) for _, x in c) if kind == 6 else None


def compress(s):
    data = s.encode() if isinstance(s, str) else bytes(s)
    return struct.pack("<I", len(data)) + zlib.compress(data) if data else b""


def uncompress(b):
    return zlib.decompress(bytes(b)[4:]).decode("utf-8", "replace") if b else ""


FUNCTIONS = {
    "json_set": ("string", json_editor("set")), "json_insert": ("string", json_editor("insert")), "json_replace": ("string", json_editor("replace")),
    "json_remove": ("string", nullable(json_remove)), "json_array_append": ("string", nullable(json_array_append)), "json_array_insert": ("string", nullable(json_array_insert)),
    "json_merge_preserve": ("string", nullable(json_merge(preserve))), "json_merge_patch": ("string", nullable(json_merge(patch))), "json_contains": ("int", nullable(json_contains)),
    "json_search": ("string", nullable(json_search)), "json_overlaps": ("int", nullable(lambda a, b: int(overlaps(json.loads(a), json.loads(b))))), "json_depth": ("int", nullable(lambda j: depth(json.loads(j)))),
    "json_schema_valid": ("int", nullable(json_schema_valid)), "json_schema_validation_report": ("string", nullable(json_schema_report)),
    "st_geomfromtext": ("binary", nullable(wkb)), "st_x": ("double", nullable(st_part(0))), "st_y": ("double", nullable(st_part(1))), "st_numpoints": ("bigint", nullable(st_numpoints)), "st_length": ("double", nullable(st_length)), "st_area": ("double", nullable(st_area)),
    "compress": ("binary", nullable(compress)), "uncompress": ("string", nullable(uncompress)),
    "inet6_aton": ("binary", nullable(lambda s: ipaddress.ip_address(s).packed)), "inet6_ntoa": ("string", nullable(lambda b: str(ipaddress.ip_address(bytes(b))))),
    "is_ipv6": ("int", lambda s: int(bool(s) and ":" in s and nullable(ipaddress.IPv6Address)(s) is not None)),
    "random_bytes": ("binary", nullable(lambda n: os.urandom(int(n)) if 1 <= n <= 1024 else None)),
}


#: Arrow types of the results.
ARROW = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def encoded(c: pa.Array):
    """A column as places in its different values, null among them; None for other types than text, bytes, whole numbers and booleans, whose equal values may differ in writing (0.0 and -0.0)."""
    is_ = pa.types
    plain = is_.is_string(c.type) or is_.is_large_string(c.type) or is_.is_binary(c.type) or is_.is_large_binary(c.type) or is_.is_integer(c.type) or is_.is_boolean(c.type)
    return c.dictionary_encode("encode") if plain else None


def values(c: pa.Array) -> list:
    """Python values of a column; NaN counts as null."""
    return [None if x != x else x for x in c.to_pylist()] if pa.types.is_floating(c.type) else c.to_pylist()


def batched(kind: str, f, distinct: bool = True):
    """f over Arrow columns. Where all columns but one have the same value in every row of the batch, f runs once for each different value of that one; else, or if not distinct, once a row."""

    def run(*columns: pa.Array) -> pa.Array:
        rows = len(columns[0])
        codes = [encoded(c) if distinct else None for c in columns]
        varying = [i for i, (c, e) in enumerate(zip(columns, codes)) if (len(e.dictionary) != 1 if e is not None else c.null_count < rows)]
        at = varying[0] if varying else 0
        if distinct and rows and len(varying) <= 1 and codes[at] is not None:
            args = [repeat(c[0].as_py()) for c in columns]
            args[at] = values(codes[at].dictionary)
            found = pa.array([f(*row) for row in zip(*args)], ARROW[kind])
            return found if len(found) == rows else found.take(codes[at].indices)
        return pa.array([f(*row) for row in zip(*map(values, columns))], ARROW[kind])

    return run


def arrow_function(kind: str, f, distinct: bool = True):
    from pyspark.sql import functions as F

    return F.arrow_udf(batched(kind, f, distinct), kind)


def register(spark) -> None:
    """Adds the Arrow functions to a session, as mr_NAME."""
    for name, (kind, f) in FUNCTIONS.items():
        u = arrow_function(kind, f, distinct=name != "random_bytes")
        spark.udf.register(f"mr_{name}", u.asNondeterministic() if name == "random_bytes" else u)
