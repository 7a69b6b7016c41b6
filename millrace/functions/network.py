"""Internet addresses."""

from __future__ import annotations

from . import builtin, define

builtin("inet6_aton:mr_inet6_aton inet6_ntoa:mr_inet6_ntoa is_ipv6:mr_is_ipv6")

V4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


@define("inet_ntoa")
def inet_ntoa(n):
    return f"if({n} between 0 and 4294967295, concat_ws('.', " + ", ".join(f"shiftright(cast({n} as bigint), {s}) & 255" for s in (24, 16, 8, 0)) + "), null)"


@define("inet_aton")
def inet_aton(s):
    part = lambda i: f"cast(split({s}, '[.]')[{i}] as bigint)"
    return f"if({s} rlike '{V4}', {part(0)} * 16777216 + {part(1)} * 65536 + {part(2)} * 256 + {part(3)}, null)"


@define("is_ipv4")
def is_ipv4(s):
    """0 for null."""
    return f"cast(coalesce({s} rlike '{V4}', false) as int)"
