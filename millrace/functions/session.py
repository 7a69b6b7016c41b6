"""Functions of the session: literals at the time a statement is rewritten. Locks are advisory and live in the driver."""

from __future__ import annotations

from . import define
from .datetime import text

#: What the session last did; Session keeps it up to date.
STATE: dict = {"connection_id": 1, "version": "8.0-millrace", "last_insert_id": 0, "found_rows": 0, "row_count": -1}
LOCKS: dict[str, int] = {}

for _name in ("user", "current_user", "session_user", "system_user"):
    define(_name)(lambda: "current_user()")
for _name in ("database", "schema"):
    define(_name)(lambda: "current_database()")
for _name in ("connection_id", "found_rows", "row_count"):
    define(_name)(lambda name=_name: f"{STATE[name]}L")


@define("version")
def version():
    return f"'{STATE['version']}'"


@define("last_insert_id")
def last_insert_id(n=None):
    """With a literal argument, sets what later calls give."""
    if n is not None and n.strip("()").lstrip("-").isdigit():
        STATE["last_insert_id"] = int(n.strip("()"))
    return n or f"{STATE['last_insert_id']}L"


@define("get_lock")
def get_lock(name, timeout="0"):
    LOCKS[text(name) or name] = STATE["connection_id"]
    return "1"


@define("release_lock")
def release_lock(name):
    return "1" if LOCKS.pop(text(name) or name, None) is not None else "NULL"


@define("is_free_lock")
def is_free_lock(name):
    return "0" if (text(name) or name) in LOCKS else "1"
