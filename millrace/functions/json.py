"""JSON functions over JSON text. Reading goes through VARIANT; edits and searches through Arrow functions."""

from __future__ import annotations

from . import builtin, define
from .datetime import text

builtin(
    "json_depth:mr_json_depth json_set:mr_json_set json_insert:mr_json_insert json_replace:mr_json_replace json_remove:mr_json_remove json_array_append:mr_json_array_append json_array_insert:mr_json_array_insert "
    "json_merge_preserve:mr_json_merge_preserve json_merge:mr_json_merge_preserve json_merge_patch:mr_json_merge_patch json_contains:mr_json_contains json_search:mr_json_search json_overlaps:mr_json_overlaps json_schema_valid:mr_json_schema_valid json_schema_validation_report:mr_json_schema_validation_report"
)


def value(x):
    """JSON text of an SQL value."""
    return f"to_json(to_variant_object(named_struct('v', {x})):v)"


@define("json_array")
def json_array(*args):
    return f"concat('[', concat_ws(',', {', '.join(f'coalesce({one(a)}, {NULL})' for a in args)}), ']')" if args else "'[]'"


NULL = "'null'"


def one(x):
    """An SQL value's JSON text: the inside of a one-element array."""
    t = f"to_json(array({x}))"
    return f"if({x} is null, 'null', substring({t}, 2, length({t}) - 2))"


@define("json_quote")
def json_quote(s):
    t = f"to_json(array({s}))"
    return f"if({s} is null, null, substring({t}, 2, length({t}) - 2))"


@define("json_object")
def json_object(*args):
    """Members in the order given, nulls kept; an odd number of arguments is an error."""
    if len(args) % 2:
        raise ValueError("JSON_OBJECT takes pairs")
    members = [f"concat({one(k)}, ':', {one(v)})" for k, v in zip(args[::2], args[1::2])]
    return "concat('{', concat_ws(',', " + ", ".join(members) + "), '}')" if members else "'{}'"


@define("json_unquote")
def json_unquote(j):
    return f"if({j} rlike '^\".*\"$', get_json_object({j}, '$'), {j})"


def read(j, path):
    if "*" in (text(path) or ""):
        return f"get_json_object({j}, {path})"
    return f"to_json(try_variant_get(try_parse_json({j}), {path}, 'variant'))"


@define("json_extract")
def json_extract(j, *paths):
    if len(paths) == 1:
        return read(j, paths[0])
    return f"if({j} is null, null, concat('[', concat_ws(',', {', '.join(f'coalesce({read(j, p)}, {NULL})' for p in paths)}), ']'))"


@define("json_value")
def json_value(j, path):
    return f"get_json_object({j}, {path})"


@define("json_keys")
def json_keys(j, path="'$'"):
    return f"to_json(json_object_keys({read(j, path)}))"


@define("json_type")
def json_type(j):
    kind = f"schema_of_variant(try_parse_json({j}))"
    return f"case when {kind} = 'VOID' then 'NULL' when {kind} = 'BOOLEAN' then upper(trim({j})) when {kind} = 'BIGINT' then 'INTEGER' when {kind} like 'DECIMAL%' or {kind} in ('DOUBLE', 'FLOAT') then if(try_cast(trim({j}) as double) = floor(try_cast(trim({j}) as double)), 'INTEGER', 'DOUBLE') when {kind} = 'STRING' then 'STRING' when {kind} like 'ARRAY%' then 'ARRAY' when {kind} like 'OBJECT%' then 'OBJECT' end"


@define("json_valid")
def json_valid(x):
    return f"if({x} is null, null, cast(try_parse_json({x}) is not null as int))"


@define("json_length")
def json_length(j, path="'$'"):
    x = read(j, path)
    return f"case when {x} is null then null when {x} like '[%' then json_array_length({x}) when {x} like '{{%' then size(json_object_keys({x})) else 1 end"


@define("json_pretty")
def json_pretty(j):
    return j


@define("json_storage_size")
def json_storage_size(j):
    return f"octet_length({j})"


@define("json_storage_free")
def json_storage_free(j):
    return f"if({j} is null, null, 0)"


@define("json_contains_path")
def json_contains_path(j, which, *paths):
    found = [f"(try_variant_get(try_parse_json({j}), {p}, 'variant') is not null)" for p in paths]
    glue = " or " if (text(which) or "").lower() == "one" else " and "
    return f"if({j} is null, null, cast({glue.join(found)} as int))"


@define("json_arrayagg")
def json_arrayagg(x):
    """Null values stay as JSON null."""
    return f"concat('[', array_join(collect_list({one(x)}), ','), ']')"


@define("json_objectagg")
def json_objectagg(k, v):
    return f"concat('{{', array_join(collect_list(concat({one(k)}, ':', {one(v)})), ','), '}}')"
