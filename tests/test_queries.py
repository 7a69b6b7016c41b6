"""Every named query against DuckDB on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from millrace.queries import ORACLES, QUERIES
from millrace.sources import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6f}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name in ORACLES:
        want = duck.execute(ORACLES[name])
        assert got == rows([d[0] for d in want.description], want.fetchall())
    else:
        assert got[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(ORACLES) <= set(e.queries())


WHOLE = {
    "lineitem": ["arithmetic"],
    "orders": ["comparison_null_safe", "is_predicates", "date_fields", "date_arithmetic", "date_weeks"],
    "part": ["bitwise", "casts", "string_case", "string_cut", "math_log_trig"],
    "customer": ["hashes"],
    "events": ["time_parts", "json_read", "json_edit"],
}


@pytest.mark.parametrize("table,name", [(t, n) for t, names in WHOLE.items() for n in names])
def test_query_covers_its_table(table, name, spark, sf, duck):
    assert QUERIES[name](spark, sf).count() == duck.execute(f"select count(*) from {table}").fetchone()[0]


def test_filters_are_by_value_alone(spark, sf, duck):
    assert QUERIES["tuple_in"](spark, sf).count() == duck.execute("select count(*) from lineitem where l_linestatus = 'F' and l_returnflag in ('R', 'A')").fetchone()[0]
    assert QUERIES["view"](spark, sf).count() == duck.execute("select count(*) from customer where c_acctbal > 5000").fetchone()[0]
    both = QUERIES["join_full"](spark, sf).toPandas()
    assert both.x.nunique() == duck.execute("select count(*) from supplier").fetchone()[0]
    assert both.y.nunique() == duck.execute("select count(*) from customer").fetchone()[0]
    assert both.x.isna().any() and both.y.isna().any() and both.dropna().size
