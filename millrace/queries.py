"""Named queries over the driver's tables, one or more for each operator, with SQL that DuckDB answers alike.

A query is MySQL-flavoured text that goes through the rewriter, or a function of (spark, sf_dir). `ORACLES` has the same text where both engines read it alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions, sources, streaming
from .operators import dml, relational
from .plans.rewrite import rewrite

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, sql: str, variables: dict | None = None) -> DataFrame:
    sources.views(spark, sf_dir, tuple(t for t in sources.TABLES if re.search(rf"\b{t}\b", sql)))
    text = rewrite(sql, variables)
    if "mr_" in text:
        functions.register(spark)
    return spark.sql(text)


SAME = object()


def query(name: str, sql: str, oracle: str | None | object = SAME) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir, sql)
    if oracle is not None:
        ORACLES[name] = sql if oracle is SAME else oracle


def frame(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


MONEY = "CAST(SUM(CAST({} AS DECIMAL(24, 4))) AS DOUBLE)"
REVENUE = MONEY.format("l_extendedprice * (1 - l_discount)")

# 2.1 scans
query("flagship", f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, {REVENUE} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 WHERE o_orderdate >= TIMESTAMP '1994-01-01 00:00:00' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""")
query("scan_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.02 AND 0.04 AND l_returnflag = 'R'")
frame("point_get", "SELECT * FROM customer WHERE c_custkey = 42")(lambda s, d: relational.point_get(read(s, d, "customer"), "c_custkey", 42))
frame("range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 300")(lambda s, d: relational.range_scan(read(s, d, "orders"), "o_orderkey", 100, 300, low_open=True).select("o_orderkey", "o_totalprice"))
query("single_row", "SELECT 1 + 1 AS two, 7 / 2 AS half, 7 DIV 2 AS whole, 7 MOD 4 AS rest FROM DUAL", "SELECT 1 + 1 AS two, 3.5::DOUBLE AS half, 3::BIGINT AS whole, 3 AS rest")
query("derived_table", "SELECT c_mktsegment, n FROM (SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) AS t WHERE n > 10")
frame("information_schema_columns")(lambda s, d: (sources.views(s, d), sources.columns(s, ("region", "nation", "orders")))[1])
frame("show_tables")(lambda s, d: (sources.views(s, d, ("region", "nation")), sources.tables(s).where(F.col("table_name").isin("region", "nation")))[1])

# 2.2 projection, filter, predicates
query("project_wildcard", "SELECT n.*, r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
query("arithmetic", "SELECT l_orderkey, l_linenumber, l_linenumber + 2 AS a, l_linenumber * 3 - 1 AS b, l_quantity / 4 AS c, l_linenumber / 0 AS z, l_orderkey % 7 AS m, l_orderkey DIV 10 AS dv, -l_linenumber AS neg FROM lineitem",
      "SELECT l_orderkey, l_linenumber, l_linenumber + 2 AS a, l_linenumber * 3 - 1 AS b, l_quantity / 4 AS c, l_linenumber / NULLIF(0, 0) AS z, l_orderkey % 7 AS m, l_orderkey // 10 AS dv, -l_linenumber AS neg FROM lineitem")
query("comparison_null_safe", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') <=> NULL AS is_f, o_orderkey <> 5 AS other FROM orders", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL AS is_f, o_orderkey <> 5 AS other FROM orders")
query("logical", "SELECT p_partkey FROM part WHERE (p_size > 40 && NOT p_brand = 'Brand#11') || (p_size < 3 XOR p_retailprice > 1500)", "SELECT p_partkey FROM part WHERE (p_size > 40 AND NOT p_brand = 'Brand#11') OR ((p_size < 3) <> (p_retailprice > 1500))")
query("bitwise", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, p_partkey ^ 5 AS x, p_partkey << 2 AS l, p_partkey >> 1 AS r, ~p_partkey AS n FROM part", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, xor(p_partkey, 5) AS x, p_partkey << 2 AS l, p_partkey >> 1 AS r, ~p_partkey AS n FROM part")
query("like_predicate", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S%' AND p_brand LIKE 'Brand#_2'")
query("regexp_predicate", "SELECT c_custkey, c_name FROM customer WHERE c_name REGEXP '[05]$' AND c_mktsegment NOT REGEXP '^A'", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[05]$') AND NOT regexp_matches(c_mktsegment, '^A')")
query("is_predicates", "SELECT o_orderkey, (o_totalprice > 100000) IS TRUE AS t, (NULLIF(o_orderstatus, 'O') = 'F') IS UNKNOWN AS u, NULLIF(o_orderstatus, 'P') IS NULL AS n FROM orders",
      "SELECT o_orderkey, coalesce(o_totalprice > 100000, false) AS t, (NULLIF(o_orderstatus, 'O') = 'F') IS NULL AS u, NULLIF(o_orderstatus, 'P') IS NULL AS n FROM orders")
query("in_list", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (1, 3, 5, 7) AND s_suppkey NOT IN (2, 4, 6)")
query("tuple_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('R', 'F'), ('A', 'F'))")
query("between_predicate", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 AND p_retailprice NOT BETWEEN 1000 AND 1400")
query("case_forms", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' END AS size, IF(o_orderkey > 50, 1, 0) AS late FROM orders",
      "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' END AS size, CASE WHEN o_orderkey > 50 THEN 1 ELSE 0 END AS late FROM orders")
query("casts", "SELECT p_partkey, CAST(p_size AS CHAR) AS t, CAST('12abc' AS SIGNED) AS lead, CAST('abc' AS SIGNED) AS none, CAST(2.5 AS SIGNED) AS up, CAST('3.75' AS DECIMAL(10,1)) AS d, CONVERT(p_size, DOUBLE) AS f FROM part",
      "SELECT p_partkey, CAST(p_size AS VARCHAR) AS t, 12::BIGINT AS lead, 0::BIGINT AS none, 3::BIGINT AS up, CAST('3.75' AS DECIMAL(10,1)) AS d, CAST(p_size AS DOUBLE) AS f FROM part")
query("literals", "SELECT r_regionkey, HEX(0x4D79) AS hx, b'101' AS b, _utf8'abc' AS intro FROM region", "SELECT r_regionkey, '4D79' AS hx, 5 AS b, 'abc' AS intro FROM region")
frame("user_variable", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000")(lambda s, d: run(s, d, "SELECT o_orderkey FROM orders WHERE o_totalprice > @least", {"least": 150000}))

# 2.3 joins
query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000")
query("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'")
query("join_full", "SELECT a.s_suppkey AS x, b.c_custkey AS y FROM supplier a FULL JOIN customer b ON a.s_suppkey = b.c_custkey + 5")
query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey < 2")
query("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
query("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
query("join_theta_only", "SELECT r_regionkey, n_nationkey FROM region LEFT JOIN nation ON n_nationkey > r_regionkey * 6")
query("join_self", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
query("join_using", "SELECT l_orderkey, n FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49) a JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey) b USING (l_orderkey)")
query("join_natural", "SELECT n_regionkey, n_name, k FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name AS k FROM region) r")
query("join_straight", "SELECT o_orderkey, c_mktsegment FROM customer STRAIGHT_JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'", "SELECT o_orderkey, c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
query("join_chain", f"SELECT r_name, n_name, {REVENUE} AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
frame("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")(lambda s, d: relational.semi_join(read(s, d, "customer"), read(s, d, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey"))
frame("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")(lambda s, d: relational.anti_join(read(s, d, "customer"), read(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey"))
frame("join_not_in_null_aware", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT CASE WHEN n_nationkey > 10 THEN n_nationkey ELSE 0 END FROM nation)")(lambda s, d: relational.not_in(read(s, d, "supplier"), "s_nationkey", read(s, d, "nation").selectExpr("if(n_nationkey > 10, n_nationkey, 0) AS v"), "v").select("s_suppkey"))
frame("join_salted", "SELECT l_returnflag, COUNT(*) AS n FROM lineitem JOIN (SELECT DISTINCT l_returnflag AS f FROM lineitem) t ON l_returnflag = f GROUP BY l_returnflag")(lambda s, d: relational.salted_join(read(s, d, "lineitem"), read(s, d, "lineitem").select("l_returnflag").distinct(), "l_returnflag").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")))

# 2.4 aggregation
query("pricing_summary", f"SELECT l_returnflag, l_linestatus, {MONEY.format('l_quantity')} AS sum_qty, {REVENUE} AS revenue, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
query("aggregate_global", "SELECT COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS c, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, COUNT(NULLIF(o_orderstatus, 'F')) AS not_f FROM orders")
query("aggregate_empty", "SELECT COUNT(*) AS n, SUM(o_orderkey) AS s, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS s, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
query("aggregate_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS s, SUM(DISTINCT l_linenumber) AS t, COUNT(DISTINCT l_suppkey, l_linenumber) AS pairs FROM lineitem GROUP BY l_returnflag",
      "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS s, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS t, COUNT(DISTINCT (l_suppkey, l_linenumber)) AS pairs FROM lineitem GROUP BY l_returnflag")
query("aggregate_bits", "SELECT n_regionkey, BIT_AND(n_nationkey) AS a, BIT_OR(n_nationkey) AS o, BIT_XOR(n_nationkey) AS x FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, BIT_AND(n_nationkey)::BIGINT AS a, BIT_OR(n_nationkey)::BIGINT AS o, BIT_XOR(n_nationkey)::BIGINT AS x FROM nation GROUP BY n_regionkey")
query("aggregate_bits_empty", "SELECT BIT_AND(n_nationkey) AS a, BIT_OR(n_nationkey) AS o, BIT_XOR(n_nationkey) AS x FROM nation WHERE n_nationkey < 0", "SELECT -1::BIGINT AS a, 0::BIGINT AS o, 0::BIGINT AS x")
query("aggregate_spread", "SELECT c_mktsegment, ROUND(VAR_POP(c_acctbal), 2) AS vp, ROUND(VAR_SAMP(c_acctbal), 2) AS vs, ROUND(STDDEV_POP(c_acctbal), 4) AS sp, ROUND(STDDEV_SAMP(c_acctbal), 4) AS ss, ROUND(VARIANCE(c_acctbal), 2) AS v, ROUND(STD(c_acctbal), 4) AS s FROM customer GROUP BY c_mktsegment",
      "SELECT c_mktsegment, ROUND(VAR_POP(c_acctbal), 2) AS vp, ROUND(VAR_SAMP(c_acctbal), 2) AS vs, ROUND(STDDEV_POP(c_acctbal), 4) AS sp, ROUND(STDDEV_SAMP(c_acctbal), 4) AS ss, ROUND(VAR_POP(c_acctbal), 2) AS v, ROUND(STDDEV_SAMP(c_acctbal), 4) AS s FROM customer GROUP BY c_mktsegment")
query("group_concat", "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name DESC SEPARATOR '; ') AS names, GROUP_CONCAT(DISTINCT n_regionkey) AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names, CAST(n_regionkey AS VARCHAR) AS keys FROM nation GROUP BY n_regionkey")
query("json_arrayagg", "SELECT n_regionkey, JSON_LENGTH(JSON_ARRAYAGG(NULLIF(n_nationkey, 3))) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(COUNT(*) AS INT) AS n FROM nation GROUP BY n_regionkey")
query("json_objectagg", "SELECT r_regionkey, JSON_OBJECTAGG(r_name, r_regionkey) AS o FROM region GROUP BY r_regionkey", "SELECT r_regionkey, '{\"' || r_name || '\":' || r_regionkey || '}' AS o FROM region")
query("any_value", "SELECT n_regionkey, ANY_VALUE(r_name) AS r FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
query("group_by_expression", "SELECT YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY y ORDER BY y", "SELECT CAST(YEAR(o_orderdate) AS INT) AS y, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY y")
query("group_by_ordinal", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1, 2")
query("having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12 AND MAX(o_totalprice) > 100000", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 100000")
query("pivot_by_case", "SELECT c_nationkey, SUM(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS building, COUNT(CASE WHEN c_acctbal < 0 THEN 1 END) AS owing, ROUND(MAX(c_acctbal) - MIN(c_acctbal), 2) AS spread FROM customer GROUP BY c_nationkey",
      "SELECT c_nationkey, CAST(SUM(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS building, COUNT(CASE WHEN c_acctbal < 0 THEN 1 END) AS owing, ROUND(MAX(c_acctbal) - MIN(c_acctbal), 2) AS spread FROM customer GROUP BY c_nationkey")
frame("rollup_extra", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")(lambda s, d: read(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")))

# 2.5 windows
query("window_ranks", "SELECT s_suppkey, ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn, RANK() OVER (ORDER BY s_nationkey) AS rk, DENSE_RANK() OVER (ORDER BY s_nationkey) AS dr, NTILE(4) OVER (ORDER BY s_suppkey) AS nt FROM supplier")
query("window_aggregates", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS hi, MIN(o_orderkey) OVER (PARTITION BY o_custkey) AS lo, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS running FROM orders")
query("window_lead_lag", "SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before_, LEAD(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after_ FROM orders")
query("window_first_last", "SELECT n_nationkey, FIRST_VALUE(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, LAST_VALUE(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM nation")
query("window_frame_extra", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM orders")
query("window_over_aggregate", "SELECT c_nationkey, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, c_nationkey) AS rn FROM customer GROUP BY c_nationkey")
query("window_in_expression", "SELECT s_suppkey, 1 + ROW_NUMBER() OVER (ORDER BY s_suppkey) AS rn FROM supplier")

# 2.6 sort, limit, distinct, set operations
query("sort_nulls", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY s, o_orderkey DESC LIMIT 50", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY s NULLS FIRST, o_orderkey DESC LIMIT 50")
query("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5, 10", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5")
frame("top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")(lambda s, d: relational.top_k(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 20, F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")))
frame("top_k_by_group", "SELECT s_nationkey, s_suppkey FROM supplier QUALIFY ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) <= 2")(lambda s, d: relational.top_k_by(read(s, d, "supplier"), ["s_nationkey"], 2, F.desc("s_acctbal"), F.asc("s_suppkey")).select("s_nationkey", "s_suppkey"))
query("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders ORDER BY 1, 2")
query("union_all", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region")
query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
query("union_chain", "SELECT 1 AS x UNION ALL SELECT 2 UNION SELECT 2 UNION ALL SELECT 3")
query("union_order_limit", "(SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P') UNION ALL (SELECT c_custkey FROM customer WHERE c_custkey < 100) ORDER BY k LIMIT 25")
query("intersect_extra", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
query("except_extra", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")

# 2.9 subqueries
query("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)")
query("scalar_subquery_empty", "SELECT r_regionkey, (SELECT MAX(n_nationkey) FROM nation WHERE n_nationkey < 0) AS none FROM region")
query("in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
query("in_union_subquery", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT 1 UNION SELECT 3 UNION SELECT 5)")
query("exists_subquery", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s.s_suppkey AND l_quantity > 49) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s.s_nationkey AND n_regionkey = 2)")
query("correlated_scalar", "SELECT o_orderkey FROM orders o WHERE o_totalprice >= (SELECT MAX(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
query("correlated_in", "SELECT c_custkey FROM customer c WHERE c_custkey IN (SELECT o_custkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')")
query("cte_chain", "WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, COUNT(*) AS customers FROM a GROUP BY n) SELECT * FROM b")
query("join_derived_right", "SELECT c_custkey, t.n FROM customer JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) t ON c_custkey = t.o_custkey")
query("recursive_cte_extra", "WITH RECURSIVE t AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")


@frame("view", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
def view(spark, sf_dir):
    run(spark, sf_dir, "SELECT * FROM customer WHERE c_acctbal > 5000").createOrReplaceTempView("rich")
    return spark.sql(rewrite("SELECT c_custkey, c_acctbal FROM rich"))


# 2.7 functions
query("string_case", "SELECT p_partkey, UPPER(p_name) AS u, LCASE(p_type) AS l, LENGTH(p_name) AS n, CHAR_LENGTH(p_name) AS cn, REVERSE(p_brand) AS r, LEFT(p_name, 3) AS a, RIGHT(p_name, 2) AS b, REPEAT('ab', 2) AS rep, SPACE(2) AS sp FROM part",
      "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_type) AS l, strlen(p_name)::INT AS n, length(p_name)::INT AS cn, REVERSE(p_brand) AS r, LEFT(p_name, 3) AS a, RIGHT(p_name, 2) AS b, REPEAT('ab', 2) AS rep, '  ' AS sp FROM part")
query("string_cut", "SELECT p_partkey, SUBSTRING(p_name, 2, 3) AS a, SUBSTR(p_name FROM 3) AS b, MID(p_name, -3, 2) AS c, SUBSTRING(p_name, 0) AS z, SUBSTRING_INDEX(p_type, ' ', 1) AS d, TRIM(BOTH 'B' FROM p_brand) AS t, LPAD(p_size, 4, '0') AS lp, RPAD(p_brand, 3, '-') AS rp, REPLACE(p_brand, '#', '') AS x, LOCATE('#', p_brand) AS at, INSTR(p_type, 'E') AS ins FROM part",
      "SELECT p_partkey, SUBSTRING(p_name, 2, 3) AS a, SUBSTR(p_name, 3) AS b, left(right(p_name, 3), 2) AS c, '' AS z, split_part(p_type, ' ', 1) AS d, trim(p_brand, 'B') AS t, LPAD(p_size::VARCHAR, 4, '0') AS lp, left(p_brand, 3) AS rp, REPLACE(p_brand, '#', '') AS x, strpos(p_brand, '#')::INT AS at, strpos(p_type, 'E')::INT AS ins FROM part")
query("string_join", "SELECT n_nationkey, CONCAT(n_name, '-', n_regionkey) AS c, CONCAT_WS('/', n_name, NULLIF(n_regionkey, 1), 'x') AS w, COALESCE(NULLIF(n_regionkey, 2), 99) AS k, IFNULL(NULLIF(n_name, 'x'), 'y') AS i, STRCMP(n_name, 'NATION_12') AS s, FIELD(n_regionkey, 3, 1) AS f, ELT(n_regionkey, 'a', 'b') AS e, FIND_IN_SET('b', 'a,b,c') AS fs, ISNULL(NULLIF(n_regionkey, 1)) AS nn FROM nation",
      "SELECT n_nationkey, n_name || '-' || n_regionkey AS c, CONCAT_WS('/', n_name, NULLIF(n_regionkey, 1), 'x') AS w, COALESCE(NULLIF(n_regionkey, 2), 99) AS k, n_name AS i, CASE WHEN n_name < 'NATION_12' THEN -1 WHEN n_name = 'NATION_12' THEN 0 ELSE 1 END AS s, CASE n_regionkey WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS f, CASE n_regionkey WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS e, 2 AS fs, CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END::BIGINT AS nn FROM nation")
query("string_hex", "SELECT n_nationkey, HEX(n_name) AS h, UNHEX(HEX(n_name)) AS u, HEX(n_nationkey) AS hn, BIN(n_nationkey) AS b, OCT(n_nationkey) AS o, CONV(n_nationkey, 10, 36) AS c, ASCII(n_name) AS a, CHAR(77, 121) AS ch, BIT_COUNT(n_nationkey) AS bc, QUOTE('it''s') AS q, MAKE_SET(5, 'a', 'b', 'c') AS m, EXPORT_SET(5, 'Y', 'N', ',', 4) AS e FROM nation",
      "SELECT n_nationkey, hex(n_name) AS h, n_name AS u, upper(to_hex(n_nationkey)) AS hn, bin(n_nationkey) AS b, to_base(n_nationkey, 8) AS o, to_base(n_nationkey, 36) AS c, ascii(n_name) AS a, 'My' AS ch, bit_count(n_nationkey)::INT AS bc, '''it\\''s''' AS q, 'a,c' AS m, 'Y,N,Y,N' AS e FROM nation")
query("math_basic", "SELECT s_suppkey, ABS(s_acctbal) AS a, SIGN(s_acctbal) AS sg, CEIL(s_acctbal) AS c, FLOOR(s_acctbal) AS f, ROUND(s_acctbal) AS r0, ROUND(s_acctbal, 1) AS r1, TRUNCATE(s_acctbal, 0) AS t, MOD(s_suppkey, 7) AS m, POW(s_suppkey, 2) AS p, GREATEST(s_suppkey, 50) AS g, LEAST(s_suppkey, NULL) AS le, PI() AS pi FROM supplier",
      "SELECT s_suppkey, ABS(s_acctbal) AS a, SIGN(s_acctbal)::INT AS sg, CEIL(s_acctbal)::BIGINT AS c, FLOOR(s_acctbal)::BIGINT AS f, ROUND(s_acctbal)::BIGINT AS r0, ROUND(s_acctbal, 1) AS r1, TRUNC(s_acctbal) AS t, s_suppkey % 7 AS m, POW(s_suppkey, 2) AS p, GREATEST(s_suppkey, 50) AS g, NULL::BIGINT AS le, PI() AS pi FROM supplier")
query("math_log_trig", "SELECT p_partkey, ROUND(SQRT(p_size), 9) AS q, ROUND(LN(p_size), 9) AS ln, ROUND(LOG(2, p_size), 9) AS lb, ROUND(LOG2(p_size), 9) AS l2, ROUND(LOG10(p_size), 9) AS lt, LOG(0) AS bad, ROUND(EXP(p_size / 50), 9) AS e, ROUND(SIN(p_size), 9) AS s, ROUND(COS(p_size), 9) AS c, ROUND(TAN(p_size), 6) AS t, ROUND(ATAN2(p_size, 3), 9) AS a2, ROUND(ASIN(p_size / 100), 9) AS asn, ROUND(ACOS(p_size / 100), 9) AS ac, ROUND(COT(p_size), 6) AS ct, ROUND(RADIANS(p_size), 9) AS r, ROUND(DEGREES(p_size), 6) AS dg FROM part",
      "SELECT p_partkey, ROUND(SQRT(p_size), 9) AS q, ROUND(LN(p_size), 9) AS ln, ROUND(LN(p_size) / LN(2), 9) AS lb, ROUND(LOG2(p_size), 9) AS l2, ROUND(LOG10(p_size), 9) AS lt, NULL::DOUBLE AS bad, ROUND(EXP(p_size / 50), 9) AS e, ROUND(SIN(p_size), 9) AS s, ROUND(COS(p_size), 9) AS c, ROUND(TAN(p_size), 6) AS t, ROUND(ATAN2(p_size, 3), 9) AS a2, ROUND(ASIN(p_size / 100), 9) AS asn, ROUND(ACOS(p_size / 100), 9) AS ac, ROUND(COT(p_size), 6) AS ct, ROUND(RADIANS(p_size), 9) AS r, ROUND(DEGREES(p_size), 6) AS dg FROM part")
query("date_fields", "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAYOFMONTH(o_orderdate) AS d, QUARTER(o_orderdate) AS q, DAYOFYEAR(o_orderdate) AS dy, DAYOFWEEK(o_orderdate) AS dw, WEEKDAY(o_orderdate) AS wd, DAYNAME(o_orderdate) AS dn, MONTHNAME(o_orderdate) AS mn, WEEKOFYEAR(o_orderdate) AS wk, LAST_DAY(o_orderdate) AS ld, DATEDIFF(o_orderdate, '1995-06-17') AS dd, EXTRACT(YEAR_MONTH FROM o_orderdate) AS ym, TO_DAYS(o_orderdate) AS td FROM orders",
      "SELECT o_orderkey, YEAR(o_orderdate)::INT AS y, MONTH(o_orderdate)::INT AS m, DAY(o_orderdate)::INT AS d, QUARTER(o_orderdate)::INT AS q, DAYOFYEAR(o_orderdate)::INT AS dy, (DAYOFWEEK(o_orderdate) + 1)::INT AS dw, (isodow(o_orderdate) - 1)::INT AS wd, DAYNAME(o_orderdate) AS dn, MONTHNAME(o_orderdate) AS mn, WEEKOFYEAR(o_orderdate)::INT AS wk, LAST_DAY(o_orderdate) AS ld, datediff('day', DATE '1995-06-17', o_orderdate::DATE)::INT AS dd, (YEAR(o_orderdate) * 100 + MONTH(o_orderdate))::BIGINT AS ym, datediff('day', DATE '1970-01-01', o_orderdate::DATE)::INT + 2440588 AS td FROM orders")
query("date_arithmetic", "SELECT o_orderkey, CAST(DATE_ADD(o_orderdate, INTERVAL 1 MONTH) AS DATE) AS a, CAST(o_orderdate - INTERVAL 10 DAY AS DATE) AS b, CAST(TIMESTAMPADD(WEEK, 2, o_orderdate) AS DATE) AS c, TIMESTAMPDIFF(MONTH, '1992-01-01', o_orderdate) AS md, DATE_FORMAT(o_orderdate, '%Y/%m/%d %H:%i:%s') AS f, UNIX_TIMESTAMP(o_orderdate) AS u, MAKEDATE(1995, 45) AS mk, CAST(STR_TO_DATE('03,05,2024', '%d,%m,%Y') AS DATE) AS sd, PERIOD_ADD(199711, 3) AS pa, PERIOD_DIFF(199803, 199711) AS pd, SEC_TO_TIME(3661) AS st, TIME_TO_SEC('01:01:01') AS ts FROM orders",
      "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS a, CAST(o_orderdate - INTERVAL 10 DAY AS DATE) AS b, CAST(o_orderdate + INTERVAL 14 DAY AS DATE) AS c, datesub('month', TIMESTAMP '1992-01-01', o_orderdate) AS md, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS f, epoch(o_orderdate)::BIGINT AS u, DATE '1995-02-14' AS mk, DATE '2024-05-03' AS sd, 199802::BIGINT AS pa, 4::BIGINT AS pd, '01:01:01' AS st, 3661::BIGINT AS ts FROM orders")
query("date_weeks", "SELECT o_orderkey, WEEK(o_orderdate) AS w0, WEEK(o_orderdate, 3) AS w3, YEARWEEK(o_orderdate, 3) AS yw FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%U')::INT AS w0, weekofyear(o_orderdate)::INT AS w3, yearweek(o_orderdate)::INT AS yw FROM orders")
query("time_parts", "SELECT event_id, HOUR(ts) AS h, MINUTE(ts) AS m, SECOND(ts) AS s, TIME_FORMAT('13:07:09', '%h:%i %p') AS tf, CAST(DATE(ts) AS CHAR) AS d, TIME(ts) AS t, MAKETIME(5, 6, 7) AS mk, TIMEDIFF('10:00:00', '08:30:00') AS td, ADDTIME('10:00:00', '00:45:30') AS ad FROM events",
      "SELECT event_id, hour(ts)::INT AS h, minute(ts)::INT AS m, second(ts)::INT AS s, '01:07 PM' AS tf, ts::DATE::VARCHAR AS d, strftime(ts, '%H:%M:%S') AS t, '05:06:07' AS mk, '01:30:00' AS td, '10:45:30' AS ad FROM events")
query("hashes", "SELECT c_custkey, MD5(c_name) AS m, SHA1(c_name) AS s1, SHA2(c_name, 256) AS s2, TO_BASE64(c_name) AS b, FROM_BASE64(TO_BASE64(c_name)) AS back FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2, base64(c_name::BLOB) AS b, c_name AS back FROM customer")
query("crc_and_cipher", "SELECT n_nationkey, CRC32('MySQL') AS c, AES_DECRYPT(AES_ENCRYPT(n_name, 'a key'), 'a key') AS back, UNCOMPRESS(COMPRESS(n_name)) AS z, UNCOMPRESSED_LENGTH(COMPRESS(n_name)) AS zl, LENGTH(UUID()) AS ul FROM nation", "SELECT n_nationkey, 3259397556::BIGINT AS c, n_name AS back, n_name AS z, strlen(n_name)::BIGINT AS zl, 36 AS ul FROM nation")
query("network", "SELECT n_nationkey, INET_ATON(CONCAT('10.0.0.', n_nationkey)) AS a, INET_NTOA(167772160 + n_nationkey) AS n, IS_IPV4('1.2.3.4') AS v4, IS_IPV6('::1') AS v6, INET6_NTOA(INET6_ATON('2001:db8::1')) AS six FROM nation", "SELECT n_nationkey, 167772160::BIGINT + n_nationkey AS a, '10.0.0.' || n_nationkey AS n, 1 AS v4, 1 AS v6, '2001:db8::1' AS six FROM nation")
query("json_read", "SELECT event_id, CAST(JSON_EXTRACT(props, '$.k') AS SIGNED) AS k, props->>'$.k' AS t, JSON_VALID(props) AS v, JSON_TYPE(props) AS ty, JSON_LENGTH(props) AS n, JSON_KEYS(props) AS ks, JSON_CONTAINS_PATH(props, 'one', '$.zz') AS p FROM events",
      "SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.k' AS t, 1 AS v, 'OBJECT' AS ty, 1 AS n, '[\"k\"]' AS ks, 0 AS p FROM events")
query("json_build", "SELECT n_nationkey, JSON_ARRAY(1, 'a', NULL) AS a, JSON_OBJECT('k', n_nationkey, 's', n_name) AS o, JSON_QUOTE('a\"b') AS q, JSON_UNQUOTE('\"x\"') AS u, JSON_DEPTH('[1,[2]]') AS d FROM nation", "SELECT n_nationkey, '[1,\"a\",null]' AS a, '{\"k\":' || n_nationkey || ',\"s\":\"' || n_name || '\"}' AS o, '\"a\\\"b\"' AS q, 'x' AS u, 3 AS d FROM nation")
query("json_edit", "SELECT event_id, JSON_SET(props, '$.z', '1') AS s, JSON_REMOVE(props, '$.k') AS r, JSON_MERGE_PATCH(props, '{\"k\":null}') AS p, JSON_CONTAINS('[1,2]', '2') AS c, JSON_OVERLAPS('[1,2]', '[2,3]') AS o, JSON_SEARCH('{\"a\":\"xy\"}', 'one', 'x%') AS f, JSON_MERGE_PRESERVE('[1]', '2') AS m, JSON_ARRAY_APPEND('[1]', '$', 'b') AS ap, JSON_SCHEMA_VALID('{\"type\":\"object\"}', props) AS ok FROM events",
      "SELECT event_id, '{\"k\":' || (props->>'$.k') || ',\"z\":\"1\"}' AS s, '{}' AS r, '{}' AS p, 1 AS c, 1 AS o, '\"$.a\"' AS f, '[1,2]' AS m, '[1,\"b\"]' AS ap, 1 AS ok FROM events")
query("spatial", "SELECT n_nationkey, ST_X(ST_GeomFromText(CONCAT('POINT(', n_nationkey, ' 2)'))) AS x, ST_LENGTH(ST_GeomFromText('LINESTRING(0 0,3 4)')) AS l, ST_AREA(ST_GeomFromText('POLYGON((0 0,4 0,4 3,0 3,0 0))')) AS a, ST_NUMPOINTS(ST_GeomFromText('LINESTRING(0 0,1 1,2 2)')) AS n FROM nation", "SELECT n_nationkey, n_nationkey::DOUBLE AS x, 5.0::DOUBLE AS l, 12.0::DOUBLE AS a, 3::BIGINT AS n FROM nation")

# 2.8 (extra) windows over event time
frame("event_windows_extra", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, COUNT(*) AS n FROM events GROUP BY ALL")(lambda s, d: streaming.tumbling(read(s, d, "events"), "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n")))


# 2.10 table changes
def nation(spark, sf_dir, where="true"):
    return read(spark, sf_dir, "nation").where(where)


KEY = ["n_nationkey"]
NEW = "n_nationkey + 20 AS n_nationkey", "concat('new ', n_name) AS n_name", "n_regionkey"
D_NEW = "SELECT n_nationkey + 20 AS n_nationkey, 'new ' || n_name AS n_name, n_regionkey FROM nation"
frame("dml_insert", f"SELECT * FROM nation UNION ALL {D_NEW}")(lambda s, d: dml.insert(nation(s, d), nation(s, d).selectExpr(*NEW)))
frame("dml_insert_columns", "SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, NULL FROM nation")(lambda s, d: dml.insert(nation(s, d), nation(s, d).selectExpr("n_nationkey + 100", "n_name"), ["n_nationkey", "n_name"]))
frame("dml_insert_ignore", f"SELECT * FROM nation UNION ALL SELECT * FROM ({D_NEW}) WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")(lambda s, d: dml.insert_ignore(nation(s, d), nation(s, d).selectExpr(*NEW), KEY))
frame("dml_replace", f"SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey + 20 FROM nation) UNION ALL {D_NEW}")(lambda s, d: dml.replace(nation(s, d), nation(s, d).selectExpr(*NEW), KEY))
frame("dml_upsert", f"WITH n AS ({D_NEW}) SELECT coalesce(t.n_nationkey, n.n_nationkey) AS n_nationkey, CASE WHEN t.n_nationkey IS NULL THEN n.n_name WHEN n.n_nationkey IS NULL THEN t.n_name ELSE t.n_name || '+' || n.n_name END AS n_name, coalesce(t.n_regionkey, n.n_regionkey) AS n_regionkey FROM nation t FULL JOIN n ON t.n_nationkey = n.n_nationkey")(
    lambda s, d: dml.upsert(nation(s, d), nation(s, d).selectExpr(*NEW), KEY, {"n_name": F.concat(F.col("t.n_name"), F.lit("+"), F.col("n.n_name"))})
)
frame("dml_update", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")(lambda s, d: dml.update(read(s, d, "customer"), {"c_acctbal": F.col("c_acctbal") + 10}, F.col("c_mktsegment") == "BUILDING"))
frame("dml_update_limited", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal, s_suppkey LIMIT 5) THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")(lambda s, d: dml.update_limited(read(s, d, "supplier"), {"s_acctbal": 0.0}, F.col("s_acctbal") > 0, [F.asc("s_acctbal"), F.asc("s_suppkey")], 5))
frame("dml_update_join", "SELECT n_nationkey, n_name || '@' || r_name AS n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda s, d: dml.update_join(nation(s, d), read(s, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"], {"n_name": F.concat("t.n_name", F.lit("@"), F.col("o.r_name"))}))
frame("dml_delete", "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F')")(lambda s, d: dml.delete(read(s, d, "orders"), F.col("o_orderstatus") == "F"))
frame("dml_delete_limited", "SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7)")(lambda s, d: dml.delete_limited(read(s, d, "supplier"), None, [F.desc("s_acctbal"), F.asc("s_suppkey")], 7))
frame("dml_delete_join", "SELECT * FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2)")(lambda s, d: dml.delete_join(nation(s, d), read(s, d, "region").where("r_regionkey < 2").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"]))
frame("dml_truncate", "SELECT * FROM nation WHERE false")(lambda s, d: dml.delete(nation(s, d)))
frame("ddl_alter", "SELECT n_nationkey, 7::BIGINT AS extra, n_name AS label FROM nation")(lambda s, d: dml.rename_column(dml.drop_column(dml.add_column(nation(s, d), "extra", "bigint", 7, after="n_nationkey"), "n_regionkey"), "n_name", "label"))


# 2.10 the same and more as statements, through a session
def statements(name: str, sql: tuple[str, ...], oracle: str) -> None:
    """Statements that a session runs one after the other; the last one is the query."""

    def through(spark, sf_dir):
        from .session import Session

        sources.views(spark, sf_dir, ("region", "nation", "supplier", "customer", "orders"))
        s = Session(spark, sources.scratch(spark))
        for text in sql[:-1]:
            s.sql(text)
        return s.sql(sql[-1])

    QUERIES[name] = through
    ORACLES[name] = oracle


statements("stmt_update_join", ("CREATE TABLE st_supp SELECT * FROM supplier", "UPDATE st_supp AS s JOIN nation n ON s.s_nationkey = n.n_nationkey SET s.s_name = CONCAT(s.s_name, '@', n.n_name), s.s_acctbal = s.s_acctbal + 1 WHERE n.n_regionkey < 3", "SELECT * FROM st_supp"),
           "SELECT s_suppkey, CASE WHEN n_regionkey < 3 THEN s_name || '@' || n_name ELSE s_name END AS s_name, s_nationkey, CASE WHEN n_regionkey < 3 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
statements("stmt_update_limit", ("CREATE TABLE st_cust SELECT * FROM customer", "UPDATE st_cust SET c_acctbal = 0 WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 25", "SELECT * FROM st_cust"),
           "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 25) THEN 0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
statements("stmt_delete_join", ("CREATE TABLE st_ord SELECT o_orderkey, o_custkey, o_orderstatus FROM orders", "DELETE o FROM st_ord AS o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'", "SELECT * FROM st_ord"),
           "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
statements("stmt_delete_limit", ("CREATE TABLE st_del SELECT * FROM supplier", "DELETE FROM st_del WHERE s_acctbal > 0 ORDER BY s_acctbal, s_suppkey LIMIT 10", "SELECT * FROM st_del"),
           "SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal, s_suppkey LIMIT 10)")
statements("stmt_insert_default", ("CREATE TABLE st_def (id INT PRIMARY KEY, name VARCHAR(40) DEFAULT 'none', n INT DEFAULT 7)", "INSERT INTO st_def (id, name) SELECT n_nationkey, n_name FROM nation", "INSERT INTO st_def SET id = 100, n = 3", "INSERT INTO st_def VALUES (101, DEFAULT, DEFAULT), (102, 'x', 1 + 1)", "SELECT * FROM st_def"),
           "SELECT n_nationkey::INT AS id, n_name AS name, 7::INT AS n FROM nation UNION ALL VALUES (100, 'none', 3), (101, 'none', 7), (102, 'x', 2)")
statements("stmt_unique_keys", ("CREATE TABLE st_uni (id INT PRIMARY KEY, code INT, n INT, UNIQUE KEY by_code (code))", "INSERT INTO st_uni SELECT n_nationkey, n_nationkey + 1000, 0 FROM nation", "INSERT INTO st_uni VALUES (200, 1003, 5), (201, 1200, 6) ON DUPLICATE KEY UPDATE n = n + VALUES(n)", "INSERT IGNORE INTO st_uni VALUES (300, 1004, 9), (301, 1301, 9), (302, NULL, 9), (303, NULL, 9)", "REPLACE INTO st_uni VALUES (400, 1005, 8)", "SELECT * FROM st_uni"),
           "SELECT n_nationkey::INT AS id, (n_nationkey + 1000)::INT AS code, CASE WHEN n_nationkey = 3 THEN 5 ELSE 0 END AS n FROM nation WHERE n_nationkey <> 5 UNION ALL VALUES (201, 1200, 6), (301, 1301, 9), (302, NULL, 9), (303, NULL, 9), (400, 1005, 8)")
statements("stmt_triggers", ("CREATE TABLE st_reg SELECT * FROM region", "CREATE TABLE st_log (id INT, old_name VARCHAR(60), new_name VARCHAR(60))", "CREATE TRIGGER st_b BEFORE UPDATE ON st_reg FOR EACH ROW SET NEW.r_name = LOWER(NEW.r_name)", "CREATE TRIGGER st_a AFTER UPDATE ON st_reg FOR EACH ROW INSERT INTO st_log VALUES (OLD.r_regionkey, OLD.r_name, CONCAT('NEW.x ', NEW.r_name))", "UPDATE st_reg SET r_name = CONCAT(r_name, '!') WHERE r_regionkey > 1", "SELECT r_regionkey, r_name, old_name, new_name FROM st_reg LEFT JOIN st_log ON r_regionkey = id"),
           "SELECT r_regionkey, CASE WHEN r_regionkey > 1 THEN lower(r_name) || '!' ELSE r_name END AS r_name, CASE WHEN r_regionkey > 1 THEN r_name END AS old_name, CASE WHEN r_regionkey > 1 THEN 'NEW.x ' || lower(r_name) || '!' END AS new_name FROM region")
statements("stmt_indexes_and_names", ("CREATE TABLE st_idx (id INT PRIMARY KEY, v INT, w INT, KEY by_w (w))", "CREATE UNIQUE INDEX by_v ON st_idx (v, w)", "ALTER TABLE st_idx RENAME TO st_idx2", "DROP INDEX by_w ON st_idx2", "ALTER TABLE st_idx2 ADD INDEX again (w)", "SHOW INDEX FROM st_idx2"),
           "SELECT * FROM (VALUES ('st_idx2', 0, 'PRIMARY', 1, 'id'), ('st_idx2', 0, 'by_v', 1, 'v'), ('st_idx2', 0, 'by_v', 2, 'w'), ('st_idx2', 1, 'again', 1, 'w')) t(\"Table\", Non_unique, Key_name, Seq_in_index, Column_name)")
query("implicit_numbers", "SELECT o_orderkey, '3' + '4' AS a, 2147483647 + 1 AS b, '2.5kg' * 2 AS c, NOT 0 AS d, NOT (o_orderkey % 2) AS e, 7 / '2' AS f FROM orders",
      "SELECT o_orderkey, 7.0::DOUBLE AS a, 2147483648::BIGINT AS b, 5.0::DOUBLE AS c, true AS d, o_orderkey % 2 = 0 AS e, 3.5::DOUBLE AS f FROM orders")
frame("join_salted_full", "SELECT c_custkey, n_nationkey, n_name FROM customer FULL JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 0")(
    lambda s, d: relational.salted_join(read(s, d, "customer").withColumn("n_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_nationkey"))).select("c_custkey", "n_nationkey"), nation(s, d).select("n_nationkey", "n_name"), "n_nationkey", how="full").select("c_custkey", F.when(F.col("n_name").isNotNull(), F.col("n_nationkey")).alias("n_nationkey"), "n_name")
)


# 2.11 functions in SQL
@frame("sql_function", "SELECT p_partkey, round(p_retailprice * 1.2, 2) AS gross FROM part")
def sql_function(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION with_tax(x DOUBLE, rate DOUBLE) RETURNS DOUBLE RETURN round(x * (1 + rate), 2)")
    return run(spark, sf_dir, "SELECT p_partkey, with_tax(p_retailprice, 0.2) AS gross FROM part")
