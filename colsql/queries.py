"""Registered queries over the driver's tables, in the dialect, each with SQL for DuckDB that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import SqlError
from .session import Session

#: name: (tables, text in the dialect, DuckDB SQL; None if the text itself is DuckDB's too)
Q: dict[str, tuple[str, str, str | None]] = {}


def q(name: str, tables: str, text: str, oracle: str | None = None) -> None:
    Q[name] = (tables, text, oracle)


#: The flagship: joins, aggregates, a window over groups.
FLAGSHIP = """SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n, RANK() OVER (ORDER BY SUM(l_extendedprice * (1 - l_discount)) DESC) AS rk
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""
q("revenue_by_nation", "lineitem orders customer nation", FLAGSHIP)

# scans, projection, predicates
q("scan_filter", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'")
q("column_alias_list", "nation", "SELECT y.a, y.b FROM nation AS y(a, b, c)")
q("derived_table", "orders", "SELECT d.k, d.n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) d WHERE d.n > 10")
q("values_rows", "", "VALUES (1, 'a'), (2, 'b'), (3, NULL)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(column1, column2)")
q("dual", "", "SELECT 1 + 2 AS a, 'x' || 'y' AS b, TRUE AS c")
q("star_joined", "nation region", "SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", 'SELECT n_nationkey AS "n.n_nationkey", n_name AS "n.n_name", n_regionkey AS "n.n_regionkey", r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM nation n JOIN region r ON n_regionkey = r_regionkey')
q("star_plain", "region", "SELECT * FROM region")
q("select_distinct", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
q("like_ilike_escape", "customer part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1_' AND NOT p_name LIKE '%x%%' ESCAPE 'x' AND p_name ILIKE '%P%'")
q("between_symmetric", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN SYMMETRIC 12 AND 10 AND l_linenumber NOT BETWEEN 2 AND 7", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND NOT l_linenumber BETWEEN 2 AND 7")
q("in_not_in_null", "nation", "SELECT n_nationkey, n_nationkey IN (1, 2, NULL) AS a, n_nationkey NOT IN (1, 2) AS b, NULLIF(n_nationkey, 3) IN (1, 2) AS c FROM nation")
q("in_subquery", "orders customer", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
q("is_distinct", "nation", "SELECT n_nationkey, NULLIF(n_nationkey, 3) IS DISTINCT FROM n_regionkey AS a, NULLIF(n_nationkey, 3) IS NOT DISTINCT FROM NULL AS b FROM nation")
q("is_true_unknown", "nation", "SELECT n_nationkey, (n_nationkey > 5) IS TRUE AS a, (NULLIF(n_nationkey, 3) > 5) IS UNKNOWN AS b, (NULLIF(n_nationkey, 3) > 5) IS NOT FALSE AS c FROM nation", "SELECT n_nationkey, (n_nationkey > 5) IS TRUE AS a, (NULLIF(n_nationkey, 3) > 5) IS NULL AS b, (NULLIF(n_nationkey, 3) > 5) IS NOT FALSE AS c FROM nation")
q("case_simple_searched", "nation", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS a, CASE WHEN n_nationkey > 20 THEN 'high' WHEN n_nationkey > 10 THEN 'mid' ELSE 'low' END AS b FROM nation")
q("row_compare", "nation", "SELECT n_nationkey, (n_regionkey, n_nationkey) > (2, 10) AS a, (n_regionkey, n_nationkey) IN ((1, 1), (2, 2)) AS b, (n_regionkey, NULLIF(n_nationkey, 4)) = (4, 4) AS c, (n_regionkey, NULLIF(n_nationkey, 4)) IS NOT NULL AS d FROM nation",
  "SELECT n_nationkey, (n_regionkey > 2 OR (n_regionkey = 2 AND n_nationkey > 10)) AS a, ((n_regionkey = 1 AND n_nationkey = 1) OR (n_regionkey = 2 AND n_nationkey = 2)) AS b, (n_regionkey = 4 AND NULLIF(n_nationkey, 4) = 4) AS c, (n_regionkey IS NOT NULL AND NULLIF(n_nationkey, 4) IS NOT NULL) AS d FROM nation")
q("quantified_any", "nation region", "SELECT n_nationkey, n_nationkey < ANY (SELECT r_regionkey FROM region) AS a, n_nationkey = SOME (SELECT r_regionkey FROM region) AS b, n_nationkey > ANY (SELECT r_regionkey FROM region WHERE r_regionkey > 99) AS c FROM nation")
q("quantified_all", "nation region", "SELECT n_nationkey, n_nationkey >= ALL (SELECT r_regionkey FROM region) AS a, n_nationkey <> ALL (SELECT r_regionkey FROM region) AS b, n_nationkey > ALL (SELECT NULLIF(r_regionkey, 2) FROM region) AS c FROM nation")
q("scalar_subquery", "nation region", "SELECT n_nationkey, (SELECT MAX(r_regionkey) FROM region) AS top, (SELECT r_regionkey FROM region WHERE r_regionkey > 99) AS none FROM nation")

# joins
q("inner_join", "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal WHERE c_acctbal > 5000")
q("left_join_residual", "customer orders", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
q("right_join", "orders customer", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
q("full_join", "supplier customer", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
q("cross_join", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey < n_nationkey")
q("comma_join", "region nation", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
q("using_join", "nation", "SELECT a.n_nationkey, a.n_name, b.n_regionkey FROM nation a JOIN nation b USING (n_nationkey, n_regionkey)", "SELECT a.n_nationkey, a.n_name, b.n_regionkey FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey AND a.n_regionkey = b.n_regionkey")
q("natural_join", "nation", "SELECT a.n_nationkey AS k, b.n_name AS n FROM nation a NATURAL LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 1) b", "SELECT a.n_nationkey AS k, b.n_name AS n FROM nation a LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 1) b ON a.n_nationkey = b.n_nationkey AND a.n_name = b.n_name")
q("theta_join", "nation", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey > b.n_regionkey")
q("self_join_chain", "nation region", "SELECT a.n_name AS x, b.n_name AS y, r.r_name AS r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN region r ON r.r_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
q("semi_exists", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
q("anti_not_exists", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey)")
q("corr_in", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
q("corr_scalar_agg", "customer orders", "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")

# aggregation
q("agg_basic", "lineitem", "SELECT l_returnflag, COUNT(*) AS n, COUNT(l_tax) AS k, ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_extendedprice), 4) AS a, MIN(l_shipdate) AS lo, MAX(l_discount) AS hi FROM lineitem GROUP BY l_returnflag")
q("agg_global_empty", "lineitem", "SELECT COUNT(*) AS n, SUM(l_quantity) AS s, MAX(l_returnflag) AS m FROM lineitem WHERE l_quantity < 0")
q("agg_distinct_multi", "orders", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS c, COUNT(DISTINCT o_orderpriority) AS p, CAST(SUM(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
q("agg_filter", "lineitem", "SELECT l_linestatus, COUNT(*) FILTER (WHERE l_quantity > 25) AS n, ROUND(SUM(l_quantity) FILTER (WHERE l_returnflag = 'A'), 2) AS s FROM lineitem GROUP BY l_linestatus")
q("agg_stat", "lineitem", "SELECT l_returnflag, ROUND(VAR_POP(l_quantity), 6) AS vp, ROUND(VAR_SAMP(l_quantity), 6) AS vs, ROUND(STDDEV_POP(l_quantity), 6) AS sp, ROUND(STDDEV(l_quantity), 6) AS ss, ROUND(VARIANCE(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag")
q("agg_bool", "nation", "SELECT n_regionkey, EVERY(n_nationkey > 3) AS e, BOOL_OR(n_nationkey > 20) AS o, BOOL_AND(NULLIF(n_nationkey, 7) > 0) AS a, ANY_VALUE(n_name) AS v FROM nation GROUP BY n_regionkey",
  "SELECT n_regionkey, MIN(CASE WHEN n_nationkey > 3 THEN 1 ELSE 0 END) = 1 AS e, MAX(CASE WHEN n_nationkey > 20 THEN 1 ELSE 0 END) = 1 AS o, MIN(CASE WHEN NULLIF(n_nationkey, 7) > 0 THEN 1 ELSE 0 END) = 1 AS a, MIN(n_name) AS v FROM nation GROUP BY n_regionkey")
q("group_expr", "orders", "SELECT EXTRACT(YEAR FROM o_orderdate) AS y, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS b, COUNT(*) AS n FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate), CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END")
q("having", "orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND SUM(o_totalprice) > 1000")
q("grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
q("rollup", "orders", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS m FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
q("cube_grouping_id", "orders", "SELECT o_orderstatus, o_orderpriority, GROUPING(o_orderstatus, o_orderpriority) AS g, GROUPING(o_orderpriority) AS h, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
  "SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderstatus, o_orderpriority) AS BIGINT) AS g, CAST(GROUPING(o_orderpriority) AS BIGINT) AS h, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")

# windows
q("win_rank", "orders", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders")
q("win_ntile_dist", "orders", "SELECT o_orderkey, NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t, ROUND(PERCENT_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 9) AS p, ROUND(CUME_DIST() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 9) AS c FROM orders")
q("win_lag_lead", "orders", "SELECT o_orderkey, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, LEAD(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders")
q("win_first_last_nth", "orders", "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER w AS f, LAST_VALUE(o_orderkey) OVER w AS l, NTH_VALUE(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)")
q("win_rows", "orders", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 3 PRECEDING) AS c, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM orders")
q("win_range", "orders", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS a, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, COUNT(*) OVER (PARTITION BY o_custkey) AS c FROM orders")
_FRAME = "OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING{})"
q("win_groups", "orders", f"SELECT o_orderkey, COUNT(*) {_FRAME.format('')} AS n, MAX(o_totalprice) {_FRAME.format('')} AS m FROM orders")
for _e, _n in (("CURRENT ROW", "current"), ("GROUP", "group"), ("TIES", "ties")):
    q(f"win_exclude_{_n}", "orders", f"SELECT o_orderkey, COUNT(*) {_FRAME.format(f' EXCLUDE {_e}')} AS n, ROUND(SUM(o_totalprice) {_FRAME.format(f' EXCLUDE {_e}')}, 2) AS s, MIN(o_totalprice) {_FRAME.format(f' EXCLUDE {_e}')} AS m FROM orders")
for _n, _e in (("group", "GROUP"), ("ties", "TIES"), ("current", "CURRENT ROW")):
    _f = f"OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE {_e})"
    _g = f"OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {_e})"
    q(f"win_exclude_ends_{_n}", "orders", f"SELECT o_orderkey, MAX(o_totalprice) {_f} AS a, MIN(NULLIF(o_orderkey, 5)) {_f} AS b" + (f", MAX(o_totalprice) {_g} AS c FROM orders WHERE o_orderkey < 2000" if _n != "current" else " FROM orders WHERE o_orderkey < 2000"))
q("win_exclude_first_last", "orders", "SELECT o_orderkey, FIRST_VALUE(o_totalprice) OVER w AS a, LAST_VALUE(o_totalprice) OVER w AS b, MIN(o_totalprice) OVER w AS c, NTH_VALUE(o_totalprice, 2) OVER w AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW)")
q("win_exclude_nothing", "orders", "SELECT o_orderkey, MAX(o_totalprice) OVER w AS a, COUNT(*) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING EXCLUDE CURRENT ROW)")
q("win_exclude_rows", "orders", "SELECT o_orderkey, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS m FROM orders")
q("win_named", "orders", "SELECT o_orderkey, COUNT(*) OVER w AS a, MIN(o_totalprice) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)")
q("win_over_group", "orders", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, CAST(SUM(COUNT(*)) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS run FROM orders GROUP BY o_orderstatus, o_orderpriority")
q("win_filter", "orders", "SELECT o_orderkey, COUNT(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders")
q("win_expression", "orders", "SELECT o_orderkey, ROUND(o_totalprice / SUM(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share FROM orders")

# order, limit, set operations
q("topk", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
q("offset_page", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 100 ROWS", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 100")
q("fetch_first", "orders", "SELECT o_orderkey FROM orders ORDER BY 1 DESC FETCH FIRST 7 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY 1 DESC LIMIT 7")
q("fetch_with_ties", "orders", "SELECT o_custkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC NULLS LAST FETCH FIRST 5 ROWS WITH TIES", "SELECT o_custkey, o_orderpriority FROM (SELECT *, RANK() OVER (ORDER BY o_orderpriority DESC NULLS LAST) AS rk FROM orders) WHERE rk <= 5")
q("nulls_first_last", "nation", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS r FROM nation ORDER BY r DESC NULLS FIRST, n_nationkey LIMIT 8")
q("order_hidden", "orders", "SELECT o_orderkey FROM orders ORDER BY o_totalprice * 2 DESC, o_orderkey LIMIT 9")
q("union", "orders customer", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
q("union_all", "region nation", "SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation")
q("intersect", "orders customer", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
q("except", "orders customer", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
q("intersect_all", "nation", "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT n_regionkey FROM nation WHERE n_nationkey > 10")
q("except_all", "nation", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT n_regionkey FROM nation WHERE n_nationkey > 10")
q("set_nested", "nation region", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT n_regionkey FROM nation INTERSECT SELECT r_regionkey FROM region UNION ALL (SELECT 99 ORDER BY 1 LIMIT 1)", "((SELECT n_nationkey AS k FROM nation) EXCEPT ((SELECT n_regionkey FROM nation) INTERSECT (SELECT r_regionkey FROM region))) UNION ALL (SELECT 99)")
q("cte", "orders", "WITH big AS (SELECT o_custkey AS k, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey), top(k, s) AS (SELECT k, s FROM big WHERE s > 500000) SELECT COUNT(*) AS n, ROUND(MAX(a.s), 2) AS m FROM top a JOIN big b ON a.k = b.k")
q("cte_recursive_all", "nation", "WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 150) SELECT COUNT(*) AS c, CAST(SUM(i) AS BIGINT) AS s FROM n", "SELECT 150 AS c, CAST(11325 AS BIGINT) AS s")
q("cte_recursive_union", "nation", "WITH RECURSIVE r(a, b) AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey = 24 UNION SELECT n.n_nationkey, n.n_regionkey FROM r JOIN nation n ON n.n_nationkey = r.b) SELECT a, b FROM r")
q("values_join", "nation", "SELECT n_name, v.label FROM nation JOIN (VALUES (0, 'zero'), (1, 'one')) v(k, label) ON n_regionkey = v.k")

# scalar functions
q("string_fns", "part", "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_name) AS l, LENGTH(p_name) AS n, OCTET_LENGTH(p_name) AS o, REPLACE(p_name, 'a', 'AA') AS r, POSITION('r' IN p_name) AS i, LPAD(p_name, 20, '*') AS lp, RPAD(p_name, 20, '*') AS rp, p_name || '/' || p_brand AS c FROM part",
  "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_name) AS l, LENGTH(p_name) AS n, CAST(strlen(p_name) AS BIGINT) AS o, REPLACE(p_name, 'a', 'AA') AS r, INSTR(p_name, 'r') AS i, LPAD(p_name, 20, '*') AS lp, RPAD(p_name, 20, '*') AS rp, p_name || '/' || p_brand AS c FROM part")
q("substr_window", "part", "SELECT p_partkey, SUBSTR(p_name, 0, 3) AS a, SUBSTRING(p_name FROM 2 FOR 4) AS b, SUBSTR(p_name, -2, 5) AS c, SUBSTR(p_name, 4) AS d FROM part",
  "SELECT p_partkey, SUBSTR(p_name, 1, 2) AS a, SUBSTR(p_name, 2, 4) AS b, SUBSTR(p_name, 1, 2) AS c, SUBSTR(p_name, 4) AS d FROM part")
q("overlay", "part", "SELECT p_partkey, OVERLAY(p_name PLACING '##' FROM 2 FOR 3) AS a FROM part", "SELECT p_partkey, SUBSTR(p_name, 1, 1) || '##' || SUBSTR(p_name, 5) AS a FROM part")
q("trim_unit", "nation", "SELECT n_nationkey, TRIM(BOTH 'ab' FROM 'ababx' || n_name || 'ab') AS a, TRIM('  ' || n_name || ' ') AS b, LTRIM('xx' || n_name, 'x') AS c FROM nation", "SELECT n_nationkey, 'x' || n_name AS a, TRIM(n_name) AS b, LTRIM('xx' || n_name, 'x') AS c FROM nation")
q("numeric_fns", "supplier", "SELECT s_suppkey, ROUND(s_acctbal, 1) AS r, ABS(s_acctbal) AS a, FLOOR(s_acctbal) AS f, CEIL(s_acctbal) AS c, ROUND(SQRT(ABS(s_acctbal)), 6) AS q, POWER(2, 10) AS p, MOD(s_suppkey, 7) AS m, -s_acctbal AS n, GREATEST(s_acctbal, 0, NULL) AS g, LEAST(s_acctbal, 100) AS l FROM supplier",
  "SELECT s_suppkey, ROUND(s_acctbal, 1) AS r, ABS(s_acctbal) AS a, FLOOR(s_acctbal) AS f, CEIL(s_acctbal) AS c, ROUND(SQRT(ABS(s_acctbal)), 6) AS q, POWER(2, 10) AS p, s_suppkey % 7 AS m, -s_acctbal AS n, GREATEST(s_acctbal, 0) AS g, LEAST(s_acctbal, 100) AS l FROM supplier")
q("div_mod_null", "nation", "SELECT n_nationkey, n_nationkey / n_regionkey AS d, n_nationkey % n_regionkey AS m FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) / NULLIF(n_regionkey, 0) AS d, n_nationkey % NULLIF(n_regionkey, 0) AS m FROM nation")
q("null_fns", "nation", "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), -1) AS a, NULLIF(n_name, 'x') AS b FROM nation")
q("cast_matrix", "nation", "SELECT n_nationkey, CAST(n_nationkey + 0.5 AS INTEGER) AS i, CAST(n_nationkey AS TEXT) AS t, CAST('42.5' AS INTEGER) AS s, CAST(' 7 ' AS DOUBLE PRECISION) AS d, CAST(n_nationkey > 3 AS TEXT) AS b, CAST('true' AS BOOLEAN) AS c, CAST(TIMESTAMP '2026-01-31 10:00:00' AS TEXT) AS x, CAST(n_nationkey + 0.25 AS TEXT) AS q FROM nation",
  "SELECT n_nationkey, n_nationkey AS i, CAST(n_nationkey AS TEXT) AS t, CAST(42 AS BIGINT) AS s, 7.0::DOUBLE AS d, CAST(n_nationkey > 3 AS TEXT) AS b, TRUE AS c, '2026-01-31T10:00:00.000Z' AS x, CAST(CAST(n_nationkey + 0.25 AS DOUBLE) AS TEXT) AS q FROM nation")
_UNITS = ("year", "quarter", "month", "week", "day", "hour")
q("date_trunc", "events", "SELECT event_id, " + ", ".join(f"DATE_TRUNC('{u}', ts) AS t_{u}" for u in _UNITS) + " FROM events", "SELECT event_id, " + ", ".join(f"CAST(DATE_TRUNC('{u}', ts) AS TIMESTAMP) AS t_{u}" for u in _UNITS) + " FROM events")
q("date_interval", "events", "SELECT event_id, ts + INTERVAL '1 month 3 days' AS a, ts - INTERVAL '2 hours' AS b, ts - INTERVAL '1' YEAR AS c FROM events", "SELECT event_id, ts + INTERVAL 1 MONTH + INTERVAL 3 DAY AS a, ts - INTERVAL 2 HOUR AS b, ts - INTERVAL 1 YEAR AS c FROM events")
_FIELDS = ("year", "quarter", "month", "week", "day", "hour", "minute", "dow")
q("extract_fields", "events", "SELECT event_id, " + ", ".join(f"EXTRACT({f} FROM ts) AS f_{f}" for f in _FIELDS) + ", EXTRACT(SECOND FROM ts) AS f_second, EXTRACT(EPOCH FROM ts) AS f_epoch FROM events",
  "SELECT event_id, " + ", ".join(f"EXTRACT({f} FROM ts) AS f_{f}" for f in _FIELDS) + ", CAST(FLOOR(EXTRACT(SECOND FROM ts)) AS BIGINT) AS f_second, FLOOR(epoch_us(ts) / 1000) / 1000 AS f_epoch FROM events")

# JSON and full-text
q("json_functions", "nation", """SELECT n_nationkey, JSON_VALUE('{"a": {"b": [1, "x", null]}}', '$.a.b[1]') AS a, JSON_QUERY('{"a": {"b": [1, "x"]}}', '$.a.b') AS b, JSON_EXISTS('{"a": 1}', '$.z') AS c, '{"a": 1}' IS JSON OBJECT AS d, '1 2' IS JSON AS e, JSON_OBJECT('k' VALUE n_nationkey, 'n' VALUE n_name, 'z' VALUE NULL) AS f, JSON_ARRAY(1, 'q', n_regionkey) AS g FROM nation""",
  """SELECT n_nationkey, 'x' AS a, '[1,"x"]' AS b, FALSE AS c, TRUE AS d, FALSE AS e, '{"k":' || n_nationkey || ',"n":"' || n_name || '"}' AS f, '[1,"q",' || n_regionkey || ']' AS g FROM nation""")
_TOKENS = "list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: left(x, 32))[1:4096]"
_ASCII = "NOT regexp_matches(text, '[^\\x00-\\x7F]')"
_DOCS = f"(SELECT doc_id, text, {_TOKENS} AS d FROM documents WHERE {_ASCII})"
q("fts_match", "documents", "SELECT doc_id FROM documents WHERE lang = 'en' AND MATCH(text) AGAINST 'the and' AND OCTET_LENGTH(text) = LENGTH(text)", f"SELECT doc_id FROM documents WHERE lang = 'en' AND {_ASCII} AND list_contains({_TOKENS}, 'the') AND list_contains({_TOKENS}, 'and')")
q("fts_match_prefix", "documents", "SELECT doc_id FROM documents WHERE OCTET_LENGTH(text) = LENGTH(text) AND MATCH(text) AGAINST 'thst* ing'", f"SELECT doc_id FROM {_DOCS} WHERE len(list_filter(d, lambda x: starts_with(x, 'thst'))) > 0 AND list_contains(d, 'ing')")


_TF = {"the": "len(list_filter(d, lambda x: x = 'the'))", "er": "len(list_filter(d, lambda x: starts_with(x, 'er')))"}


def _score(d: str, columns: str) -> str:
    """Scores of 'the er*' over a relation d(columns, d) of token lists, with its own statistics."""
    part = " + ".join(f"ln(1 + (n - df_{k} + 0.5) / (df_{k} + 0.5)) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * len(d) / (total / n)))" for k, f in _TF.items())
    stats = "SELECT CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(len(d)) AS DOUBLE) AS total, " + ", ".join(f"CAST(COUNT(*) FILTER (WHERE {f} > 0) AS DOUBLE) AS df_{k}" for k, f in _TF.items()) + f" FROM {d}"
    return f"SELECT {columns}, ROUND({part}, 6) AS score FROM {d}, ({stats}) s"


_WORDS = _TOKENS.replace("[a-z0-9]", r"[\p{L}\p{N}]")
_SEARCHED = {"documents": "doc_id text lang source n_chars", "conversations": "conv_id turn role text"}


def _search() -> str:
    """The ten best rows of several tables, by all their cells."""
    out = []
    for t, cells in _SEARCHED.items():
        tokens = " || ".join(_WORDS.replace("text", f"CAST({c} AS VARCHAR)") for c in cells.split())
        every = " AND ".join(f"{f} > 0" for f in _TF.values())
        out.append(f"(SELECT source, score FROM (WITH {t}_d AS (SELECT '{t}' AS source, {tokens} AS d FROM {t}) {_score(f'{t}_d', 'source, d')}) WHERE {every})")
    return " UNION ALL ".join(out) + " ORDER BY score DESC, source LIMIT 10"


q("fts_bm25", "benchmark", "SELECT item_id, ROUND(BM25(text) AGAINST 'the er*', 6) AS score FROM benchmark", f"WITH d AS (SELECT benchmark.item_id, {_WORDS} AS d FROM benchmark) {_score('d', 'item_id')}")

q("fts_all_columns", "part", "SELECT p_partkey FROM part WHERE MATCH(*) AGAINST 'small 1*'",
  "SELECT p_partkey FROM (SELECT p_partkey, " + " || ".join(_WORDS.replace("text", c) for c in ("p_name", "p_brand", "p_type", "CAST(p_partkey AS VARCHAR)", "CAST(p_size AS VARCHAR)", "CAST(p_retailprice AS VARCHAR)")) + " AS d FROM part) WHERE list_contains(d, 'small') AND len(list_filter(d, lambda x: starts_with(x, '1'))) > 0")
q("is_json", "events", "SELECT event_id, props IS JSON OBJECT AS a, props IS JSON ARRAY AS b, event_type IS JSON AS c, event_type IS NOT JSON SCALAR AS d, NULLIF(props, props) IS JSON AS e FROM events",
  "SELECT event_id, TRUE AS a, FALSE AS b, FALSE AS c, TRUE AS d, CAST(NULL AS BOOLEAN) AS e FROM events")
q("order_by_subquery", "nation customer", "SELECT n_name FROM nation n ORDER BY (SELECT COUNT(*) FROM customer WHERE c_nationkey = n.n_nationkey) DESC, n_name LIMIT 7")
q("select_list_subquery", "nation customer", "SELECT n_name, (SELECT COUNT(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS poor, (SELECT MAX(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS top FROM nation")
q("literals", "", "SELECT 0x1F AS a, 0b101 AS b, 0o17 AS c, 1_000 AS d, 'it''s' AS e, 1.5e3 AS f, DATE '2026-01-31' AS g /* nothing */ -- here",
  "SELECT 31 AS a, 5 AS b, 15 AS c, 1000 AS d, 'it''s' AS e, CAST(1500 AS DOUBLE) AS f, TIMESTAMP '2026-01-31 00:00:00' AS g")
q("number_text", "lineitem", "SELECT DISTINCT CAST(l_quantity * 1000000 AS TEXT) AS a, CAST(l_extendedprice AS TEXT) AS b FROM lineitem",
  "SELECT DISTINCT CAST(CAST(l_quantity * 1000000 AS BIGINT) AS VARCHAR) AS a, regexp_replace(CAST(l_extendedprice AS VARCHAR), '\\.0$', '') AS b FROM lineitem")

# analytic shapes of a retail suite
q("page_filtered", "orders", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
q("top_per_group", "lineitem part", "WITH r AS (SELECT p_brand, p_partkey, ROUND(SUM(l_extendedprice), 2) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_partkey), k AS (SELECT p_brand, p_partkey, s, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY s DESC, p_partkey) AS rn FROM r) SELECT p_brand, p_partkey, s, rn FROM k WHERE rn <= 3")
q("cohort", "customer orders", "WITH f AS (SELECT o_custkey AS c, MIN(o_orderdate) AS d FROM orders GROUP BY o_custkey) SELECT DATE_TRUNC('year', f.d) AS cohort, EXTRACT(YEAR FROM o_orderdate) - EXTRACT(YEAR FROM f.d) AS age, COUNT(DISTINCT o_custkey) AS n FROM orders JOIN f ON o_custkey = f.c GROUP BY DATE_TRUNC('year', f.d), EXTRACT(YEAR FROM o_orderdate) - EXTRACT(YEAR FROM f.d)",
  "WITH f AS (SELECT o_custkey AS c, MIN(o_orderdate) AS d FROM orders GROUP BY o_custkey) SELECT CAST(DATE_TRUNC('year', f.d) AS TIMESTAMP) AS cohort, EXTRACT(YEAR FROM o_orderdate) - EXTRACT(YEAR FROM f.d) AS age, COUNT(DISTINCT o_custkey) AS n FROM orders JOIN f ON o_custkey = f.c GROUP BY ALL")
q("rate_of_returns", "lineitem part", "SELECT p_brand, COUNT(*) AS n, ROUND(COUNT(*) FILTER (WHERE l_returnflag = 'R') / COUNT(*), 6) AS rate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
q("contains_newest", "orders", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority LIKE '%URG%' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")


q("rollup_of_no_rows", "orders", "SELECT o_orderstatus, COUNT(*) AS n, SUM(o_totalprice) AS s, MAX(o_orderdate) AS d FROM orders WHERE o_orderkey < 0 GROUP BY ROLLUP (o_orderstatus)")
q("cube_of_no_rows", "orders", "SELECT o_orderstatus, o_custkey % 3 AS k, GROUPING(o_orderstatus) AS g, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY CUBE (o_orderstatus, o_custkey % 3) HAVING COUNT(*) < 5")
q("grouping_sets_twice_empty", "nation", "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY GROUPING SETS ((n_regionkey), (), ()) ORDER BY n DESC, n_regionkey LIMIT 4")
# forms that had no query of their own
q("distinct_star", "nation", "SELECT DISTINCT * FROM (SELECT n_regionkey, n_nationkey % 2 AS odd FROM nation) d")
q("agg_all", "lineitem", "SELECT l_returnflag, COUNT(ALL l_tax) AS n, ROUND(SUM(ALL l_quantity), 2) AS s, MAX(ALL l_shipdate) AS d FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(l_tax) AS n, ROUND(SUM(l_quantity), 2) AS s, MAX(l_shipdate) AS d FROM lineitem GROUP BY l_returnflag")
q("order_ordinals", "orders", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders ORDER BY 3 DESC, 2 LIMIT 40")
q("current_moments", "nation", "SELECT n_nationkey, CURRENT_DATE <= CURRENT_TIMESTAMP AS a, CURRENT_TIMESTAMP > TIMESTAMP '2020-01-01 00:00:00' AS b, LENGTH(CURRENT_TIME) AS c, LOCALTIMESTAMP - INTERVAL '1' DAY < CURRENT_TIMESTAMP AS d FROM nation", "SELECT n_nationkey, TRUE AS a, TRUE AS b, 8 AS c, TRUE AS d FROM nation")
q("spilling_join", "lineitem orders", "SELECT o_orderkey, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate GROUP BY o_orderkey")
q("small_build_side", "orders customer nation", "SELECT n_name, COUNT(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
q("sort_keys", "customer", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_acctbal, c_custkey DESC LIMIT 100")
q("sort_all", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber")
q("string_order", "part", "SELECT p_partkey, p_name, ROW_NUMBER() OVER (ORDER BY p_name, p_partkey) AS at FROM part")
q("correlated_superset", "nation region", "SELECT r_regionkey FROM region WHERE EXISTS (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 20)")
q("datetime_milliseconds", "orders", "SELECT o_orderkey, DATE_TRUNC('day', o_orderdate) + INTERVAL '1' SECOND AS at FROM orders", "SELECT o_orderkey, DATE_TRUNC('day', o_orderdate) + INTERVAL 1 SECOND AS at FROM orders")
q("group_by_semantics", "orders", "SELECT o_custkey % 10 AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10")


def _runner(tables: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Session(spark).load(sf_dir, *tables.split()).sql(text)

    return run


def fts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Session(spark).load(sf_dir, *_SEARCHED).search("the er*", list(_SEARCHED), 10)
    return found.select("source", F.round("score", 6).alias("score"))


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark).load(sf_dir, "orders")
    return s.sql("SELECT o_orderkey, o_totalprice * $2 AS x, $3 AS name FROM orders WHERE o_orderstatus = $1 AND o_totalprice > $4 ORDER BY o_orderkey LIMIT $5", ["F", 2, "it's", 100000.5, 50])


#: Statements that the dialect refuses, each for a reason of its own.
REFUSED = (
    "SELECT n_name FROM nation WHERE RANK() OVER (ORDER BY n_name) = 1", "SELECT SUM(DISTINCT n_nationkey) OVER () AS x FROM nation", "SELECT NTILE(2) OVER () AS x FROM nation",
    "SELECT SUM(n_nationkey) OVER (ORDER BY n_nationkey RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS x FROM nation", "SELECT n_name, n_name FROM nation", "SELECT DISTINCT COUNT(*) FROM nation",
    "SELECT r_name FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_name = r_name)", "SELECT (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey) AS x FROM region",
    "SELECT n_name FROM nation HAVING n_name = 'x'", "SELECT n_name FROM nation LIMIT 0", "SELECT n_name + 1 AS x FROM nation", "SELECT 1; SELECT 2",
)


def refused_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement, and whether it is an error."""
    s = Session(spark).load(sf_dir, "nation", "region")

    def is_error(text: str) -> bool:
        try:
            s.spark_sql(text)
        except SqlError:
            return True
        return False

    return spark.createDataFrame([(i, is_error(t)) for i, t in enumerate(REFUSED)], "form int, refused boolean")


def scalar_of_many_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar subquery of several rows is an error when it runs; one of one row or none isn't."""
    s = Session(spark).load(sf_dir, "region")

    def fails(where: str) -> bool:
        try:
            s.sql(f"SELECT (SELECT r_name FROM region WHERE {where}) AS x").collect()
        except Exception:  # noqa: BLE001  Spark's own
            return True
        return False

    return spark.createDataFrame([(w, fails(w)) for w in ("r_regionkey < 3", "r_regionkey = 3", "r_regionkey > 99")], "part string, fails boolean")


def plan_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the physical plans of some statements have: filters and columns at the scan, partial sums, a bounded sort."""
    s = Session(spark).load(sf_dir, "orders", "lineitem", "nation", "customer")
    scan = s.explain("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
    facts = {
        "filters are pushed": "GreaterThan(o_totalprice" in scan and "EqualTo(o_orderstatus,F)" in scan,
        "columns are pruned": "o_orderkey" in scan and "o_comment" not in scan and "o_custkey" not in scan,
        "sums are partial": "partial_sum" in s.explain("SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag"),
        "top rows are a bounded sort": "TakeOrderedAndProject" in s.explain("SELECT o_orderkey FROM orders ORDER BY o_totalprice LIMIT 5"),
        "a small side is broadcast": "BroadcastHashJoin" in s.explain("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey"),
        "a semi join stays one": "LeftSemi" in s.explain("SELECT c_custkey FROM customer WHERE EXISTS (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey)"),
    }
    return spark.createDataFrame(list(facts.items()), "fact string, holds boolean")


def arrow_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as Arrow's stream format and back."""
    import pyarrow as pa

    table = Session(spark).load(sf_dir, "nation").sql("SELECT n_nationkey, n_name, NULLIF(n_regionkey, 2) AS r FROM nation").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return spark.createDataFrame(pa.ipc.open_stream(sink.getvalue()).read_all())


def _constants(names: str, rows: list[tuple]) -> str:
    texts = ("(" + ", ".join("TRUE" if v is True else "FALSE" if v is False else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {', '.join(texts)}) v({names})"


_FACTS = ("filters are pushed", "columns are pruned", "sums are partial", "top rows are a bounded sort", "a small side is broadcast", "a semi join stays one")
#: Registered queries that are functions, with DuckDB's SQL.
MORE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "fts_search": (fts_search, _search()),
    "refused_forms": (refused_forms, _constants("form, refused", [(i, True) for i in range(len(REFUSED))])),
    "scalar_of_many_rows": (scalar_of_many_rows, _constants("part, fails", [("r_regionkey < 3", True), ("r_regionkey = 3", False), ("r_regionkey > 99", False)])),
    "plan_facts": (plan_facts, _constants("fact, holds", [(f, True) for f in _FACTS])),
    "arrow_wire": (arrow_wire, "SELECT n_nationkey, n_name, NULLIF(n_regionkey, 2) AS r FROM nation"),
    "parameters": (parameters, "SELECT o_orderkey, o_totalprice * 2 AS x, 'it''s' AS name FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000.5 ORDER BY o_orderkey LIMIT 50"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _runner(t, text) for n, (t, text, _) in Q.items()} | {n: f for n, (f, _) in MORE.items()}


def oracle_sql() -> dict[str, str]:
    return {n: o or text for n, (_, text, o) in Q.items()} | {n: o for n, (_, o) in MORE.items()}
