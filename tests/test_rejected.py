"""Forms that the dialect refuses although Spark might take them."""

import pytest

from colsql.errors import SqlError
from colsql.plans.parser import parse

COMPILE = {
    "SELECT 1; SELECT 2": "Run one SELECT",
    "SELECT *, n_name FROM nation": "SELECT * cannot be mixed",
    "SELECT n_name, n_name FROM nation": "Duplicate output column",
    "SELECT sha2(n_name, 256) FROM nation": "Unsupported function",
    "SELECT DISTINCT COUNT(*) FROM nation": "SELECT DISTINCT cannot be combined",
    "SELECT n_name FROM nation HAVING n_name = 'x'": "HAVING requires",
    "SELECT n_name FROM nation WHERE COUNT(*) > 1": "Aggregate functions are not allowed",
    "SELECT n_name FROM nation WHERE RANK() OVER (ORDER BY n_name) = 1": "Window functions are only allowed",
    "SELECT SUM(DISTINCT n_nationkey) OVER () AS x FROM nation": "DISTINCT window aggregates",
    "SELECT SUM(n_nationkey) OVER (ORDER BY n_nationkey RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS x FROM nation": "RANGE frames take only",
    "SELECT NTILE(2) OVER () AS x FROM nation": "requires ORDER BY inside OVER",
    "SELECT GROUPING(n_name) AS g FROM nation GROUP BY n_name": "GROUPING requires",
    "SELECT COUNT(*) AS n FROM nation GROUP BY CUBE (1, 2, 3, 4, 5, 6)": "CUBE supports at most 5",
    "SELECT * FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey": "RIGHT JOIN is only supported",
    "SELECT n_name FROM nation NATURAL RIGHT JOIN region": "NATURAL RIGHT JOIN",
    "SELECT n_name FROM nation FULL JOIN region ON n_regionkey < r_regionkey": "FULL JOIN requires",
    "SELECT r_name FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_name = r_name)": "Correlated NOT IN",
    "SELECT r_name FROM region WHERE EXISTS (SELECT n_name FROM nation WHERE n_regionkey < r_regionkey)": "support only equality",
    "SELECT (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey) AS x FROM region": "A correlated scalar subquery must",
    "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT r_regionkey, r_name FROM region)": "must select exactly one column",
    "SELECT n_nationkey > ANY (1, 2) AS x FROM nation": "ANY/ALL take a subquery",
    "SELECT 1 FROM LATERAL (SELECT 1) x": "LATERAL",
    "SELECT 1 FROM (SELECT 1)": "A derived table requires an alias",
    "SELECT n_name FROM nation LIMIT 0": "LIMIT must be",
    "SELECT n_name FROM nation LIMIT 100001": "LIMIT must be",
    "SELECT n_name FROM nation OFFSET 100000001": "OFFSET must be",
    "SELECT n_name FROM nation FETCH FIRST 1 ROWS WITH TIES": "FETCH ... WITH TIES requires",
    "SELECT n_name FROM nation ORDER BY 'x'": "ORDER BY expressions require",
    "SELECT DISTINCT n_name FROM nation ORDER BY n_nationkey + 1": "SELECT DISTINCT orders by",
    "SELECT n_name LIKE 'a' ESCAPE 'xy' AS x FROM nation": "LIKE ESCAPE takes a single",
    "SELECT CAST(1 AS BLOB) AS x": "Unsupported column type",
    "SELECT n_name || n_nationkey AS x FROM nation": "needs a string",
    "SELECT n_name + 1 AS x FROM nation": "needs a number",
    "WITH RECURSIVE r AS (SELECT a FROM r UNION SELECT 1 AS a) SELECT a FROM r": "can't refer to itself",
    "SELECT MATCH(n_name) AGAINST 'a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7' AS x FROM nation": "at most 32 terms",
    "SELECT n_name FROM nation UNION SELECT n_name, n_nationkey FROM nation": "same number of columns",
    "SELECT x FROM nation": "Unknown column",
    "SELECT JSON_VALUE('{}', '$.*') AS x": "Unsupported JSON path",
}


@pytest.mark.parametrize("sql", COMPILE)
def test_refused(tpch, sql):
    with pytest.raises(SqlError) as e:
        tpch.spark_sql(sql)
    assert COMPILE[sql] in str(e.value)


PARSE = {
    "INSERT INTO t VALUES (1)": "Expected (",
    "INSERT INTO t (a) SELECT * FROM u": "explicit select list",
    "INSERT INTO t (a) VALUES (1) ON CONFLICT (a) DO UPDATE SET b = 1": "EXCLUDED",
    "MERGE INTO t USING t ON t.a = t.a WHEN MATCHED THEN DELETE": "different aliases",
    "MERGE INTO t USING s ON t.a = s.a": "needs a WHEN",
    "MERGE INTO t USING s ON t.a = s.a WHEN NOT MATCHED BY SOURCE THEN DELETE": "BY SOURCE",
    "CREATE TABLE t (a INT, b INT, PRIMARY KEY (a, b))": "one unique key column",
    "CREATE TABLE t (a INT CHECK (COUNT(*) > 1))": "CHECK takes no",
    "CREATE TABLE t (a INT, FOREIGN KEY (a) REFERENCES u(a) ON UPDATE CASCADE)": "ON UPDATE takes",
    "DROP TABLE t CASCADE": "CASCADE is not supported",
    "BEGIN ISOLATION LEVEL SERIALIZABLE": "there is one isolation level",
    "CREATE TRIGGER g AFTER INSERT ON t BEGIN SELECT 1; END": "statements are INSERT",
    "UPDATE t SET a = 1, a = 2": "set twice",
    "SELECT ? + $1": "Use either",
}


@pytest.mark.parametrize("sql", PARSE)
def test_refused_by_the_parser(sql):
    with pytest.raises(SqlError) as e:
        parse(sql)
    assert PARSE[sql] in str(e.value)


def test_lax_sessions_take_what_spark_takes(spark):
    from colsql.session import Session

    s = Session(spark, strict=False).load("/root/testdata/sf0.001", "nation", "region")
    assert s.sql("SELECT r_name FROM region WHERE EXISTS (SELECT n_name FROM nation WHERE n_regionkey < r_regionkey)").count() == 4


def test_parameters(tpch):
    assert tpch.sql("SELECT n_name FROM nation WHERE n_nationkey = ? AND n_name <> ? LIMIT ?", [3, "it's", 5]).count() == 1
    assert tpch.sql("SELECT $2 AS a, $1 AS b, $2 AS c", ["x\\y'", None]).first() == (None, "x\\y'", None)
    with pytest.raises(SqlError, match="takes 1 parameters"):
        tpch.sql("SELECT ? AS a", [])
    with pytest.raises(SqlError, match="LIMIT must be"):
        tpch.sql("SELECT n_name FROM nation LIMIT ?", [0])


def test_literals_and_comments(tpch):
    r = tpch.sql("SELECT 0x1F AS a, 0b101 AS b, 0o17 AS c, 1_000 AS d, 'it''s' AS e, 1.5e3 AS f /* x */ -- y\n;").first()
    assert tuple(r) == (31, 5, 15, 1000, "it's", 1500.0)


def test_error_offsets():
    with pytest.raises(SqlError) as e:
        parse("SELECT a FROM t WHERE a == 1")
    assert e.value.offset == 25


def test_null_semantics(tpch):
    r = tpch.sql("SELECT NULL IN (1, 2) AS a, 1 NOT IN (2, NULL) AS b, NULL > ALL (SELECT 1 WHERE 1 = 2) AS c, 3 > ANY (SELECT NULLIF(1, 1)) AS d, EVERY(n_nationkey > 0) AS e, 7 / 0 AS f, SUBSTR('abcdef', 3, 0) AS g, TRIM(BOTH '' FROM 'x') AS h FROM nation").first()
    assert tuple(r) == (None, None, True, None, False, None, "", "x")


def test_exact_round(spark):
    from colsql.session import Session

    assert tuple(Session(spark, exact_round=True).sql("SELECT ROUND(1.005, 2) AS a, ROUND(2.5) AS b, ROUND(-0.5) AS c").first()) == (1.0, 3.0, -1.0)


def test_with_ties_and_offset(tpch):
    got = [r.n_regionkey for r in tpch.sql("SELECT n_regionkey FROM nation ORDER BY n_regionkey OFFSET 2 ROWS FETCH FIRST 4 ROWS WITH TIES").collect()]
    assert got == [0] * 3 + [1] * 5


def test_plans_push_down_and_prune(tpch):
    plan = tpch.explain("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000")
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice" in plan and "o_comment" not in plan
