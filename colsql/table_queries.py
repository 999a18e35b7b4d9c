"""Registered queries over versioned tables: each runs its statements in a database of its own and gives what is then there."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConstraintError
from .session import Session
from .sources.intermediate import shared_folder
from .sources.migrate import Column, Table, migrate
from .streaming.live import follow, subscribe
from .streaming.writer import BufferedWriter

_LIVE: list[tuple[SparkSession, str]] = []
#: name: (what makes the result, DuckDB SQL)
T: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}

ACC = "CREATE TABLE acc (id INT PRIMARY KEY, segment TEXT, balance DOUBLE PRECISION CHECK (balance > -1000000), note TEXT NOT NULL DEFAULT 'none')"
FILL = "INSERT INTO acc (id, segment, balance) SELECT c_custkey, c_mktsegment, c_acctbal FROM customer"
#: DuckDB's version of acc after FILL.
BASE = "acc AS (SELECT CAST(c_custkey AS DOUBLE) AS id, c_mktsegment AS segment, c_acctbal AS balance, 'none' AS note FROM customer)"
READ = "SELECT id, segment, balance, note FROM acc"


def database(spark: SparkSession, sf_dir: str, *tables: str) -> Session:
    """A session with a new database in the shared folder, deleted when Python ends, and tables of the driver."""
    root = f"{shared_folder(spark)}/colsql-db-{uuid.uuid4().hex}"
    _LIVE.append((spark, root))
    return Session(spark, root).load(sf_dir, *tables)


@atexit.register
def _clean() -> None:
    for spark, root in _LIVE:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(root)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended
            return


def script(name: str, tables: str, statements: list[str], read: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = database(spark, sf_dir, *tables.split())
        for text in statements:
            s.execute(text)
        return s.sql(read)

    T[name] = run, oracle


def made(oracle: str) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        T[f.__name__] = f, oracle
        return f

    return put


# statements

script("insert_select_defaults", "customer", [ACC, FILL], READ, f"WITH {BASE} SELECT * FROM acc")
script("insert_values", "", [ACC, "INSERT INTO acc (id, segment, balance) VALUES (1, 'a', 1 + 2), (2, NULL, NULL)", "INSERT INTO acc (note, id) VALUES ('it''s', 3)"], READ,
  "SELECT CAST(id AS DOUBLE) AS id, segment, CAST(balance AS DOUBLE) AS balance, note FROM (VALUES (1, 'a', 3, 'none'), (2, NULL, NULL, 'none'), (3, NULL, NULL, 'it''s')) v(id, segment, balance, note)")
script("update_where", "customer", [ACC, FILL, "UPDATE acc SET balance = balance * 2, segment = LOWER(segment) WHERE id % 3 = 0"], READ,
  f"WITH {BASE} SELECT id, CASE WHEN id % 3 = 0 THEN lower(segment) ELSE segment END AS segment, CASE WHEN id % 3 = 0 THEN balance * 2 ELSE balance END AS balance, note FROM acc")
script("update_subquery", "customer orders", [ACC, FILL, "UPDATE acc SET note = 'large' WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"], READ,
  f"WITH {BASE} SELECT id, segment, balance, CASE WHEN id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'large' ELSE note END AS note FROM acc")
script("delete_where", "customer", [ACC, FILL, "DELETE FROM acc WHERE segment = 'BUILDING' OR (id, balance) IN ((1, 1), (2, 2)) OR balance < 0"], READ,
  f"WITH {BASE} SELECT * FROM acc WHERE (segment = 'BUILDING' OR balance < 0) IS NOT TRUE")
script("delete_with_cte", "customer orders", [ACC, FILL, "WITH busy AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) DELETE FROM acc WHERE id IN (SELECT k FROM busy WHERE n > 10)"], READ,
  f"WITH {BASE} SELECT * FROM acc WHERE id NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10)")
script("insert_with_cte", "customer", [ACC, "WITH r AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) INSERT INTO acc (id, balance) SELECT k, k * 2 AS b FROM r"], READ,
  "SELECT CAST(c_custkey AS DOUBLE) AS id, CAST(NULL AS VARCHAR) AS segment, CAST(c_custkey * 2 AS DOUBLE) AS balance, 'none' AS note FROM customer WHERE c_acctbal > 0")
script("on_conflict_nothing", "customer", [ACC, FILL, "INSERT INTO acc (id, balance) VALUES (1, 5), (-1, 6) ON CONFLICT (id) DO NOTHING"], READ,
  f"WITH {BASE} SELECT * FROM acc UNION ALL SELECT -1, NULL, 6, 'none'")
script("on_conflict_update", "customer", [ACC, FILL, "INSERT INTO acc (id, balance, segment) VALUES (1, 5, 'x'), (-1, 6, 'y') ON CONFLICT (id) DO UPDATE SET balance = EXCLUDED.balance"], READ,
  f"WITH {BASE} SELECT id, segment, CASE WHEN id = 1 THEN 5 ELSE balance END AS balance, note FROM acc UNION ALL SELECT -1, 'y', 6, 'none'")
_MERGE = "MERGE INTO acc USING (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) s ON acc.id = s.k WHEN MATCHED AND s.n > 12 THEN DELETE WHEN MATCHED AND s.n > 8 THEN UPDATE SET balance = acc.balance + s.n, note = 'busy' WHEN NOT MATCHED THEN INSERT (id, balance) VALUES (s.k, s.n)"
script("merge_branches", "customer orders", [ACC, FILL, "DELETE FROM acc WHERE id % 2 = 0", _MERGE], READ,
  f"WITH {BASE}, s AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), h AS (SELECT * FROM acc WHERE id % 2 <> 0) "
  "SELECT h.id, segment, CASE WHEN n > 8 THEN balance + n ELSE balance END AS balance, CASE WHEN n > 8 THEN 'busy' ELSE note END AS note FROM h LEFT JOIN s ON h.id = s.k WHERE n IS NULL OR n <= 12 "
  "UNION ALL SELECT CAST(k AS DOUBLE), NULL, CAST(n AS DOUBLE), 'none' FROM s WHERE k NOT IN (SELECT id FROM h)")
_TRIGGERS = [
    "CREATE TABLE audit (action TEXT, item INT, amount DOUBLE PRECISION)",
    "CREATE TRIGGER a1 AFTER INSERT ON acc FOR EACH ROW BEGIN INSERT INTO audit (action, item, amount) VALUES ('in', NEW.id, NEW.balance); END",
    "CREATE TRIGGER a2 BEFORE DELETE ON acc BEGIN INSERT INTO audit (action, item, amount) VALUES ('out', OLD.id, OLD.balance); END",
    "CREATE TRIGGER a3 AFTER UPDATE ON acc BEGIN INSERT INTO audit (action, item, amount) VALUES ('up', OLD.id, NEW.balance - OLD.balance); END",
]
script("triggers", "customer", [ACC, *_TRIGGERS, FILL, "UPDATE acc SET balance = balance + 8 WHERE segment = 'MACHINERY'", "DELETE FROM acc WHERE segment = 'BUILDING'"], "SELECT action, item, ROUND(amount, 2) AS amount FROM audit",
  "SELECT 'in' AS action, CAST(c_custkey AS DOUBLE) AS item, ROUND(c_acctbal, 2) AS amount FROM customer UNION ALL SELECT 'out', c_custkey, ROUND(c_acctbal, 2) FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'up', c_custkey, 8 FROM customer WHERE c_mktsegment = 'MACHINERY'")
_PARENTS = ["CREATE TABLE p (id INT PRIMARY KEY)", "INSERT INTO p (id) SELECT n_nationkey FROM nation"]
script("foreign_key_cascade", "nation customer", [*_PARENTS, "CREATE TABLE c (id INT PRIMARY KEY, p INT, FOREIGN KEY (p) REFERENCES p(id) ON DELETE CASCADE)", "INSERT INTO c (id, p) SELECT c_custkey, c_nationkey FROM customer", "DELETE FROM p WHERE id >= 10"], "SELECT id, p FROM c",
  "SELECT CAST(c_custkey AS DOUBLE) AS id, CAST(c_nationkey AS DOUBLE) AS p FROM customer WHERE c_nationkey < 10")
script("foreign_key_set_null", "nation customer", [*_PARENTS, "CREATE TABLE c (id INT PRIMARY KEY, p INT, FOREIGN KEY (p) REFERENCES p(id) ON DELETE SET NULL)", "INSERT INTO c (id, p) SELECT c_custkey, c_nationkey FROM customer", "DELETE FROM p WHERE id >= 10"], "SELECT id, p FROM c",
  "SELECT CAST(c_custkey AS DOUBLE) AS id, CAST(CASE WHEN c_nationkey < 10 THEN c_nationkey END AS DOUBLE) AS p FROM customer")
script("create_table_as", "orders", ["CREATE TABLE t AS SELECT o_orderpriority AS p, COUNT(*) AS n, MAX(o_orderdate) AS d FROM orders GROUP BY o_orderpriority"], "SELECT p, n, d FROM t",
  "SELECT o_orderpriority AS p, CAST(COUNT(*) AS DOUBLE) AS n, MAX(o_orderdate) AS d FROM orders GROUP BY o_orderpriority")
script("alter_add_column", "customer", [ACC, FILL, "ALTER TABLE acc ADD COLUMN extra INT DEFAULT 4", "INSERT INTO acc (id, extra) VALUES (-1, 9)", "ALTER TABLE acc ADD more TEXT"], "SELECT id, extra, more FROM acc",
  "SELECT CAST(c_custkey AS DOUBLE) AS id, CAST(4 AS DOUBLE) AS extra, CAST(NULL AS VARCHAR) AS more FROM customer UNION ALL SELECT -1, 9, NULL")
script("views_of_views", "customer", [ACC, FILL, "CREATE VIEW good AS SELECT id, balance, segment FROM acc WHERE balance > 0", "CREATE VIEW sums AS SELECT segment, COUNT(*) AS n, SUM(balance) AS s FROM good GROUP BY segment", "DELETE FROM acc WHERE id % 5 = 0"], "SELECT segment, n, ROUND(s, 2) AS s FROM sums",
  f"WITH {BASE} SELECT segment, COUNT(*) AS n, ROUND(SUM(balance), 2) AS s FROM acc WHERE balance > 0 AND id % 5 <> 0 GROUP BY segment")
script("transactions", "customer", [ACC, "BEGIN", FILL, "UPDATE acc SET note = 'z' WHERE id < 100", "COMMIT", "START TRANSACTION", "DELETE FROM acc", "ROLLBACK WORK"], READ,
  f"WITH {BASE} SELECT id, segment, balance, CASE WHEN id < 100 THEN 'z' ELSE note END AS note FROM acc")


# what is reached by functions


@made(f"WITH {BASE} SELECT id, balance + 1 AS balance FROM acc WHERE segment = 'MACHINERY'")
def returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = database(spark, sf_dir, "customer")
    s.execute(ACC), s.execute(FILL)
    return s.execute("UPDATE acc SET balance = balance + 1 WHERE segment = 'MACHINERY' RETURNING id, balance").rows


@made(f"WITH {BASE} SELECT * FROM acc")
def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version from before changes, after them."""
    s = database(spark, sf_dir, "customer")
    s.execute(ACC), s.execute(FILL)
    version = s.state()["version"]
    s.execute("DELETE FROM acc WHERE id < 700")
    with s.snapshot(version):
        return s.sql(READ)


@made("SELECT CAST(id AS DOUBLE) AS id, CAST(balance AS DOUBLE) AS balance, note FROM (VALUES (1, 7, 'a'), (2, NULL, 'w'), (4, 40, 'none')) v(id, balance, note)")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = database(spark, sf_dir)
    s.execute(ACC)
    s.insert_rows("acc", [{"id": 1, "balance": 5, "note": "a"}, {"id": 2, "note": "b"}, {"id": 3, "balance": 1}])
    s.upsert_rows("acc", {"id": [2, 4], "balance": [None, 40]})
    s.update_rows("acc", [{"id": 2, "note": "w"}, {"id": 1, "balance": 7}])
    s.delete_keys("acc", [3])
    return s.sql("SELECT id, balance, note FROM acc")


@made("SELECT CAST(i AS DOUBLE) AS id, CAST(i * i AS DOUBLE) AS balance FROM range(25) r(i)")
def buffered_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = database(spark, sf_dir)
    s.execute(ACC)
    with BufferedWriter(s, "acc", max_rows=10) as w:
        for i in range(25):
            w.add({"id": i, "balance": i * i})
    return s.sql("SELECT id, balance FROM acc")


@made(f"WITH {BASE} SELECT * FROM acc WHERE id % 7 <> 0")
def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = database(spark, sf_dir, "customer")
    s.execute(ACC), s.execute(FILL)
    s.execute("DELETE FROM acc WHERE id % 7 = 0")
    with s.transaction():
        s.work.compact("acc", 500)
    s.store.vacuum()
    return s.sql(READ)


@made(f"WITH {BASE} SELECT * FROM acc")
def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = database(spark, sf_dir, "customer")
    s.execute(ACC), s.execute(FILL)
    copy = database(spark, sf_dir)
    s.store.export(copy.store.root)
    s.execute("DELETE FROM acc")
    return copy.sql(READ)


@made("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS DOUBLE) AS id, r_name AS title, 'x' AS sort FROM region")
def migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys given out in order, then a column renamed and one added."""
    s = database(spark, sf_dir, "region")
    wanted = {"t": Table({"id": Column("number", False, "autoincrement"), "name": Column("string")}, key="id")}
    migrate(s, wanted)
    s.insert_rows("t", [{"name": r.r_name} for r in s.sql("SELECT r_name FROM region ORDER BY r_regionkey").collect()])
    wanted["t"].columns = {"id": wanted["t"].columns["id"], "title": Column("string", renamed_from="name"), "sort": Column("string", False, "'x'")}
    migrate(s, wanted)
    return s.sql("SELECT id, title, sort FROM t")


@made("SELECT * FROM (SELECT 0 AS step, COUNT(*) AS n FROM customer UNION ALL SELECT 1, COUNT(*) FROM customer WHERE c_custkey >= 100) x")
def live_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that a subscriber is told of: commits to other tables, and such as change no result, are passed over."""
    s = database(spark, sf_dir, "customer")
    s.execute(ACC), s.execute(FILL)
    seen: list[DataFrame] = []
    live = subscribe(s, "SELECT COUNT(*) AS n FROM acc", on_change=seen.append)
    for text in ("CREATE TABLE side (a INT)", "INSERT INTO side (a) VALUES (1)", "UPDATE acc SET note = 'q' WHERE id = 1", "DELETE FROM acc WHERE id < 100"):
        s.execute(text)
        live.poll()
    live.close()
    out = [df.select(F.lit(i).alias("step"), "n") for i, df in enumerate(seen)]
    return out[0].unionByName(out[1]) if len(out) == 2 else s.sql("SELECT 0 AS step, 0 AS n")


@made("SELECT CAST(event_id AS DOUBLE) AS id, value FROM events")
def stream_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over a folder of Parquet files, each micro-batch one commit."""
    s = database(spark, sf_dir)
    s.execute("CREATE TABLE e (id INT PRIMARY KEY, value DOUBLE PRECISION)")
    s.spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), "value").repartition(3).write.parquet(f"{s.store.root}/_in")
    stream = s.spark.readStream.schema("id long, value double").option("maxFilesPerTrigger", 1).parquet(f"{s.store.root}/_in")
    follow(s, stream, "e", f"{s.store.root}/_checkpoint").awaitTermination()
    return s.sql("SELECT id, value FROM e")


_ODD = 'CREATE TABLE "my table" (id INT PRIMARY KEY, segment TEXT, balance DOUBLE PRECISION)'
_ODD_FILL = 'INSERT INTO "my table" (id, segment, balance) SELECT c_custkey, c_mktsegment, c_acctbal FROM customer'
_ODD_BASE = "acc AS (SELECT CAST(c_custkey AS DOUBLE) AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer)"
script("quoted_name_update", "customer", [_ODD, _ODD_FILL, 'UPDATE "my table" SET balance = 0 WHERE id < 50', 'DELETE FROM "my table" WHERE id = 7'], 'SELECT id, segment, balance FROM "my table"',
  f"WITH {_ODD_BASE} SELECT id, segment, CASE WHEN id < 50 THEN 0 ELSE balance END AS balance FROM acc WHERE id <> 7")
script("quoted_name_upsert_merge", "customer", [_ODD, _ODD_FILL, "INSERT INTO \"my table\" (id, segment, balance) VALUES (1, 'x', 5), (-1, 'y', 6) ON CONFLICT (id) DO UPDATE SET segment = EXCLUDED.segment",
  'MERGE INTO "my table" t USING (VALUES (2, 9), (-2, 8)) s(k, v) ON t.id = s.k WHEN MATCHED THEN UPDATE SET balance = s.v WHEN NOT MATCHED THEN INSERT (id, balance) VALUES (s.k, s.v)'], 'SELECT id, segment, balance FROM "my table"',
  f"WITH {_ODD_BASE} SELECT id, CASE WHEN id = 1 THEN 'x' ELSE segment END AS segment, CASE WHEN id = 2 THEN 9 ELSE balance END AS balance FROM acc UNION ALL SELECT -1, 'y', 6 UNION ALL SELECT -2, NULL, 8")
script("key_lookup", "customer", [ACC, FILL, "INSERT INTO acc (id, note) VALUES (-5, 'low')"], "SELECT id, note FROM acc WHERE id = 77 OR id IS NULL UNION ALL SELECT id, note FROM acc WHERE id IN (-5, 3, 1e9)",
  "SELECT CAST(c_custkey AS DOUBLE) AS id, 'none' AS note FROM customer WHERE c_custkey IN (3, 77) UNION ALL SELECT -5, 'low'")
script("key_ranges", "customer", [ACC, FILL, "INSERT INTO acc (id, note) VALUES (-5, 'low')", "UPDATE acc SET note = 'mid' WHERE id BETWEEN 10 AND 20 AND balance IS NOT NULL"], "SELECT id, note FROM acc WHERE id >= -5 AND 30 > id",
  "SELECT CAST(c_custkey AS DOUBLE) AS id, CASE WHEN c_custkey BETWEEN 10 AND 20 THEN 'mid' ELSE 'none' END AS note FROM customer WHERE c_custkey < 30 UNION ALL SELECT -5, 'low'")
script("count_star", "customer", [ACC, FILL, "DELETE FROM acc WHERE id % 3 = 0", "INSERT INTO acc (id) VALUES (-1), (-2)"], "SELECT COUNT(*) AS n FROM acc", "SELECT COUNT(*) + 2 AS n FROM customer WHERE c_custkey % 3 <> 0")
script("filtered_then_read", "customer", [ACC, FILL, "UPDATE acc SET balance = -1 WHERE segment = 'BUILDING'", "DELETE FROM acc WHERE segment = 'MACHINERY'"], "SELECT segment, COUNT(*) AS n, ROUND(SUM(balance), 2) AS s FROM acc WHERE balance < 5000 GROUP BY segment",
  f"WITH {BASE}, b AS (SELECT segment, CASE WHEN segment = 'BUILDING' THEN -1 ELSE balance END AS balance FROM acc WHERE segment <> 'MACHINERY') SELECT segment, COUNT(*) AS n, ROUND(SUM(balance), 2) AS s FROM b WHERE balance < 5000 GROUP BY segment")
script("dropped_and_made_again", "customer", [ACC, FILL, "DROP TABLE acc", "DROP TABLE IF EXISTS acc", ACC, "INSERT INTO acc (id, balance) VALUES (1, 2)"], "SELECT id, balance, note FROM acc", "SELECT CAST(1 AS DOUBLE) AS id, CAST(2 AS DOUBLE) AS balance, 'none' AS note")


def _codes(s: Session, statements: list[str]) -> DataFrame:
    """What each statement fails with; 'done' if it doesn't."""
    out = []
    for i, text in enumerate(statements):
        try:
            s.execute(text)
            out.append((i, "done"))
        except ConstraintError as e:
            out.append((i, e.code))
    return s.spark.createDataFrame(out, "statement int, outcome string")


@made(f"WITH {BASE} SELECT id, segment, CASE WHEN id = 3 THEN 0 ELSE balance END AS balance, note FROM acc WHERE id NOT BETWEEN 10 AND 12 UNION ALL SELECT 11, NULL, 5, 'none'")
def marked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are changed and deleted in files which stay: read less what is gone, a key that is gone and back among them."""
    s = database(spark, sf_dir, "customer")
    s.store.delta_bytes = 0
    s.execute(ACC), s.execute(FILL)
    for text in ("UPDATE acc SET balance = 0 WHERE id = 3", "DELETE FROM acc WHERE id BETWEEN 10 AND 12", "INSERT INTO acc (id, balance) VALUES (11, 4)", "UPDATE acc SET balance = balance + 1 WHERE id = 11"):
        s.execute(text)
    return s.sql(READ)


@made("SELECT * FROM (VALUES (0, 'check'), (1, 'done'), (2, 'null'), (3, 'check'), (4, 'done')) v(statement, outcome)")
def check_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = database(spark, sf_dir)
    s.execute(ACC)
    return _codes(s, ["INSERT INTO acc (id, balance) VALUES (1, -2000000)", "INSERT INTO acc (id, balance) VALUES (1, NULL)", "INSERT INTO acc (id, note) VALUES (2, NULL)", "UPDATE acc SET balance = -1000000", "UPDATE acc SET balance = -999999"])


@made("SELECT * FROM (VALUES (0, 'done'), (1, 'unique'), (2, 'unique'), (3, 'unique'), (4, 'done'), (5, 'null')) v(statement, outcome)")
def uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = database(spark, sf_dir)
    s.execute(ACC)
    return _codes(s, ["INSERT INTO acc (id) VALUES (1), (2)", "INSERT INTO acc (id) VALUES (3), (1)", "INSERT INTO acc (id) VALUES (4), (4)", "UPDATE acc SET id = 2", "UPDATE acc SET id = 9 WHERE id = 2", "INSERT INTO acc (note) VALUES ('x')"])


@made("SELECT * FROM (VALUES ('a count reads no file', TRUE), ('a key opens one file', TRUE), ('a range opens the files it meets', TRUE), ('a table sorted by key is narrowed in its file', TRUE)) v(fact, holds)")
def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans over a table of several files."""
    s = database(spark, sf_dir, "customer")
    s.execute(ACC)
    third = s.sql("SELECT COUNT(*) AS n FROM customer").first().n // 3
    for low in (0, third, 2 * third):
        s.execute(f"INSERT INTO acc (id, segment) SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey > {low} AND c_custkey <= {low + third}")
    files = lambda where: len(s.sql(f"SELECT segment FROM acc WHERE {where}").inputFiles())
    facts = {
        "a count reads no file": "parquet" not in s.explain("SELECT COUNT(*) AS n FROM acc").lower(),
        "a key opens one file": files(f"id = {third + 5}") == 1 < files("segment = 'BUILDING'"),
        "a range opens the files it meets": files(f"id BETWEEN {third - 5} AND {third + 5}") == 2,
        "a table sorted by key is narrowed in its file": "GreaterThanOrEqual" in s.explain(f"SELECT segment FROM acc WHERE id >= {third + 5}"),
    }
    return s.spark.createDataFrame(list(facts.items()), "fact string, holds boolean")


@made("SELECT 0 AS step, COUNT(*) AS n FROM customer UNION ALL SELECT 1, COUNT(*) FROM customer WHERE c_custkey >= 200")
def live_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slow reader of results: of two changes it gets the later one."""
    s = database(spark, sf_dir, "customer")
    s.execute(ACC), s.execute(FILL)
    live = subscribe(s, "SELECT COUNT(*) AS n FROM acc")
    results = live.results(every=0.05, timeout=5)
    seen = [next(results)]
    s.execute("DELETE FROM acc WHERE id < 100"), s.execute("DELETE FROM acc WHERE id < 200")
    seen.append(next(results))
    live.close()
    return seen[0].select(F.lit(0).alias("step"), "n").unionByName(seen[1].select(F.lit(1).alias("step"), "n"))


@made("SELECT CAST(event_id AS DOUBLE) AS id, value FROM events")
def stream_started_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream whose checkpoint is lost after its commits: the batches come again, and are left out."""
    s = database(spark, sf_dir)
    s.execute("CREATE TABLE e (id INT, value DOUBLE PRECISION)")
    s.spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), "value").coalesce(1).write.parquet(f"{s.store.root}/_in")
    batch = s.spark.read.schema("id long, value double").parquet(f"{s.store.root}/_in")
    for number in (0, 0):
        s.append_batch("e", batch, "a stream", number)
    return s.sql("SELECT id, value FROM e")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"table_{n}": f for n, (f, _) in T.items()}


def oracle_sql() -> dict[str, str]:
    return {f"table_{n}": sql for n, (_, sql) in T.items()}
