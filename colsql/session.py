"""Session: the dialect over registered DataFrames and, with a root, over versioned tables."""

from __future__ import annotations

import contextlib
import itertools
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import functions
from .errors import ConflictError, SqlError
from .operators import fulltext, recursion
from .plans.ast import QUERIES, Node, mapped, walk
from .plans.bounds import Asked
from .plans.lower import Columns, Lower, Scope, Source, ident
from .plans.parser import parse, parse_expression
from .sources.database import RETRIES, Work
from .sources.store import SPARK_TYPES, Bounds, Store

CONF = {"spark.sql.caseSensitive": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}
SELF = "__self"
#: What remembered results may have in all.
MEMO_BYTES = 64 << 20
A = TypeVar("A")


def logical(t: T.DataType) -> str | None:
    if isinstance(t, T.NumericType):
        return "number"
    return {T.StringType: "string", T.BooleanType: "boolean", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DateType: "datetime"}.get(type(t))


@dataclass
class Result:
    count: int
    rows: DataFrame | None = None


class Session:
    """One user of a database. It has a Spark session of its own, so its settings and views don't touch the caller's."""

    def __init__(self, spark: SparkSession, root: str | None = None, strict: bool = True, exact_round: bool = False, idle_seconds: float = 30.0) -> None:
        self.spark = spark.newSession()
        for k, v in CONF.items():
            self.spark.conf.set(k, v)
        functions.register(self.spark)
        self.strict, self.exact_round = strict, exact_round
        self.frames: dict[str, DataFrame] = {}
        self.store = Store(self.spark, root) if root else None
        self.work: Work | None = None
        self.at_version: int | None = None
        self.numbers = itertools.count()
        self._statistics: dict = {}
        self._memo: dict[tuple, pa.Table] = {}
        self.idle_seconds, self._idle = idle_seconds, threading.Lock()

    # sources

    def register(self, name: str, df: DataFrame) -> None:
        """Makes a DataFrame of the caller's session a table of this one."""
        own = self._own(df)
        own.createOrReplaceTempView(name)
        self.frames[name] = own

    def _own(self, df: DataFrame) -> DataFrame:
        """The same plan as a DataFrame of this session, by way of a view that sessions share."""
        name = f"colsql_{uuid.uuid4().hex}"
        df.createOrReplaceGlobalTempView(name)
        try:
            return self.spark.table(f"global_temp.{name}")
        finally:
            self.spark.catalog.dropGlobalTempView(name)

    def read_parquet(self, name: str, path: str) -> None:
        df = self.spark.read.parquet(path)
        df.createOrReplaceTempView(name)
        self.frames[name] = df

    def load(self, sf_dir: str, *names: str) -> Session:
        for n in names:
            self.read_parquet(n, f"{sf_dir}/{n}.parquet")
        return self

    def state(self) -> dict:
        if self.work:
            return self.work.state
        return self.store.state(self.at_version) if self.store else {"tables": {}, "views": {}, "triggers": {}, "version": 0}

    def table(self, name: str) -> DataFrame:
        """A table's rows as a DataFrame: the query builder is Spark's own."""
        if name in self.frames:
            return self.frames[name]
        state = self.state()
        if name in state["tables"]:
            return self.store.frame(state["tables"][name])
        if name in state["views"]:
            return self.sql(state["views"][name])
        raise SqlError(f"Unknown table {name}")

    def relation(self, name: str, asked: Asked | None = None) -> tuple[str, Columns] | Node:
        """A table or view as lowering sees it. Of a table of its own, files that can't have a key within what is asked are left out,
        and rows that don't match by a text index; conditions are still evaluated on what is left."""
        if name in self.frames:
            return ident(name), [(f.name, logical(f.dataType)) for f in self.frames[name].schema.fields]
        state = self.state()
        if name in state["tables"]:
            t = state["tables"][name]
            view = f"__t{next(self.numbers)}"
            files = self.store.files(t, asked.bounds(t["key"]) if asked and t["key"] else None)
            self._matching(t, files, asked.texts() if asked and t.get("texts") else []).createOrReplaceTempView(view)
            return view, [(c["name"], c["type"]) for c in t["columns"]]
        if name in state["views"]:
            return parse(state["views"][name])[0]
        raise SqlError(f"Unknown table {name}")

    # text indexes

    def index_text(self, name: str, *columns: str) -> int:
        """Makes a text index of a table with a key, or adds to it what was written since: postings of each file that has none.
        Queries use it where it covers what they ask, and scan the rest. Gives the files that were added."""

        def run(w: Work) -> int:
            t = w.table(name)
            key, kinds = Work.keyed(t, name, "A text index"), dict(self.columns_of(t))
            if unknown := [c for c in columns if kinds.get(c) in (None, "boolean")]:
                raise SqlError(f"{name} has no column {unknown[0]} to search")
            indexes = t.setdefault("texts", [])
            index = next((i for i in indexes if set(i["columns"]) == set(columns)), None)
            if index is None:
                index = {"columns": sorted(columns), "files": {}, "folders": []}
                indexes.append(index)
            listed = self.store.files(t)
            new = [f for f in listed if f["path"] not in index["files"]]
            if not new:
                return 0
            cells = [fulltext.cell_sql(ident(c), kinds[c]) for c in index["columns"]]
            folder = self.store.index(fulltext.postings(self.store.with_file(t, files=new), key, cells), name)
            sums = {r.file: r for r in self.store.spark.read.parquet(f"{self.store.root}/{folder}").select("file", "key", "length").distinct().groupBy("file").agg(F.sum("length").alias("tokens")).collect()}
            index["files"] |= {f["path"]: {"tokens": int(sums[f["path"]].tokens) if f["path"] in sums else 0} for f in new}
            index["folders"].append(folder)
            w.changed.add(name)
            return len(new)

        return self._in_work(run)

    def _matching(self, t: dict, files: list[dict], texts: list[tuple[frozenset[str], str]]) -> DataFrame:
        """Rows of files, without those of indexed files that lack a term of a text that their columns must match."""
        rows = self.store.frame(t, files)
        for columns, query in texts:
            index = next((i for i in t["texts"] if set(i["columns"]) == columns), None)
            terms = fulltext.query_terms(query) if index else []
            known = [f for f in files if index and f["path"] in index["files"]]
            if not known or not terms:
                continue
            keys = fulltext.having_all(self.store.postings(index, known), query).withColumnRenamed("key", "__key")
            found = self.store.frame(t, known).join(keys, F.col(ident(t["key"])) == F.col("__key"), "left_semi")
            rest = [f for f in files if f["path"] not in index["files"]]
            return found.unionByName(self.store.frame(t, rest)) if rest else found
        return rows

    def _indexed_statistics(self, name: str, cells: list[str], query: str) -> tuple | None:
        """BM25's statistics from an index of all files of a table; None if there is none."""
        t = self.state()["tables"].get(name, {})
        for index in t.get("texts", []):
            kinds = dict(self.columns_of(t))
            if {fulltext.cell_sql(ident(c), kinds[c]) for c in index["columns"]} != set(cells):
                continue
            files = self.store.files(t)
            if all(f["path"] in index["files"] and not f.get("gone") for f in files) and (n := self.store.count(t)) is not None:
                return n, sum(index["files"][f["path"]]["tokens"] for f in files), fulltext.rows_having(self.store.postings(index, files), query)
        return None

    def statistics(self, name: str, cells: list[str], query: str) -> tuple:
        key = (name, tuple(cells), query, None if name in self.frames else self.state()["tables"][name].get("manifest"))
        if key not in self._statistics:
            indexed = None if name in self.frames else self._indexed_statistics(name, cells, query)
            self._statistics[key] = indexed or fulltext.statistics(self.table(name), cells, query)
        return self._statistics[key]

    # queries

    def lower(self, params: Sequence[object] = ()) -> Lower:
        return Lower(self.relation, params, self.strict, self.exact_round, statistics=self.statistics, recurse=lambda base, names, step: recursion.union_fixpoint(self.spark, base, names, step))

    @staticmethod
    def check_params(written: list[str], params: Sequence[object]) -> None:
        need = len(written) if written and written[0] == "?" else max((int(p[1:]) for p in written), default=0)
        if need != len(params):
            raise SqlError(f"This statement takes {need} parameters, not {len(params)}")

    def spark_sql(self, text: str, params: Sequence[object] = ()) -> str:
        """The Spark SQL of a query."""
        tree, written = parse(text)
        if tree.kind != "query":
            raise SqlError("Run one SELECT statement at a time: execute() takes others")
        self.check_params(written, params)
        text, columns = self.lower(params).query(tree)
        n = self.counted(tree)
        return text if n is None else f"SELECT CAST({n} AS BIGINT) AS {ident(columns[0][0])}"

    def counted(self, q: Node) -> int | None:
        """The rows of a table of its own, if a query asks for nothing else: its manifest has them, no file is read."""
        b = q.body
        if q.ctes or q.order or q.limit or q.offset or b.kind != "select" or b.where is not None or b.group or b.having or b.distinct or len(b.items) != 1 or len(b.joins) != 1:
            return None
        e, source = b.items[0].expr if b.items[0].kind == "item" else None, b.joins[0].source
        if e is None or e.kind != "call" or e.name != "count" or not e.star or e.over is not None or getattr(e, "filter", None) is not None:
            return None
        if source.kind != "table" or source.name in self.frames or source.name not in (tables := self.state()["tables"]):
            return None
        return self.store.count(tables[source.name])

    def sql(self, text: str, params: Sequence[object] = ()) -> DataFrame:
        return self.spark.sql(self.spark_sql(text, params))

    def result(self, text: str, params: Sequence[object] = ()) -> pa.Table:
        """A query's rows. Those of queries over tables of its own are remembered, up to MEMO_BYTES in all, for as long as the tables
        are the same: by their manifests, which never change. Queries that ask for the time run each time."""
        tree = parse(text)[0]
        names, views, todo = set(), self.state()["views"], [tree]
        while todo:
            for n in walk(todo.pop()):
                if n.kind == "table" and n.name not in names:
                    names.add(n.name)
                    todo += [parse(views[n.name])[0]] if n.name in views else []
                elif n.kind == "now":
                    return self.sql(text, params).toArrow()
        tables = self.state()["tables"]
        if any(n in self.frames for n in names):
            return self.sql(text, params).toArrow()
        key = text, repr(params), tuple(sorted((n, tables[n].get("manifest"), json.dumps(tables[n]["columns"])) for n in names if n in tables)), tuple(sorted((n, views[n]) for n in names if n in views))
        if key in self._memo:
            self._memo[key] = self._memo.pop(key)  # the last used is the last to go
        else:
            out = self.sql(text, params).toArrow()
            if out.nbytes > MEMO_BYTES:
                return out
            self._memo[key] = out
            while sum(t.nbytes for t in self._memo.values()) > MEMO_BYTES:
                self._memo.pop(next(iter(self._memo)))
        return self._memo[key]

    def explain(self, text: str, params: Sequence[object] = ()) -> str:
        return self.sql(text, params)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def search(self, query: str, tables: Sequence[str], limit: int = 10) -> DataFrame:
        return fulltext.search({n: self.table(n) for n in tables}, query, limit)

    def another(self) -> Session:
        """A session of the same database and tables with settings, a transaction and a version of its own."""
        out = Session(self.spark, self.store.root if self.store else None, self.strict, self.exact_round, self.idle_seconds)
        for name, df in self.frames.items():
            out.register(name, df)
        return out

    # snapshots and transactions

    @contextlib.contextmanager
    def snapshot(self, version: int | None = None) -> Iterator[Session]:
        """Queries inside see one version, whatever is committed meanwhile."""
        before, self.at_version = self.at_version, self.store.state(version)["version"]
        try:
            yield self
        finally:
            self.at_version = before

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Session]:
        self.execute("BEGIN")
        try:
            yield self
        except BaseException:
            if self.work:
                self.execute("ROLLBACK")
            raise
        self.execute("COMMIT")

    def execute(self, text: str, params: Sequence[object] = ()) -> Result:
        """Runs any statement: changes are one commit, or part of the open transaction."""
        tree, written = parse(text)
        self.check_params(written, params)
        if tree.kind == "query":
            return Result(0, self.sql(text, params))
        if not self.store:
            raise SqlError("This session has no tables of its own: give it a root")
        if tree.kind == "begin":
            if self.work:
                raise SqlError("A transaction is open")
            self.work = Work(self.store)
            self._watch(self.work)
            return Result(0)
        self._touch()
        if tree.kind in ("commit", "rollback"):
            work, self.work = self.work, None
            if not work:
                raise SqlError("No transaction is open")
            if tree.kind == "rollback" or work.failed:
                work.rollback()
                if tree.kind == "commit":
                    raise SqlError("The transaction failed before: it was rolled back")
                return Result(0)
            return Result(work.commit())
        own = self.work is None
        if not own and tree.kind not in ("insert", "update", "delete", "merge"):
            raise SqlError("Tables can't be created, altered or dropped in a transaction")
        return self._in_work(lambda w: getattr(self, f"do_{tree.kind}")(tree, w, params))

    def _touch(self) -> None:
        """A statement of the open transaction begins: it isn't idle. One that was for too long has been rolled back."""
        if self.work:
            with self._idle:
                if self.work.expired:
                    self.work = None
                    raise SqlError(f"The transaction was idle for {self.idle_seconds} seconds: it was rolled back")
                self.work.used = time.monotonic()

    def _watch(self, work: Work) -> None:
        """Rolls work back once no statement has used it for idle_seconds."""

        def look() -> None:
            with self._idle:
                if self.work is not work or work.expired:
                    return
                left = self.idle_seconds - (time.monotonic() - work.used)
                if left <= 0 and not work.busy:
                    work.expired = True
                    work.rollback()
                    return
            again(max(left, 0.05))

        def again(seconds: float) -> None:
            t = threading.Timer(seconds, look)
            t.daemon = True
            t.start()

        again(self.idle_seconds)

    def write(self, body: Callable[[Session], A]) -> A:
        """Runs body in a transaction; if another writer changed the same tables meanwhile, again on top of that."""
        for left in range(RETRIES, -1, -1):
            try:
                with self.transaction():
                    return body(self)
            except ConflictError:
                if not left:
                    raise
        raise AssertionError

    # expressions over one table's rows

    def expression(self, e: Node, sources: list[Source], params: Sequence[object] = (), strip: str | None = None) -> Column:
        text = self.lower(params).x(e, Scope(sources))[0]
        return F.expr(text.replace(ident(strip) + ".", "") if strip else text)

    def columns_of(self, t: dict) -> Columns:
        return [(c["name"], c["type"]) for c in t["columns"]]

    def check(self, t: dict, text: str) -> str:
        return self.lower().x(parse_expression(text), Scope([Source(SELF, self.columns_of(t))]))[0].replace(ident(SELF) + ".", "")

    def default(self, c: dict) -> Column:
        if c["default"] in (None, "autoincrement"):
            return F.lit(None)
        return F.expr(self.lower().x(parse_expression(c["default"]), Scope([]))[0])

    @staticmethod
    def projected(rows: DataFrame, names: list[str] | None) -> DataFrame | None:
        return None if names is None else rows if names == ["*"] else rows.select(*(F.col(f"`{n}`") for n in names))

    # changes

    def insert_frame(self, name: str, df: DataFrame) -> Result:
        """Batch insert of a DataFrame (of this session, or of the caller's)."""
        return self._in_work(lambda w: Result(self._insert(w, name, self._own(df)).count()))

    def append_batch(self, name: str, batch: DataFrame, stream: str, number: int) -> bool:
        """Inserts a numbered batch of a stream, unless that one or a later one is there: whether it wasn't."""

        def run(w: Work) -> bool:
            seen = w.table(name).setdefault("streams", {})
            if seen.get(stream, -1) >= number:
                return False
            self._insert(w, name, self._own(batch))
            seen[stream] = number
            return True

        return self._in_work(run)

    def insert_rows(self, name: str, rows: Sequence[dict] | dict[str, Sequence]) -> Result:
        return self.insert_frame(name, self._frame(name, rows))

    def upsert_rows(self, name: str, rows: Sequence[dict] | dict[str, Sequence]) -> Result:
        def run(w: Work) -> Result:
            df = w.complete(name, self._frame(name, rows), self.default)
            added, old, new = w.upsert(name, df, df.columns, self.check)
            self.fire(w, name, "insert", None, added)
            self.fire(w, name, "update", old, new)
            return Result(added.count() + new.count())

        return self._in_work(run)

    def update_rows(self, name: str, rows: Sequence[dict] | dict[str, Sequence]) -> Result:
        """Replaces the columns given, of rows with the keys given. Rows may give different columns; it is one commit."""
        key = Work.keyed(self.state()["tables"][name], name, "UPDATE")
        alike: dict[tuple[str, ...], list[dict]] = {}
        for r in self._listed(rows):
            alike.setdefault(tuple(sorted(r)), []).append(r)

        def run(w: Work) -> Result:
            n = 0
            for group in alike.values():
                df = self._frame(name, group)
                sets = [c for c in df.columns if c != key]
                there = w.frame(name)
                new = there.join(df.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_n_{c}") for c in sets)), F.col(f"`{key}`") == F.col("_k")).select(*(F.col(f"_n_{c}").alias(c) if c in sets else F.col(f"`{c}`") for c in there.columns))
                _, old, changed = w.upsert(name, new, sets, self.check)
                self.fire(w, name, "update", old, changed)
                n += changed.count()
            return Result(n)

        return self._in_work(run)

    def delete_keys(self, name: str, keys: Sequence[object]) -> Result:
        key = Work.keyed(self.state()["tables"][name], name, "DELETE")
        values = [float(k) if isinstance(k, int) and not isinstance(k, bool) else k for k in keys]
        return self._in_work(lambda w: self._delete(w, name, F.col(f"`{key}`").isin(list(keys)), Bounds(values=values)))

    @staticmethod
    def _listed(rows: Sequence[dict] | dict[str, Sequence]) -> Sequence[dict]:
        return [dict(zip(rows, values, strict=True)) for values in zip(*rows.values(), strict=True)] if isinstance(rows, dict) else rows

    def _frame(self, name: str, rows: Sequence[dict] | dict[str, Sequence]) -> DataFrame:
        t, rows = self.state()["tables"][name], self._listed(rows)
        names = list(dict.fromkeys(k for r in rows for k in r))
        kinds = {c["name"]: c["type"] for c in t["columns"]}
        if unknown := [n for n in names if n not in kinds]:
            raise SqlError(f"{name} has no column {unknown[0]}")
        # a row that lacks a column which others have takes its default, too
        lacking = [c for c in t["columns"] if c["name"] in names and c["default"] not in (None, "autoincrement") and any(c["name"] not in r for r in rows)]
        if lacking:
            given = self.spark.range(1).select(*(self.default(c).cast(SPARK_TYPES[c["type"]]).alias(c["name"]) for c in lacking)).first().asDict()
            rows = [given | r for r in rows]
        schema = T.StructType([T.StructField(n, SPARK_TYPES[kinds[n]]) for n in names])
        return self.spark.createDataFrame([tuple(float(v) if isinstance(v := r.get(n), int) and not isinstance(v, bool) else v for n in names) for r in rows], schema)

    def _in_work(self, f: Callable[[Work], A]) -> A:
        """f as part of the open transaction, or as a commit of its own: if another writer changed the same tables meanwhile, f
        runs again on top of that."""
        self._touch()
        if self.work:
            if self.work.failed:
                raise SqlError("The transaction failed before: roll it back")
            try:
                self.work.busy = True
                return f(self.work)
            except BaseException:
                self.work.failed = True
                raise
            finally:
                self.work.used, self.work.busy = time.monotonic(), False
        for left in range(RETRIES, -1, -1):
            self.work = work = Work(self.store)
            try:
                out = f(work)
                work.commit()
                return out
            except ConflictError:
                if not left:
                    raise
            except BaseException:
                work.rollback()
                raise
            finally:
                self.work = None
        raise AssertionError

    def _insert(self, w: Work, name: str, df: DataFrame) -> DataFrame:
        new = w.insert(name, w.complete(name, df, self.default), self.check)
        self.fire(w, name, "insert", None, new)
        return new

    def _delete(self, w: Work, name: str, where: Column, bounds: Bounds | None = None) -> Result:
        gone, n = w.delete(name, where, self.check, bounds)
        if n:
            self.fire(w, name, "delete", gone, None)
        return Result(n, gone)

    def with_ctes(self, tree: Node, q: Node) -> Node:
        return q.copy(ctes=[*tree.ctes, *q.ctes]) if tree.ctes else q

    def do_insert(self, tree: Node, w: Work, params) -> Result:
        t = w.table(tree.table)
        if tree.query is not None:
            sql, columns = self.lower(params).query(self.with_ctes(tree, tree.query))
            df = self.spark.sql(sql).toDF(*tree.columns)
        else:
            body = Node("query", None, ctes=tree.ctes, recursive=False, body=Node("values", None, rows=tree.rows), order=[], limit=None, offset=None, ties=False)
            sql, columns = self.lower(params).query(body)
            df = self.spark.sql(sql).toDF(*tree.columns)
        kinds = dict(self.columns_of(t))
        for n, (_, kind) in zip(tree.columns, columns, strict=True):
            if n in kinds and kind and kind != kinds[n]:
                raise SqlError(f"{n} is a {kinds[n]}, not a {kind}", tree.at)
        if tree.conflict is None:
            new = self._insert(w, tree.table, df)
            return Result(new.count(), self.projected(new, tree.returning))
        key = w.keyed(t, tree.table, "ON CONFLICT")
        if tree.conflict.key != [key]:
            raise SqlError(f"ON CONFLICT names the key {key}", tree.at)
        columns = tree.conflict.columns if tree.conflict.kind == "replace" else None
        if columns and key in columns:
            raise SqlError("ON CONFLICT can't set the key", tree.at)
        added, old, new = w.upsert(tree.table, w.complete(tree.table, df, self.default), columns, self.check)
        self.fire(w, tree.table, "insert", None, added)
        self.fire(w, tree.table, "update", old, new)
        both = added.unionByName(new)
        return Result(both.count(), self.projected(both, tree.returning))

    def do_update(self, tree: Node, w: Work, params) -> Result:
        t = w.table(tree.table)
        key = w.keyed(t, tree.table, "UPDATE")
        names = w.names(t)
        for c, _ in tree.sets:
            if c not in names:
                raise SqlError(f"{tree.table} has no column {c}", tree.at)
        if any(n.kind in QUERIES for n in walk([tree.where, *(e for _, e in tree.sets)] if tree.where is not None else [e for _, e in tree.sets])) or tree.ctes:
            if key in dict(tree.sets):
                raise SqlError("A key can't be set together with a subquery", tree.at)
            sets = dict(tree.sets)
            items = [Node("item", None, expr=sets.get(c, Node("column_ref", None, path=[c])), alias=c) for c in names]
            rows = self.spark.sql(self.lower(params).query(self.rows_where(tree, items))[0])
            _, old, new = w.upsert(tree.table, rows, list(sets), self.check)
            n = new.count()
        else:
            source = [Source(SELF, self.columns_of(t)), Source(tree.table, self.columns_of(t))][:1]
            sets = {c: self.expression(self.own(e, tree.table), source, params, SELF) for c, e in tree.sets}
            where = self.expression(self.own(tree.where, tree.table), source, params, SELF) if tree.where is not None else F.lit(True)
            old, new, n = w.update(tree.table, where, sets, self.check, self.asked(tree, key, params))
        self.fire(w, tree.table, "update", old, new)
        return Result(n, self.projected(new, tree.returning))

    @staticmethod
    def own(e: Node, table: str) -> Node:
        """Columns that name the table itself, without its name."""
        return mapped(e, lambda n: n.copy(path=n.path[1:]) if n.kind == "column_ref" and len(n.path) == 2 and n.path[0] == table else None)

    def asked(self, tree: Node, key: str, params: Sequence[object]) -> Bounds | None:
        return Asked(tree.where, tree.table, True, self.lower(params).param).bounds(key)

    def rows_where(self, tree: Node, items: list[Node]) -> Node:
        source = Node("table", None, name=tree.table, alias=tree.table, columns=None)
        join = Node("join", None, type="from", source=source, on=None, using=None, natural=False)
        body = Node("select", None, distinct=False, items=items, joins=[join], where=tree.where, group=None, having=None, named={})
        return Node("query", None, ctes=tree.ctes, recursive=False, body=body, order=[], limit=None, offset=None, ties=False)

    def do_delete(self, tree: Node, w: Work, params) -> Result:
        t = w.table(tree.table)
        key = w.keyed(t, tree.table, "DELETE")
        if tree.where is not None and any(n.kind in QUERIES for n in walk(tree.where)) or tree.ctes:
            items = [Node("item", None, expr=Node("column_ref", None, path=[key]), alias=key)]
            keys = self.spark.sql(self.lower(params).query(self.rows_where(tree, items))[0])
            out = self._delete_rows(w, tree.table, keys)
        else:
            where = self.expression(self.own(tree.where, tree.table), [Source(SELF, self.columns_of(t))], params, SELF) if tree.where is not None else F.lit(True)
            out = self._delete(w, tree.table, where, self.asked(tree, key, params))
        return Result(out.count, self.projected(out.rows, tree.returning))

    def _delete_rows(self, w: Work, name: str, keys: DataFrame) -> Result:
        """Deletes the rows with a key in keys(key): they are written first, then found file by file."""
        t = w.table(name)
        key = t["key"]
        k = keys.toDF("_k").distinct()
        inside, touched, kept = w.touched(t, w.store.with_file(t).join(k, F.col(f"`{key}`") == F.col("_k"), "left_semi"))
        gone = inside.join(k, F.col(f"`{key}`") == F.col("_k"), "left_semi")
        n = gone.count() if touched else 0
        if n:
            files = w.write(inside.join(k, F.col(f"`{key}`") == F.col("_k"), "left_anti"), name)
            w.put(name, kept + files)
            w.references_to(name, gone, self.check)
            self.fire(w, name, "delete", gone, None)
        return Result(n, gone)

    def do_merge(self, tree: Node, w: Work, params) -> Result:
        t = w.table(tree.table)
        key = w.keyed(t, tree.table, "MERGE")
        lower = self.lower(params)
        text, source, _ = lower.source(tree.source, None)
        df = self.spark.sql(f"SELECT * FROM {text}").toDF(*(c for c, _ in source.columns))
        sources = [Source(tree.alias, self.columns_of(t)), source]

        def side(e: Node) -> bool | None:
            return e.kind == "column_ref" and (e.path == [tree.alias, key] or e.path == [key] and not any(c == key for c, _ in source.columns))

        on = tree.on
        if not (on.kind == "compare" and on.op == "=" and side(on.left) != side(on.right)):
            raise SqlError("MERGE's ON must equate the unique key", tree.at)
        other = on.right if side(on.left) else on.left
        branches = []
        for b in tree.branches:
            out = {"matched": b.matched, "action": b.action, "cond": None if b.cond is None else self.expression(b.cond, sources if b.matched else sources[1:], params)}
            if b.action == "update":
                out["sets"] = {c: self.expression(e, sources, params) for c, e in b.sets}
                if key in out["sets"]:
                    raise SqlError("MERGE can't set the key", tree.at)
            if b.action == "insert":
                out["values"] = {c: self.expression(e, sources[1:], params) for c, e in zip(b.columns, b.values, strict=True)}
            branches.append(out)
        done = w.merge(tree.table, df, tree.alias, source.alias, self.expression(on, sources, params), self.expression(other, sources[1:], params), branches, self.default, self.check)
        self.fire(w, tree.table, "insert", None, done["inserted"])
        self.fire(w, tree.table, "delete", done["deleted"], None)
        self.fire(w, tree.table, "update", done["old"], done["updated"])
        return Result(done["count"])

    # triggers: each statement is one operation over all rows

    def fire(self, w: Work, table: str, event: str, old: DataFrame | None, new: DataFrame | None) -> None:
        if w.in_trigger:
            return
        mine = [g for g in w.state["triggers"].values() if g["table"] == table and g["event"] == event]
        if not mine:
            return
        t = w.table(table)
        rows = old.alias("old") if new is None else new.alias("new")
        sources = [Source("old" if new is None else "new", self.columns_of(t))]
        if event == "update" and old is not None:
            rows = old.alias("old").join(new.alias("new"), F.expr(f"`old`.{ident(t['key'])} = `new`.{ident(t['key'])}"))
            sources.append(Source("old", self.columns_of(t)))
        w.in_trigger = True
        try:
            for g in sorted(mine, key=lambda g: g["timing"] != "before"):
                for text in g["body"]:
                    self.trigger_statement(w, parse(text)[0], rows, sources)
        finally:
            w.in_trigger = False

    def trigger_statement(self, w: Work, s: Node, rows: DataFrame, sources: list[Source]) -> None:
        s = mapped(s, lambda n: n.copy(path=[n.path[0].lower(), *n.path[1:]]) if n.kind == "column_ref" and len(n.path) == 2 and n.path[0].lower() in ("new", "old") else None)
        if s.kind == "insert":
            for values in s.rows:
                df = rows.select(*(self.expression(e, sources).alias(c) for c, e in zip(s.columns, values, strict=True)))
                self._insert(w, s.table, df)
            return
        t = w.table(s.table)
        key = w.keyed(t, s.table, s.kind.upper())
        target = [Source(s.table, self.columns_of(t)), *sources]
        where = self.expression(s.where, target) if s.where is not None else F.lit(True)
        hit = w.frame(s.table).alias(s.table).join(rows, where)
        if s.kind == "delete":
            self._delete_rows(w, s.table, hit.select(F.expr(f"{ident(s.table)}.{ident(key)}")))
            return
        sets = {c: self.expression(e, target) for c, e in s.sets}
        changed = hit.select(*(sets[c].cast(SPARK_TYPES[kind]).alias(c) if c in sets else F.expr(f"{ident(s.table)}.{ident(c)}").alias(c) for c, kind in self.columns_of(t)))
        if changed.groupBy(F.col(ident(key))).count().where("count > 1").isEmpty():
            w.upsert(s.table, changed, list(sets), self.check)
            return
        # several rows change one: they add up, so one after another, a few at a time on the driver
        for r in rows.toLocalIterator():
            one = self.spark.createDataFrame([r], rows.schema)
            parts, at = None, 0
            for src in reversed(sources) if len(sources) == 2 else sources:
                k = len(src.columns)
                piece = one.select(*(F.lit(r[at + i]).cast(rows.schema[at + i].dataType).alias(c) for i, (c, _) in enumerate(src.columns))).alias(src.alias)
                parts, at = (piece if parts is None else parts.crossJoin(piece)), at + k
            self.trigger_statement(w, s, parts, sources)

    # definitions

    def do_create_table(self, tree: Node, w: Work, params) -> Result:
        if tree.name in w.state["tables"] or tree.name in w.state["views"]:
            if tree.exists:
                return Result(0)
            raise SqlError(f"{tree.name} exists", tree.at)
        names = [c.name for c in tree.columns]
        if len(set(names)) < len(names):
            raise SqlError("A column is defined twice", tree.at)
        if tree.key is not None and tree.key not in names:
            raise SqlError(f"The key {tree.key} isn't a column", tree.at)
        columns = [{"id": f"c{i}", "name": c.name, "type": c.type, "nullable": c.nullable and c.name != tree.key, "default": c.default} for i, c in enumerate(tree.columns)]
        refs = []
        for r in tree.refs:
            parent = w.state["tables"].get(r.table)
            if parent is None or parent["key"] is None or r.parent not in (None, parent["key"]):
                raise SqlError(f"A FOREIGN KEY refers to the unique key of a table: {r.table}", tree.at)
            refs.append({"column": r.column, "table": r.table, "parent": r.parent, "action": r.action})
        t = {"columns": columns, "key": tree.key, "checks": tree.checks, "refs": refs, "manifest": None, "ids": len(columns)}
        for k in tree.checks:
            self.check(t, k)
        for c in columns:
            self.default(c)
        w.state["tables"][tree.name] = t
        w.changed.add("*")
        return Result(0)

    def do_create_as(self, tree: Node, w: Work, params) -> Result:
        sql, columns = self.lower(params).query(tree.query)
        df = self.spark.sql(sql)
        if any(t is None for _, t in columns) and any(f.dataType == T.NullType() for f in df.schema.fields):
            raise SqlError("Cannot infer a column type", tree.at)
        cols = [{"id": f"c{i}", "name": n, "type": t or logical(df.schema[i].dataType) or "string", "nullable": True, "default": None} for i, (n, t) in enumerate(columns)]
        if tree.name in w.state["tables"]:
            if tree.exists:
                return Result(0)
            raise SqlError(f"{tree.name} exists", tree.at)
        w.state["tables"][tree.name] = {"columns": cols, "key": None, "checks": [], "refs": [], "manifest": None, "ids": len(cols)}
        w.changed.add("*")
        return Result(w.insert(tree.name, df, self.check).count())

    def do_create_view(self, tree: Node, w: Work, params) -> Result:
        if tree.name in w.state["tables"] or tree.name in w.state["views"] and not tree.replace:
            raise SqlError(f"{tree.name} exists", tree.at)
        self.lower().query(parse(tree.text)[0])
        w.state["views"][tree.name] = tree.text
        w.changed.add("*")
        return Result(0)

    def do_create_trigger(self, tree: Node, w: Work, params) -> Result:
        if tree.name in w.state["triggers"]:
            raise SqlError(f"{tree.name} exists", tree.at)
        w.table(tree.table)
        w.state["triggers"][tree.name] = {"table": tree.table, "event": tree.event, "timing": tree.timing, "body": tree.body}
        w.changed.add("*")
        return Result(0)

    def do_alter_add(self, tree: Node, w: Work, params) -> Result:
        t, c = w.table(tree.table), tree.column
        if c.name in w.names(t):
            raise SqlError(f"{tree.table} has a column {c.name}", tree.at)
        if not c.nullable and c.default is None and t["manifest"]:
            raise SqlError("A NOT NULL column that is added needs a DEFAULT", tree.at)
        column = {"id": f"c{t['ids']}", "name": c.name, "type": c.type, "nullable": c.nullable, "default": c.default, "backfill": None}
        if c.default is not None:
            column["backfill"] = self.lower().x(parse_expression(c.default), Scope([]))[0]
        t["ids"] += 1
        t["columns"].append(column)
        w.changed.add("*")
        return Result(0)

    def _drop(self, kind: str, tree: Node, w: Work) -> Result:
        if tree.name not in w.state[kind]:
            if tree.exists:
                return Result(0)
            raise SqlError(f"Unknown {kind[:-1]} {tree.name}", tree.at)
        if kind != "triggers":
            users = [g for g, x in w.state["triggers"].items() if x["table"] == tree.name] + [v for v, text in w.state["views"].items() if v != tree.name and any(n.kind == "table" and n.name == tree.name for n in walk(parse(text)[0]))]
            users += [c for c, x in w.state["tables"].items() if c != tree.name and any(r["table"] == tree.name for r in x["refs"])]
            if users:
                raise SqlError(f"{users[0]} depends on {tree.name}", tree.at)
        del w.state[kind][tree.name]
        w.changed.add("*")
        return Result(0)

    def do_drop_table(self, tree: Node, w: Work, params) -> Result:
        return self._drop("tables", tree, w)

    def do_drop_view(self, tree: Node, w: Work, params) -> Result:
        return self._drop("views", tree, w)

    def do_drop_trigger(self, tree: Node, w: Work, params) -> Result:
        return self._drop("triggers", tree, w)

    # introspection

    def tables(self) -> dict[str, list[dict]]:
        return {n: t["columns"] for n, t in self.state()["tables"].items()}
