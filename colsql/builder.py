"""A query builder: queries and changes put together from Python values. What it compiles to is text with parameters, parsed like any
other, so a built query and a written one have the same tree."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row

from .plans.ast import Node
from .plans.parser import parse
from .session import Result, Session


def name(path: str) -> str:
    """A column or table, quoted: parts between dots, * as it is."""
    return ".".join(p if p == "*" else '"' + p.replace('"', '""') + '"' for p in path.split("."))


class Expr:
    """A piece of SQL with the parameters in it, in order."""

    def __init__(self, text: str, params: Iterable[object] = (), alias: str | None = None) -> None:
        self.text, self.params, self.alias = text, list(params), alias

    def as_(self, alias: str) -> Expr:
        return Expr(self.text, self.params, alias)

    def item(self) -> str:
        return self.text + (f" AS {name(self.alias)}" if self.alias else "")

    def __eq__(self, other: object) -> Expr:  # type: ignore[override]
        return self.is_null() if other is None else both("=", self, other)

    def __ne__(self, other: object) -> Expr:  # type: ignore[override]
        return self.is_not_null() if other is None else both("<>", self, other)

    __hash__ = None  # type: ignore[assignment]

    def __lt__(self, other: object) -> Expr:
        return both("<", self, other)

    def __le__(self, other: object) -> Expr:
        return both("<=", self, other)

    def __gt__(self, other: object) -> Expr:
        return both(">", self, other)

    def __ge__(self, other: object) -> Expr:
        return both(">=", self, other)

    def __add__(self, other: object) -> Expr:
        return both("+", self, other)

    def __sub__(self, other: object) -> Expr:
        return both("-", self, other)

    def __mul__(self, other: object) -> Expr:
        return both("*", self, other)

    def __truediv__(self, other: object) -> Expr:
        return both("/", self, other)

    def __mod__(self, other: object) -> Expr:
        return both("%", self, other)

    def __neg__(self) -> Expr:
        return Expr(f"(- {self.text})", self.params)

    def concat(self, other: object) -> Expr:
        return both("||", self, other)

    def __and__(self, other: Expr) -> Expr:
        return both("AND", self, other)

    def __or__(self, other: Expr) -> Expr:
        return both("OR", self, other)

    def __invert__(self) -> Expr:
        return Expr(f"(NOT {self.text})", self.params)

    def like(self, pattern: object) -> Expr:
        return both("LIKE", self, pattern)

    def ilike(self, pattern: object) -> Expr:
        return both("ILIKE", self, pattern)

    def in_(self, values: Sequence[object] | Select) -> Expr:
        if isinstance(values, Select):
            inner = values.compile()
            return Expr(f"({self.text} IN ({inner.text}))", [*self.params, *inner.params])
        items = [value(v) for v in values]
        return Expr(f"({self.text} IN ({', '.join(i.text for i in items)}))", [*self.params, *(p for i in items for p in i.params)])

    def between(self, low: object, high: object) -> Expr:
        a, b = value(low), value(high)
        return Expr(f"({self.text} BETWEEN {a.text} AND {b.text})", [*self.params, *a.params, *b.params])

    def is_null(self) -> Expr:
        return Expr(f"({self.text} IS NULL)", self.params)

    def is_not_null(self) -> Expr:
        return Expr(f"({self.text} IS NOT NULL)", self.params)

    def is_distinct_from(self, other: object) -> Expr:
        return both("IS DISTINCT FROM", self, other)

    def over(self, partition_by: Sequence[str | Expr] = (), order_by: Sequence[str | Expr | tuple] = ()) -> Expr:
        parts, orders = [ref(p) for p in partition_by], [ordering(o) for o in order_by]
        inside = " ".join((["PARTITION BY " + ", ".join(p.text for p in parts)] if parts else []) + (["ORDER BY " + ", ".join(o.text for o in orders)] if orders else []))
        return Expr(f"{self.text} OVER ({inside})", [*self.params, *(p for e in [*parts, *orders] for p in e.params)])


def ref(path: str | Expr) -> Expr:
    return path if isinstance(path, Expr) else Expr(name(path))


def value(v: object) -> Expr:
    """A parameter; an expression or a subquery is taken as it is."""
    if isinstance(v, Expr):
        return v
    if isinstance(v, Select):
        inner = v.compile()
        return Expr(f"({inner.text})", inner.params)
    return Expr("?", [v])


def both(op: str, a: object, b: object) -> Expr:
    x, y = value(a), value(b)
    return Expr(f"({x.text} {op} {y.text})", [*x.params, *y.params])


def ordering(o: str | Expr | tuple) -> Expr:
    """A column or expression, or one with "asc" or "desc", and "first" or "last" for nulls."""
    e, *how = o if isinstance(o, tuple) else (o,)
    words = [h.upper() if h.lower() in ("asc", "desc") else f"NULLS {h.upper()}" for h in how]
    return Expr(" ".join([ref(e).text, *words]), ref(e).params)


def exists(query: Select) -> Expr:
    inner = query.compile()
    return Expr(f"EXISTS ({inner.text})", inner.params)


def match(columns: Sequence[str], query: str) -> Expr:
    return Expr(f"MATCH({', '.join(name(c) for c in columns) or '*'}) AGAINST ?", [query])


def bm25(columns: Sequence[str], query: str) -> Expr:
    return Expr(f"BM25({', '.join(name(c) for c in columns) or '*'}) AGAINST ?", [query])


def case(*branches: tuple[Expr, object], otherwise: object = None) -> Expr:
    parts = [(c, value(v)) for c, v in branches]
    last = value(otherwise) if otherwise is not None else Expr("NULL")
    text = " ".join(f"WHEN {c.text} THEN {v.text}" for c, v in parts)
    return Expr(f"(CASE {text} ELSE {last.text} END)", [p for c, v in parts for p in [*c.params, *v.params]] + last.params)


class _Functions:
    """fn.name(arguments): any function of the dialect; strings are columns, other values parameters; count_all() is COUNT(*)."""

    @staticmethod
    def count_all() -> Expr:
        return Expr("COUNT(*)")

    def __getattr__(self, function: str) -> Callable[..., Expr]:
        def call(*args: object) -> Expr:
            items = [ref(a) if isinstance(a, str) else value(a) for a in args]
            return Expr(f"{function.upper()}({', '.join(i.text for i in items)})", [p for i in items for p in i.params])

        return call


fn = _Functions()


@dataclass
class Compiled:
    text: str
    params: list[object]

    def tree(self) -> Node:
        return parse(self.text)[0]


class _Built:
    def __init__(self, session: Session) -> None:
        self.session = session

    def compile(self) -> Compiled:
        raise NotImplementedError

    def to_sql(self) -> str:
        return self.compile().text


def _joined(parts: Iterable[Expr], between: str = ", ") -> Expr:
    listed = list(parts)
    return Expr(between.join(p.text for p in listed), [x for p in listed for x in p.params])


def _source(table: str | Select, alias: str | None) -> Expr:
    inner = value(table) if isinstance(table, Select) else Expr(name(table))
    return Expr(inner.text + (f" AS {name(alias)}" if alias else ""), inner.params)


class Select(_Built):
    """A query; each call gives another one, and leaves this as it is."""

    def __init__(self, session: Session, source: Expr, ctes: Sequence[Expr] = ()) -> None:
        super().__init__(session)
        self.parts: dict[str, Any] = {"ctes": list(ctes), "from": [source], "where": [], "group": [], "having": [], "order": [], "items": [], "distinct": False, "limit": None, "offset": None, "sets": []}

    def _with(self, **parts: Any) -> Select:
        out = Select(self.session, self.parts["from"][0])
        out.parts = {**self.parts, **parts}
        return out

    def _more(self, part: str, *values: object) -> Select:
        return self._with(**{part: [*self.parts[part], *values]})

    def select(self, *items: str | Expr) -> Select:
        exprs = [i if isinstance(i, Expr) else ref(i) for i in items]
        return self._more("items", *(Expr(i.item(), i.params) for i in exprs))

    def select_all(self) -> Select:
        return self._more("items", Expr("*"))

    def distinct(self) -> Select:
        return self._with(distinct=True)

    def join(self, table: str | Select, on: Expr | None, alias: str | None = None, kind: str = "INNER") -> Select:
        s = _source(table, alias)
        text = f"{kind} JOIN {s.text}" + (f" ON {on.text}" if on is not None else "")
        return self._more("from", Expr(text, [*s.params, *(on.params if on is not None else [])]))

    def left_join(self, table: str | Select, on: Expr, alias: str | None = None) -> Select:
        return self.join(table, on, alias, "LEFT")

    def where(self, *conditions: Expr) -> Select:
        return self._more("where", *conditions)

    def search(self, columns: Sequence[str], query: str) -> Select:
        return self.where(match(columns, query))

    def group_by(self, *items: str | Expr) -> Select:
        return self._more("group", *(ref(i) for i in items))

    def having(self, *conditions: Expr) -> Select:
        return self._more("having", *conditions)

    def order_by(self, *orders: str | Expr | tuple) -> Select:
        return self._more("order", *(ordering(o) for o in orders))

    def limit(self, n: int) -> Select:
        return self._with(limit=n)

    def offset(self, n: int) -> Select:
        return self._with(offset=n)

    def _set(self, op: str, other: Select) -> Select:
        inner = other.compile()
        return self._more("sets", Expr(f"{op} {inner.text}", inner.params))

    def union(self, other: Select) -> Select:
        return self._set("UNION", other)

    def union_all(self, other: Select) -> Select:
        return self._set("UNION ALL", other)

    def intersect(self, other: Select) -> Select:
        return self._set("INTERSECT", other)

    def except_(self, other: Select) -> Select:
        return self._set("EXCEPT", other)

    def compile(self) -> Compiled:
        p = self.parts
        out = [_joined(p["ctes"])] if p["ctes"] else []
        if out:
            out[0].text = "WITH " + out[0].text
        items = _joined(p["items"] or [Expr("*")])
        out += [Expr("SELECT " + "DISTINCT " * p["distinct"] + items.text, items.params), Expr("FROM"), _joined(p["from"], " ")]
        for word, part, between in (("WHERE", "where", " AND "), ("GROUP BY", "group", ", "), ("HAVING", "having", " AND "), ("", "sets", " "), ("ORDER BY", "order", ", ")):
            if p[part]:
                x = _joined(p[part], between)
                out.append(Expr(f"{word} {x.text}".strip(), x.params))
        out += [Expr(f"{word} ?", [p[part]]) for word, part in (("LIMIT", "limit"), ("OFFSET", "offset")) if p[part] is not None]
        whole = _joined(out, " ")
        return Compiled(whole.text, whole.params)

    def frame(self) -> DataFrame:
        c = self.compile()
        return self.session.sql(c.text, c.params)

    def execute(self) -> list[Row]:
        return self.frame().collect()

    def take_first(self) -> Row | None:
        return self.limit(1).frame().first()

    def take_first_or_raise(self) -> Row:
        if (row := self.take_first()) is None:
            raise LookupError("no row")
        return row

    def live(self, **callbacks: Any):
        from .streaming.live import subscribe

        c = self.compile()
        return subscribe(self.session, c.text, c.params, **callbacks)


class _Change(_Built):
    def __init__(self, session: Session, table: str) -> None:
        super().__init__(session)
        self.table, self.returns = table, ""
        self.conditions: list[Expr] = []

    def where(self, *conditions: Expr):
        self.conditions += conditions
        return self

    def returning(self, *columns: str):
        self.returns = " RETURNING " + ", ".join(name(c) for c in columns)
        return self

    def returning_all(self):
        self.returns = " RETURNING *"
        return self

    def _tail(self) -> Expr:
        x = _joined(self.conditions, " AND ")
        return Expr((f" WHERE {x.text}" if self.conditions else "") + self.returns, x.params)

    def execute(self) -> Result:
        c = self.compile()
        return self.session.execute(c.text, c.params)


class Insert(_Change):
    def __init__(self, session: Session, table: str) -> None:
        super().__init__(session, table)
        self.rows: list[dict[str, object]] = []
        self.query: tuple[list[str], Select] | None = None
        self.conflict = ""

    def values(self, *rows: dict[str, object]) -> Insert:
        self.rows += rows
        return self

    def select(self, columns: Sequence[str], query: Select) -> Insert:
        self.query = list(columns), query
        return self

    def on_conflict(self, key: str, *replaced: str) -> Insert:
        """Of rows whose key is there, the columns to replace; none: they are left out."""
        sets = ", ".join(f"{name(c)} = EXCLUDED.{name(c)}" for c in replaced)
        self.conflict = f" ON CONFLICT ({name(key)}) DO " + (f"UPDATE SET {sets}" if replaced else "NOTHING")
        return self

    def compile(self) -> Compiled:
        if self.query:
            columns, q = self.query[0], self.query[1].compile()
            body, params = q.text, q.params
        else:
            columns = list(dict.fromkeys(c for r in self.rows for c in r))
            each = [_joined(value(r.get(c)) for c in columns) for r in self.rows]
            body, params = "VALUES " + ", ".join(f"({e.text})" for e in each), [p for e in each for p in e.params]
        return Compiled(f"INSERT INTO {name(self.table)} ({', '.join(name(c) for c in columns)}) {body}{self.conflict}{self.returns}", params)


class Update(_Change):
    def set(self, **values: object) -> Update:
        self.sets = {**getattr(self, "sets", {}), **values}
        return self

    def compile(self) -> Compiled:
        sets, tail = [(c, value(v)) for c, v in self.sets.items()], self._tail()
        text = f"UPDATE {name(self.table)} SET {', '.join(f'{name(c)} = {v.text}' for c, v in sets)}{tail.text}"
        return Compiled(text, [*(p for _, v in sets for p in v.params), *tail.params])


class Delete(_Change):
    def compile(self) -> Compiled:
        tail = self._tail()
        return Compiled(f"DELETE FROM {name(self.table)}{tail.text}", tail.params)


class Builder:
    """Where queries and changes of a session begin."""

    def __init__(self, session: Session, ctes: Sequence[Expr] = ()) -> None:
        self.session, self.ctes = session, list(ctes)

    def with_(self, alias: str, query: Select) -> Builder:
        inner = query.compile()
        return Builder(self.session, [*self.ctes, Expr(f"{name(alias)} AS ({inner.text})", inner.params)])

    def select_from(self, table: str | Select, alias: str | None = None) -> Select:
        return Select(self.session, _source(table, alias), self.ctes)

    def insert_into(self, table: str) -> Insert:
        return Insert(self.session, table)

    def update_table(self, table: str) -> Update:
        return Update(self.session, table)

    def delete_from(self, table: str) -> Delete:
        return Delete(self.session, table)

    def search(self, query: str, tables: Sequence[str], limit: int = 10) -> DataFrame:
        return self.session.search(query, tables, limit)

    def transaction(self, body: Callable[[Builder], object]) -> object:
        """body in a transaction, again if another writer was first."""
        return self.session.write(lambda s: body(Builder(s)))

    def sql(self, *parts: object) -> Result:
        """Text and values in turn: texts at even places, each value between them a parameter or an expression."""
        pieces = [Expr(str(p)) if i % 2 == 0 else value(p) for i, p in enumerate(parts)]
        whole = _joined(pieces, "")
        return self.session.execute(whole.text, whole.params)
