"""Full-text search: MATCH, BM25 and search over several tables, as SQL expressions and DataFrame operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import LONGEST, MOST, query_terms

K1, B = 1.2, 0.75


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens_sql(cell: str) -> str:
    """Tokens of a string expression. Plain ASCII takes Spark's own functions; only other texts reach the Python function."""
    plain = f"({cell} rlike '^[\\\\x00-\\\\x7F]*$')"
    native = f"transform(slice(regexp_extract_all(lower({cell}), '[a-z0-9]+', 0), 1, {MOST}), t -> left(t, {LONGEST}))"
    return f"coalesce(CASE WHEN {plain} THEN {native} END, array_remove(split(colsql_tokens(CASE WHEN NOT {plain} THEN {cell} END), ' '), ''))"


def document_sql(cells: Sequence[str]) -> str:
    """Tokens of all cells, one cell after the other; none of nulls."""
    return "flatten(array_compact(array(" + ", ".join(tokens_sql(c) for c in cells) + ")))"


def _hits(term: tuple[str, bool], token: str) -> str:
    return f"startswith({token}, {quote(term[0])})" if term[1] else f"{token} = {quote(term[0])}"


def _every(terms: Sequence[tuple[str, bool]]) -> str:
    """Whether the tokens d have every term; false without terms."""
    return " AND ".join(f"exists(d, t -> {_hits(x, 't')})" for x in terms) or "FALSE"


def match_sql(cells: Sequence[str], query: str) -> str:
    """Whether every term is in one of the cells; null if all cells are; false for a query without terms."""
    terms = query_terms(query)
    empty = " AND ".join(f"{c} IS NULL" for c in cells)
    if not terms:
        return f"(CASE WHEN {empty} THEN CAST(NULL AS BOOLEAN) ELSE FALSE END)"
    return f"(CASE WHEN {empty} THEN NULL ELSE transform(array({document_sql(cells)}), d -> {_every(terms)})[0] END)"


def statistics(table: DataFrame, cells: Sequence[str], query: str) -> tuple[int, int, list[int]]:
    """Rows, tokens, and rows that have each term, of the whole table, in one aggregation."""
    terms = query_terms(query)
    rows = table.select(F.expr(document_sql(cells)).alias("d"))
    sums = [F.expr(f"coalesce(sum(CASE WHEN exists(d, t -> {_hits(x, 't')}) THEN 1 ELSE 0 END), 0)") for x in terms]
    n, total, *df = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("d")), F.lit(0)), *sums).first()
    return n, total, list(df)


def bm25_sql(cells: Sequence[str], query: str, stats: tuple[int, int, list[int]]) -> str:
    """The score of a row; 0 without a term in it, null if all cells are."""
    empty = " AND ".join(f"{c} IS NULL" for c in cells)
    return f"(CASE WHEN {empty} THEN NULL ELSE transform(array({document_sql(cells)}), d -> {_score(query_terms(query), stats)})[0] END)"


def _score(terms: Sequence[tuple[str, bool]], stats: tuple[int, int, list[int]]) -> str:
    """The score of the tokens d."""
    n, total, df = stats
    mean = total / n if n and total else 1.0
    part = []
    for x, k in zip(terms, df, strict=True):
        idf = math.log(1 + (n - k + 0.5) / (k + 0.5))
        tf = f"cast(size(filter(d, t -> {_hits(x, 't')})) AS DOUBLE)"
        part.append(f"{idf!r}D * {tf} * {K1 + 1!r}D / ({tf} + {K1!r}D * ({1 - B!r}D + {B!r}D * size(d) / {mean!r}D))")
    return " + ".join(part) or "0D"


def matching_scores_sql(cells: Sequence[str], query: str, stats: tuple[int, int, list[int]]) -> str:
    """An array of the score of a row that matches, or of nothing. MATCH and BM25 as columns of their own would each have their tokens
    made in Python, by workers that live at the same time."""
    terms = query_terms(query)
    return f"transform(filter(array({document_sql(cells)}), d -> {_every(terms)}), d -> {_score(terms, stats)})"


def cell_sql(name: str, kind: str | None) -> str:
    """A column as search reads it: strings as they are, numbers and datetimes as text."""
    if kind == "number":
        return number_text(name)
    if kind == "datetime":
        return f"date_format({name}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
    return name


def number_text(x: str) -> str:
    """A number as text: the shortest digits that give it back, without an exponent from 1e-6 up to below 1e21."""
    whole = f"cast(cast({x} AS DECIMAL(38,0)) AS STRING)"
    plain = f"rtrim('0', cast(cast({x} AS DECIMAL(38,{{}})) AS STRING))"
    short = f"regexp_replace(replace(lower(cast(cast({x} AS DOUBLE) AS STRING)), '.0e', 'e'), 'e(?=[0-9])', 'e+')"
    part = f"CASE WHEN {x} = 0 OR abs({x}) >= 1e-3 AND abs({x}) < 1e7 THEN {short} WHEN abs({x}) >= 1e7 AND abs({x}) < 1e21 THEN {plain.format(9)} WHEN abs({x}) >= 1e-6 AND abs({x}) < 1e-3 THEN {plain.format(24)} ELSE {short} END"
    return f"(CASE WHEN {x} % 1D = 0 AND abs({x}) < 1e21 THEN {whole} ELSE {part} END)"


def match(columns: Sequence[str], query: str) -> Column:
    return F.expr(match_sql([f"`{c}`" for c in columns], query))


def bm25(table: DataFrame, columns: Sequence[str], query: str) -> Column:
    """A column of scores for rows of table, with statistics of the whole table as it is now."""
    cells = [f"`{c}`" for c in columns]
    return F.expr(bm25_sql(cells, query, statistics(table, cells, query)))


def searched_cells(table: DataFrame) -> list[str]:
    """Cells that a search of all columns reads: strings, numbers and datetimes."""

    def kind(t: T.DataType) -> str | None:
        return "number" if isinstance(t, T.NumericType) else "datetime" if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType) else "string" if isinstance(t, T.StringType) else None

    return [cell_sql(f"`{f.name}`", k) for f in table.schema.fields if (k := kind(f.dataType))]


def search(tables: dict[str, DataFrame], query: str, limit: int = 10) -> DataFrame:
    """(source, score, row as JSON): the best rows of several tables, each ranked by its own statistics over all its cells."""
    out = None
    for name, table in tables.items():
        cells = searched_cells(table)
        if not cells:
            continue
        score = F.explode(F.expr(matching_scores_sql(cells, query, statistics(table, cells, query))))
        hits = table.select(F.lit(name).alias("source"), score.alias("score"), F.to_json(F.struct(*table.columns)).alias("row"))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        raise ValueError("no table has a column to search")
    return out.orderBy(F.desc("score"), "source", "row").limit(limit)


def postings(rows: DataFrame, key: str, cells: Sequence[str]) -> DataFrame:
    """An inverted index of rows: (term, file, key, tf, length), with the file that a row is in, as _file."""
    each = rows.select(F.col("_file").alias("file"), F.col(f"`{key}`").alias("key"), F.expr(document_sql(cells)).alias("d")).withColumn("length", F.size("d"))
    return each.select("file", "key", "length", F.explode("d").alias("term")).groupBy("term", "file", "key").agg(F.count("*").cast("int").alias("tf"), F.first("length").alias("length"))


def _term(term: tuple[str, bool]) -> Column:
    return F.col("term").startswith(term[0]) if term[1] else F.col("term") == term[0]


def with_terms(index: DataFrame, query: str) -> DataFrame:
    """(key, terms) of rows of an index(term, key) with any term of a query: a bit for each term that the row has. Filters reach
    the index's files, which are sorted by term."""
    terms = query_terms(query)
    any_ = F.lit(False)
    for x in terms:
        any_ = any_ | _term(x)
    bits = F.lit(0).cast("long")
    for i, x in enumerate(terms):
        bits = bits.bitwiseOR(F.when(_term(x), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return index.where(any_).select("key", bits.alias("terms")).groupBy("key").agg(F.bit_or("terms").alias("terms"))


def having_all(index: DataFrame, query: str) -> DataFrame:
    """(key) of rows with every term of a query."""
    return with_terms(index, query).where(F.col("terms") == (1 << len(query_terms(query))) - 1).select("key")


def rows_having(index: DataFrame, query: str) -> list[int]:
    """The rows that have each term of a query."""
    sums = [F.coalesce(F.sum(F.shiftright("terms", i).bitwiseAND(F.lit(1).cast("long"))), F.lit(0)) for i in range(len(query_terms(query)))]
    return [int(x) for x in with_terms(index, query).agg(*sums).first()] if sums else []
