"""Full-text search over texts that Python makes the tokens of: results, and what a worker holds."""

import json
import math
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colsql import functions
from colsql.functions.text import tokens, tokens_udf
from colsql.operators import fulltext
from colsql.session import Session

TEXTS = (None, "", " ", "—", "the", "The cat — über älter", "ﬁne ＴＨＥ x", "東京タワーへ行く the", "é thé theà", "ÜBER über the über " * 40, "x" * 40 + "é the", "the é a " * 3000, "no hit é", "der Überbau the")


@pytest.fixture(scope="module")
def texts(spark):
    s = Session(spark)
    s.register("a", spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string"))
    s.register("b", spark.createDataFrame([("the Übermut", None), (None, None), ("the uber", "é")], "source string, row string"))
    return s


def ranked(tables, query_terms, k1=1.2, b=0.75):
    """The best rows of several tables by plain loops: (source, score, first cell)."""
    out = []
    for name, rows in tables.items():
        docs = [[t for c in r if c is not None for t in tokens(str(c))] for r in rows]
        hits = [[sum(t.startswith(w) if p else t == w for t in d) for w, p in query_terms] for d in docs]
        mean = sum(map(len, docs)) / len(docs)
        for r, d, tf in zip(rows, docs, hits, strict=True):
            if all(tf):
                df = [sum(h[i] > 0 for h in hits) for i in range(len(tf))]
                out.append((name, sum(math.log(1 + (len(docs) - k + 0.5) / (k + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(d) / mean)) for f, k in zip(tf, df, strict=True)), r[0]))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def test_search_against_plain_loops(texts):
    tables = {"a": list(enumerate(TEXTS)), "b": [("the Übermut", None), (None, None), ("the uber", "é")]}
    for query, terms in (("the", [("the", False)]), ("THE üb*", [("the", False), ("üb", True)]), ("東京 the", [("東京", False), ("the", False)])):
        found = [(x.source, x.score, next(iter(json.loads(x.row).values()))) for x in texts.search(query, ["a", "b"], 50).collect()]
        wanted = ranked(tables, terms)
        assert len(found) == len(wanted) > 0
        assert sorted((s, k) for s, _, k in found) == sorted((s, k) for s, _, k in wanted)
        assert all(abs(x[1] - y[1]) < 1e-9 for x, y in zip(found, wanted, strict=True))
    assert texts.search("", ["a", "b"]).collect() == [] == texts.search("— é nothere", ["a", "b"]).collect()


def test_search_is_match_and_bm25(texts):
    for query in ("the", "THE üb*", "x*"):
        apart = texts.sql(f"SELECT id, BM25(*) AGAINST '{query}' AS score FROM a WHERE MATCH(*) AGAINST '{query}' ORDER BY id").collect()
        once = sorted((json.loads(x.row)["id"], x.score) for x in texts.search(query, ["a"], 50).collect())
        assert once == [(x.id, x.score) for x in apart] and once


def test_tokens_of_odd_texts(texts):
    got = texts.table("a").orderBy("id").select(F.expr(fulltext.tokens_sql("text")).alias("d")).collect()
    assert [x.d for x in got] == [None if t is None else tokens(t) for t in TEXTS]


def test_a_search_makes_tokens_of_a_table_once(texts):
    plan = texts.search("the üb*", ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_a_worker_holds_tokens_of_one_text_only():
    batch = pd.Series([" ".join(f"wörd{i * j % 997}" for j in range(400)) for i in range(500)])
    size = int(batch.str.len().sum())
    tracemalloc.start()
    out = tokens_udf(batch)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x.split() for x in out[:3]] == [tokens(x) for x in batch[:3]]
    assert most < 3 * size


def test_batches_of_long_texts_are_bounded(spark):
    s = Session(spark)
    s.spark.udf.register("batch_size", F.pandas_udf(lambda x: pd.Series([int(x.str.len().sum())] * len(x)), "long"))
    s.register("long", spark.range(0, 48, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text")))
    most = s.spark.sql("SELECT MAX(batch_size(text)) AS n FROM long").first().n
    assert most <= functions.BATCH_BYTES + (1 << 20)
