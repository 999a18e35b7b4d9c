"""The measures against DuckDB, the cascade against all rules at once."""

import duckdb
from pyspark.sql import DataFrame

from colsql.llm import quality
from colsql.llm.oracles import ORACLES

from .conftest import frame


def same_as_sql(df: DataFrame) -> None:
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841  DuckDB finds it by name
    expected = duckdb.sql(ORACLES["op2_quality"]).df()
    got = quality.measures(df).toPandas()[list(expected.columns)]
    assert sorted(map(repr, got.astype(object).where(got.notna(), None).values.tolist())) == sorted(map(repr, expected.astype(object).where(expected.notna(), None).values.tolist()))


def test_measures_are_those_of_sql(docs):
    same_as_sql(docs)


def test_measures_of_windows_lines_and_symbols(spark):
    run = "a b c d e f g h"
    same_as_sql(frame(spark, f"{run} x {run}", f"{run} {run} {run}", run, "a a a a a a a a a a", "x\n x\nx\n\n\nx", "#*$%&|<> é", "A" * 200 + " b" * 30, "Ü" * 50, "no! no! no!", None, "", "a" * 400 + " b"))


def test_order_never_changes_a_verdict(docs):
    texts = [r.text.encode() for r in docs.limit(60).collect()] + [None, b""]
    forward = [quality.passes(quality.Text(t), quality.RULES) for t in texts]
    assert forward == [quality.passes(quality.Text(t), quality.RULES[::-1]) for t in texts]
    assert forward == [not any([r.rejects(quality.Text(t)) for r in quality.RULES]) for t in texts]  # noqa: C419  all rules, no short circuit


def test_order_is_by_rejection_per_cost():
    rules = [quality.Rule(n, lambda t: False, needs) for n, needs in (("a", ("x",)), ("b", ("y",)), ("c", ("z",)))]
    sample = [quality.Sampled({"x": 1.0, "y": 0.1, "z": 10.0}, (k < 50, 40 <= k < 60, k < 90)) for k in range(100)]
    assert [r.name for r in quality.ordered(sample, rules)] == ["b", "a", "c"]


def test_shared_measures_cost_once_and_rejected_texts_count_once():
    rules = [quality.Rule(n, lambda t: False, needs) for n, needs in (("a", ("x",)), ("b", ("x", "y")), ("c", ("z",)))]
    # b costs little once a has asked for x, so it comes before c, though c rejects more for its cost than b from nothing
    sample = [quality.Sampled({"x": 1.0, "y": 0.01, "z": 0.5}, (k < 60, 50 <= k < 70, k >= 85)) for k in range(100)]
    assert [r.name for r in quality.ordered(sample, rules)] == ["a", "b", "c"]
    # what a rejects is no merit of d
    rules, sample = [quality.Rule(n, lambda t: False, (n,)) for n in "ade"], [quality.Sampled({"a": 1.0, "d": 1.0, "e": 1.0}, (k < 60, k < 55, k >= 95)) for k in range(100)]
    assert [r.name for r in quality.ordered(sample, rules)] == ["a", "e", "d"]


def test_rules_need_what_they_say():
    """A rule computes no measure that it doesn't list."""
    for rule in quality.RULES:
        t = quality.Text(b"some words and, well, !!! more\n" * 20)
        rule.rejects(t)
        assert set(vars(t)) - {"text"} <= set(rule.needs), rule.name


def test_the_sample_is_of_all_rows(spark):
    """Sorted input: the first partitions alone would never show what rejects."""
    good = " ".join(f"word{i}" for i in range(60))
    docs = spark.range(4000).repartitionByRange(8, "id").selectExpr("id AS doc_id", f"CASE WHEN id < 3000 THEN '{good}' ELSE repeat('# ', 50) END AS text")
    sample = quality.fit(docs)
    assert sample[0].name in ("symbols", "stutter", "repeated_windows", "word_length") and sample[-1].name != "symbols"


def test_texts_without_spaces(spark):
    thai, chinese, short = "\u0e01\u0e32\u0e23\u0e17\u0e14\u0e2a\u0e2d\u0e1a" * 8, "".join(chr(0x4E00 + 37 * i) for i in range(90)), chr(0x4E00) * 3
    assert [r.doc_id for r in quality.keep_good(frame(spark, chinese, short)).collect()] == [0]
    assert quality.Spaced(thai.encode()).n_words == len(thai) and quality.Spaced("naïve – a".encode()).n_words == 3


def test_a_cascade_stops_at_the_first_rejection():
    asked = []
    rules = [quality.Rule("yes", lambda t: True, ()), quality.Rule("later", lambda t: asked.append(1) or False, ())]
    assert not quality.passes(quality.Text(b"x"), rules) and not asked


def test_keep_good_is_kept(docs):
    kept = {r.doc_id for r in quality.measures(docs).where("kept").collect()}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept


def test_labelled_documents(spark, docs):
    """Good ones stay unless the base fails, and bad ones go."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality.measures(docs).join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality and not r.base_failed)
    assert sum(r.kept for r in rows if not r.quality) == 0
