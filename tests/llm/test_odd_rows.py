"""Every operator and stage on odd rows, on no rows, and on nothing but nulls."""

import pytest

import corpus_pipeline
from colsql.llm import langid, lm, nearcopies, packing, pieces, pii, quality, sharding, simhash, spotsigs, tokencount

from .conftest import TEXTS

PER_ROW = {
    "simhash": simhash.near_duplicates,
    "quality": quality.measures,
    "pieces": pieces.encode,
    "lm": lm.held_out_scores,
    "spotsigs": spotsigs.edited_and_next,
    "langid": lambda d: langid.predict(d.select("doc_id", "text"), langid.fit(d)),
    "tokencount": tokencount.token_counts,
    "sharding": lambda d: sharding.shard(d, 4),
    "pii": pii.find,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_result_for_every_row(odd, name):
    got = PER_ROW[name](odd).select("doc_id").collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in TEXTS), key=str)


@pytest.mark.parametrize("name", [*PER_ROW, "pack", "near_copies", "matches", "class_of"])
def test_no_rows(empty, name):
    f = PER_ROW | {"pack": packing.pack, "near_copies": nearcopies.near_copies, "matches": spotsigs.matches, "class_of": spotsigs.class_of}
    assert f[name](empty).count() == 0


@pytest.mark.parametrize("name", PER_ROW)
def test_only_nulls(spark, name):
    rows = spark.createDataFrame([(None, None, None, None)] * 3, "doc_id long, text string, lang string, source string")
    assert PER_ROW[name](rows).count() == 3


def test_near_copies_has_a_row_for_every_id(odd):
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(odd).collect()}
    assert got == {i: 1 if i == 2 else i for i, _ in TEXTS}


def test_packing_has_every_document(odd):
    got = packing.pack(odd).groupBy("doc_id").count().count()
    assert got == len({i for i, _ in TEXTS})


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_the_columns(spark, odd, empty, stage):
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, odd, "")
    assert [(c, t) for c, t in out.dtypes] == odd.dtypes
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert set(ids) <= {i for i, _ in TEXTS}
    assert f(spark, empty, "").count() == 0


def test_the_last_stage(spark, odd, empty):
    f = corpus_pipeline.STAGES[4][1]
    assert f(spark, odd, "").count() >= len(TEXTS)
    assert f(spark, empty, "").count() == 0
